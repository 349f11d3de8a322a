"""Stored order: any page equals a slice of a full sort, and only its ranges are opened."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noticeloom.operators import ordering


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    source = random.Random(1)
    rows = [(source.choice(["9", "10", "n/a", None, "7.5"]), source.choice(["2024-01-02", "", None, "2023-12-31"]), at) for at in range(2000)]
    frame = spark.createDataFrame(rows, "score string, published string, seq long").repartition(7)
    path = str(tmp_path_factory.mktemp("order") / "stored")
    order = ordering.export_keys("score", "published", "seq")
    ordering.write_ordered(frame, order, path, rows_per_range=150)
    return path, [row["seq"] for row in frame.orderBy(*order).collect()]


@pytest.mark.parametrize(("number", "size"), [(1, 50), (3, 50), (40, 50), (41, 50), (0, 7), (10**9, 7), (2, 700), (1, 5000)])
def test_pages_equal_slices_of_a_full_sort(spark, stored, number, size):
    path, expected = stored
    pages = max(1, -(-len(expected) // size))
    assert ordering.page_count(spark, path, size) == pages
    first = (min(max(number, 1), pages) - 1) * size
    found = ordering.read_page(spark, path, number, size, position="position").collect()
    assert [row["seq"] for row in found] == expected[first : first + size]
    assert [row["position"] for row in found] == list(range(first + 1, first + len(found) + 1))


def test_other_ranges_are_not_opened(spark, stored):
    """The scan's folders are chosen by the range, of which a page of 30 rows names one or two."""
    plan = ordering.read_page(spark, stored[0], 20, 30)._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan, re.S)[1]
    assert 1 <= len(set(re.findall(r"_range#\d+ = (\d+)", filters))) <= 2
    assert len(list(Path(stored[0], "rows").glob("_range=*"))) >= 10


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "seq long")
    ordering.write_ordered(empty, [F.col("seq").asc()], str(tmp_path / "none"))
    assert ordering.page_count(spark, str(tmp_path / "none"), 10) == 1
    assert ordering.read_page(spark, str(tmp_path / "none"), 5, 10).count() == 0


def test_small_ranges_stay_few_and_pages_whole(spark, tmp_path, monkeypatch):
    """Ranges of five rows asked for: folders do not grow with the table, pages are the same."""
    monkeypatch.setattr(ordering, "MANY_RANGES", 20, raising=False)
    path = str(tmp_path / "small")
    ordering.write_ordered(spark.range(3000).selectExpr("id AS seq"), [F.col("seq").desc()], path, rows_per_range=5)
    assert len(list(Path(path, "rows").glob("_range=*"))) <= 20
    found = ordering.read_page(spark, path, 30, 40, position="position").collect()
    assert [(row["seq"], row["position"]) for row in found] == [(2999 - at, at + 1) for at in range(1160, 1200)]
