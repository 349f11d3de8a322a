"""The state log: commits in every order, folds beside runs, buckets that are opened, repeats."""

from __future__ import annotations

import itertools
import random
import shutil

import pytest

from noticeloom import schemas
from noticeloom.sources import state as log


def _rows(spark, rows):
    return spark.createDataFrame(rows, schemas.STATE)


def _state(spark, path, **options):
    return sorted(map(tuple, log.read_state(spark, path, **options).collect()))


def _orders():
    """Two runs that are committed, and a fold that looks and is committed, in every order."""
    for order in set(itertools.permutations(["one", "two", "look", "fold"])):
        if order.index("look") < order.index("fold"):
            yield order


@pytest.fixture(scope="module")
def begun(spark, tmp_path_factory):
    """A state, and two runs that have written their records but not committed them."""
    path = str(tmp_path_factory.mktemp("state") / "state")
    log.append_state(_rows(spark, [("a", "0", "k"), ("b", "0", None)]), path, 0)
    runs = {"one": [("a", "1", "k"), ("c", "1", "k")], "two": [("a", "2", "k2"), ("d", "2", None)]}
    marked = {name: _rows(spark, rows).selectExpr("*", "1L as version", f"'{name}' as run") for name, rows in runs.items()}
    written = {name: log.write_entry(rows, path) for name, rows in marked.items()}
    assert _state(spark, path) == [("a", "0", "k"), ("b", "0", None)]
    return path, written


@pytest.mark.parametrize("order", sorted(_orders()))
def test_a_fold_loses_no_run(spark, tmp_path, begun, order):
    path = str(tmp_path / "state")
    shutil.copytree(begun[0], path)
    for step in order:
        if step == "look":
            plan = log.plan_fold(spark, path, 5)
        elif step == "fold":
            log.finish_fold(spark, path, plan)
        else:
            log.commit_entry(spark, path, *begun[1][step], "run", 1, step)
    assert _state(spark, path) == [("a", "2", "k2"), ("b", "0", None), ("c", "1", "k"), ("d", "2", None)]


def test_repeats_and_two_folds(spark, tmp_path):
    path = str(tmp_path / "state")
    plans = []
    for version in range(3):
        log.append_state(_rows(spark, [("a", str(version), "k"), (f"p{version}", "x", "")]), path, version, run="stream")
        plans.append(log.plan_fold(spark, path, version))
    before = _state(spark, path)
    log.append_state(_rows(spark, [("a", "2", "k"), ("p2", "x", "")]), path, 2, run="stream")
    assert _state(spark, path) == before
    for plan in (plans[1], plans[0], plans[2]):
        log.finish_fold(spark, path, plan)
        assert _state(spark, path) == before
    log.fold_state(spark, path, 9)
    assert _state(spark, path) == before and len(log.live_entries(spark, path)) == 1
    assert _state(spark, path, before=2) == [("a", "1", "k"), ("p0", "x", ""), ("p1", "x", "")]


def test_only_wanted_buckets_are_opened(spark, tmp_path, monkeypatch):
    """A batch that touches one bucket in a hundred reads about as many files; what it reads is the same."""
    monkeypatch.setattr(log, "BUCKET_ROWS", 20)
    path, source = str(tmp_path / "state"), random.Random(1)
    rows = [(f"p{at}", str(at), f"k{source.randrange(1500)}") for at in range(3000)]
    log.append_state(_rows(spark, rows), path, 0)
    log.fold_state(spark, path, 0)
    wanted = _rows(spark, [("p5", "", "k7"), ("nobody", "", ""), ("p6", "", None)])
    keys = {row[0] for row in rows if row[2] == "k7"} | {"p5", "p6"}
    assert _state(spark, path, wanted=wanted) == sorted(row for row in rows if row[0] in keys)
    entries = log.live_entries(spark, path)
    every = log._entries(spark, path, "records", log.LOG, entries)
    some = log._wanted_records(spark, path, entries, wanted)
    opened = {row[0] for row in every.join(some.select("policy_id"), "policy_id", "left_semi").selectExpr("bucket").distinct().collect()}
    assert every.select("bucket").distinct().count() > 100 and len(opened) <= len(keys) + 2
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [exists(" in plan.replace("isnotnull(bucket), ", "")


def test_stream_equals_batches_over_many_rounds(spark, tmp_path):
    """A long run of small rounds, folded now and then, against a plain dictionary."""
    path, source, plain = str(tmp_path / "state"), random.Random(3), {}
    for version in range(12):
        rows = {f"p{source.randrange(30)}": (str(source.randrange(4)), f"k{source.randrange(9)}") for _ in range(6)}
        log.append_state(_rows(spark, [(key, *value) for key, value in rows.items()]), path, version, run="stream")
        plain |= rows
        if version % 4 == 3:
            log.fold_state(spark, path, version)
        wanted = _rows(spark, [(f"p{source.randrange(30)}", "", f"k{source.randrange(9)}")])
        one = wanted.first()
        found = {row[0]: row[1:] for row in _state(spark, path, wanted=wanted)}
        needed = {key: value for key, value in plain.items() if key == one["policy_id"] or value[1] == one["dedupe_key"]}
        assert needed.items() <= found.items() <= plain.items()
    assert {row[0]: row[1:] for row in _state(spark, path)} == plain
