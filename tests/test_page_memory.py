"""Page facts hold few Python objects at a time."""

from __future__ import annotations

import gc

from pyspark.sql import functions as F

from noticeloom.operators.discovery import keyword_hits
from noticeloom.sources import html


def test_a_read_page_leaves_no_tree_behind():
    """Elements know their parents; without the collector they must go all the same."""
    gc.collect()
    gc.disable()
    try:
        for kind in ("listing", "detail", "portal"):
            outer, inner = html._split(kind, None)
            row = html._read(kind, outer, inner, "<ul><li><a href='/x'>a</a><b>2024-01-02</b></ul>" * 20, "https://h/", None)
            assert row["problem"] is None and len(row["anchors"]) == 20
        assert not [one for one in gc.get_objects() if isinstance(one, html._Element)]
    finally:
        gc.enable()


def test_facts_are_arrow_data_slice_by_slice(spark):
    """Rows on both sides of a slice's end keep their order; nulls and unreadable pages stay in place."""
    count = 3 * html.SLICE + 1
    page = F.when(F.col("id") % 50 == 7, None).otherwise(F.format_string("<title>t%d</title><a href='/%d'>x</a>", "id", "id"))
    rows = spark.range(0, count, 1, 1).select("id", page.alias("html"), F.lit("https://h/").alias("url"))
    facts = rows.select("id", html.portal_facts("html", "url", ["page_title", "anchors.url"]).alias("f"))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    for row in facts.collect():
        empty = row["id"] % 50 == 7
        assert row["f"]["page_title"] == ("" if empty else f"t{row['id']}")
        assert [one["url"] for one in row["f"]["anchors"]] == ([] if empty else [f"https://h/{row['id']}"])


def test_hits_of_nulls_and_empty_words(spark):
    rows = spark.createDataFrame([("ab",), (None,), ("",)], "text string")
    found = lambda words: [row[0] for row in rows.select(keyword_hits("text", words)).collect()]
    assert found(["b", "", "a"]) == [["", "a", "b"], [], [""]]
    assert found([""]) == [[""], [], [""]]
    assert found(["b"]) == [["b"], [], []]
