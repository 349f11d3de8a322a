"""Hot keys, blocks, segments and global positions against plain operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F, Window

from noticeloom import skew
from noticeloom.operators import fill, listing, ordering


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted(map(repr, frame.select(*names).collect()))


@pytest.fixture
def skewed(spark):
    """Half of the rows share one key and some have none."""
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))
    )
    return spark.range(4000).select(F.col("id"), key.alias("k"), (F.col("id") % 13).alias("v"))


def test_facts_meet_narrow_rows(spark, skewed):
    facts = skewed.filter("k <> 'k3'").groupBy("k").agg(F.max("v").alias("m"))
    wide = skewed.withColumn("html", F.repeat(F.lit("x"), 50))
    joined = skew.join_facts(wide, facts, ["k"], ["id"])
    assert rows_of(joined.drop("html")) == rows_of(skewed.join(facts, "k", "left"))


def test_an_aggregate_never_stands_in_a_facts_join(spark, skewed):
    """Both inputs of the key's join are plain scans, so adaptive execution can split a hot key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = skewed.groupBy("k").agg(F.max("v").alias("m"))
        plan = skew.join_facts(skewed, facts, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Aggregate" not in plan and plan.count("SortMergeJoin") == 2


@pytest.mark.parametrize(("block", "blocks"), [(1, 3), (7, 2), (100, 1000), (10_000, 1)])
def test_forward_fill_equals_one_window(spark, skewed, block, blocks):
    marked = skewed.withColumn("x", F.when(F.col("id") % 31 == 0, F.col("id").cast("string")))
    window = Window.partitionBy("k").orderBy("id")
    plain = marked.withColumn("f", F.last("x", True).over(window))
    assert rows_of(fill.forward_fill(marked.filter("k IS NOT NULL"), "k", "id", "x", "f", block, blocks)) == rows_of(
        plain.filter("k IS NOT NULL")
    )


def test_stop_equals_running_flag(spark, skewed):
    log = skewed.withColumn("hit", (F.col("v") == 11) & (F.col("id") > 500))
    window = Window.partitionBy("k").orderBy("id")
    before = F.max("hit").over(window.rowsBetween(Window.unboundedPreceding, -1))
    plain = log.withColumn(
        "outcome",
        F.when(F.coalesce(before, F.lit(False)), "dropped").when(F.col("hit"), "restricted").otherwise("kept"),
    ).filter("k IS NOT NULL")
    got = listing.stop_on_restricted(log, "k", "id", "hit").filter("k IS NOT NULL")
    assert rows_of(got) == rows_of(plain)


def test_distinct_pages_equals_a_walk(spark):
    rows = [("a", n, f"u{n % 7 if n < 20 else n}", "x") for n in range(30)] + [
        ("b", n, f"u{n}", "x") for n in range(40)
    ]
    pages = spark.createDataFrame(rows, "listing_id string, seq int, url string, html string")
    expected = set()
    for name in "ab":
        seen = set()
        for listing_id, seq, url, markup in rows:
            if listing_id != name:
                continue
            if url + markup in seen:
                break
            seen.add(url + markup)
            expected.add((name, seq))
    got = listing.distinct_pages(pages)
    assert {(row["listing_id"], row["seq"]) for row in got.collect()} == expected


@pytest.mark.parametrize("rule", ["oldest_before", "none_current"])
def test_cutoff_equals_a_walk(spark, rule):
    from datetime import date, timedelta

    start = date(2026, 1, 10)
    rows = []
    for name in ("a", "b"):
        for page in range(1, 30):
            for n in range(3):
                day = start + timedelta(days=(17 * page * (n + 1) + len(name) * 5) % 40 - (page if name == "a" else 0))
                rows.append((name, page, page * 10 + n, None if (page + n) % 6 == 0 else day))
    entries = spark.createDataFrame(rows, "listing_id string, page_no int, entry_id int, published_at date")
    expected = set()
    for name in ("a", "b"):
        for page in range(1, 30):
            if rule == "oldest_before" and page > 20:
                break
            here = [row for row in rows if row[0] == name and row[1] == page]
            expected |= {(row[0], row[2]) for row in here}
            days = [row[3] for row in here if row[3] is not None]
            if rule == "oldest_before" and days and min(days) < start:
                break
            if rule == "none_current" and not any(day >= start for day in days):
                break
    cap = 20 if rule == "oldest_before" else None
    got = listing.pages_until_cutoff(entries, start, rule=rule, max_pages=cap)
    assert {(row["listing_id"], row["entry_id"]) for row in got.collect()} == expected


def test_top_per_group_limits_before_the_shuffle(spark, skewed):
    top = listing.top_per_group(skewed, ["k"], ["id"], 5)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_positions_and_deep_pages(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("n")).repartition(6)
    numbered = ordering.with_global_position(rows, [F.col("n").desc()])
    assert numbered.filter(F.col("position") + F.col("n") != 5000).count() == 0
    deep = ordering.page(rows, [F.col("n").asc()], 40, 30).collect()
    assert [row["n"] for row in deep] == list(range(1170, 1200))
    last = ordering.page(rows, [F.col("n").asc()], 10_000, 30).collect()
    assert [row["n"] for row in last] == list(range(4980, 5000))


def test_filters_reach_the_scan(spark):
    from datetime import date

    from noticeloom.functions.dates import date_window

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = (
        orders.filter(date_window("o_orderdate", date(1998, 1, 1), date(1998, 2, 1)))
        .select("o_orderkey")
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    assert "PushedFilters: [Or(IsNull(o_orderdate)" in plan
    assert "o_totalprice" not in plan


def test_change_detection_with_hot_ids_and_keys(spark):
    from noticeloom.operators.incremental import changed_only

    rows = spark.range(3000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("p"), "id")).alias("policy_id"),
        F.when(F.col("id") % 2 == 0, "key").when(F.col("id") % 5 > 0, F.concat(F.lit("k"), "id")).alias("dedupe_key"),
        F.when(F.col("id") % 7 == 0, "x").otherwise("h").alias("content_hash"),
    )
    state = spark.createDataFrame(
        [("same", "h", "other"), ("zz", "x", "key"), ("p1", "h", None)],
        "policy_id string, content_hash string, dedupe_key string",
    )
    salted = changed_only(rows, state)
    plain = changed_only(rows, state, deduplicated=True)
    assert rows_of(salted) == rows_of(plain)


def test_settings_follow_the_data():
    from noticeloom.session import settings_for

    assert settings_for(0)["spark.sql.shuffle.partitions"] == "200"
    assert int(settings_for(100 * 1024**4)["spark.sql.shuffle.partitions"]) == 100_000
