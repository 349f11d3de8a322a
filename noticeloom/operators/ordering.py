"""Export order, pages and newest-first listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from noticeloom.functions.text import col
from noticeloom.session import ensure_checkpoint_dir

#: Ranges of a stored order may be wider than asked for where there would be more than so many, up to so many rows.
MANY_RANGES, WIDE_RANGE = 500, 100_000

def export_keys(score: Column | str, published: Column | str, seq: Column | str) -> list[Column]:
    """Score descending, date descending with unknown last, then input order."""
    points = F.coalesce(col(score).try_cast("double"), F.lit(0.0))
    return [points.desc(), col(published).try_cast("date").desc_nulls_last(), col(seq).asc()]


def export_order(
    rows: DataFrame, score: str = "商机评分", published: str = "发布日期", seq: str = "seq"
) -> DataFrame:
    """Whole table in export order: one range-partitioned sort."""
    return rows.orderBy(*export_keys(score, published, seq))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a table ordered for it alone; the number is clamped to the pages there are.

    For page after page of the same rows, ``write_ordered`` once and ``read_page``. The page is cut out of numbered rows, so rows before it are never gathered in one task.
    """
    numbered = with_global_position(rows, order)
    total = numbered.agg(F.max("position").alias("n")).first()["n"] or 0
    last = max(1, -(-total // size))
    first = (min(max(number, 1), last) - 1) * size
    inside = F.col("position").between(first + 1, first + size)
    return numbered.filter(inside).orderBy("position").drop("position")


def write_ordered(rows: DataFrame, order: list[Column], path: str, rows_per_range: int = 100_000) -> None:
    """Store rows in order, once, for any number of pages to be read from.

    One sort deals them into ranges of about ``rows_per_range`` rows, a folder each; a row carries its
    place in the range. Beside them lies an index of one row per range: its rows and the rows before it.
    A range costs a task and a folder, so a table that would fall into very many small ones gets wider ones:
    a page opens as few of them, and within them only the blocks of its places.
    """
    spark = rows.sparkSession
    count = rows.count()
    width = max(rows_per_range, min(WIDE_RANGE, -(-count // MANY_RANGES)))
    ranged = rows.repartitionByRange(max(1, -(-count // width)), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.select("*", F.spark_partition_id().alias("_range"), place.alias("_place"))
    writer = placed.write.mode("errorifexists")
    (writer.partitionBy("_range") if count else writer).parquet(f"{path}/rows")
    sizes = spark.read.parquet(f"{path}/rows").groupBy("_range").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.select("_range", "rows", before.alias("before")).write.mode("errorifexists").parquet(f"{path}/index")


def page_count(spark: SparkSession, path: str, size: int) -> int:
    """Pages of a stored order, at least one; reads the index only."""
    total = spark.read.parquet(f"{path}/index").agg(F.sum("rows").alias("n")).first()["n"] or 0
    return max(1, -(-total // size))


def read_page(spark: SparkSession, path: str, number: int, size: int, position: str | None = None) -> DataFrame:
    """One page of a stored order, from the one or few ranges that hold it; the number is clamped.

    The index names the ranges, so no other folder is listed or opened and nothing is sorted but the page.
    ``position`` adds the row's place in the whole order, from 1.
    """
    first = (min(max(number, 1), page_count(spark, path, size)) - 1) * size
    index = spark.read.parquet(f"{path}/index")
    # No more ranges than the page has rows, and one.
    hit = index.filter((F.col("before") < first + size) & (F.col("before") + F.col("rows") > first)).collect()
    inside, offset = F.lit(False), F.lit(0)
    for row in hit:
        here = F.col("_range") == row["_range"]
        low = first - row["before"]
        inside = inside | (here & F.col("_place").between(low, low + size - 1))
        offset = F.when(here, row["before"]).otherwise(offset)
    folders = [f"{path}/rows/_range={row['_range']}" for row in hit] or [f"{path}/rows"]
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*folders).filter(inside).orderBy("_range", "_place")
    added = rows if position is None else rows.withColumn(position, (offset + F.col("_place") + 1).cast("long"))
    return added.drop("_range", "_place")


def with_global_position(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Number all rows in order, starting at 1, without a window over the whole table.

    Rows are sorted into ranges and pinned by a checkpoint; each range then only needs the
    number of rows before it, which is one small row per range.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    sorted_rows = rows.orderBy(*order).select("*", F.monotonically_increasing_id().alias("_id"))
    pinned = sorted_rows.checkpoint(eager=True)
    spread = pinned.withColumn("_range", F.shiftright("_id", 33)).withColumn(
        "_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = spread.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    # One row per range: bounded by the number of shuffle partitions.
    return (
        spread.join(F.broadcast(offsets), "_range")
        .withColumn("position", F.col("_before") + F.col("_place") + 1)
        .drop("_range", "_id", "_place", "_before")
    )


def newest_first(
    files: DataFrame, modified: str = "modified_at", name: str = "name", position: str | None = None
) -> DataFrame:
    """Files by modification time, newest first; ``position`` adds the place in that order, from 1."""
    order = [F.col(modified).desc(), F.col(name).desc()]
    if position is None:
        return files.orderBy(*order)
    return with_global_position(files, order).withColumnRenamed("position", position).orderBy(position)


def last_n_runs(runs: DataFrame, started: str = "started_at", n: int = 12) -> DataFrame:
    """The latest runs, newest first."""
    return runs.orderBy(F.col(started).desc()).limit(n)
