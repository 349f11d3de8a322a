"""Forward fill and the classification table built with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from noticeloom.functions.text import is_blank, strip

#: Numbers in a block, and blocks that are summed up together.
BLOCK_ROWS = 1_000_000
BLOCKS = 1_000


def forward_fill(
    rows: DataFrame,
    key: str,
    seq: str,
    value: str,
    output: str,
    block_rows: int = BLOCK_ROWS,
    blocks: int = BLOCKS,
    inner: str | None = None,
) -> DataFrame:
    """Carry the last known value forward in each key, in order of ``seq``, then ``inner``.

    ``seq`` numbers the rows of a key. The order is cut into blocks of ``block_rows`` numbers and
    those into groups of ``blocks``: each block is filled on its own, the value carried into a
    block comes from one summary row per block of its group, and that into a group from one row
    per group. No window holds more than a block, however large the key is.
    """
    order = [seq] if inner is None else [seq, inner]
    staged = rows.withColumn("_block", F.floor(F.col(seq) / block_rows))
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    summary = staged.groupBy(key, "_block").agg(F.max_by(F.col(value), known).alias("_last"))
    grouped = summary.withColumn("_group", F.floor(F.col("_block") / blocks))
    near = _carried(grouped, [key, "_group"], "_block", "_near")
    whole = grouped.groupBy(key, "_group").agg(
        F.max_by(F.col("_last"), F.when(F.col("_last").isNotNull(), F.col("_block"))).alias("_last")
    )
    far = _carried(whole, [key], "_group", "_far")
    carried = near.join(far, [key, "_group"]).select(
        key, "_block", F.coalesce("_near", "_far").alias("_before")
    )
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    local = F.last(value, ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        staged.withColumn("_local", local)
        .join(carried, [key, "_block"], "left")
        .withColumn(output, F.coalesce("_local", "_before"))
        .drop("_block", "_local", "_before")
    )


def _carried(summary: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The last known value of the rows before, within the keys."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(
        *dict.fromkeys([*keys, order]), F.last("_last", ignorenulls=True).over(before).alias(name)
    )


def classification_pairs(rows: DataFrame, row_no: str = "row_no") -> DataFrame:
    """Code and name pairs from rows of merged cells, with their section letter.

    Columns: four code columns and ``name``, each possibly several lines. Names pair with all the
    codes of a row when the counts agree, else with the codes of each column by position. The
    section letter carries forward; rows before the first section are dropped.
    """
    code_columns = ("section", "division", "group", "class")

    def lines(name: str):
        parts = F.transform(F.split(F.coalesce(F.col(name), F.lit("")), r"\r\n|\r|\n"), strip)
        return F.filter(parts, lambda part: part != "")

    staged = rows.select(
        F.lit(0).alias("one"), row_no, lines("name").alias("names"),
        *[lines(name).alias(f"c_{name}") for name in code_columns],
    )
    flat = F.concat(*[F.col(f"c_{name}") for name in code_columns])
    indexes = F.flatten(
        F.array(
            *[
                F.transform(F.col(f"c_{name}"), lambda _, place: place)
                for name in code_columns
            ]
        )
    )
    aligned = F.size("names") == F.size(flat)
    exploded = staged.select(
        "one",
        row_no,
        "names",
        aligned.alias("aligned"),
        F.posexplode(F.arrays_zip(flat.alias("code"), indexes.alias("place"))).alias("n", "pair"),
    )
    pairs = exploded.select(
        "one",
        F.col(row_no).alias("row_no"),
        "n",
        F.col("pair.code").alias("raw_code"),
        F.get("names", F.when(F.col("aligned"), F.col("n")).otherwise(F.col("pair.place"))).alias(
            "name"
        ),
    )
    is_section = F.col("raw_code").rlike("^[A-Z]$")
    marked = pairs.withColumn("letter", F.when(is_section, F.col("raw_code")))
    filled = forward_fill(marked, "one", "row_no", "letter", "section_code", inner="n")
    code = F.when(is_section, F.col("raw_code")).otherwise(
        F.concat("section_code", "raw_code")
    )
    return filled.filter(~is_blank("section_code")).select(
        F.struct("row_no", "n").alias("seq"), code.alias("code"), "name", "section_code"
    )
