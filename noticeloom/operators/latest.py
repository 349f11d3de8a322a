"""Keyed updates: first, last, replace, append and uniqueness.

All of them are aggregations with a map-side partial step, so a key with very many rows sends
one row per task to its reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _one_per_key(df: DataFrame, keys: Sequence[str], chosen: Column, *extra: Column) -> DataFrame:
    picked = df.groupBy(*keys).agg(chosen.alias("_row"), *extra)
    rest = [name for name in df.columns if name not in keys]
    extras = [name for name in picked.columns if name not in (*keys, "_row")]
    return picked.select(*keys, *[F.col("_row")[name].alias(name) for name in rest], *extras)


def _payload(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.struct(*[name for name in df.columns if name not in keys])


def last_per_key(
    df: DataFrame, keys: Sequence[str], seq: str, position: str | None = None
) -> DataFrame:
    """A later record replaces an earlier one; ``position`` keeps the place of the first."""
    extra = [F.min(seq).alias(position)] if position else []
    return _one_per_key(df, keys, F.max_by(_payload(df, keys), F.col(seq)), *extra)


def first_per_key(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The first record of a key wins."""
    return _one_per_key(df, keys, F.min_by(_payload(df, keys), F.col(seq)))


def union_listings(*candidates: DataFrame, order: str = "position") -> DataFrame:
    """Candidates of several listings in turn: the last one per source and URL wins.

    Each input carries ``order``; the place of an input in the call comes first.
    """
    staged = [
        frame.withColumn("_seq", F.struct(F.lit(number).alias("listing"), F.col(order)))
        for number, frame in enumerate(candidates)
    ]
    whole = staged[0]
    for frame in staged[1:]:
        whole = whole.unionByName(frame)
    kept = last_per_key(whole, ["source_id", "detail_url"], "_seq", position="first_seen")
    return kept.drop("_seq", order)


def append_candidates(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry and new candidates together; duplicates stay, later ones are read as newer."""
    return registry.unionByName(new, allowMissingColumns=True)


def replace_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Remove the rows of the given ids and append the new ones."""
    kept = table.join(rows.select(key).distinct(), key, "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    )


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "key") -> DataFrame:
    """Return the table; fail when a key occurs twice."""
    require_none(duplicate_keys(df, keys), f"duplicate {what}", keys)
    return df


class ProblemsFound(ValueError):
    """Rows that break a rule: ``problems`` is the whole table of them, ``count`` its size."""

    def __init__(self, message: str, problems: DataFrame, count: int):
        super().__init__(message)
        self.problems, self.count = problems, count


def require_none(problems: DataFrame, what: str, names: Sequence[str]) -> None:
    """Fail with the number of problems, all of them attached, the first one named."""
    label = F.concat_ws(" ", *[F.col(name).cast("string") for name in names])
    found = problems.agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("first")).first()
    if found["n"]:
        raise ProblemsFound(f"{what}: {found['n']}, first {found['first']}", problems, found["n"])


def removed_ids(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Ids that an edit dropped; an edit may only add."""
    return before.select(key).distinct().join(after.select(key), key, "left_anti")


def ordered_distinct(values: Column | str) -> Column:
    """Distinct array items in first-seen order."""
    return F.array_distinct(F.col(values) if isinstance(values, str) else values)


def code_table(rows: DataFrame, seq: str) -> DataFrame:
    """Trimmed code and name pairs: blank codes dropped, last one per code, sorted by code."""
    from noticeloom.functions.text import is_blank, strip

    cleaned = rows.select(strip("code").alias("code"), strip("name").alias("name"), seq)
    last = last_per_key(cleaned.filter(~is_blank("code")), ["code"], seq)
    return last.select("code", "name").orderBy("code")
