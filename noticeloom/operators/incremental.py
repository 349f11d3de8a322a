"""Incremental processing against the state of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noticeloom import skew


def with_known_hash(
    docs: DataFrame,
    state: DataFrame,
    row_id: str = "seq",
    deduplicated: bool = False,
) -> DataFrame:
    """Add the recorded hash: the match by policy_id, else the one by dedupe key.

    Two equi-joins in place of an OR join. Among several records of a key the smallest policy_id
    counts. Documents may share ids and keys in any number: only ids and keys with the unique
    ``row_id`` meet the state, unless the documents are deduplicated and no key can be hot.
    """
    by_id = state.select("policy_id", F.col("content_hash").alias("hash_by_id"))
    by_key = (
        state.filter(F.col("dedupe_key") != "")
        .groupBy("dedupe_key")
        .agg(F.min_by("content_hash", "policy_id").alias("hash_by_key"))
    )
    joined = docs
    for right, key in ((by_id, "policy_id"), (by_key, "dedupe_key")):
        if deduplicated:
            joined = joined.join(right, key, "left")
        else:
            joined = skew.join_facts(joined, right, [key], [row_id])
    return joined.withColumn("known_hash", F.coalesce("hash_by_id", "hash_by_key")).drop(
        "hash_by_id", "hash_by_key"
    )


def changed_only(
    docs: DataFrame,
    state: DataFrame,
    force: bool = False,
    row_id: str = "seq",
    deduplicated: bool = False,
) -> DataFrame:
    """Documents that are unseen or whose hash differs; ``force`` keeps them all."""
    if force:
        return docs
    marked = with_known_hash(docs, state, row_id, deduplicated)
    return marked.filter(~F.col("content_hash").eqNullSafe(F.col("known_hash"))).drop("known_hash")


def upsert_state(state: DataFrame, successes: DataFrame, seq: str | None = None) -> DataFrame:
    """Insert or update by policy_id; the last success of an id wins."""
    if seq is None:
        fresh = successes.groupBy("policy_id").agg(
            F.max(F.struct("content_hash", "dedupe_key")).alias("new")
        )
    else:
        fresh = successes.groupBy("policy_id").agg(
            F.max_by(F.struct("content_hash", "dedupe_key"), seq).alias("new")
        )
    merged = state.join(fresh, "policy_id", "full_outer")
    updated = F.col("new").isNotNull()
    return merged.select(
        "policy_id",
        F.when(updated, F.col("new.content_hash"))
        .otherwise(F.col("content_hash"))
        .alias("content_hash"),
        F.when(updated, F.col("new.dedupe_key")).otherwise(F.col("dedupe_key")).alias("dedupe_key"),
    )
