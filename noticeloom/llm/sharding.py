"""Sharding: groups that must stay together go, largest first, to the least loaded shard."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from noticeloom.llm.common import keyed
from noticeloom.operators.ordering import with_global_position
from noticeloom.session import staged

#: Rows of a shard that are numbered together, about.
SLICE_ROWS = 200_000


def text_size(text: Column, per_row: int = 16) -> Column:
    """Bytes of the text (none if null) and a fixed amount for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + per_row).cast("long")


def spread(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[list[tuple[int, int]]]:
    """Longest-processing-time rule for (size, number of groups of that size), largest size first.

    Per class, (shard, groups it gets) by shard. Groups go one by one to the least loaded shard, the
    smallest number among equals, through a heap. What a long row of equal groups comes to is worked
    out at once: it fills the shards up to a common level. An empty group counts as one byte.
    """
    heap = [(0, shard) for shard in range(shards)]
    for size, count in classes:
        step = max(size, 1)
        if count > 8 * shards:
            loads = np.zeros(shards, np.int64)
            for load, shard in heap:
                loads[shard] = load
            given = _filled(loads, step, count)
            heap = list(zip((loads + given * step).tolist(), range(shards), strict=True))
            heapq.heapify(heap)
            yield [(shard, number) for shard, number in enumerate(given.tolist()) if number]
            continue
        taken: Counter[int] = Counter()
        for _ in range(count):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + step, shard))
            taken[shard] += 1
        yield sorted(taken.items())


def _filled(loads: np.ndarray, step: int, count: int) -> np.ndarray:
    """Groups of ``step`` bytes that each shard gets when ``count`` go to the least loaded in turn."""

    def begun(level: int) -> np.ndarray:
        return np.maximum(0, (level - loads) // step + 1)

    # The highest load at which no more than all groups have been begun.
    low, high = int(loads.min()) - 1, int(loads.min()) + step * count
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if int(begun(middle).sum()) <= count else (low, middle - 1)
    given = begun(low)
    last = np.flatnonzero(loads + given * step == low + 1)[: count - int(given.sum())]
    given[last] += 1
    return given


def schedule(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """The rule for single units (unit, size): unit to shard, units of equal size in their order."""
    units: dict[int, list[int]] = {}
    for unit, size in sorted(sizes):
        units.setdefault(size, []).append(unit)
    order = sorted(units, reverse=True)
    placed = {}
    for size, taken in zip(order, spread([(size, len(units[size])) for size in order], shards), strict=True):
        places = chain.from_iterable([shard] * number for shard, number in taken)
        placed.update(zip(units[size], places, strict=True))
    return placed


def assign_shards(groups: DataFrame, shards: int) -> DataFrame:
    """(group, shard) for (group, bytes), a group being a long that stands once.

    The driver sees sizes with their number of groups, never groups: distinct sizes add up to no
    more than all bytes, so there are at most the square root of twice the bytes. Groups are
    numbered in the order of their size and take the shards of their class by rank.
    """
    spark: SparkSession = groups.sparkSession
    counted = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("bytes").desc()).toArrow()
    classes = list(zip(counted["bytes"].to_pylist(), counted["n"].to_pylist(), strict=True))
    first, plan = 1, []
    for (size, count), taken in zip(classes, spread(classes, shards), strict=True):
        upto = list(accumulate(number for _, number in taken))
        plan.append((size, first, upto, [shard for shard, _ in taken]))
        first += count
    kind = "bytes long, first long, upto array<long>, shards array<int>"
    table = spark.createDataFrame(plan, kind)
    numbered = with_global_position(groups.select("group", "bytes"), [F.col("bytes").desc(), F.col("group").asc()])
    rank = F.col("position") - F.col("first")
    before = F.size(F.filter("upto", lambda end: end <= rank))
    return numbered.join(table, "bytes").select("group", F.get("shards", before).alias("shard"))


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_row: int = 16,
    carry: list[str] | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """Per row: ``_row`` (the carried columns), ``_text``, size, text_crc32, law, shard, slot, grown_shard.

    Rows of equal text stay together (null and empty texts are two groups). Law ``bytes``: sizes of
    shards are near equal, as far as the largest group allows; so ``grown_shard`` is null. ``slot``
    numbers the rows of a shard from 0, without gaps, by slice of the shard and then by key; rows
    that nothing tells apart are numbered in any order. No rows give no rows. Without ``keep_text``,
    ``_text`` is left out.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = keyed(docs, id_col, text_col, carry).rows
    text = F.col("_text")
    group = F.xxhash64(F.sha2(text, 256), F.octet_length(text))
    # Written once: the tie between rows that nothing tells apart must not change between two readers.
    sized = staged(
        rows.select(
            "_key",
            "_row",
            *(["_text"] if keep_text else []),
            text_size(text, per_row).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            group.alias("group"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "sizes",
    )
    groups = staged(sized.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    placed = staged(assign_shards(groups, shards), "placed")
    slices = -(-sized.count() // (shards * SLICE_ROWS)) or 1
    part = F.pmod(F.xxhash64("_key", "tie"), F.lit(slices)).cast("int")
    sliced = sized.join(placed, "group").withColumn("slice", part)
    counted = sliced.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row for about SLICE_ROWS rows.
    offsets = counted.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("_key", "tie"))
    numbered = sliced.withColumn("place", place).join(offsets, ["shard", "slice"])
    return numbered.select(
        "_row",
        *(["_text"] if keep_text else []),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; large shards become several files, each of slots that follow another."""
    spread_out = sharded.repartition("shard", F.floor(F.col("slot") / SLICE_ROWS))
    spread_out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
