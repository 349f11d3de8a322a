"""Mixing sources to target weights: exact quotas of blocks, split among output shards by a tree.

The words of a source are one stream, cut into blocks. A source's target says how many blocks are drawn:
every block once per whole pass, and the rest of one more pass; the last draw is trimmed so that the words
taken are the target. The quotas of all sources are split among the shards by a tree whose every fork draws
from the multivariate hypergeometric distribution, so each shard is an even sample and all quotas are used
up exactly. A shard's share of a source is a range of draws; a keyed permutation of the block numbers says
which block a draw takes, so the ranges are disjoint. ``place`` shuffles the draws of a shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from noticeloom.llm.common import keyed, longs
from noticeloom.operators.ordering import with_global_position
from noticeloom.session import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block at least; more where the table would have over MOST_BLOCKS, which the draws allow.
BLOCK_WORDS, MOST_BLOCKS = 1024, 1 << 29
#: A stream's documents are added up in bins of so many rows; draws meet shards in ranges of so many.
BIN_ROWS, DRAW_RANGE = 4096, 4096
#: Sources whose quotas are split together.
FAMILY = 1024


class Mix(NamedTuple):
    """``documents``: _row, _text, source_no, size, source_size, target, start. ``draws``: source_no, start,
    first_word, last_word, block, pass_no, draw, shard, place; start is the document's place in its source."""

    documents: DataFrame
    draws: DataFrame


def _mixed(values: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """A 64-bit finaliser of values and salt."""
    out = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(salt).astype(np.uint64)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def permuted(numbers: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``numbers`` in keyed permutations of 0..counts-1.

    Four Feistel rounds over the next even power of two, walked until the place is below the count.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(counts, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = numbers.astype(np.uint64), np.ones(len(numbers), bool)
    limit, keys = counts.astype(np.uint64), keys.astype(np.uint64)
    while open_.any():
        left, right = out[open_] >> half[open_], out[open_] & mask[open_]
        for turn in range(4):
            left, right = right, left ^ (_mixed(right, keys[open_] + np.uint64(turn)) & mask[open_])
        out[open_] = (left << half[open_]) | right
        open_[open_] = out[open_] >= limit[open_]
    return out.astype(np.int64)


def _pass_keys(source_no: np.ndarray, pass_no: np.ndarray, seed: int) -> np.ndarray:
    return _mixed(source_no * 64 + pass_no, seed)


def _level(sources: DataFrame, total: int, cap: float) -> float:
    """The words a weight of one is worth, so that targets, cut at ``cap`` times the size, share ``total``.

    Every turn cuts the sources that the level of the turn before puts above their cap; the level only
    rises, so it ends when no further source is cut.
    """
    level = -1.0
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * F.lit(cap)
        row = sources.agg(
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.sum(F.when(full, F.col("source_size") * F.lit(cap)).otherwise(0.0)).alias("cut"),
        ).first()
        if not row["open"]:
            return level
        following = (total - row["cut"]) / row["open"]
        if following <= level * (1 + 1e-12):
            return level
        level = following


def _plan_draws(size: np.ndarray, target: np.ndarray, number: np.ndarray, block: int, seed: int) -> dict:
    """Blocks, whole passes, draws and words trimmed off the last draw, by source."""
    blocks = -(-size // block)
    wanted = np.rint(target).astype(np.int64)
    passes = np.where(size > 0, wanted // np.maximum(size, 1), 0)
    rest = np.where(size > 0, wanted - passes * size, 0)
    some = np.maximum(blocks, 1)
    short_place = permuted(some - 1, some, _pass_keys(number, passes, seed))
    missing = some * block - size
    drawn = -(-rest // block)
    reached = drawn * block - np.where(short_place < drawn, missing, 0)
    drawn = drawn + (reached < rest)
    reached = drawn * block - np.where(short_place < drawn, missing, 0)
    return {"blocks": blocks, "passes": passes, "draws": passes * blocks + drawn, "trimmed": np.where(rest > 0, reached - rest, 0)}


def split_quotas(quotas: np.ndarray, sizes: np.ndarray, seed: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its quotas): quotas of all colours dealt to shards of given sizes, by a tree of even samples."""
    stack = [(0, len(sizes), quotas.astype(np.int64))]
    while stack:
        low, high, here = stack.pop()
        if high - low == 1:
            yield low, here
            continue
        middle = (low + high) // 2
        source = np.random.default_rng([*seed, low, high])
        left = source.multivariate_hypergeometric(here, int(sizes[low:middle].sum()), method="marginals")
        stack.append((middle, high, here - left))
        stack.append((low, middle, left))


def _shard_shares(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, shard, first, last): the draws of a source that a shard gets.

    Families of sources are split first, then each family's sources by what the shards took of it, which is
    the same distribution; no task sees more than the families' totals or one family.
    """
    family = F.floor(F.col("source_no") / FAMILY)
    totals = sources.groupBy(family.alias("family")).agg(F.sum("draws").alias("draws"))

    def split_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("family", pa.int64()), ("draws", pa.int64())]))
        order = np.argsort(longs(table.column("family").combine_chunks()))
        names, quotas = (longs(table.column(at).combine_chunks())[order] for at in (0, 1))
        whole = int(quotas.sum())
        sizes = np.diff([whole * at // shards for at in range(shards + 1)])
        for shard, share in split_quotas(quotas, sizes, [seed, 0]) if whole else ():
            there = share > 0
            columns = [names[there], np.full(there.sum(), shard, np.int32), share[there]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["family", "shard", "share"])

    shares = totals.coalesce(1).mapInArrow(split_families, "family long, shard int, share long")
    taken = shares.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("shard", "share"))).alias("shares"))
    members = sources.filter("draws > 0").groupBy(family.alias("family")).agg(
        F.sort_array(F.collect_list(F.struct("source_no", "draws"))).alias("members")
    )

    def split_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, members, shares in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                numbers = np.array([one["source_no"] for one in members], np.int64)
                quotas = np.array([one["draws"] for one in members], np.int64)
                sizes = np.zeros(shards, np.int64)
                sizes[[one["shard"] for one in shares]] = [one["share"] for one in shares]
                before = np.zeros(len(numbers), np.int64)
                for shard, share in split_quotas(quotas, sizes, [seed, 1, name]):
                    there = share > 0
                    first = before[there]
                    before += share
                    columns = [numbers[there], np.full(there.sum(), shard, np.int32), first, before[there] - 1]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["source_no", "shard", "first", "last"])

    both = members.join(taken, "family").select("family", "members", "shares")
    return both.mapInArrow(split_members, "source_no long, shard int, first long, last long")


def _blocks_drawn(documents: DataFrame, block: int, seed: int) -> DataFrame:
    """(source_no, start, first_word, last_word, block, pass_no, draw) for every block of a document drawn."""
    schema = "source_no long, start long, first_word long, last_word long, block long, pass_no int, draw long"
    names = ["source_no", "start", "first_word", "last_word", "block", "pass_no", "draw"]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, start, size, length, blocks, passes, draws, trimmed = (longs(column) for column in batch.columns)
            first = start // block
            count = np.where(size > 0, (start + size - 1) // block - first + 1, 0)
            for low in _steps(count):
                span = count[low]
                row = np.repeat(low, span)
                number = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(span) - span, span)
                for turn in range(int(passes[low].max(initial=-1)) + 1):
                    here = (turn < passes[row]) | ((turn == passes[row]) & (draws[row] > passes[row] * blocks[row]))
                    rows, at = row[here], number[here]
                    key = _pass_keys(source[rows], np.full(len(rows), turn), seed)
                    draw = turn * blocks[rows] + permuted(at, blocks[rows], key)
                    end = np.minimum((at + 1) * block, length[rows]) - np.where(draw == draws[rows] - 1, trimmed[rows], 0)
                    head = np.maximum(at * block, start[rows])
                    tail = np.minimum(end, start[rows] + size[rows])
                    good = (draw < draws[rows]) & (head < tail)
                    rows, begin = rows[good], start[rows[good]]
                    columns = [
                        source[rows], begin, head[good] - begin, tail[good] - begin - 1, at[good],
                        np.full(good.sum(), turn, np.int32), draw[good],
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    needed = documents.select(
        "source_no", "start", "size", "source_size", "blocks", "passes", "draws", "trimmed"
    ).filter("size > 0 and draws > 0")
    return needed.mapInArrow(drawn, schema)


def _steps(counts: np.ndarray, limit: int = 100_000) -> Iterator[np.ndarray]:
    """Row numbers in parts of about ``limit`` blocks."""
    part = np.cumsum(counts) // limit
    edges = np.flatnonzero(np.diff(part)) + 1
    yield from np.split(np.arange(len(counts)), edges)


def mix_sources(
    docs: DataFrame,
    shards: int = 64,
    weights: Sequence[float] = (1, 2, 3),
    cap: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: list[str] | None = None,
    keep_text: bool = True,
    block_words: int = BLOCK_WORDS,
    seed: int = 7,
) -> Mix:
    """Mix all rows so that sources share the words of the whole table by weight.

    Sources in order, null last, take ``weights`` in turn. A target stops at ``cap`` times the words of its
    source; what it leaves goes to the others by weight. A null or empty text has no words and is never drawn;
    a source without words, like an empty table, has target 0. Every row counts, repeated ones too. Same rows
    and seed, same mix. Columns not named are only carried along.
    """
    if shards < 1 or cap < 1 or min(weights) <= 0:
        raise ValueError("shards and cap are at least 1, weights above 0")
    names = docs.columns if carry is None else list(dict.fromkeys([*carry, source_col]))
    names = [name for name in names if name != text_col]
    rows = keyed(docs, id_col, text_col, names).rows
    size = F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = rows.select("_key", "_row", *(["_text"] if keep_text else []), F.col(f"_row.`{source_col}`").alias("_source"), size.alias("size"))
    sized = staged(sized, "sizes")
    summed = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    placed = with_global_position(summed, [F.col("_source").asc_nulls_last()])
    turn = ((F.col("position") - 1) % len(weights) + 1).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(one)) for one in weights]), turn)
    ranked = staged(placed.select("_source", (F.col("position") - 1).alias("source_no"), "source_size", "n", weight.alias("weight")), "sources")
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("n").alias("n")).first()
    total, count = whole["words"] or 0, whole["n"] or 0
    block = max(block_words, -(-total * cap // MOST_BLOCKS))
    level = F.lit(_level(ranked, total, float(cap)) if total else 0.0)
    limit = (F.col("source_size") * cap).cast("double")
    sources = staged(_with_draws(ranked.withColumn("target", F.least(F.col("weight") * level, limit)), block, seed), "targets")
    documents = _streamed(sized, sources, max(1, count // BIN_ROWS), seed)
    documents = staged(documents.drop("_key"), "documents")
    drawn = _blocks_drawn(documents, block, seed).withColumn("reach", F.floor(F.col("draw") / DRAW_RANGE))
    reach = F.sequence(F.floor(F.col("first") / DRAW_RANGE), F.floor(F.col("last") / DRAW_RANGE))
    shares = staged(_shard_shares(sources.select("source_no", "draws"), shards, seed), "shares")
    shares = shares.withColumn("reach", F.explode(reach))
    met = drawn.join(shares, ["source_no", "reach"]).filter("draw between first and last")
    place = F.xxhash64(F.lit(seed), "source_no", "draw")
    draws = met.drop("reach", "first", "last").withColumn("place", place)
    return Mix(documents.drop("blocks", "passes", "draws", "trimmed"), draws)


def _with_draws(sources: DataFrame, block: int, seed: int) -> DataFrame:
    new = ["blocks", "passes", "draws", "trimmed"]

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = longs(batch.column("source_size")), longs(batch.column("source_no"))
            target = batch.column("target").to_numpy(zero_copy_only=False)
            found = _plan_draws(size, target, number, block, seed)
            columns = [*batch.columns, *(pa.array(found[name].astype(np.int64)) for name in new)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])

    rows = sources.select("_source", "source_no", "source_size", "target")
    kind = dict(rows.dtypes)["_source"]
    schema = f"_source {kind}, source_no long, source_size long, target double, " + ", ".join(f"{name} long" for name in new)
    return rows.mapInArrow(planned, schema)


def _streamed(sized: DataFrame, sources: DataFrame, bins: int, seed: int) -> DataFrame:
    """Rows with their source's figures and ``start``, the words of the source before them.

    Rows stand by bin, then key; only bins of a bounded number of rows and their sums are put in order.
    """
    named = sources.withColumnRenamed("_source", "_named")
    rows = sized.join(named, F.col("_source").eqNullSafe(F.col("_named"))).drop("_named", "_source")
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("_key", "_row", F.lit(seed)), F.lit(bins)))
    sums = rows.groupBy("source_no", "bin").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source_no").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source_no", "bin", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_no", "bin").orderBy("_key", F.xxhash64("_row"))
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = rows.withColumn("reached", F.sum("size").over(inside))
    joined = ordered.join(before, ["source_no", "bin"])
    return joined.withColumn("start", F.col("before") + F.col("reached") - F.col("size")).drop("bin", "reached", "before")


def taken_words(mix: Mix) -> DataFrame:
    """Documents with ``taken``, the words the mix takes of them, how often it draws from them, and shards."""
    length = F.col("last_word") - F.col("first_word") + 1
    sums = mix.draws.groupBy("source_no", "start").agg(
        F.sum(length).alias("taken"),
        F.count(F.lit(1)).alias("n_draws"),
        F.min("shard").alias("first_shard"),
        F.max("shard").alias("last_shard"),
    )
    sized = F.when(F.col("size") > 0, F.col("start"))
    rows = mix.documents.withColumn("_at", sized)
    sums = sums.withColumnRenamed("start", "_at")
    return rows.join(sums, ["source_no", "_at"], "left").drop("_at").na.fill(0, ["taken", "n_draws"])


def mixed_texts(mix: Mix) -> DataFrame:
    """(shard, place, source_no, draw, start, text): the pieces to write; a shard is sorted by place, draw, start."""
    texts = mix.documents.filter("size > 0").select("source_no", "start", "_text")
    words = F.regexp_extract_all("_text", F.lit(f"({WORD})"))
    count = (F.col("last_word") - F.col("first_word") + 1).cast("int")
    part: Column = F.slice(words, (F.col("first_word") + 1).cast("int"), count)
    joined = mix.draws.join(texts, ["source_no", "start"])
    return joined.select("shard", "place", "source_no", "draw", "start", F.array_join(part, " ").alias("text"))
