"""Near-duplicate groups: fast similarity sketches, banding, and exact checks on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticeloom.llm.common import Keyed, bytes_of, keyed, longs, record_batch, signed, small
from noticeloom.llm.components import components
from noticeloom.llm.rolling import mix, word_chunks
from noticeloom.session import staged

#: Words of a shingle, and the similarity from which documents are linked, in percent.
SHINGLE = 5
PERCENT = 80
#: Two sets of similarity 0.8 share none of 32 bands of 4 coordinates once in twenty million pairs.
BANDS, ROWS = 32, 4

#: Shingles of one side of a block; columns of its matrices, and rows compared, at a time.
BLOCK_SHINGLES = 100_000
_COLUMNS, _ROWS = 1024, 512

_FILLED = np.uint64(2**64 - 1)


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, sorted distinct hashes of its shingles); texts without words are left out."""
    for words in word_chunks(texts, lower=True):
        numbers, heads = np.unique(words.document, return_index=True)
        tails = np.append(heads[1:], len(words.code))
        rolled = words.code.copy()
        for at in range(1, width):
            rolled[: len(rolled) - at] = mix(rolled[: len(rolled) - at], 11) ^ words.code[at:]
        rolled = mix(rolled, 12)
        for number, head, tail in zip(numbers.tolist(), heads.tolist(), tails.tolist(), strict=True):
            if tail - head >= width:
                yield number, np.unique(rolled[head : tail - width + 1])
            else:
                short = words.code[head].copy().reshape(1)
                for code in words.code[head + 1 : tail]:
                    short = mix(short, 13) ^ code
                yield number, mix(short, 14 + tail - head)


def fast_sketch(owner: np.ndarray, codes: np.ndarray, count: int, size: int) -> np.ndarray:
    """Fast similarity sketches of ``count`` sets; ``owner`` names the set of every element.

    In round i each element falls into one bin by the round's hash and offers (i, hash) there, the
    smallest stays. Rounds of the second half put all elements into bin i - size, so every
    coordinate is filled after 2 * size rounds at the latest; a set whose bins are full is done.
    """
    bits = np.uint64(64 - (size.bit_length() - 1))
    sketch = np.full(count * size, _FILLED, np.uint64)
    low = np.uint64((1 << 54) - 1)
    for turn in range(2 * size):
        hashes = mix(codes, 100 + turn)
        bins = (hashes >> bits).astype(np.int64) if turn < size else turn - size
        np.minimum.at(sketch, owner * size + bins, (np.uint64(turn) << np.uint64(54)) | (hashes & low))
        open_ = (sketch.reshape(count, size) == _FILLED).any(axis=1)[owner]
        if not open_.any():
            break
        owner, codes = owner[open_], codes[open_]
    return sketch.reshape(count, size)


def _sketches(width: int, bands: int, rows: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.arange(bands, dtype=np.uint64) + np.uint64(1)

        def out(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(one) for one in sets], np.int64)
            codes = np.concatenate(sets)
            heads = np.cumsum(sizes) - sizes
            marks = [np.add.reduceat(mix(codes, salt), heads) for salt in (15, 16)]
            sketch = fast_sketch(np.repeat(np.arange(len(sets)), sizes), codes, len(sets), bands * rows)
            buckets = np.tile(mix(salts, 17), (len(sets), 1))
            for row in range(rows):
                buckets = mix(buckets ^ sketch[:, row::rows][:, :bands], 18)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(signed(buckets.ravel()))
            )
            columns = [pa.array(keys, pa.int64()), pa.array(sizes), *(pa.array(signed(mark)) for mark in marks), lists]
            return pa.RecordBatch.from_arrays(columns, names=["_key", "n", "mark", "mark2", "buckets"])

        for batch in small(batches):
            ids = longs(batch.column(0))
            keys: list[int] = []
            sets: list[np.ndarray] = []
            size = 0
            for number, one in shingle_sets(bytes_of(batch.column(1)), width):
                keys.append(int(ids[number]))
                sets.append(one)
                size += len(one)
                if size > 200_000:
                    yield out(keys, sets)
                    keys, sets, size = [], [], 0
            if keys:
                yield out(keys, sets)

    return emit


def _confirm(width: int, percent: int):
    """Pairs whose full shingle sets are similar enough."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            left, right = longs(batch.column(0)), longs(batch.column(1))
            sets: list[list[np.ndarray]] = []
            for column in (2, 3):
                texts = bytes_of(batch.column(column))
                distinct = list(dict.fromkeys(texts))
                by_text = {distinct[number]: one for number, one in shingle_sets(distinct, width)}
                sets.append([by_text[text] for text in texts])
            linked = np.zeros(len(left), bool)
            for number, (one, other) in enumerate(zip(*sets, strict=True)):
                shared = len(np.intersect1d(one, other, assume_unique=True))
                linked[number] = 100 * shared >= percent * (len(one) + len(other) - shared)
            yield record_batch(["a", "b", "linked"], [left, right, linked])

    return emit


def _tested(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked) for pairs (a, b), a < b."""
    sides = [texts.select(F.col("_key").alias(end), F.col("_text").alias(f"text_{end}")) for end in "ab"]
    both = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "text_a", "text_b")
    return staged(both.mapInArrow(_confirm(width, percent), "a long, b long, linked boolean"), "tested")


def _block(width: int, percent: int):
    """Distinct pairs of components that hold linked documents, from one block of a group.

    Overlaps of all sets of the block come from products of 0/1 matrices, some shingles at a time.
    """

    def emit(block: pa.Table) -> pa.Table:
        texts = bytes_of(block.column("_text"))
        sets = [np.zeros(0, np.uint64)] * len(texts)
        for number, one in shingle_sets(texts, width):
            sets[number] = one
        sizes = np.array([len(one) for one in sets], np.int64)
        roots, stray = longs(block.column("root")), block.column("stray").to_numpy()
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = np.cumsum(counts > 1) - 1
        some = counts[codes] > 1
        owner, codes = owner[some], several[codes[some]]
        order = np.argsort(codes, kind="stable")
        owner, codes = owner[order], codes[order]
        cuts = np.searchsorted(codes, np.arange(0, (codes[-1] if len(codes) else 0) + _COLUMNS + 1, _COLUMNS))
        left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
        ends = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(left), _ROWS):
            some = left[at : at + _ROWS]
            shared = np.zeros((len(some), len(right)), np.float32)
            for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                matrix = np.zeros((len(sets), _COLUMNS), np.float32)
                matrix[owner[a:b], codes[a:b] - part * _COLUMNS] = 1
                shared += matrix[some] @ matrix[right].T
            whole = sizes[some][:, None] + sizes[right][None, :] - shared.astype(np.int64)
            linked = (100 * shared.astype(np.int64) >= percent * whole) & (shared > 0)
            one, other = np.nonzero(linked & (roots[some][:, None] != roots[right][None, :]))
            pairs = np.sort(np.stack([roots[some[one]], roots[right[other]]]), axis=0)
            ends.append(np.unique(pairs, axis=1))
        pairs = np.unique(np.concatenate(ends, axis=1), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return emit


def _links(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that connect every two members of a bucket that are similar enough.

    First every member is compared with the bucket's smallest one. Buckets whose members are then
    still in several components form groups; in each, the members outside the largest component
    are a query set, compared with all others of the group in blocks of bounded size. So a group of
    copies costs as many comparisons as it has members, and no link between components is lost.
    """
    first = members.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("c"))
    centers = staged(first.select("bucket", F.col("c.rep").alias("center"), F.col("c.n").alias("center_n")), "centers")
    fits = F.least("n", "center_n") * 100 >= F.greatest("n", "center_n") * percent
    joined = members.join(centers, "bucket").filter((F.col("rep") != F.col("center")) & fits)
    pairs = staged(joined.select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = staged(_tested(pairs, texts, width, percent).filter("linked").select("a", "b"), "first_links")
    roots = components(links).withColumnRenamed("node", "rep")
    named = members.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = staged(named.select("bucket", "rep", "n", "root"), "named")
    state = named.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")
    )
    # Two members are compared already.
    apart = staged(state.filter("low < high and size > 2").select("bucket"), "apart")
    if apart.isEmpty():
        return links
    rest = named.join(apart, "bucket").join(centers.select("bucket", "center"), "bucket")
    groups = components(rest.select(F.col("center").alias("a"), F.col("rep").alias("b")))
    placed = rest.select("rep", "n", "root").distinct().join(groups.select(F.col("node").alias("rep"), F.col("root").alias("group")), "rep")
    placed = staged(placed, "placed")
    parts = placed.groupBy("group", "root").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("shingles"))
    largest = parts.groupBy("group").agg(
        F.max(F.struct("count", "root"))["root"].alias("main"),
        F.sum("shingles").alias("shingles"),
        F.max(F.struct("count", "root", "shingles"))["shingles"].alias("main_shingles"),
    )
    chunks = lambda shingles: F.ceil(shingles / F.lit(BLOCK_SHINGLES)).cast("int")
    plan = staged(
        largest.select(
            "group",
            "main",
            chunks(F.col("shingles")).alias("columns"),
            F.greatest(chunks(F.col("shingles") - F.col("main_shingles")), F.lit(1)).alias("rows"),
        ),
        "plan",
    )
    marked = placed.join(plan, "group").join(texts.withColumnRenamed("_key", "rep"), "rep")
    marked = staged(marked, "marked")
    row = F.pmod(F.xxhash64("rep"), F.col("rows")).cast("int")
    column = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("columns")).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    stray = marked.filter("root <> main").select("group", row.alias("row"), every("columns").alias("column"), "root", "_text", F.lit(True).alias("stray"))
    other = marked.select("group", every("rows").alias("row"), column.alias("column"), "root", "_text", F.lit(False).alias("stray"))
    blocks = stray.unionByName(other).groupBy("group", "row", "column")
    found = staged(blocks.applyInArrow(_block(width, percent), "a long, b long"), "block_links")
    return links.unionByName(found)


def near_groups(
    docs: Keyed, width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(_key, n_shingles, component): the smallest key each document is connected with.

    A document's set holds its distinct shingles of ``width`` words, A-Z lowered; with fewer words
    the whole sequence is the one shingle. Documents are linked when their sets' similarity is at
    least ``percent`` / 100. Null, empty and wordless texts have no shingles and are alone. Equal
    sets are one class; classes are compared through the first document of each.
    """
    schema = "_key long, n long, mark long, mark2 long, buckets array<long>"
    texts = docs.texts()
    sketches = staged(texts.mapInArrow(_sketches(width, bands, rows), schema), "sketches")
    marks = ["mark", "mark2", "n"]
    classes = staged(sketches.groupBy(*marks).agg(F.min("_key").alias("rep")), "classes")
    firsts = sketches.select("_key", "n", "buckets").join(classes.select(F.col("rep").alias("_key")), "_key")
    exploded = firsts.select(F.explode("buckets").alias("bucket"), F.col("_key").alias("rep"), "n")
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = staged(shared.select("bucket"), "shared")
    members = staged(exploded.join(shared, "bucket"), "members")
    wanted = members.select(F.col("rep").alias("_key")).distinct()
    near = staged(texts.join(wanted, "_key"), "near")
    roots = components(_links(members, near, width, percent)).withColumnRenamed("node", "rep")
    grouped = sketches.select("_key", *marks).join(classes, marks).join(staged(roots, "roots"), "rep", "left")
    found = grouped.select("_key", "n", F.coalesce("root", "rep").alias("component"))
    everyone = texts.select("_key").join(found, "_key", "left")
    return everyone.select(
        "_key",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.coalesce("component", "_key").alias("component"),
    )


def minhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, **options: int
) -> DataFrame:
    """Per row: ``_row`` (the carried columns), n_shingles, component_id, kept.

    ``component_id`` is the id of the component's first document, ``kept`` marks that document.
    See ``near_groups`` for what links documents, and ``keyed`` for null and repeated ids.
    """
    rows = keyed(docs, id_col, text_col, list(dict.fromkeys([*(carry or docs.columns), id_col])))
    groups = near_groups(rows, **options)
    ids = rows.rows.select("_key", "_row")
    if rows.unique:
        named = groups.withColumn("component_id", F.col("component"))
    else:
        groups = staged(groups, "groups")
        names = ids.groupBy(F.col("_key").alias("component")).agg(F.min(F.col(f"_row.`{id_col}`")).alias("component_id"))
        named = groups.join(names, "component")
    found = ids.join(named, "_key")
    return found.select("_row", "n_shingles", "component_id", (F.col("_key") == F.col("component")).alias("kept"))
