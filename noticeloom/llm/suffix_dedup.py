"""Suffix-array dedup: bytes of substrings that already occur earlier, by a Burrows-Wheeler order.

Blocks of contexts that may share a window (same anchor, see ``repeats``) are ordered by suffix;
``bwt.repeats`` finds equal windows by threshold-bounded interval expansion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticeloom.llm.bwt import repeats
from noticeloom.llm.common import bytes_of, keyed, list_slices, longs, merged, record_batch, sha256, small
from noticeloom.llm.repeats import Candidates, Windows, candidates, undecided
from noticeloom.llm.rolling import BYTE_CODES, gram_hashes, prefix_sums
from noticeloom.session import staged

LEAST = 100
GRAM = 32
#: Contexts of one anchor that a block may hold. Contexts of an anchor with more are cut and named by
#: more of their bytes, over and over, until every name has few enough; see ``_refined``.
BLOCK_CONTEXTS = 5_000
BLOCK_BYTES = 1 << 19

SPANS = "array<struct<start:long,end:long>>"


def _contexts(least: int):
    """Bytes of the given runs: all that their windows cover."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keys, texts = longs(batch.column(0)), bytes_of(batch.column(1))
            lists = [list(list_slices(batch.column(i))) for i in (2, 3, 4)]
            owner, anchors, starts, parts = [], [], [], []
            for number, text in enumerate(texts):
                anchor, first, last = (column[number] for column in lists)
                owner += [keys[number]] * len(first)
                anchors += anchor.tolist()
                starts += first.tolist()
                parts += [text[a : b + least] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            columns = [pa.array(owner, pa.int64()), pa.array(anchors, pa.int64()), pa.array(starts, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(parts, pa.binary())], names=["_key", "anchor", "first", "context"]
            )

    return emit


def _expand(least: int):
    """Spans of windows that stand earlier in a context of the same anchor; rows come sorted."""

    def block(keys: list[int], firsts: list[int], texts: list[bytes]) -> pa.RecordBatch:
        owner, start = repeats(texts, least)
        begin = np.array(firsts, np.int64)[owner] + start
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(owner)) - 1 if len(owner) else heads
        return record_batch(
            ["_key", "start", "end"], [np.array(keys, np.int64)[owner[heads]], begin[heads], begin[tails] + least]
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        firsts: list[int] = []
        texts: list[bytes] = []
        size, current = 0, None
        for batch in small(batches):
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for anchor, key, first, text in rows:
                if anchor != current and size >= BLOCK_BYTES:
                    yield block(keys, firsts, texts)
                    keys, firsts, texts, size = [], [], [], 0
                current = anchor
                keys.append(key)
                firsts.append(first)
                texts.append(text)
                size += len(text)
        if texts:
            yield block(keys, firsts, texts)

    return emit


def _anchor_place(context: bytes, gram: int) -> int:
    """Where the anchor of a context stands in it: its least gram, the rightmost of equals."""
    hashes = gram_hashes(prefix_sums(BYTE_CODES[np.frombuffer(context, np.uint8)]), gram, 2)
    return len(hashes) - 1 - int(hashes[::-1].argmin())


def _digest(data: bytes, salt: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little", signed=True)


HALVES = "_key long, anchor long, content long, first long, end long, place long, low long, high long, context binary"


def _halves(least: int, gram: int):
    """Contexts cut in two by how far the anchor stands behind a window's start, from ``low`` to ``high``.

    The windows of a half share all bytes from its last window's start to its first window's end, as far
    as ``low`` and ``high`` allow; these name it. Equal windows hold the anchor at the same place, so they
    lie in halves of the same name.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in HALVES.split(", ")]
        for batch in small(batches):
            found = []
            for key, first, place, low, high, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                place = first + _anchor_place(text, gram) if place is None else place
                last, middle = first + len(text) - least, (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    start, stop = max(first, place - b), min(last, place - a)
                    if a > b or start > stop:
                        continue
                    part = text[start - first : stop - first + least]
                    shared = text[place - a - first : place - b + least - first]
                    found.append((key, _digest(shared, b), _digest(part), start, stop + least, place, a, b, part))
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            types = [pa.int64()] * (len(names) - 1) + [pa.binary()]
            arrays = [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return emit


def _refined(contexts: DataFrame, least: int, gram: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts of crowded anchors under names that blocks can hold, and spans of whole repeats.

    A level halves the range of places the anchor may have in a window, so the bytes that name a half
    grow from ``gram`` to ``least`` in as many levels as that range has bits. Of halves with equal bytes
    the first goes on and the others are repeats; at the last level a half is one window and its name all
    of it, so one is left of every name. No name is gathered in a task before it is small enough.
    """
    names = ["_key", "first", "place", "low", "high", "context"]
    ready, spans = [], []
    wide = contexts.select(
        "_key", "anchor", "first", F.lit(None).cast("long").alias("place"), F.lit(0).cast("long").alias("low"),
        F.lit(least - gram).cast("long").alias("high"), "context",
    )
    for _ in range((least - gram).bit_length()):
        halves = staged(wide.select(*names).mapInArrow(_halves(least, gram), HALVES), "halves")
        lowest = halves.groupBy("anchor", "content").agg(
            F.min(F.struct("_key", "first")).alias("lowest"), F.count(F.lit(1)).alias("n")
        )
        lowest = staged(lowest.filter("n > 1").select("anchor", "content", "lowest"), "lowest")
        repeat = F.coalesce(F.struct("_key", "first") > F.col("lowest"), F.lit(False))
        judged = staged(
            halves.join(lowest, ["anchor", "content"], "left").withColumn("repeat", repeat).drop("content", "lowest"),
            "judged",
        )
        spans.append(judged.filter("repeat").select("_key", F.col("first").alias("start"), "end"))
        firsts = judged.filter("not repeat").drop("repeat", "end")
        sizes = staged(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
        crowded = sizes.filter(F.col("n") > BLOCK_CONTEXTS)
        ready.append(firsts.join(sizes.filter(F.col("n") <= BLOCK_CONTEXTS), "anchor"))
        wide = firsts.join(crowded, "anchor")
        if crowded.isEmpty():
            return ready, spans
    return [*ready, wide], spans


def _spans(found: Candidates, least: int, gram: int) -> DataFrame:
    """(_key, start, end): bytes covered by windows that start earlier; not yet merged."""
    end = (F.col("last") + least).alias("end")
    whole = found.runs.filter("repeat").select("_key", F.col("first").alias("start"), end)
    places = undecided(found.runs).groupBy("_key").agg(
        *[F.collect_list(name).alias(f"{name}s") for name in ("anchor", "first", "last")]
    )
    contexts = found.texts.join(places, "_key").select("_key", "_text", "anchors", "firsts", "lasts")
    cut = contexts.mapInArrow(_contexts(least), "_key long, anchor long, first long, context binary")
    cut = staged(cut, "contexts")
    crowded = staged(
        cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_CONTEXTS), "crowded"
    )
    names = ["_key", "anchor", "first", "context"]
    blocks, spans = cut.join(crowded, "anchor", "left_anti").select(*names), whole
    if not crowded.isEmpty():
        ready, repeated = _refined(cut.join(crowded, "anchor", "left_semi"), least, gram)
        for part in ready:
            blocks = blocks.unionByName(part.select(*names))
        for part in repeated:
            spans = spans.unionByName(part)
    ordered = blocks.repartition("anchor").sortWithinPartitions("anchor", "_key", "first")
    near = ordered.select("anchor", "_key", "first", "context").mapInArrow(_expand(least), "_key long, start long, end long")
    return spans.unionByName(near)


def _cut(spell: bool):
    """Per document with spans: n_bytes, n_removed, kept_sha256, spans and, if wanted, what is left."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            starts, ends = list_slices(batch.column(2)), list_slices(batch.column(3))
            sizes, removals, hashes, spans, lefts = [], [], [], [], []
            for text, start, end in zip(bytes_of(batch.column(1)), starts, ends, strict=True):
                first, last = merged(start, end)
                pairs = list(zip(first.tolist(), last.tolist(), strict=True))
                kept, at = [], 0
                for a, b in pairs:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]])
                sizes.append(len(text))
                removals.append(len(text) - len(left))
                hashes.append(sha256(left))
                spans.append([{"start": a, "end": b} for a, b in pairs])
                lefts.append(left if spell else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(removals, pa.int64()),
                    pa.array(hashes, pa.string()),
                    pa.array(spans, pa.list_(span)),
                    pa.array(lefts, pa.binary()),
                ],
                names=["_row", "n_bytes", "n_removed", "kept_sha256", "spans", "kept"],
            )

    return emit


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    gram: int = GRAM,
    spell: bool = True,
    carry: list[str] | None = None,
) -> DataFrame:
    """Per row: ``_row`` (the carried columns), n_bytes, n_removed, kept_sha256, spans, kept.

    Texts are UTF-8 bytes; a null text is empty. A byte goes when a string of ``least`` bytes
    covers it that also starts earlier: in a document of smaller id or further left in the same
    one. Overlaps count, strings are judged on the input, and none crosses documents. ``spans``
    are the maximal removed runs, half-open; ``kept`` is what is left, as bytes, since a cut may
    fall inside a character (null when ``spell`` is off). Rows of equal id and text are one
    document; see ``keyed`` for null and repeated ids. An empty table gives an empty result.
    """
    if not 0 < gram <= least:
        raise ValueError("gram must be between 1 and least")
    rows = keyed(docs, id_col, text_col, carry)
    text = F.coalesce("_text", F.lit(""))
    whole = {"n_bytes": F.octet_length(text).cast("long"), "kept_sha256": F.sha2(text, 256)}
    found = candidates(rows, Windows(least, gram, words=False), False, whole, spell)
    # Cut and untouched documents both read the spans: without a table the blocks would be walked for each.
    grouped = staged(
        _spans(found, least, gram).groupBy("_key").agg(
            F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")
        ),
        "spans",
    )
    names = ["_row", "n_bytes", "n_removed", "kept_sha256", "spans", "kept"]
    untouched = [
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast(SPANS).alias("spans"),
        (F.coalesce("_text", F.lit("")).cast("binary") if spell else F.lit(None).cast("binary")).alias("kept"),
    ]
    joined = found.docs.filter("_near").join(grouped, "_key", "left")
    row_type = found.docs.schema["_row"].dataType.simpleString()
    schema = f"_row {row_type}, n_bytes long, n_removed long, kept_sha256 string, spans {SPANS}, kept binary"
    cut = joined.filter(F.col("starts").isNotNull()).select("_row", "_text", "starts", "ends")
    same = found.docs.filter(~F.col("_near")).unionByName(
        joined.filter(F.col("starts").isNull()).drop("starts", "ends")
    )
    return same.select("*", *untouched).select(*names).unionByName(cut.mapInArrow(_cut(spell), schema))
