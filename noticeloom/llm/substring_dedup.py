"""Substring dedup: repeated token windows by Rabin-Karp hashes, merged into removal intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticeloom.llm.common import bytes_of, keyed, list_slices, longs, merged, record_batch, sha256, signed, small
from noticeloom.llm.repeats import Candidates, Windows, candidates, undecided
from noticeloom.llm.rolling import window_hashes, word_chunks
from noticeloom.session import staged

WINDOW = 50
#: Words of an anchor gram: long enough that chance repeats are rare.
GRAM = 10

SPANS = "array<struct<start:long,end:long>>"


def _window_hashes(length: int):
    """Hashes of the windows that start in the given runs of a document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keys, texts = longs(batch.column(0)), bytes_of(batch.column(1))
            firsts, lasts = list(list_slices(batch.column(2))), list(list_slices(batch.column(3)))
            for words in word_chunks(texts):
                hashes = window_hashes(words.code, length, 5)
                numbers, heads = np.unique(words.document, return_index=True)
                for number, head in zip(numbers.tolist(), heads.tolist(), strict=True):
                    starts = np.concatenate(
                        [np.arange(a, b + 1) for a, b in zip(firsts[number], lasts[number], strict=True)]
                    )
                    columns = np.full(len(starts), keys[number]), signed(hashes[head + starts]), starts
                    yield record_batch(["_key", "window", "start"], columns)

    return emit


def _spans(found: Candidates, length: int) -> DataFrame:
    """(_key, start, end): words covered by windows that a smaller key also has; not yet merged."""
    copies = found.runs.filter("repeat")
    whole = copies.select("_key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    places = undecided(found.runs).groupBy("_key").agg(
        F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")
    )
    hashed = (
        found.texts.join(places, "_key")
        .select("_key", "_text", "firsts", "lasts")
        .mapInArrow(_window_hashes(length), "_key long, window long, start long")
    )
    windows = staged(hashed, "windows")
    counted = windows.groupBy("window").agg(F.min("_key").alias("low"), F.max("_key").alias("high"))
    counted = staged(counted.filter("low < high").select("window", "low"), "counted")
    single = windows.join(counted, "window").filter("_key > low")
    end = (F.col("start") + length).alias("end")
    return whole.unionByName(single.select("_key", "start", end))


def _cut(spell: bool):
    """Per document with spans: n_words, n_removed, kept_sha256, spans and, if wanted, the new text."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            starts, ends = list_slices(batch.column(2)), list_slices(batch.column(3))
            counts, removals, hashes, spans, texts = [], [], [], [], []
            for text, start, end in zip(bytes_of(batch.column(1)), starts, ends, strict=True):
                words = (text or b"").split()
                first, last = merged(start, end)
                kept, at, removed = [], 0, 0
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    kept += words[at:a]
                    removed += b - a
                    at = b
                left = b" ".join(kept + words[at:])
                counts.append(len(words))
                removals.append(removed)
                hashes.append(sha256(left))
                spans.append([{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                texts.append(left.decode() if spell else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(removals, pa.int64()),
                    pa.array(hashes, pa.string()),
                    pa.array(spans, pa.list_(span)),
                    pa.array(texts, pa.string()),
                ],
                names=["_row", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"],
            )

    return emit


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = WINDOW,
    gram: int = GRAM,
    spell: bool = True,
    carry: list[str] | None = None,
) -> DataFrame:
    """Per row: ``_row`` (the carried columns), n_words, n_removed, kept_sha256, spans, kept_text.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes when a window of ``length`` consecutive words
    covers it whose sequence also starts in a document with a smaller id; windows are judged on
    the input. ``spans`` are the maximal removed intervals of words, half-open. ``kept_text`` is
    the text itself where nothing is removed, else the kept words joined by one space; it is null
    when ``spell`` is off. A null or empty text has no words. Rows of equal id and text are one
    document; see ``keyed`` for null and repeated ids. An empty table gives an empty result.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    rows = keyed(docs, id_col, text_col, carry)
    words = F.array_remove(F.split(F.coalesce("_text", F.lit("")), "[ \\x09-\\x0D]+"), "")
    whole = {"n_words": F.size(words).cast("long"), "kept_sha256": F.sha2(F.array_join(words, " "), 256)}
    found = candidates(rows, Windows(length, gram, words=True), True, whole, spell)
    grouped = _spans(found, length).groupBy("_key").agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")
    )
    names = ["_row", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
    untouched = [
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast(SPANS).alias("spans"),
        (F.col("_text") if spell else F.lit(None).cast("string")).alias("kept_text"),
    ]
    joined = found.docs.filter("_near").join(grouped, "_key", "left")
    row_type = found.docs.schema["_row"].dataType.simpleString()
    schema = f"_row {row_type}, n_words long, n_removed long, kept_sha256 string, spans {SPANS}, kept_text string"
    cut = joined.filter(F.col("starts").isNotNull()).select("_row", "_text", "starts", "ends")
    same = found.docs.filter(~F.col("_near")).unionByName(
        joined.filter(F.col("starts").isNull()).drop("starts", "ends")
    )
    return same.select("*", *untouched).select(*names).unionByName(cut.mapInArrow(_cut(spell), schema))
