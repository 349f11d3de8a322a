"""Windows of fixed length that occur more than once in a corpus: exact, without shuffling them all.

Every window is named by its anchor, the smallest hash of a short gram inside it. Equal windows
have equal anchors, so only windows whose anchor repeats need a closer look:

1. count anchors in Spark (map-side combined) and keep those that occur more than once;
2. join them back to the runs of windows they name, and the runs to their documents; texts are
   shuffled once, and only texts with a repeated anchor are kept;
3. a run whose whole content occurs earlier is a repeat; the first run of each content goes on
   when its anchor also stands in other contents.

What is left is decided by the caller. No group is gathered in one task: counting is an
aggregation, and the joins are plain equi-joins on staged tables, whose hot keys adaptive
execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from noticeloom.llm.common import Keyed, bytes_of, list_slices, longs, record_batch, signed, small
from noticeloom.llm.rolling import BYTE_CODES, Runs, anchored_runs, byte_chunks, digest64, word_chunks
from noticeloom.session import staged


@dataclass(frozen=True)
class Windows:
    """``length`` consecutive units (words or bytes), anchored by grams of ``gram`` units."""

    length: int
    gram: int
    words: bool

    def runs(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, Runs]]:
        """(document number, offset to add to window starts, runs) of a batch, chunk by chunk."""
        if self.words:
            for words in word_chunks(texts):
                runs = anchored_runs(words.code, words.document, self.length, self.gram)
                heads = np.searchsorted(words.document, runs.segment)
                yield runs.segment, -heads, runs
        else:
            for buffer, segments, owners, offsets in byte_chunks(texts, self.length - 1):
                runs = anchored_runs(BYTE_CODES[buffer], segments, self.length, self.gram)._replace(units=buffer)
                heads = np.searchsorted(segments, runs.segment)
                yield owners[runs.segment], offsets[runs.segment] - heads, runs


@dataclass
class Candidates:
    """``docs``: every row; ``_near`` marks texts in which an anchor repeats.

    ``texts``: (_key, _text) of those documents. ``runs``: their runs of windows.
    """

    docs: DataFrame
    texts: DataFrame
    runs: DataFrame


def _anchors(windows: Windows):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keys = longs(batch.column(0))
            for document, shift, runs in windows.runs(bytes_of(batch.column(1))):
                columns = keys[document], signed(runs.anchor), runs.first + shift
                yield record_batch(["_key", "anchor", "first"], columns)

    return emit


def _contents(windows: Windows):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "anchor", "content", "first", "last", "again"]
        for batch in small(batches):
            keys, texts = longs(batch.column(0)), bytes_of(batch.column(1))
            wanted = [np.zeros(0, np.int64) if part is None else part for part in list_slices(batch.column(2))]
            tags = np.concatenate([(number << 40) + part for number, part in enumerate(wanted)])
            found = []
            for document, shift, runs in windows.runs(texts):
                first = runs.first + shift
                some = np.flatnonzero(np.isin((document << 40) + first, tags))
                spans = zip(runs.first[some].tolist(), (runs.last[some] + windows.length).tolist(), strict=True)
                content = np.array([digest64(runs.units[a:b]) for a, b in spans], np.uint64)
                columns = document, signed(runs.anchor), first, runs.last + shift
                document, anchor, first, last = (column[some] for column in columns)
                found.append([document, anchor, signed(content), first, last])
            if not found:
                continue
            document, anchor, content, first, last = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((first, content, anchor, document))
            document, anchor, content = document[order], anchor[order], content[order]
            again = np.zeros(len(order), bool)
            again[1:] = (
                (document[1:] == document[:-1]) & (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
            )
            yield record_batch(names, (keys[document], anchor, content, first[order], last[order], again))

    return emit


def candidates(
    docs: Keyed, windows: Windows, across: bool, whole: dict[str, Column], keep_text: bool
) -> Candidates:
    """Documents and runs whose anchor repeats; ``across``: only in different documents.

    ``whole`` are columns to work out from ``_text`` while it is at hand; afterwards the text
    stays only where it is needed, or everywhere with ``keep_text``.
    """
    anchors = docs.texts().mapInArrow(_anchors(windows), "_key long, anchor long, first long")
    if across:
        counted = anchors.groupBy("anchor").agg(F.min("_key").alias("low"), F.max("_key").alias("high"))
        repeated = counted.filter("low < high")
    else:
        counted = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
        repeated = counted.filter("n > 1")
    repeated = staged(repeated.select("anchor"), "anchors")
    places = anchors.join(repeated, "anchor").groupBy("_key").agg(F.collect_list("first").alias("_places"))
    near = F.col("_places").isNotNull()
    text = F.col("_text") if keep_text else F.when(near, F.col("_text"))
    joined = docs.rows.join(places, "_key", "left").select(
        "_key", "_row", near.alias("_near"), "_places", text.alias("_text"),
        *[value.alias(name) for name, value in whole.items()],
    )
    rows = staged(joined, "affected")
    texts = docs.texts(rows.filter("_near"))
    schema = "_key long, anchor long, content long, first long, last long, again boolean"
    affected = rows.filter("_near").select("_key", "_text", "_places")
    if not docs.unique:
        affected = affected.dropDuplicates(["_key"])
    found = staged(affected.mapInArrow(_contents(windows), schema), "contents")
    lowest = found.groupBy("anchor", "content").agg(F.min("_key").alias("low"), F.count(F.lit(1)).alias("n"))
    lowest = staged(lowest.filter("n > 1").drop("n"), "lowest")
    earlier = F.coalesce(F.col("_key") > F.col("low"), F.lit(False))
    repeat = earlier if across else earlier | F.col("again")
    runs = found.join(lowest, ["anchor", "content"], "left").select(
        "_key", "anchor", "first", "last", repeat.alias("repeat")
    )
    return Candidates(rows, texts, staged(runs, "runs"))


def undecided(runs: DataFrame) -> DataFrame:
    """First runs of their content whose anchor stands in other contents as well."""
    firsts = runs.filter(~F.col("repeat"))
    several = staged(
        firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1"), "several"
    )
    return firsts.join(several, "anchor").select("_key", "anchor", "first", "last", "contents")
