"""Document rows with a sound key, and helpers for Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticeloom.operators.ordering import with_global_position


class Keyed(NamedTuple):
    """``rows``: (_key, _text, _row), one per input row. ``unique``: no key stands in two rows."""

    rows: DataFrame
    unique: bool

    def texts(self, rows: DataFrame | None = None) -> DataFrame:
        """(_key, _text), one row per document."""
        texts = (self.rows if rows is None else rows).select("_key", "_text")
        return texts if self.unique else texts.dropDuplicates(["_key"])


def keyed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None
) -> Keyed:
    """Rows under a sound key; ``_row`` holds the columns to carry along.

    By default that is every column but the text, so that own column names never clash with theirs.
    ``_key`` is the id where ids are whole numbers, unique and not null. Otherwise rows of equal id
    and text are one document; different texts under one id are different documents, and a null id
    comes before all others. Documents are then numbered in the order of (id, text hash).
    """
    names = [name for name in docs.columns if name != text_col] if carry is None else carry
    row = F.struct(*[F.col(f"`{name}`") for name in names])
    rows = docs.select(F.col(f"`{id_col}`").alias("_key"), F.col(f"`{text_col}`").alias("_text"), row.alias("_row"))
    whole = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    counts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    if whole and counts.filter((F.col("n") > 1) | F.col("_key").isNull()).isEmpty():
        return Keyed(rows.withColumn("_key", F.col("_key").cast("long")), True)
    tagged = rows.select(
        F.col("_key").alias("_doc"),
        F.sha2(F.coalesce("_text", F.lit("")), 256).alias("_tag"),
        F.col("_text").isNull().alias("_none"),
        "_text",
        "_row",
    )
    named = tagged.select("_doc", "_tag", "_none").distinct()
    order = [F.col("_doc").asc_nulls_first(), F.col("_tag").asc(), F.col("_none").asc()]
    numbered = with_global_position(named, order).withColumnRenamed("position", "_key")
    same = (
        tagged["_doc"].eqNullSafe(numbered["_doc"])
        & (tagged["_tag"] == numbered["_tag"])
        & (tagged["_none"] == numbered["_none"])
    )
    return Keyed(tagged.join(numbered, same).select("_key", "_text", "_row"), False)


def small(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that only few of their texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(binary).to_pylist()


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def record_batch(names: list[str], columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=names)


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's signed longs."""
    return values.view(np.int64)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open intervals joined where they overlap or touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(start)) - 1
    return start[heads], end[tails]


def list_slices(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """Every list of longs in an Arrow column, null for a null list."""
    offsets = column.offsets.to_numpy()
    values = longs(column.values.slice(offsets[0], offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    valid = column.is_valid().to_pylist()
    for index, there in enumerate(valid):
        yield values[offsets[index] : offsets[index + 1]] if there else None
