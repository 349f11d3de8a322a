"""Sorted Arrow streams cut into runs of equal keys, and rows gathered into batches again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa


def run_edges(batch: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where another key than the row's before begins, 0 and the number of rows included."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in keys:
        values = batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy()
        new |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [batch.num_rows]])


def whole_runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs and their edges; rows come sorted by integer ``keys``.

    At any time one batch and one run are in memory, so runs must be of bounded length.
    """
    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        edges = run_edges(table, keys)
        joined = kept and all(kept[-1].column(name)[-1].as_py() == table.column(name)[0].as_py() for name in keys)
        if joined and len(edges) == 2:
            kept.append(table)
            continue
        if kept:
            head = table.slice(0, edges[1]) if joined else table.slice(0, 0)
            whole = pa.concat_tables([*kept, head]).combine_chunks()
            yield whole, run_edges(whole, keys)
            table, edges = (table.slice(edges[1]), edges[1:] - edges[1]) if joined else (table, edges)
        if len(edges) > 2:
            whole = table.slice(0, edges[-2]).combine_chunks()
            yield whole, edges[:-1]
        kept = [table.slice(edges[-2])]
    if kept:
        whole = pa.concat_tables(kept).combine_chunks()
        yield whole, run_edges(whole, keys)


class Rows:
    """Columns that grow row by row and leave as record batches."""

    def __init__(self, schema: pa.Schema, limit: int = 2000):
        self.schema, self.limit = schema, limit
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def full(self) -> bool:
        return len(self.columns[0]) >= self.limit

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(column, field.type) for column, field in zip(self.columns, self.schema, strict=True)]
        self.columns = [[] for _ in self.schema]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)
