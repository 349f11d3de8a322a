"""Running report counters over a stream of stage-tagged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_run_counts(rows: DataFrame, stage: str = "stage") -> DataFrame:
    """Rows per stage so far; use update or complete mode. Counters combine before the shuffle."""
    return rows.groupBy(F.col(stage).alias("stage")).agg(F.count(F.lit(1)).alias("n"))
