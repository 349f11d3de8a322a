"""Change detection on a stream of documents, with the same result as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from noticeloom.operators.incremental import changed_only
from noticeloom.sources.state import append_state, fold_state, read_state


def stream_changed(
    docs: DataFrame,
    state_path: str,
    output_path: str,
    checkpoint: str,
    row_id: str = "seq",
    fold_every: int = 50,
) -> DataStreamWriter:
    """Write the changed documents of each micro-batch and record them, exactly once.

    A micro-batch sees the versions before its own number. Output and state are written under
    that number, and of a repeat after a lost executor the last state counts. ``docs`` carries
    dedupe_key and a unique ``row_id``. A micro-batch opens only the buckets of the state that its own
    ids and keys fall into; every ``fold_every`` of them the log is folded, so what is read does not grow
    with the stream's age. Others may add to the state meanwhile.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The batch is read by the state filter and by the joins.
        batch.persist()
        try:
            state = read_state(spark, state_path, before=number, wanted=batch)
            changed = changed_only(batch, state, row_id=row_id)
            target = f"{output_path.rstrip('/')}/batch={number}"
            changed.write.mode("overwrite").parquet(target)
            # Read back what was written: the state records exactly the output.
            written = spark.read.schema(changed.schema).parquet(target)
            append_state(written, state_path, number, run="stream")
            if (number + 1) % fold_every == 0:
                fold_state(spark, state_path, number)
        finally:
            batch.unpersist()

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
