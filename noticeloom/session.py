"""Session settings the operators rely on, and the checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark folds its logs of the files that a stream reads and writes every so many micro-batches (10 by itself), and
#: each fold writes the whole log again: of an old stream that outgrows the micro-batches themselves.
STREAM_LOGS = {
    "spark.sql.streaming.fileSource.log.compactInterval": "1000",
    "spark.sql.streaming.fileSink.log.compactInterval": "1000",
}

RECOMMENDED = {
    # Recording the call site of every expression makes building wide plans several times slower.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Raw pages are large: bound an Arrow batch by bytes as well as by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    **STREAM_LOGS,
}


# More shuffle tasks than this cost the scheduler more than smaller tasks save.
MAX_PARTITIONS = 100_000


def settings_for(data_bytes: int, task_bytes: int = 200 * 1024**2) -> dict[str, str]:
    """Shuffle settings for a job over ``data_bytes``: tasks that fit memory, joined when small."""
    partitions = min(MAX_PARTITIONS, max(200, -(-data_bytes // task_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(task_bytes),
        "spark.sql.files.maxPartitionBytes": str(task_bytes),
    }


def build_session(app: str = "noticeloom", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the recommended settings; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fold_stream_logs_rarely(spark: SparkSession) -> None:
    """Set ``STREAM_LOGS`` where the session has no setting of its own; streams started later go by them."""
    for key, value in STREAM_LOGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, as ``spark.checkpoint.dir`` names it.

    Only a session in one process may go without: driver and executors are the same then, and a
    temporary folder of their machine serves, as in tests.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="noticeloom-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors can reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a costly result once and read it back; later passes prune and filter the files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
