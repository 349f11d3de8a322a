"""Batch files as a stream: every new immutable file is read once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from noticeloom import rules, schemas
from noticeloom.session import fold_stream_logs_rarely
from noticeloom.sources.readers import checked_batches
from noticeloom.sources.writers import of_known_version


def stream_batches(
    spark: SparkSession,
    folder: str,
    pattern: str = rules.BATCH_FILE_GLOB,
    max_files_per_trigger: int = 100,
) -> DataFrame:
    """Documents of each new batch file; the checkpoint of the query remembers what was read."""
    fold_stream_logs_rarely(spark)
    files = (
        spark.readStream.schema(schemas.BATCH)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(folder)
        .withColumn("name", F.col("_metadata.file_name"))
    )
    return checked_batches(files).select(
        F.col("name").alias("batch_id"), F.posexplode("documents").alias("place", "document")
    ).select("batch_id", "place", "document.*")


def shares(pattern: str) -> list[str]:
    """Patterns that deal the files of ``pattern`` to ten streams, which may then run side by side.

    A micro-batch costs its planning, its logs and its commit however small it is, one after the other within a
    stream. Files go by the character before what ``pattern`` has behind its ``*``, and each fits exactly one
    share, so all streams together read every file once. The last takes what has no digit there, too: names decide
    how even the shares are, never what is read.
    """
    if pattern.count("*") != 1 or set(pattern) & set("\\[]{}"):
        raise ValueError(f"only a pattern of one * and plain characters or ? can be dealt out: {pattern}")
    start, end = pattern.split("*")
    return [*(f"{start}*{digit}{end}" for digit in range(9)), f"{{{start},{start}*[!0-8]}}{end}"]


def stream_written(
    spark: SparkSession,
    folder: str,
    output_path: str,
    checkpoint: str,
    schema: T.StructType = schemas.DOCUMENT,
    max_files_per_trigger: int = 100,
) -> DataStreamWriter:
    """Write the documents of each new complete batch folder, with their batch_id, exactly once.

    The stream is the batches' headers, which are written last, so a batch that a run left without one is
    never read; when the run is redone, its batch has a folder and a header of its own. A micro-batch reads
    the documents of its headers, at most ``max_files_per_trigger`` folders, and writes under its number.
    """
    fold_stream_logs_rarely(spark)
    headers = (
        spark.readStream.schema(T.StructType([T.StructField("schema_version", T.LongType())]))
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(f"{folder.rstrip('/')}/{rules.BATCH_FOLDER_GLOB}/header")
    )
    places = of_known_version(headers).select(
        F.regexp_replace(F.col("_metadata.file_path"), "/header/[^/]*$", "").alias("place")
    )
    versioned = T.StructType([*schema.fields, T.StructField("schema_version", T.LongType())])

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        whole = [f"{row['place']}/documents" for row in batch.distinct().collect()]
        if not whole:
            return
        read = session.read.schema(versioned).parquet(*whole)
        name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/documents/[^/]*$", 1)
        docs = of_known_version(read.select("*", name.alias("batch_id"))).drop("schema_version")
        docs.write.mode("overwrite").parquet(f"{output_path.rstrip('/')}/batch={number}")

    return places.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
