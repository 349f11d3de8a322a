"""Immutable writes: every run or batch gets a new folder and nothing is overwritten."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticeloom import rules
from noticeloom.operators.ordering import export_keys
from noticeloom.operators.rows import clean_links


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or a folder with files is there; asks Spark's own file source."""
    try:
        return not (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(path)
            .select("path")
            .isEmpty()
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def available_path(spark: SparkSession, base: str) -> str:
    """The path itself, or with the first free number appended."""
    path, number = base, 1
    while _exists(spark, path):
        path = f"{base}-{number}"
        number += 1
    return path


def write_snapshots(pages: DataFrame, root: str) -> int:
    """Store raw pages as files ``<root>/<YYYYMMDD>/<id>[-n].<ext>``; the number of files written.

    ``pages``: collected_on (date), snapshot_id, copy (0: no number), extension, content (bytes; null: an
    empty file). Tasks write their own rows through the file system that ``root`` names, under names that
    come from the row, so a repeated task writes the same file again; a partition is never gathered.
    """
    parts = pages.select(
        F.concat_ws(
            "/",
            F.date_format("collected_on", "yyyyMMdd"),
            F.concat(
                F.col("snapshot_id").cast("string"),
                F.when(F.col("copy") > 0, F.concat(F.lit("-"), F.col("copy").cast("string"))).otherwise(""),
                F.lit("."),
                "extension",
            ),
        ).alias("name"),
        F.coalesce("content", F.lit("").cast("binary")).alias("content"),
    )
    local = root.startswith(("/", "file:"))
    uri = "file://" + re.sub("^file:/+", "/", root) if local else root

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = FileSystem.from_uri(uri)
        count = 0
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                path = f"{top}/{name.as_py()}"
                files.create_dir(path.rpartition("/")[0], recursive=True)
                with files.open_output_stream(path) as out:
                    out.write(content.as_py())
                count += 1
        yield pa.RecordBatch.from_pydict({"n": [count]})

    return parts.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def batch_path(spark: SparkSession, folder: str, end: date) -> str:
    return available_path(spark, f"{folder.rstrip('/')}/policy-batch-{end.isoformat()}")


def write_documents(documents: DataFrame, path: str) -> DataFrame:
    """Write the documents of a new batch, each with the schema version, and return them."""
    marked = documents.withColumn("schema_version", F.lit(rules.SCHEMA_VERSION).cast("long"))
    marked.write.mode("errorifexists").parquet(f"{path}/documents")
    return documents.sparkSession.read.schema(documents.schema).parquet(f"{path}/documents")


def write_header(
    spark: SparkSession,
    path: str,
    end: date,
    header: dict[str, Column],
    row: DataFrame | None = None,
    **tables: DataFrame | None,
) -> None:
    """Write the tables beside the documents and the one-row header last.

    ``row`` is one row whose columns join the header, such as a report. A batch without header is
    not complete and is not read.
    """
    for name, table in tables.items():
        if table is not None:
            table.write.mode("errorifexists").parquet(f"{path}/{name}")
    (spark.range(1).drop("id") if row is None else row).select(
        "*",
        F.lit(rules.SCHEMA_VERSION).alias("schema_version"),
        F.current_timestamp().alias("created_at"),
        F.lit(end).alias("end_date"),
        *[value.alias(name) for name, value in header.items()],
    ).coalesce(1).write.mode("errorifexists").json(f"{path}/header")


def write_batch(documents: DataFrame, header: dict[str, Column], folder: str, end: date) -> str:
    """Write a batch once: its documents as Parquet beside a one-row JSON header."""
    spark = documents.sparkSession
    path = batch_path(spark, folder, end)
    write_documents(documents, path)
    write_header(spark, path, end, header)
    return path


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a written batch; an incomplete one or one of another version is an error."""
    if not _exists(spark, f"{path}/header"):
        raise ValueError(f"incomplete batch: {path}")
    return of_known_version(spark.read.parquet(f"{path}/documents")).drop("schema_version")


def of_known_version(rows: DataFrame) -> DataFrame:
    """The rows, after each one's schema version was checked.

    The check is a filter, so no choice of columns can prune it.
    """
    known = F.coalesce(F.col("schema_version") == rules.SCHEMA_VERSION, F.lit(False))
    failed = F.raise_error(F.lit("unsupported policy batch schema")).cast("boolean")
    return rows.filter(F.when(known, F.lit(True)).otherwise(failed))


def write_export(rows: DataFrame, folder: str, run_date: date, seq: str = "seq") -> str:
    """Write both sheets in export order, 36 columns each, into a new folder.

    One range-partitioned sort orders the files inside each sheet.
    """
    path = available_path(
        rows.sparkSession, f"{folder.rstrip('/')}/policy-opportunities-{run_date.isoformat()}"
    )
    ordered = clean_links(rows).orderBy(
        "sheet_name", *export_keys("商机评分", "发布日期", seq)
    )
    ordered.select("sheet_name", *rules.EXPORT_HEADERS).write.mode("errorifexists").partitionBy(
        "sheet_name"
    ).parquet(path)
    return path


def write_report(report: DataFrame, folder: str, run_date: date) -> str:
    """Write the one-row report as a JSON object into a new folder."""
    path = available_path(
        report.sparkSession,
        f"{folder.rstrip('/')}/policy-opportunities-{run_date.isoformat()}-report",
    )
    report.limit(1).coalesce(1).write.mode("errorifexists").json(path)
    return path


def write_discovery(found: dict[str, DataFrame], folder: str, job_id: str) -> str:
    """Write totals, per-portal status and candidates of a discovery run into a new folder."""
    report = found["report"]
    path = available_path(report.sparkSession, f"{folder.rstrip('/')}/{job_id}-report")
    found["candidates"].write.mode("errorifexists").parquet(f"{path}/candidates")
    found["status"].write.mode("errorifexists").json(f"{path}/portals")
    report.coalesce(1).write.mode("errorifexists").json(f"{path}/totals")
    return path
