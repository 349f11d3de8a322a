"""Run, collection and discovery reports as map-side combined aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticeloom import rules, schemas
from noticeloom.functions.text import col

FAILURE_COUNTERS = ("source_failures", "parse_failures", "analysis_failures")


def _counted(stages: DataFrame, stage: str, amount: str | None, names: dict[str, tuple]) -> DataFrame:
    weight = F.lit(1) if amount is None else F.col(amount)
    totals = [
        F.coalesce(F.sum(F.when(F.col(stage).isin(list(members)), weight)), F.lit(0))
        .cast("long")
        .alias(name)
        for name, members in names.items()
    ]
    return stages.agg(*totals)


def run_report(stages: DataFrame, stage: str = "stage", amount: str | None = None) -> DataFrame:
    """One row of run counters from stage-tagged rows (or pre-counted ones)."""
    return _counted(
        stages,
        stage,
        amount,
        {
            "discovered": ("discovered",),
            "changed": ("changed",),
            "skipped": ("duplicate", "unchanged"),
            "source_failures": ("source_failure",),
            "parse_failures": ("parse_failure",),
            "analysis_failures": ("analysis_failure",),
            "priority_rows": ("priority_row",),
            "observation_rows": ("observation_row",),
        },
    )


def collection_report(
    stages: DataFrame, stage: str = "stage", amount: str | None = None
) -> DataFrame:
    """One row of collection counters."""
    return _counted(
        stages,
        stage,
        amount,
        {
            "discovered": ("discovered",),
            "collected": ("changed",),
            "skipped": ("duplicate", "unchanged"),
            "source_failures": ("source_failure",),
            "parse_failures": ("parse_failure",),
        },
    )


def audit_rows(spark: SparkSession, audit: DataFrame | None) -> DataFrame:
    """Evidence rows of the selected sources as a table of their own, of any length."""
    return spark.createDataFrame([], schemas.AUDIT) if audit is None else audit.select(*schemas.AUDIT.names)


def stage_counts(**tables: DataFrame) -> DataFrame:
    """(stage, n) with one pre-aggregated row per named table."""
    parts = [
        table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        for name, table in tables.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def row_stages(rows: DataFrame, sheet: str = "sheet_name") -> DataFrame:
    """Result rows counted by the sheet they go to."""
    stage = F.when(F.col(sheet) == rules.PRIORITY_SHEET, "priority_row").otherwise(
        "observation_row"
    )
    return rows.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def run_status(return_code: Column | str | None = None, counters=FAILURE_COUNTERS) -> Column:
    """running, failed, warning (any failure counter above zero) or success."""
    partial = F.lit(False)
    for name in counters:
        partial = partial | (F.coalesce(F.col(name), F.lit(0)) > 0)
    finished = F.when(partial, "warning").otherwise("success")
    if return_code is None:
        return finished
    code = col(return_code)
    return F.when(code.isNull(), "running").when(code != 0, "failed").otherwise(finished)


def portal_status(portals: DataFrame, pages: DataFrame, matches: DataFrame) -> DataFrame:
    """Per scanned portal: status, number of matched items and error reason."""
    found = matches.groupBy("portal_id").agg(F.count(F.lit(1)).alias("matched"))
    scanned = (
        portals.select("portal_id", "entry_url")
        .join(
            pages.select("portal_id", "restricted", "restricted_reason", "error"),
            "portal_id",
            "left",
        )
        .join(found, "portal_id", "left")
    )
    failed = F.col("error").isNotNull() | F.col("restricted").isNull()
    status = F.when(failed, "error").when(F.col("restricted"), "restricted").otherwise("ok")
    return scanned.select(
        "portal_id",
        F.col("entry_url").alias("url"),
        status.alias("status"),
        F.when(status == "ok", F.coalesce("matched", F.lit(0)))
        .otherwise(0)
        .cast("long")
        .alias("policies_found"),
        F.when(status == "error", "exception")
        .when(status == "restricted", F.col("restricted_reason"))
        .alias("reason"),
        F.when(status == "error", F.coalesce("error", F.lit(""))).otherwise("").alias("detail"),
    )


def discovery_report(status: DataFrame) -> DataFrame:
    """One row of discovery totals; the per-portal list is the status table itself."""
    found = F.col("policies_found")
    return status.agg(
        F.count(F.lit(1)).alias("portals_scanned"),
        F.coalesce(F.sum(found), F.lit(0)).cast("long").alias("policies_extracted"),
        F.count_if(found > 0).alias("candidates_found"),
        F.count_if(F.col("status") == "restricted").alias("restricted_stopped"),
    )


def discovery_errors(status: DataFrame) -> DataFrame:
    """Portals that failed or were restricted, with the reason."""
    return status.filter(F.col("reason").isNotNull()).select("portal_id", "reason", "detail")


def batch_summary(batches: DataFrame, documents: DataFrame) -> DataFrame:
    """Per batch: window, counters and document count, newest first."""
    counts = documents.groupBy("batch_id").agg(F.count(F.lit(1)).alias("document_count"))
    return (
        batches.join(counts, "batch_id", "left")
        .withColumn("document_count", F.coalesce("document_count", F.lit(0)))
        .orderBy(F.col("created_at").desc(), F.col("batch_id").desc())
    )


def dashboard_summary(sources: DataFrame, summary: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: sources, batches, documents of the latest batch, runs and the latest run's counters.

    Each input is reduced to one row on its own; the parts are stacked and folded.
    """
    parts = [
        sources.agg(F.count(F.lit(1)).alias("source_count")),
        summary.agg(
            F.count(F.lit(1)).alias("batch_count"),
            F.max_by("batch_id", F.struct("created_at", "batch_id")).alias("latest_batch"),
            F.max_by("document_count", F.struct("created_at", "batch_id")).alias(
                "latest_documents"
            ),
        ),
        reports.agg(
            F.count(F.lit(1)).alias("report_count"),
            F.max_by("report_id", F.struct("created_at", "report_id")).alias("latest_report"),
        ),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    folded = stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
    return folded.withColumn("latest_documents", F.coalesce("latest_documents", F.lit(0)))
