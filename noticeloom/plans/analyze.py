"""Analysis: documents to scored rows, exports, run report and recorded state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeloom.functions.dates import date_window
from noticeloom.functions.text import normalize_text
from noticeloom.operators import analysis, reports, rows
from noticeloom.plans.collect import changed_documents
from noticeloom.sources import state as state_table
from noticeloom.sources import writers


def analyzed_documents(
    documents: DataFrame,
    raw: DataFrame,
    catalog: Mapping[str, str],
    tags: Sequence[str] | None,
) -> DataFrame:
    """Documents with their checked analysis, or an error type and text."""
    parsed = analysis.parse_analysis(raw)
    failed = parsed.select(
        *[name for name in ("policy_id", "seq") if name in raw.columns],
        "analysis",
        F.coalesce(
            "error_type", F.when(F.col("contract_errors").isNotNull(), "ValidationError")
        ).alias("error_type"),
        F.coalesce("error", "contract_errors").alias("error"),
    )
    joined = analysis.join_analysis(documents, failed)
    checked = analysis.valid_opportunities(
        F.col("analysis.opportunities"), normalize_text("normalized_text"), catalog, tags
    )
    return joined.withColumn(
        "analysis",
        F.when(
            F.col("analysis").isNotNull(), F.col("analysis").withField("opportunities", checked)
        ),
    ).withColumn("analyzed_at", F.current_timestamp())


def run(
    spark: SparkSession,
    documents: DataFrame,
    analyzer: analysis.Analyzer,
    catalog: Mapping[str, str],
    tags: Sequence[str],
    output: str,
    state_path: str,
    start: date,
    end: date,
    force: bool = False,
    audit: DataFrame | None = None,
) -> tuple[str, str]:
    """Analyse new and changed documents; returns the export and report paths.

    ``documents`` has the document columns and ``seq``. The analyzer's answers are written before
    anything reads them, so it is called once per document even if later work is repeated.
    """
    known = state_table.read_state(spark, state_path)
    version = state_table.next_version(spark, state_path)
    staging = writers.available_path(spark, f"{output.rstrip('/')}/_staging-{end.isoformat()}")
    changed_documents(documents, known, start, end, force).write.parquet(f"{staging}/changed")
    changed = spark.read.parquet(f"{staging}/changed")
    analysis.analyze_checked(changed, analyzer).write.parquet(f"{staging}/answers")
    answers = spark.read.parquet(f"{staging}/answers")

    analyzed = analyzed_documents(changed, answers, catalog, tags)
    rows.result_rows(analyzed, end).write.parquet(f"{staging}/rows")
    result = spark.read.parquet(f"{staging}/rows")
    export = writers.write_export(result, output, end)
    failed = analyzed.filter("error_type IS NOT NULL").select("seq")
    state_table.append_state(changed.join(failed, "seq", "left_anti"), state_path, version)
    stages = reports.stage_counts(
        discovered=documents, changed=changed, analysis_failure=failed
    ).unionByName(reports.row_stages(result))
    # Every document in the window is changed, folded into another or unchanged.
    inside = documents.filter(date_window("publish_date", start, end))
    skipped = (
        reports.stage_counts(unchanged=inside)
        .unionByName(
            reports.stage_counts(unchanged=changed).withColumn("n", -F.col("n"))
        )
    )
    report = reports.run_report(stages.unionByName(skipped), amount="n")
    written = writers.write_report(report, output, end)
    reports.audit_rows(spark, audit).write.mode("errorifexists").parquet(f"{written}-audit")
    return export, written
