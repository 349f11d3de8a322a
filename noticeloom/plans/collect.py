"""Collection: stored pages to new documents, state recorded only once the batch is written."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticeloom import skew
from noticeloom.functions.dates import date_window
from noticeloom.functions.urls import allowed_host, fetch_restricted
from noticeloom.operators import dedupe, extract, incremental, reports
from noticeloom.session import staged
from noticeloom.sources import state as state_table
from noticeloom.sources import writers


_NARROW = (
    "seq",
    "policy_id",
    "detail_url",
    "content_hash",
    "supplementary_urls",
    "dedupe_key",
    "priority",
)


def changed_documents(
    documents: DataFrame, state: DataFrame, start: date, end: date, force: bool = False
) -> DataFrame:
    """Primary documents in the window that are new or changed, with links to their group.

    Grouping, links and the comparison with the state work on ids and hashes only; the text
    moves once, in the last join.
    """
    inside = documents.filter(date_window("publish_date", start, end))
    keyed = dedupe.with_dedupe_key(inside).select(*_NARROW)
    linked = dedupe.with_supplementary_urls(
        dedupe.dedupe(keyed), dedupe.supplementary_links(keyed)
    )
    changed = incremental.changed_only(linked, state, force, deduplicated=True)
    chosen = changed.select("seq", "dedupe_key", "group_size", "supplementary_urls")
    return documents.drop("supplementary_urls").join(chosen, "seq")


def reached_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages fetched before their source met a restriction, and one row per stopped source.

    Other answers than success, and a final address outside the allowed hosts, are marked in
    ``fetch_error``; they end nothing. Only the stopping number of each source meets the pages.
    """
    hit = fetch_restricted("status_code", "html")
    stops = staged(
        pages.filter(hit).groupBy("source_id").agg(F.min("seq").alias("stop_seq")), "stops"
    )
    joined = skew.join_facts(pages, stops, ["source_id"], ["seq"])
    before = F.col("stop_seq").isNull() | (F.col("seq") < F.col("stop_seq"))
    failed = F.when(
        ~F.col("status_code").between(200, 299),
        F.concat(F.lit("http_"), F.col("status_code").cast("string")),
    )
    return joined.filter(before).withColumn("fetch_error", failed).drop("stop_seq"), stops


def parsed_pages(
    pages: DataFrame, sources: DataFrame, attachments: DataFrame | None = None
) -> DataFrame:
    """Document rows with ``parse_error``: no adapter, a failed or foreign fetch, unreadable markup.

    ``attachments`` (policy_id, number, name, text, error) are merged into their documents.
    """
    configured = extract.with_source_columns(pages, sources)
    columns = configured.columns
    reached = F.col("final_url" if "final_url" in columns else "detail_url")
    foreign = F.when(
        ~F.coalesce(allowed_host(reached, F.col("allowed_domains")), F.lit(False)), "cross_domain"
    )
    fetch = F.col("fetch_error") if "fetch_error" in columns else F.lit(None).cast("string")
    problem = F.coalesce(F.col("profile_error"), fetch, foreign)
    marked = configured.withColumn("refused", problem)
    # A refused page is not parsed: its markup is emptied, its row stays and is counted.
    usable = marked.withColumn("html", F.when(F.col("refused").isNull(), F.col("html")))
    parsed = extract.parse_pages(usable, "content_selectors")
    whole = parsed.withColumn("parse_error", F.coalesce("refused", "parse_error")).drop(
        "allowed_domains", "listing_selectors", "content_selectors", "profile_error", "fetch_error", "refused"
    )
    return whole if attachments is None else extract.merge_attachments(whole, attachments)


def collect_batch(
    spark: SparkSession,
    pages: DataFrame,
    sources: DataFrame,
    folder: str,
    state_path: str,
    start: date,
    end: date,
    audit: DataFrame | None = None,
    development: bool = False,
    attachments: DataFrame | None = None,
) -> tuple[str, DataFrame]:
    """Parse, deduplicate and write the changed documents; returns the batch path and report.

    ``pages`` holds one fetched detail page per row with its candidate columns and ``seq``; with a
    ``status_code`` a source ends at its first restricted page. ``audit`` holds the evidence rows
    of the selected sources, ``attachments`` the extracted texts. The batch holds the tables
    documents, links, sources and audit. State is recorded after the batch is complete: a run that
    stops in between is redone, nothing is lost.
    """
    fetched, stops = reached_pages(pages) if "status_code" in pages.columns else (pages, None)
    # Parsing runs Python over every page: keep its result, since counts and rows both read it.
    read = staged(parsed_pages(fetched, sources, attachments), "parsed")
    failed = read.filter("parse_error IS NOT NULL")
    documents = read.filter("parse_error IS NULL").drop("parse_error")

    version = state_table.next_version(spark, state_path)
    known = state_table.read_state(spark, state_path)
    path = writers.batch_path(spark, folder, end)
    written = writers.write_documents(changed_documents(documents, known, start, end), path)

    inside = dedupe.with_dedupe_key(documents.filter(date_window("publish_date", start, end)))
    groups = dedupe.primary_per_group(inside)
    report = staged(collection_counts(pages, groups, written, failed, stops), "report")
    links = dedupe.supplementary_links(inside.select(*_NARROW))
    writers.write_header(
        spark,
        path,
        end,
        {"start_date": F.lit(start), "development_mode": F.lit(development)},
        row=report.select(F.struct("*").alias("report")),
        links=links.join(written.select("dedupe_key"), "dedupe_key", "left_semi"),
        sources=sources.select("source_id").distinct(),
        audit=reports.audit_rows(spark, audit),
    )
    state_table.append_state(written, state_path, version)
    return path, report


def collection_counts(
    pages: DataFrame,
    groups: DataFrame,
    written: DataFrame,
    failed: DataFrame,
    stops: DataFrame | None = None,
) -> DataFrame:
    """Collection report: members folded into a primary are duplicates, primaries that were not
    written are unchanged."""
    counts = groups.agg(
        F.coalesce(F.sum("group_size"), F.lit(0)).cast("long").alias("fetched"),
        F.count(F.lit(1)).alias("selected"),
    )

    def stage(name: str, n: Column) -> Column:
        return F.struct(F.lit(name).alias("stage"), n.alias("n"))

    folded = counts.select(
        F.inline(
            F.array(
                stage("duplicate", F.col("fetched") - F.col("selected")),
                stage("unchanged", F.col("selected")),
            )
        )
    )
    counted = {"discovered": pages, "changed": written, "parse_failure": failed}
    if stops is not None:
        counted["source_failure"] = stops
    kept = reports.stage_counts(**counted)
    settled = reports.stage_counts(unchanged=written).withColumn("n", -F.col("n"))
    stages = folded.unionByName(kept).unionByName(settled)
    return reports.collection_report(stages, amount="n")
