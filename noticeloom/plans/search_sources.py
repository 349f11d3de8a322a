"""Source discovery: fetched portal pages to registry candidates and a report."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from noticeloom.functions.urls import host, path, restricted_reason, robots_allows
from noticeloom.operators import discovery, extract, reports
from noticeloom.operators.latest import append_candidates
from noticeloom.session import staged


def scanned_pages(portals: DataFrame, fetches: DataFrame) -> DataFrame:
    """One row per portal: restriction, title, text and items.

    ``fetches``: portal_id, status_code, final_url, html, error, robots_txt, retry_after,
    snapshot_path, page_seq.
    """
    domains = portals.select("portal_id", F.array("gov_domain").alias("domains"))
    joined = fetches.join(domains, "portal_id")
    reason = restricted_reason("status_code", "html", host("final_url"), "domains")
    marked = joined.withColumn("restricted_reason", reason).withColumn(
        "restricted", F.when(F.col("error").isNull(), F.col("restricted_reason").isNotNull())
    )
    parsed = extract.parse_portal_pages(marked).withColumn(
        "error", F.coalesce("error", "parse_error")
    )
    target = F.when(path("final_url") == "", "/").otherwise(path("final_url"))
    allowed = robots_allows(F.coalesce("robots_txt", F.lit("")), target)
    return parsed.drop("parse_error").withColumn("robots_allowed", allowed)


def search_sources(
    portals: DataFrame,
    fetches: DataFrame,
    keywords: DataFrame,
    registry: DataFrame,
    today: date,
    tags: Sequence[str] | None = None,
    portal_ids: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Candidates, the extended registry, per-portal status and report totals."""
    chosen = portals.filter(discovery.selected("portal_id", portal_ids))
    pack = staged(discovery.chosen_keywords(keywords, tags), "keyword-pack")
    # Four outputs read the pages: parse them once.
    pages = staged(scanned_pages(chosen, fetches).drop("html"), "portal-pages")
    usable = pages.filter(F.col("error").isNull() & ~F.col("restricted"))
    # Candidates read the matches twice, the status once more; they are a few rows a portal.
    matches = staged(discovery.match_keywords(usable, pack), "portal-matches")
    narrow = usable.select(
        "portal_id",
        "page_title",
        "status_code",
        "restricted_reason",
        "robots_allowed",
        "retry_after",
        "snapshot_path",
        F.lit(today).alias("discovered_at"),
    )
    candidates = discovery.build_candidates(chosen, narrow, matches)
    status = reports.portal_status(chosen, pages, matches)
    return {
        "candidates": candidates,
        "registry": append_candidates(registry, candidates),
        "status": status,
        "errors": reports.discovery_errors(status),
        "report": _with_keywords(reports.discovery_report(status), pack),
    }


def _with_keywords(report: DataFrame, pack: DataFrame) -> DataFrame:
    """The one-row report with the sorted keywords of the run, put together by Spark."""
    words = pack.agg(F.array_sort(F.collect_list("text")).alias("keywords_used"))
    return report.withColumn("_one", F.lit(1)).join(words.withColumn("_one", F.lit(1)), "_one").drop("_one")
