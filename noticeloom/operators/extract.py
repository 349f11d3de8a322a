"""Records from page facts: candidates, documents, portal pages and merged attachments."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from noticeloom import rules
from noticeloom.functions import dates
from noticeloom.functions.identity import policy_id
from noticeloom.functions.text import (
    col,
    contains_any,
    content_hash,
    is_blank,
    normalize_text,
    title_filter,
)
from noticeloom.functions.urls import allowed_host, path
from noticeloom.operators.latest import last_per_key
from noticeloom.session import scratch
from noticeloom.sources.html import detail_facts, listing_facts, portal_facts

PARTS_PER_SEGMENT = 1000


def parser_profile(
    sources: DataFrame,
    profiles: Mapping[str, tuple] = rules.EXTRACTION_PROFILES,
    generic: tuple = rules.GENERIC_PROFILE,
) -> DataFrame:
    """Add listing and content selectors: dedicated by id, else the generic profile.

    A source with neither has NULL content selectors and a ``profile_error``.
    """

    def texts(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(value) for value in values]).cast("array<string>")

    is_generic = (F.col("origin") == "discovery") | (F.col("adapter_version") == "generic")
    listing = F.when(is_generic, texts(generic[0]))
    content = F.when(is_generic, texts(generic[1]))
    for source_id, (listing_selectors, content_selectors) in profiles.items():
        named = F.col("source_id") == source_id
        listing = F.when(named, texts(listing_selectors)).otherwise(listing)
        content = F.when(named, texts(content_selectors)).otherwise(content)
    return sources.select(
        "*",
        listing.alias("listing_selectors"),
        content.alias("content_selectors"),
        F.when(content.isNull(), F.concat(F.lit("no adapter: "), F.col("source_id"))).alias(
            "profile_error"
        ),
    )


def listing_date(snippets: Column) -> Column:
    """First valid date among the texts near a link."""
    found = F.filter(F.transform(snippets, dates.loose_date), lambda day: day.isNotNull())
    return F.get(found, F.lit(0))


def extract_candidates(
    pages: DataFrame,
    start: date,
    end: date,
    markers: Sequence[str] = rules.TITLE_MARKERS,
    source: str = "source_id",
    seq: str = "seq",
    selectors: str | None = None,
    domains: str = "allowed_domains",
) -> DataFrame:
    """Listing links that pass title, host and date rules; the last one per source and URL wins.

    ``pages``: source id, url, html, seq and allowed domains per listing page.
    """
    wanted = [f"anchors.{name}" for name in ("title", "label", "href", "url", "dates")]
    facts = pages.withColumn("facts", listing_facts("html", "url", selectors, wanted))
    anchors = facts.select(
        source, seq, domains, F.posexplode("facts.anchors").alias("place", "anchor")
    )
    title = F.coalesce("anchor.title", "anchor.label")
    kept = anchors.select(
        source,
        domains,
        F.struct(F.col(seq).alias("page"), "place").alias("position"),
        title.alias("title"),
        F.col("anchor.href").alias("href"),
        F.col("anchor.url").alias("detail_url"),
        listing_date(F.col("anchor.dates")).alias("published_at"),
    ).filter(
        (F.col("href") != "")
        & title_filter("title", markers)
        & allowed_host("detail_url", domains)
        & dates.date_window("published_at", start, end)
    )
    slim = kept.select(source, "detail_url", "title", "published_at", "position")
    return last_per_key(slim, [source, "detail_url"], "position", "first_position").drop("position")


def attachment_links(
    anchors: Column, domains: Column | Sequence[str], suffixes=rules.ATTACHMENT_SUFFIXES
) -> Column:
    """Allowed links to attachments in document order, duplicates kept."""

    def wanted(anchor: Column) -> Column:
        target = F.lower(path(anchor["url"]))
        ends = F.lit(False)
        for suffix in suffixes:
            ends = ends | target.endswith(suffix)
        return F.coalesce(allowed_host(anchor["url"], domains) & ends, F.lit(False))

    return F.transform(F.filter(anchors, wanted), lambda anchor: anchor["url"])


def parse_pages(pages: DataFrame, selectors: str | None = None) -> DataFrame:
    """Full document rows from detail pages joined with their candidate and source columns.

    ``pages``: html, source_id, source_name, region, title, detail_url, published_at,
    allowed_domains, collected_at, snapshot_path; other columns pass through. A page that cannot
    be read has ``parse_error`` set and no text.
    """
    chosen = F.array(F.lit("article"), F.lit("main")) if selectors is None else F.col(selectors)
    wanted = ["heading", "metadata_text", "content_text", "anchors.url"]
    facts = pages.withColumn("facts", detail_facts("html", "detail_url", chosen, wanted)).drop("html")
    meta = F.col("facts.metadata_text")
    read = (
        facts.withColumn("document_number", dates.document_number(meta))
        .withColumn("raw_text", normalize_text("facts.content_text"))
        .withColumn("candidate_title", F.col("title"))
    )
    parsed = read.select(
        *[name for name in pages.columns if name not in _REPLACED],
        policy_id(
            "source_id", "detail_url", "candidate_title", "published_at", "document_number"
        ).alias("policy_id"),
        F.coalesce("facts.heading", "candidate_title").alias("title"),
        dates.publisher(meta).alias("publisher"),
        "document_number",
        F.coalesce(
            dates.labelled_date(meta, rules.PUBLISH_DATE_LABELS), F.col("published_at")
        ).alias("publish_date"),
        dates.labelled_date(meta, rules.EFFECTIVE_DATE_LABELS).alias("effective_date"),
        dates.labelled_date(meta, rules.APPLICATION_START_LABELS).alias("application_start_date"),
        dates.labelled_date(meta, rules.APPLICATION_END_LABELS).alias("application_end_date"),
        "raw_text",
        F.col("raw_text").alias("normalized_text"),
        attachment_links(F.col("facts.anchors"), F.col("allowed_domains")).alias(
            "attachment_urls"
        ),
        F.array().cast("array<string>").alias("attachment_snapshot_paths"),
        F.array().cast("array<string>").alias("attachment_errors"),
        F.array().cast("array<string>").alias("supplementary_urls"),
        F.col("facts.problem").alias("parse_error"),
    )
    return parsed.withColumn("content_hash", F.sha2("raw_text", 256))


def parse_by_source(
    pages: DataFrame,
    overrides: Mapping[str, Callable[[DataFrame], DataFrame]],
    selectors: str | None = None,
) -> DataFrame:
    """Documents of all pages; sources with their own extraction use it for their pages.

    ``overrides`` maps a source id to a function from its pages to document rows. Their pages are
    written once, by source, so each function reads only its own; all others, those without a
    source included, are parsed from the table itself.
    """
    if not overrides:
        return parse_pages(pages, selectors)
    named = F.coalesce(F.col("source_id").isin(list(overrides)), F.lit(False))
    whole = parse_pages(pages.filter(~named), selectors)
    path = scratch(pages.sparkSession, "routed")
    routed = pages.filter(named).withColumn("_route", F.col("source_id"))
    routed.write.partitionBy("_route").parquet(path)
    kept = pages.sparkSession.read.schema(routed.schema).parquet(path)
    for source_id, parse in overrides.items():
        own = parse(kept.filter(F.col("_route") == source_id).drop("_route"))
        whole = whole.unionByName(own, allowMissingColumns=True)
    return whole


_REPLACED = {"html", "title", "published_at"}


def parse_portal_pages(
    pages: DataFrame, markers: Sequence[str] = rules.TITLE_MARKERS, url: str = "final_url"
) -> DataFrame:
    """Page title, visible text and links whose text holds a marker; duplicates kept."""
    parts = ["page_title", "page_text", "anchors.packed", "anchors.url"]
    facts = pages.withColumn("facts", portal_facts("html", url, parts))
    wanted = F.filter(
        "facts.anchors",
        lambda anchor: (anchor["packed"] != "") & contains_any(anchor["packed"], markers),
    )
    items = F.transform(
        wanted,
        lambda anchor: F.struct(anchor["packed"].alias("title"), anchor["url"].alias("url")),
    )
    return facts.select(
        *pages.columns,
        F.col("facts.page_title").alias("page_title"),
        F.col("facts.page_text").alias("text_content"),
        items.alias("policy_items"),
        F.col("facts.problem").alias("parse_error"),
    )


def attachment_number(links: DataFrame, key: str, column: str = "attachment_urls") -> DataFrame:
    """One row per attachment with its one-based number in document order."""
    return links.select(key, F.posexplode(column).alias("place", "url")).select(
        key, (F.col("place") + 1).alias("number"), "url"
    )


def attachment_name(url: Column | str, number: Column | str) -> Column:
    """Decoded file name of the URL, else a numbered name."""
    raw = F.regexp_extract(path(url), r"([^/]*)/*$", 1)
    decoded = F.url_decode(
        F.replace(F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    )
    return F.coalesce(
        F.nullif(decoded, F.lit("")), F.concat(F.lit("attachment-"), col(number).cast("string"))
    )


def attachment_parts(attachments: DataFrame) -> DataFrame:
    """Heading and text of each attachment, or its error.

    ``attachments``: policy_id, number, name, text, error (extraction error text or NULL).
    """
    name = F.col("name")
    legacy = F.lower(name).endswith(".doc")
    open_mark, middle, close = rules.ATTACHMENT_HEADING
    before, after = rules.ATTACHMENT_LEGACY_ERROR
    failed, between = rules.ATTACHMENT_FAILED_ERROR
    problem = F.coalesce(
        F.when(legacy, F.concat(F.lit(before), name, F.lit(after))),
        F.when(
            F.col("error").isNotNull(), F.concat(F.lit(failed), name, F.lit(between), F.col("error"))
        ),
        F.when(
            F.coalesce(F.col("text"), F.lit("")) == "",
            F.concat(F.lit(failed), name, F.lit(between + rules.ATTACHMENT_EMPTY_ERROR)),
        ),
    )
    part = F.concat(
        F.lit(open_mark), F.col("number").cast("string"), F.lit(middle), name, F.lit(close),
        F.col("text"),
    )
    return attachments.select(
        "policy_id",
        "number",
        F.when(problem.isNull(), part).alias("part"),
        problem.alias("problem"),
    )


def merge_parts(
    parts: DataFrame,
    key: str,
    number: str,
    part: str,
    per_segment: int = PARTS_PER_SEGMENT,
) -> DataFrame:
    """Normalised parts joined in order, in segments of at most ``per_segment`` numbers.

    A key with fewer parts has exactly one segment, its whole text. A key with more is spread
    over several tasks; its segments joined by a space are the whole text.
    """
    segment = F.floor((F.col(number) - 1) / per_segment)
    cleaned = parts.select(
        key, segment.alias("segment"), F.col(number).alias("number"), normalize_text(part).alias("p")
    ).filter(F.col("p") != "")
    grouped = cleaned.groupBy(key, "segment").agg(
        F.array_sort(F.collect_list(F.struct("number", "p"))).alias("ordered")
    )
    return grouped.select(
        key,
        "segment",
        F.size("ordered").alias("n_parts"),
        F.array_join(F.transform("ordered", lambda item: item["p"]), " ").alias("merged_text"),
    )


def merge_attachments(
    docs: DataFrame, attachments: DataFrame, per_segment: int = PARTS_PER_SEGMENT
) -> DataFrame:
    """Documents with all attachment text appended, hash recomputed and all errors listed.

    Parts are joined within segments first and segments within the document then: a document's
    text is one value, but no sort holds more than a segment.
    """
    parts = attachment_parts(attachments)
    merged = merge_parts(
        parts.filter("part IS NOT NULL"), "policy_id", "number", "part", per_segment
    )
    texts = merged.groupBy("policy_id").agg(
        F.array_sort(F.collect_list(F.struct("segment", "merged_text"))).alias("segments")
    )
    problems = parts.filter(F.col("problem").isNotNull())
    errors = problems.groupBy("policy_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "problem"))).alias("problems")
    )
    joined = docs.join(texts, "policy_id", "left").join(errors, "policy_id", "left")
    body = F.array_join("segments.merged_text", " ")
    whole = normalize_text(
        F.concat_ws(" ", "normalized_text", F.when(~is_blank(body), body))
    )
    return (
        joined.withColumn("normalized_text", whole)
        .withColumn("content_hash", content_hash("normalized_text"))
        .withColumn(
            "attachment_errors",
            F.coalesce(F.col("problems.problem"), F.array().cast("array<string>")),
        )
        .drop("segments", "problems")
    )


def with_source_columns(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach configuration and selectors of the source to its pages."""
    config = parser_profile(sources).select(
        "source_id",
        F.col("display_name").alias("source_name"),
        "region",
        "allowed_domains",
        "listing_selectors",
        "content_selectors",
        "profile_error",
    )
    return pages.join(config, "source_id")
