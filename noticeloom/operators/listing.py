"""Listing rules: stop on restriction, repeated pages, paging cut-off, top items."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F, Window

from noticeloom import rules, skew
from noticeloom.functions.text import col, content_hash


def stop_on_restricted(
    log: DataFrame,
    source: str = "source_id",
    seq: str = "seq",
    restricted: Column | str = "restricted",
) -> DataFrame:
    """Mark each fetch: reached, the one that hit the restriction, or dropped after it.

    A running flag over a source equals a comparison with the source's first restricted
    sequence number, so this needs one small aggregate and no window over a whole source.
    ``seq`` is unique in a source.
    """
    first = (
        log.filter(col(restricted))
        .groupBy(source)
        .agg(F.min(seq).alias("stop_seq"))
    )
    joined = skew.join_facts(log, first, [source], [seq])
    place = (
        F.when(F.col("stop_seq").isNull() | (F.col(seq) < F.col("stop_seq")), "kept")
        .when(F.col(seq) == F.col("stop_seq"), "restricted")
        .otherwise("dropped")
    )
    return joined.withColumn("outcome", place).drop("stop_seq")


def fetch_counts(
    log: DataFrame,
    source: str = "source_id",
    seq: str = "seq",
    restricted: Column | str = "restricted",
    failed: Column | str = "failed",
) -> DataFrame:
    """Per source: rows kept, rows dropped, one source failure if stopped, and parse failures."""
    marked = stop_on_restricted(log, source, seq, restricted)
    reached = F.col("outcome") == "kept"
    return marked.groupBy(source).agg(
        F.count_if(reached & ~col(failed)).alias("fetched"),
        F.count_if(reached & col(failed)).alias("parse_failures"),
        F.count_if(F.col("outcome") == "restricted").alias("source_failures"),
        F.count_if(F.col("outcome") == "dropped").alias("dropped"),
    )


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column | str], n: int
) -> DataFrame:
    """First rows of each group; Spark limits each task's groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def distinct_pages(
    pages: DataFrame,
    listing: str = "listing_id",
    seq: str = "seq",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Pages of a listing up to the first one that repeats an earlier page.

    Only (listing, fingerprint, seq) is grouped; the two smallest numbers of a fingerprint are
    enough, and they are taken map-side.
    """
    marked = pages.withColumn("fingerprint", content_hash(F.concat(F.col(url), F.col(html))))
    marks = top_per_group(
        marked.select(listing, "fingerprint", seq), [listing, "fingerprint"], [F.col(seq)], 2
    )
    repeat = marks.filter("place = 2").groupBy(listing).agg(F.min(seq).alias("stop_seq"))
    joined = skew.join_facts(pages, repeat, [listing], [seq])
    return joined.filter(F.col("stop_seq").isNull() | (F.col(seq) < F.col("stop_seq"))).drop(
        "stop_seq"
    )


def pages_until_cutoff(
    entries: DataFrame,
    start: date,
    listing: str = "listing_id",
    page: str = "page_no",
    published: str = "published_at",
    rule: str = "oldest_before",
    max_pages: int | None = rules.LISTING_PAGE_CAP,
    entry_id: str = "entry_id",
) -> DataFrame:
    """Entries on the pages a crawl would read before it is past the window.

    ``oldest_before`` stops after the first page whose oldest date is before the window;
    ``none_current`` after the first page without a date in or after it.
    """
    dates = entries.groupBy(listing, page).agg(
        F.min(published).alias("oldest"), F.max(published).alias("newest")
    )
    first = F.lit(start)
    if rule == "oldest_before":
        past = F.col("oldest") < first
    elif rule == "none_current":
        past = ~F.coalesce(F.col("newest") >= first, F.lit(False))
    else:
        raise ValueError(f"unknown cut-off rule: {rule}")
    stops = dates.filter(past).groupBy(listing).agg(F.min(page).alias("stop_page"))
    capped = entries if max_pages is None else entries.filter(F.col(page) <= max_pages)
    joined = skew.join_facts(capped, stops, [listing], [entry_id])
    return joined.filter(
        F.col("stop_page").isNull() | (F.col(page) <= F.col("stop_page"))
    ).drop("stop_page")
