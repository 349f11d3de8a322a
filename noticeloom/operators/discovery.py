"""Portal discovery: keyword matches, passive checks, importance and candidate records."""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from noticeloom import rules
from noticeloom.functions.text import col, contains_any
from noticeloom.functions.urls import is_gov_domain
from noticeloom.operators.keywords import keyword_links
from noticeloom.operators.listing import top_per_group
from noticeloom.session import staged

SAMPLES_PER_PORTAL = 5


def selected(column: Column | str, chosen: Sequence[str] | None) -> Column:
    """Membership test; no selection means everything."""
    return col(column).isin(list(chosen)) if chosen else F.lit(True)


def chosen_keywords(keywords: DataFrame, tags: Sequence[str] | None = None) -> DataFrame:
    """Distinct texts of the selected keywords, a table of any length."""
    return keywords.filter(selected("tag", tags)).select("text").filter("text IS NOT NULL").distinct()


def keyword_pack(keywords: DataFrame, tags: Sequence[str] | None = None) -> list[str]:
    """The chosen keywords as a sorted list, for packs short enough to be named by hand."""
    return sorted(row["text"] for row in chosen_keywords(keywords, tags).toLocalIterator())


def keyword_hits(text: Column | str, keywords: Sequence[str]) -> Column:
    """Keywords of a short list found in the text, sorted; ``keyword_links`` takes a table of them."""
    words = sorted(set(keywords))
    if not words:
        return F.array().cast("array<string>")

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def hits(texts: pa.Array) -> pa.Array:
        automaton = ahocorasick.Automaton()
        for word in filter(None, words):
            automaton.add_word(word, word)
        automaton.make_automaton()
        always = {""} if "" in words else set()

        def found(body: str | None) -> list[str]:
            if body is None:
                return []
            return sorted({word for _, word in automaton.iter(body)} | always if len(automaton) else always)

        # One text at a time is a Python object; the batch stays Arrow data.
        return pa.array((found(body.as_py()) for body in texts), pa.list_(pa.string()))

    return hits(col(text))


def match_keywords(
    pages: DataFrame,
    keywords: Sequence[str] | DataFrame,
    portal: str = "portal_id",
    items: str = "policy_items",
    text: str = "text_content",
    order: Sequence[str] = ("page_seq",),
    limit: int = SAMPLES_PER_PORTAL,
) -> DataFrame:
    """Matching items, at most ``limit`` per portal in document order.

    A keyword anywhere in the page text marks every item of the page. No keywords lets every item
    through. Keywords are a short list, or a table with a column ``text`` that is joined with the texts.
    """
    if isinstance(keywords, DataFrame):
        if not keywords.isEmpty():
            return _matched_by_table(pages, keywords, portal, items, text, order, limit)
        keywords = ()
    scanned = pages.withColumn("_page_hits", keyword_hits(text, keywords)).select(
        portal, *order, "_page_hits", F.posexplode(items).alias("item_place", "item")
    )
    hits = F.array_sort(
        F.array_union(F.col("_page_hits"), keyword_hits("item.title", keywords))
    )
    matched = scanned.select(
        portal,
        *order,
        "item_place",
        F.col("item.title").alias("title"),
        F.col("item.url").alias("url"),
        hits.alias("matched_keywords"),
    )
    if keywords:
        matched = matched.filter(F.size("matched_keywords") > 0)
    return top_per_group(matched, [portal], [*order, "item_place"], limit)


def _matched_by_table(
    pages: DataFrame, keywords: DataFrame, portal: str, items: str, text: str, order: Sequence[str], limit: int
) -> DataFrame:
    """As ``match_keywords``: page texts and item titles are searched in one join with the keywords."""
    numbered = pages.select(
        portal, *order, F.col(text).alias("_body"), F.col(items).alias("_items"), F.monotonically_increasing_id().alias("_page")
    )
    pinned = staged(numbered, "pages")
    listed = pinned.select(portal, *order, "_page", F.posexplode("_items").alias("item_place", "item"))
    bodies = pinned.select("_page", F.lit(-1).alias("item_place"), F.col("_body").alias("text"))
    titles = listed.select("_page", "item_place", F.col("item.title").alias("text"))
    found = staged(keyword_links(bodies.unionByName(titles), keywords, ["_page", "item_place"]), "hits")
    of_page = found.filter("item_place = -1").select("_page", F.col("hits").alias("_page_hits"))
    of_item = found.filter("item_place >= 0").withColumnRenamed("hits", "_item_hits")
    none = F.array().cast("array<string>")
    hits = F.array_sort(F.array_union(F.coalesce("_page_hits", none), F.coalesce("_item_hits", none)))
    matched = listed.join(of_page, "_page", "left").join(of_item, ["_page", "item_place"], "left").select(
        portal, *order, "item_place", F.col("item.title").alias("title"), F.col("item.url").alias("url"), hits.alias("matched_keywords")
    )
    return top_per_group(matched.filter(F.size("matched_keywords") > 0), [portal], [*order, "item_place"], limit)


def distinct_keywords(
    matches: DataFrame, portal: str = "portal_id", words: str = "matched_keywords"
) -> DataFrame:
    """Sorted distinct keywords per portal; the pack bounds the list."""
    pairs = matches.select(portal, F.explode(words).alias("keyword")).distinct()
    return pairs.groupBy(portal).agg(F.array_sort(F.collect_list("keyword")).alias("keywords"))


def distinct_tags(keywords: DataFrame, seq: str = "seq") -> DataFrame:
    """Distinct tags in first-seen order."""
    tags = keywords.filter(F.coalesce("tag", F.lit("")) != "").groupBy("tag")
    return tags.agg(F.min(seq).alias("first_seen")).orderBy("first_seen")


def signal_points(hits: Column, samples: Column) -> Column:
    """Points by the share of samples that carry a finance term."""
    share = hits / F.nullif(samples, F.lit(0))
    return F.when(share >= 0.6, 20).when(share >= 0.3, 10).otherwise(5)


def signal_density(
    samples: DataFrame,
    key: str = "portal_id",
    title: str = "title",
    terms: Sequence[str] = (*rules.LEASE_TERMS, *rules.FINANCE_TERMS),
) -> DataFrame:
    """Per portal: samples, samples with a term, and the points for their share."""
    counted = samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(contains_any(title, terms)).alias("hits"),
    )
    return counted.withColumn("points", signal_points(F.col("hits"), F.col("samples")))


def compliance_check(
    domain: Column,
    status: Column,
    restricted_reason: Column,
    robots_allowed: Column,
    retry_after: Column,
    samples: Column,
    suffix: str = rules.GOV_SUFFIX,
) -> Column:
    """Passive check of a portal and the recommendation that follows from it."""
    owner = F.coalesce(is_gov_domain(domain, suffix), F.lit(False))
    reason = F.coalesce(restricted_reason, F.lit(""))
    public = F.coalesce(status == 200, F.lit(False))
    rejected = (
        ~owner | reason.isin("login", "captcha") | ~F.coalesce(robots_allowed, F.lit(True)) | ~public
    )
    attention = (samples < 3) | (F.coalesce(retry_after, F.lit("")) != "")
    result = (
        F.when(rejected, "not_recommended").when(attention, "needs_attention").otherwise("pass")
    )
    advice = F.lit(None).cast("string")
    for name, text in rules.RECOMMENDATIONS.items():
        advice = F.when(result == name, text).otherwise(advice)
    return F.struct(
        result.alias("check_result"),
        F.struct(
            F.when(owner, "gov").otherwise("other").alias("domain_owner"),
            public.alias("public"),
            (reason == "login").alias("login_required"),
            (reason == "captcha").alias("captcha_triggered"),
            F.coalesce(robots_allowed, F.lit(True)).alias("robots_allowed"),
            retry_after.alias("retry_after"),
            samples.cast("long").alias("sample_count"),
        ).alias("check_details"),
        advice.alias("recommendation"),
    )


def importance_score(
    admin_level: Column,
    domain: Column,
    page_title: Column,
    titles: Column,
    check_result: Column,
    lease_terms: Sequence[str] = rules.LEASE_TERMS,
    finance_terms: Sequence[str] = rules.FINANCE_TERMS,
    industry_terms: Sequence[str] = rules.INDUSTRY_TERMS,
    levels: dict[str, int] = rules.ADMIN_LEVEL_SCORES,
    suffix: str = rules.GOV_SUFFIX,
) -> Column:
    """Six scored dimensions, their total and the level. ``titles`` is the short sample list."""
    blob = F.concat(F.coalesce(page_title, F.lit("")), F.array_join(titles, ""))
    count = F.size(titles)
    hits = F.size(
        F.filter(titles, lambda title: contains_any(title, (*lease_terms, *finance_terms)))
    )
    admin = F.lit(rules.ADMIN_LEVEL_DEFAULT)
    for name, points in levels.items():
        admin = F.when(admin_level == name, points).otherwise(admin)
    access = F.lit(0)
    for name, points in rules.CHECK_SCORES.items():
        access = F.when(check_result == name, points).otherwise(access)
    relevance = (
        F.when(contains_any(blob, lease_terms), 25)
        .when(contains_any(blob, finance_terms), 15)
        .when(contains_any(blob, industry_terms), 10)
        .otherwise(5)
    )
    relevance_reason = (
        F.when(relevance == 25, "金融租赁直接相关 +25")
        .when(relevance == 15, "其他金融 +15")
        .when(relevance == 10, "产业通用 +10")
        .otherwise("非金融 +5")
    )
    density = F.when(count > 0, signal_points(hits, count)).otherwise(5)
    percent = F.floor(hits / F.nullif(count, F.lit(0)) * 100).cast("string")
    band = F.when(density == 20, "高").when(density == 10, "中").otherwise("低")
    density_reason = F.when(count == 0, "无样例 +5").otherwise(
        F.concat(
            F.lit("样例密度 "), percent, F.lit("%（"), band, F.lit("）+"), density.cast("string")
        )
    )
    authority = F.when(is_gov_domain(domain, suffix), 5).otherwise(0)
    named = [
        (admin, 30, F.concat(admin_level, F.lit("级信源 +"), admin.cast("string"))),
        (relevance, 25, relevance_reason),
        (density, 20, density_reason),
        (F.lit(5), 10, F.when(count < 3, "样例不足 +5").otherwise("中频（月更）+5")),
        (access, 10, F.concat(check_result, F.lit(" +"), access.cast("string"))),
        (authority, 5, F.when(authority == 5, "gov.cn 官方 +5").otherwise("非 gov.cn +0")),
    ]
    breakdown = F.array(
        *[
            F.struct(
                F.lit(dimension).alias("dimension"),
                points.cast("long").alias("score"),
                F.lit(top).cast("long").alias("max"),
                reason.alias("reason"),
            )
            for dimension, (points, top, reason) in zip(rules.SCORE_DIMENSIONS, named, strict=True)
        ]
    )
    total = admin + relevance + density + F.lit(5) + access + authority
    high, middle, low = rules.PRIORITY_LEVELS
    level = F.when(total >= 80, high).when(total >= 60, middle).otherwise(low)
    return F.struct(
        total.cast("long").alias("priority_score"),
        level.alias("priority_level"),
        breakdown.alias("score_breakdown"),
    )


def build_candidates(portals: DataFrame, pages: DataFrame, matches: DataFrame) -> DataFrame:
    """Registry records, phase candidate and not enabled, for portals with matching items.

    ``matches`` holds at most a few rows per portal (see ``match_keywords``), so the sample list
    of a portal is bounded. ``pages`` is one row per portal with its fetch log.
    """
    samples = matches.groupBy("portal_id").agg(
        F.array_sort(
            F.collect_list(F.struct("place", "title", "url", "matched_keywords"))
        ).alias("ordered")
    )
    words = distinct_keywords(matches)
    joined = (
        portals.join(pages, "portal_id")
        .join(samples, "portal_id")
        .join(words, "portal_id", "left")
    )
    titles = F.transform("ordered", lambda item: item["title"])
    checked = joined.withColumn(
        "check",
        compliance_check(
            F.col("gov_domain"),
            F.col("status_code"),
            F.col("restricted_reason"),
            F.col("robots_allowed"),
            F.col("retry_after"),
            F.size("ordered"),
        ),
    )
    scored = checked.withColumn(
        "score",
        importance_score(
            F.col("admin_level"),
            F.col("gov_domain"),
            F.col("page_title"),
            titles,
            F.col("check.check_result"),
        ),
    )
    sample = F.transform(
        "ordered",
        lambda item: F.struct(
            item["title"].alias("title"),
            item["url"].alias("url"),
            item["matched_keywords"].alias("matched_keywords"),
        ),
    )
    return scored.select(
        F.col("portal_id").alias("source_id"),
        "display_name",
        "region",
        F.lit("candidate").alias("phase"),
        F.lit(False).alias("enabled"),
        F.array("entry_url").alias("official_urls"),
        F.lit("discovery").alias("origin"),
        F.struct(
            F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
            F.col("discovered_at"),
            F.col("portal_id").alias("portal_seed_id"),
            "admin_level",
            sample.alias("sample_policies"),
            F.filter(F.array("snapshot_path"), lambda item: item != "").alias("snapshots"),
            F.col("check.check_result").alias("check_result"),
            F.col("check.check_details").alias("check_details"),
            F.col("check.recommendation").alias("recommendation"),
            F.col("score.priority_score").alias("priority_score"),
            F.col("score.priority_level").alias("priority_level"),
            F.col("score.score_breakdown").alias("score_breakdown"),
        ).alias("discovery"),
    )
