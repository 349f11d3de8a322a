"""Cross-source deduplication with primary selection and links to the other members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from noticeloom.functions.identity import cross_source_key, source_priority
from noticeloom.functions.text import col
from noticeloom.session import staged


def with_dedupe_key(docs: DataFrame, number: str | None = "document_number") -> DataFrame:
    """Add the key reposts share and the priority of the hosting source."""
    return docs.withColumn(
        "dedupe_key", cross_source_key("title", "publish_date", "content_hash", number)
    ).withColumn("priority", source_priority("publisher", "source_name"))


def primary_per_group(
    docs: DataFrame, key: str = "dedupe_key", priority: Column | str = "priority", seq: str = "seq"
) -> DataFrame:
    """One row per group: the sequence number of its primary and the group size.

    Smallest priority, any integer, an unknown one last; then smallest ``seq``, a unique integer.
    A group of any size is combined map-side.
    """
    rank = col(priority)
    best = F.min(F.struct(rank.isNull().alias("unknown"), rank.alias("rank"), F.col(seq).alias("seq")))
    return docs.groupBy(key).agg(
        best["seq"].alias(seq), F.count(F.lit(1)).alias("group_size")
    )


def dedupe(
    docs: DataFrame, key: str = "dedupe_key", priority: Column | str = "priority", seq: str = "seq"
) -> DataFrame:
    """Primary documents with their group size.

    Groups are formed on narrow columns; the wide rows meet the chosen ``seq`` in one join on a
    unique number, so no group of copies ever sits in one task.
    """
    chosen = primary_per_group(docs, key, priority, seq)
    return docs.join(chosen.select(seq, "group_size"), seq)


def duplicate_count(primaries: DataFrame) -> DataFrame:
    """One row: how many documents were folded into another one."""
    return primaries.agg(
        F.coalesce(F.sum(F.col("group_size") - 1), F.lit(0)).cast("long").alias("duplicates")
    )


def supplementary_links(
    docs: DataFrame,
    key: str = "dedupe_key",
    priority: Column | str = "priority",
    seq: str = "seq",
) -> DataFrame:
    """Links of each group, one row per distinct link, ordered by ``link_order``.

    The primary's own links come first, then URL and links of every member with another
    policy_id, in input order. Long form: a group of any size stays spread over its links.
    """
    members = docs.select(
        key,
        "policy_id",
        F.col(seq).alias("member_seq"),
        col(priority).alias("rank"),
        "detail_url",
        F.coalesce("supplementary_urls", F.array().cast("array<string>")).alias("own_links"),
    )
    order = F.struct("rank", "member_seq", "policy_id")
    primaries = members.groupBy(key).agg(F.min(order).alias("best")).select(
        key, F.col("best.policy_id").alias("policy_id"), F.col("best.member_seq").alias("first")
    )
    # Place 0 is a member's URL, its links follow. Copies of one document combine map-side.
    places = F.posexplode(F.concat(F.array("detail_url"), F.col("own_links"))).alias("place", "link")
    exploded = members.select(key, "policy_id", "rank", "member_seq", places)
    own = F.when(F.col("place") > 0, F.struct("rank", "member_seq", "place"))
    links = exploded.groupBy(key, "policy_id", "link").agg(
        F.min(F.struct("member_seq", "place")).alias("any_place"), F.min(own).alias("own_place")
    )
    # The primary has the smallest rank and number, so its own link is the smallest own place.
    joined = links.join(primaries, [key, "policy_id"], "left")
    is_primary = F.col("first").isNotNull()
    placed = joined.filter(
        ~is_primary | F.coalesce(F.col("own_place.member_seq") == F.col("first"), F.lit(False))
    ).select(
        key,
        "link",
        F.when(
            is_primary,
            F.struct(
                F.lit(0).alias("stage"),
                F.col("own_place.member_seq").alias("member_seq"),
                F.col("own_place.place").alias("place"),
            ),
        )
        .otherwise(
            F.struct(
                F.lit(1).alias("stage"),
                F.col("any_place.member_seq").alias("member_seq"),
                F.col("any_place.place").alias("place"),
            )
        )
        .alias("link_order"),
    )
    return placed.groupBy(key, "link").agg(F.min("link_order").alias("link_order"))


def with_supplementary_urls(
    primaries: DataFrame, links: DataFrame, key: str = "dedupe_key"
) -> DataFrame:
    """Put all links of a group, in order, on its primary row.

    A document's links are one value of its row. Where groups may be too large for that, use the
    link table itself: it has one row per link.
    """
    order = F.struct("link_order", "link")
    inline = links.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("ordered"))
    # Keys are unique on both sides here, so this join cannot be skewed.
    return (
        primaries.drop("supplementary_urls")
        .join(inline, key, "left")
        .withColumn(
            "supplementary_urls", F.coalesce("ordered.link", F.array().cast("array<string>"))
        )
        .drop("ordered")
    )


def numbered_links(links: DataFrame, key: str = "dedupe_key", segments: int = 64) -> DataFrame:
    """(key, link, place): the links of each group numbered from 1 in their order.

    The members of a group are dealt to ``segments`` by range of their number, so a group of any
    size is sorted in parts; a part's first place follows from the sizes of those before it.
    """
    member = F.col("link_order.member_seq")
    bounds = links.groupBy(key).agg(F.min(member).alias("low"), F.max(member).alias("high"))
    joined = links.join(staged(bounds, "bounds"), key)
    width = (F.col("high") - F.col("low") + 1) / segments
    part = F.when(F.col("link_order.stage") == 0, F.lit(-1)).otherwise(
        F.floor((member - F.col("low")) / width).cast("int")
    )
    dealt = joined.select(key, "link", "link_order", part.alias("part"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most segments + 1 rows per group.
    sizes = dealt.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(key, "part").orderBy("link_order", "link"))
    placed = dealt.withColumn("inside", inside).join(offsets, [key, "part"])
    return placed.select(key, "link", (F.col("offset") + F.col("inside")).cast("long").alias("place"))
