"""Bindings of the operators to the given tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticeloom.functions.identity import policy_id
from noticeloom.functions.text import content_hash, normalize_text
from noticeloom.functions.urls import host

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


# Unicode white space spelt out, for engines whose own class is ASCII only.
_SQL_SPACE = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def sql_norm(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '{_SQL_SPACE}+', ' ', 'g'))"


def sql_any(expression: str, terms) -> str:
    return "(" + " OR ".join(f"contains({expression}, {sql_text(term)})" for term in terms) + ")"


def long(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")


def iso(value: Column | str) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


# ---- documents as collected notices ------------------------------------------------------------

SQL_DOCS = f"""docs AS (
  SELECT doc_id, source AS source_id, source AS source_name, lang AS region, text AS raw_text,
         {sql_norm("split_part(text, chr(10), 1)")} AS title,
         'https://' || source || '.example.org/d/' || doc_id AS detail_url,
         'src' || (doc_id // 3 % 20) AS publisher,
         {sql_norm("text")} AS normalized_text
  FROM documents),
notices AS (
  SELECT *, substr(sha256(source_id || '|url:' || detail_url), 1, 24) AS policy_id,
         sha256(normalized_text) AS content_hash,
         sha256('title-date-content:' || title || '||' || sha256(normalized_text)) AS dedupe_key,
         CASE WHEN contains(source_name, publisher) OR contains(publisher, source_name) THEN 0
              ELSE 2 END AS priority,
         CASE WHEN doc_id % 11 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 200 AS INTEGER) END
           AS publish_date
  FROM docs)"""


def notices(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the columns of a collected notice; the first line is the title."""
    docs = table(spark, folder, "documents")
    number = F.col("doc_id")
    staged = docs.select(
        number,
        number.alias("seq"),
        F.col("source").alias("source_id"),
        F.col("source").alias("source_name"),
        F.col("lang").alias("region"),
        normalize_text(F.substring_index("text", "\n", 1)).alias("title"),
        F.concat(
            F.lit("https://"), "source", F.lit(".example.org/d/"), number.cast("string")
        ).alias("detail_url"),
        F.concat(F.lit("src"), (F.floor(number / 3) % 20).cast("string")).alias("publisher"),
        F.when(
            number % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (number % 200).cast("int"))
        ).alias("publish_date"),
        F.col("text").alias("raw_text"),
        normalize_text("text").alias("normalized_text"),
        content_hash("text").alias("content_hash"),
        F.array().cast("array<string>").alias("supplementary_urls"),
    )
    return staged.withColumn("policy_id", policy_id("source_id", "detail_url", "title"))


def keyed_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Notices with the key of their repost group (no date, so that copies share it)."""
    from noticeloom.functions.identity import cross_source_key, source_priority

    return (
        notices(spark, folder)
        .withColumn("dedupe_key", cross_source_key("title", None, "content_hash"))
        .withColumn("priority", source_priority("publisher", "source_name"))
    )


# ---- pages as snapshots ------------------------------------------------------------------------

SQL_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def hosted_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").withColumn("host", host("url"))
