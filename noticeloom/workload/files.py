"""Configuration files written from the tables and read back by the readers that check them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeloom.session import scratch
from noticeloom.sources import readers
from noticeloom.workload.base import long, query, table


def _json_file(rows: DataFrame, order: str, *fields: Column) -> str:
    """The rows as one JSON array in a folder of its own; a configuration file is one value."""
    path = scratch(rows.sparkSession, "config")
    item = F.struct(F.col(order).alias("_order"), F.struct(*fields).alias("item"))
    listed = rows.agg(F.array_sort(F.collect_list(item)).alias("items"))
    listed.select(F.to_json("items.item")).write.text(path)
    return path


@query(
    "sources_file",
    """SELECT s_name AS source_id, s_suppkey % 3 <> 1 AS enabled,
      CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2.5 ELSE 1.0 END AS DOUBLE) AS pause,
      CASE WHEN s_suppkey % 5 = 0 THEN 'generic' ELSE 'unregistered' END AS adapter_version,
      CASE WHEN s_suppkey % 4 = 0 THEN 'discovery' ELSE 'manual' END AS origin FROM supplier""",
)
def sources_file(spark, folder):
    """Absent fields take their defaults; ``enabled`` must be a real boolean."""
    number = F.col("s_suppkey")
    path = _json_file(
        table(spark, folder, "supplier"),
        "s_suppkey",
        F.col("s_name").alias("source_id"),
        F.col("s_name").alias("display_name"),
        F.when(number % 3 == 1, False).when(number % 3 == 2, True).alias("enabled"),
        F.when(number % 2 == 0, 2.5).alias("request_interval_seconds"),
        F.when(number % 5 == 0, "generic").alias("adapter_version"),
        F.when(number % 4 == 0, "discovery").alias("origin"),
    )
    read = readers.read_sources(spark, path)
    pause = F.col("request_interval_seconds").alias("pause")
    return read.select("source_id", "enabled", pause, "adapter_version", "origin")


@query(
    "registry_file",
    """SELECT s_name AS source_id, s_suppkey AS seq, s_nationkey AS requests,
      CASE WHEN s_suppkey % 2 = 0 THEN 'desk' ELSE 'unassigned' END AS owner FROM supplier""",
)
def registry_file(spark, folder):
    """Nested records in file order with their defaults."""
    path = _json_file(
        table(spark, folder, "supplier"),
        "s_suppkey",
        F.col("s_name").alias("source_id"),
        F.when(F.col("s_suppkey") % 2 == 0, "desk").alias("owner"),
        F.struct(F.col("s_nationkey").alias("max_requests"), F.lit(60).alias("period_seconds")).alias("rate_limit"),
    )
    read = readers.read_registry(spark, path)
    return read.select("source_id", long("seq").alias("seq"), long("rate_limit.max_requests").alias("requests"), "owner")


@query(
    "keywords_file",
    """SELECT item_id AS seq, text, 'k' || item_id % 3 AS tag,
      CASE WHEN item_id % 2 = 0 THEN 'strong' END AS signal_strength FROM benchmark""",
)
def keywords_file(spark, folder):
    """A keyword pack with quotes, line ends and letters of any script in its texts."""
    path = _json_file(
        table(spark, folder, "benchmark"),
        "item_id",
        F.col("text"),
        F.concat(F.lit("k"), (F.col("item_id") % 3).cast("string")).alias("tag"),
        F.when(F.col("item_id") % 2 == 0, "strong").alias("signal_strength"),
    )
    read = readers.read_keywords(spark, path)
    return read.select(long("seq").alias("seq"), "text", "tag", "signal_strength")


@query(
    "codes_csv",
    """SELECT 'C' || p_partkey AS code, p_name || ', "' || p_brand || '"' AS name FROM part""",
)
def codes_csv(spark, folder):
    """Codes and names through a CSV with header, quotes and commas."""
    path = scratch(spark, "codes")
    name = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    code = F.concat(F.lit("C"), F.col("p_partkey").cast("string"))
    rows = table(spark, folder, "part").select(code.alias("code"), name.alias("name"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_industry_csv(spark, path).select("code", "name")
