"""JSON API payloads as tables: listing, detail and listing units."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from noticeloom import rules
from noticeloom.functions.dates import iso_date_prefix
from noticeloom.functions.identity import policy_id
from noticeloom.functions.text import content_hash, first_nonblank, is_blank, strip
from noticeloom.operators.latest import last_per_key


def _member(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, path, "variant")


def _string(payload: Column, path: str) -> Column:
    """A JSON string; any other JSON type counts as absent."""
    value = _member(payload, path)
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _checked(payload: Column, kind: str) -> Column:
    """Reason an API answer cannot be used."""
    body = F.schema_of_variant(_member(payload, "$.body"))
    status = F.try_variant_get(payload, "$.status", "long")
    return F.when(
        ~F.coalesce(status == 1, F.lit(False)), f"{kind} API returned an unsuccessful status"
    ).when(
        ~F.coalesce(body.startswith("OBJECT"), F.lit(False)), f"{kind} API returned an invalid body"
    )


def read_api_list(
    pages: DataFrame,
    start: date,
    end: date,
    detail_url: str,
    payload: str = "payload",
    source: str = "source_id",
    seq: str = "seq",
) -> DataFrame:
    """Candidates from list payloads in the window; the last row per id wins.

    Payloads that cannot be used give no rows; see ``api_list_errors``.
    """
    parsed = pages.withColumn("_payload", F.try_parse_json(payload))
    usable = parsed.filter(_checked(F.col("_payload"), "list").isNull())
    entries = usable.select(
        source,
        seq,
        F.posexplode(F.try_variant_get("_payload", "$.body.list", "array<variant>")).alias(
            "place", "entry"
        ),
    )
    entry = F.col("entry")
    rows = entries.select(
        F.col(source).alias("source_id"),
        F.struct(F.col(seq).alias("page"), "place").alias("position"),
        F.try_variant_get(entry, "$.id", "string").alias("external_id"),
        strip(_string(entry, "$.title")).alias("title"),
        iso_date_prefix(_string(entry, "$.publishDate")).alias("published_at"),
    )
    kept = rows.filter(
        F.col("external_id").isNotNull()
        & ~is_blank("title")
        & F.col("published_at").between(F.lit(start), F.lit(end))
    )
    last = last_per_key(kept, ["source_id", "external_id"], "position", "first_position")
    link = F.concat(F.lit(detail_url + "?id="), F.url_encode("external_id"))
    return last.select("source_id", "title", link.alias("detail_url"), "published_at", "first_position")


def api_list_errors(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """List payloads that cannot be used, with the reason."""
    parsed = F.try_parse_json(payload)
    listed = F.schema_of_variant(_member(parsed, "$.body.list"))
    no_list = F.when(
        ~F.coalesce(listed.startswith("ARRAY"), F.lit(False)), "list API returned an invalid list"
    )
    return pages.withColumn("error", F.coalesce(_checked(parsed, "list"), no_list)).filter(
        "error IS NOT NULL"
    )


def read_api_detail(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """Documents from detail payloads joined with their candidate and source columns.

    ``answers``: payload, source_id, source_name, region, title, detail_url, published_at,
    collected_at, snapshot_path. An unusable payload gives a row with ``error`` set.
    """
    staged = answers.withColumn("_payload", F.try_parse_json(payload)).withColumn(
        "error", _checked(F.col("_payload"), "detail")
    )
    body = F.col("_payload")

    def text(name: str) -> Column:
        return _string(body, f"$.body.{name}")

    read = (
        staged.withColumn("candidate_title", F.col("title"))
        .withColumn("document_number", F.nullif(first_nonblank(text("code")), F.lit("")))
        .withColumn(
            "raw_text", first_nonblank(text("content_trim"), text("content"), text("intercontent"))
        )
        .withColumn("title", first_nonblank(text("title"), "candidate_title"))
        .withColumn("publisher", F.nullif(first_nonblank(text("department")), F.lit("")))
        .withColumn(
            "publish_date", F.coalesce(iso_date_prefix(text("publishdate")), F.col("published_at"))
        )
    )
    no_text = F.array(F.lit(rules.API_NO_TEXT_ERROR))
    nothing = F.array().cast("array<string>")
    return read.select(
        *[name for name in answers.columns if name not in (payload, "title", "published_at")],
        policy_id(
            "source_id", "detail_url", "candidate_title", "published_at", "document_number"
        ).alias("policy_id"),
        "title",
        "publisher",
        "document_number",
        "publish_date",
        "raw_text",
        F.col("raw_text").alias("normalized_text"),
        F.when(F.col("raw_text") == "", no_text).otherwise(nothing).alias("attachment_errors"),
        content_hash("raw_text").alias("content_hash"),
        "error",
    )


def unwrap_unit_html(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """HTML inside a listing unit answer, or the reason there is none."""
    parsed = F.try_parse_json(payload)
    data = F.schema_of_variant(_member(parsed, "$.data"))
    html = _string(parsed, "$.data.html")
    error = F.when(
        ~F.coalesce(data.startswith("OBJECT"), F.lit(False)), "unit response is missing data"
    ).when(is_blank(html), "unit response is missing data.html")
    return pages.withColumn("error", error).withColumn("html", F.when(error.isNull(), html))


def unit_query(raw: Column | str) -> Column:
    """Single-quoted query attribute of a listing unit as a map of texts."""
    value = F.col(raw) if isinstance(raw, str) else raw
    return F.from_json(F.replace(value, F.lit("'"), F.lit('"')), "map<string,string>")
