"""Result rows: opportunities, observations and failures in the fixed export columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from noticeloom import rules, schemas
from noticeloom.functions.dates import date_window
from noticeloom.functions.text import (
    append_disclaimer,
    col,
    is_blank,
    is_compliant_script,
    null_if_blank,
    strip,
)
from noticeloom.functions.urls import valid_links
from noticeloom.operators.latest import require_none
from noticeloom.operators.quality import document_columns, evaluate

NUMERIC_HEADERS = {"商机评分": "int", "行业判断置信度": "double"}
DATE_HEADERS = ("发布日期", "申报开始日期", "申报截止日期")
TIME_HEADERS = ("采集时间", "AI 分析时间")


def header_type(header: str) -> str:
    if header in DATE_HEADERS:
        return "date"
    if header in TIME_HEADERS:
        return "timestamp"
    return NUMERIC_HEADERS.get(header, "string")


OPPORTUNITY_TYPE = schemas.OPPORTUNITY
OPPORTUNITY, BENEFIT, FAILURE = "opportunity", "benefit", "failure"


def _row_kind() -> Column:
    """What rows a document gives; NULL for none."""
    found = F.size("analysis.opportunities")
    return (
        F.when(F.col("error_type").isNotNull(), FAILURE)
        .when(found > 0, OPPORTUNITY)
        .when(F.col("analysis.is_benefit_policy") & (found == 0), BENEFIT)
    )


def _document_values() -> dict[str, Column]:
    links = F.concat(
        F.array("detail_url"), F.coalesce("supplementary_urls", F.array().cast("array<string>"))
    )
    return {
        "政策名称": F.col("title"),
        "适用地区": F.col("region"),
        "发布机构": F.col("publisher"),
        "政策文号": F.col("document_number"),
        "发布日期": F.col("publish_date"),
        "申报开始日期": F.col("application_start_date"),
        "申报截止日期": F.col("application_end_date"),
        "政策原文链接": F.array_join(links, rules.LIST_JOINER),
        "附件链接": F.array_join("attachment_urls", rules.LIST_JOINER),
        "数据来源": F.col("source_name"),
        "采集时间": F.col("collected_at"),
        "AI 分析时间": F.col("analyzed_at"),
        "免责声明": F.lit(rules.DISCLAIMER),
    }


def _analysis_values() -> dict[str, Column]:
    return {
        "政策摘要": F.col("analysis.summary"),
        "支持方向": F.col("analysis.support_direction"),
        "适用企业条件": F.col("analysis.eligible_conditions"),
        "风险与限制": F.col("analysis.risk_notes"),
    }


def _opportunity_values(opportunity: Column) -> dict[str, Column]:
    script = opportunity["opening_script"]
    return {
        "商机等级": F.col("quality.grade"),
        "商机评分": F.col("quality.score"),
        "国标行业门类名称": opportunity["section_name"],
        "国标行业门类代码": opportunity["section_code"],
        "国标行业大类名称": opportunity["division_name"],
        "国标行业大类代码": opportunity["division_code"],
        "业务行业标签": F.array_join(opportunity["business_tags"], rules.LIST_JOINER),
        "行业判断置信度": opportunity["confidence"],
        "机会场景": F.array_join(opportunity["scenarios"], rules.LIST_JOINER),
        "融资租赁关联度": opportunity["leasing_relevance"],
        "推荐理由": opportunity["leasing_relevance"],
        "评分理由": F.col("quality.review_reason"),
        "政策原文依据": F.array_join(opportunity["evidence"]["quote"], "\n"),
        "依据位置": F.array_join(opportunity["evidence"]["location"], "\n"),
        "推荐动作": opportunity["recommended_action"],
        "行业营销开场白": F.when(
            F.coalesce(is_compliant_script(script), F.lit(False)), append_disclaimer(script)
        ).otherwise(rules.DISCLAIMER),
        "复核原因": F.col("quality.review_reason"),
    }


def _pending_values(reason: Column) -> dict[str, Column]:
    pending = F.lit(rules.PENDING_REVIEW)
    return {
        "商机等级": F.lit(rules.OBSERVATION_GRADE),
        "商机评分": F.lit(0),
        "国标行业门类名称": pending,
        "国标行业门类代码": pending,
        "国标行业大类名称": pending,
        "国标行业大类代码": pending,
        "复核原因": reason,
    }


def result_rows(
    analyzed: DataFrame,
    reference: date,
    kinds: tuple[str, ...] = (OPPORTUNITY, BENEFIT, FAILURE),
    keep: tuple[str, ...] = ("policy_id", "seq"),
) -> DataFrame:
    """Result rows of analysed documents, 36 columns each, in one pass over the documents.

    A document gives a scored row per opportunity, one observation when it is a benefit without
    a verifiable opportunity, and one observation when its analysis failed. Text that is missing
    is empty; typed columns are NULL.
    """
    kind, opportunity = F.col("kind"), F.col("opportunity")
    items = F.when(kind == OPPORTUNITY, F.col("analysis.opportunities")).when(
        kind.isNotNull(), F.array(F.lit(None).cast(OPPORTUNITY_TYPE))
    )
    wanted_kind = F.when(_row_kind().isin(list(kinds)), _row_kind())
    exploded = (
        analyzed.withColumn("kind", wanted_kind)
        .select("*", F.posexplode_outer(items).alias("place", "opportunity"))
        # Not a filter on the kind: that would move down and check all quotes a second time.
        .filter("place IS NOT NULL")
    )
    scored = exploded.withColumn(
        "quality",
        F.when(kind == OPPORTUNITY, evaluate(document_columns(), opportunity, reference)),
    )
    document = _document_values()
    failure = {
        **_pending_values(failure_reason("error_type", "error")),
        "政策摘要": failure_summary("normalized_text", "raw_text"),
    }
    by_kind = {
        OPPORTUNITY: {**_analysis_values(), **_opportunity_values(opportunity)},
        BENEFIT: {**_analysis_values(), **_pending_values(F.lit(rules.REASON_NO_OPPORTUNITY))},
        FAILURE: failure,
    }

    def cell(header: str) -> Column:
        wanted = header_type(header)
        value = document.get(header)
        if value is None:
            value = F.lit(None).cast(wanted)
            for name in kinds:
                if header in by_kind[name]:
                    value = F.when(kind == name, by_kind[name][header].cast(wanted)).otherwise(value)
        value = value.cast(wanted)
        return (F.coalesce(value, F.lit("")) if wanted == "string" else value).alias(header)

    sheet = F.coalesce("quality.sheet_name", F.lit(rules.OBSERVATION_SHEET))
    return scored.select(
        *keep,
        "place",
        sheet.alias("sheet_name"),
        *[cell(header) for header in rules.EXPORT_HEADERS],
    )


def opportunity_rows(analyzed: DataFrame, reference: date) -> DataFrame:
    """One scored row per document and opportunity."""
    return result_rows(analyzed, reference, (OPPORTUNITY,))


def benefit_observation_rows(analyzed: DataFrame, reference: date) -> DataFrame:
    """One observation row per benefit document without a verifiable opportunity."""
    return result_rows(analyzed, reference, (BENEFIT,))


def failure_rows(analyzed: DataFrame, reference: date) -> DataFrame:
    """One observation row per document whose analysis failed."""
    return result_rows(analyzed, reference, (FAILURE,))


def failure_reason(error_type: Column | str, error: Column | str) -> Column:
    detail = F.coalesce(null_if_blank(strip(error)), F.lit(rules.FAILURE_NO_DETAIL))
    before, after = rules.FAILURE_REASON
    return F.concat(F.lit(before), col(error_type), F.lit(": "), detail, F.lit(after))


def failure_summary(normalized_text: Column | str, raw_text: Column | str) -> Column:
    """First characters of the normalised text, or of the raw text when that is blank."""
    text = F.when(~is_blank(normalized_text), strip(normalized_text)).otherwise(
        strip(F.coalesce(col(raw_text), F.lit("")))
    )
    return F.substring(text, 1, rules.FAILURE_SUMMARY_CHARS)


def union_rows(*parts: DataFrame) -> DataFrame:
    """All result rows in one table."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def clean_links(rows: DataFrame) -> DataFrame:
    """Keep only valid links in the link columns, one per line."""
    for header in rules.EXPORT_LINK_HEADERS:
        rows = rows.withColumn(header, valid_links(F.col(header)))
    return rows


def document_listing(docs: DataFrame) -> DataFrame:
    """Short listing of documents with text length and attachment count."""
    return docs.select(
        "policy_id",
        "title",
        "source_id",
        "source_name",
        "region",
        "publisher",
        "document_number",
        "publish_date",
        F.char_length("normalized_text").alias("text_length"),
        F.greatest(F.size("attachment_urls"), F.lit(0)).alias("attachment_count"),
        "detail_url",
    )


def documents_to_candidates(docs: DataFrame, start: date, end: date) -> DataFrame:
    """Stored documents as listing candidates in the window."""
    return docs.filter(date_window("publish_date", start, end)).select(
        "source_id", "title", "detail_url", F.col("publish_date").alias("published_at")
    )


def select_documents(docs: DataFrame, requested: DataFrame) -> DataFrame:
    """Documents among the requested ids."""
    return docs.join(requested.select("policy_id").distinct(), "policy_id", "left_semi")


def missing_documents(docs: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested ids that no document has."""
    return requested.select("policy_id").distinct().join(
        docs.select("policy_id"), "policy_id", "left_anti"
    )


def require_documents(docs: DataFrame, requested: DataFrame) -> DataFrame:
    """The requested documents; no request and unknown ids are errors."""
    if not requested.limit(1).count():
        raise ValueError("select at least one document")
    require_none(missing_documents(docs, requested), "documents not in this batch", ["policy_id"])
    return select_documents(docs, requested)


def local_documents(docs: DataFrame, start: date, end: date, seq: str = "seq") -> DataFrame:
    """Stored documents as a run reads them again: the last one per source and URL, in the window."""
    last = docs.groupBy("source_id", "detail_url").agg(F.max(seq).alias(seq)).select(seq)
    return docs.filter(date_window("publish_date", start, end)).join(last, seq)


def document_by_id(docs: DataFrame, policy_id: str) -> DataFrame:
    """The document with that id."""
    return docs.filter(F.col("policy_id") == policy_id).limit(1)
