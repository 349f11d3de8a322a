"""Analyzer output, review gates, scores and result rows over whole tables."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import functions as F

from noticeloom import rules, schemas
from noticeloom.functions.text import is_compliant_script, normalize_text
from noticeloom.operators import analysis, quality, rows
from noticeloom.plans.analyze import analyzed_documents
from noticeloom.sources import writers
from noticeloom.session import scratch, staged
from noticeloom.workload.base import (
    SQL_DOCS,
    iso,
    long,
    notices,
    query,
    sql_norm,
    table,
)


@query(
    "score_route",
    """WITH i AS (
      SELECT d.doc_id, quality = 1 AS source, d.doc_id % 10 <> 0 AS evidence, toxic = 0 AS timely,
             lang IN ('en', 'fr') AS clear, greatest(0, least(n_chars % 20 - 2, 15)) AS support,
             greatest(0, least(n_chars % 40 - 5, 30)) AS lease, d.doc_id % 2 = 0 AS act
      FROM documents d JOIN labels USING (doc_id)),
    t AS (SELECT *, CASE WHEN source THEN 15 ELSE 0 END + CASE WHEN timely THEN 10 ELSE 0 END
        + CASE WHEN clear THEN 20 ELSE 0 END + support + lease + CASE WHEN act THEN 10 ELSE 0 END
        AS total FROM i),
    s AS (SELECT *, CASE WHEN timely THEN total ELSE least(total, 59) END AS points FROM t),
    g AS (SELECT *, CASE WHEN points >= 80 THEN 'A' WHEN points >= 60 THEN 'B'
        WHEN points >= 40 THEN 'C' ELSE '观察' END AS letter FROM s),
    p AS (SELECT *, timely AND letter IN ('A', 'B') AND source AND clear AND lease > 0 AS top FROM g)
    SELECT doc_id, CASE WHEN evidence THEN points ELSE 0 END AS score,
           CASE WHEN evidence THEN letter ELSE '观察' END AS grade,
           CASE WHEN evidence AND top THEN '重点商机' ELSE '政策观察' END AS sheet_name,
           CASE WHEN NOT evidence THEN '缺少可定位的行业原文依据' WHEN NOT timely THEN '政策申报已截止'
                WHEN top THEN NULL WHEN NOT source THEN '来源信息不完整'
                WHEN NOT clear THEN '行业判断不明确' WHEN lease = 0 THEN '缺少明确的机会场景'
           END AS review_reason
    FROM p""",
)
def score_route(spark, folder):
    joined = table(spark, folder, "documents").drop("text").join(
        table(spark, folder, "labels"), "doc_id"
    )
    result = quality.score(
        source_complete=F.col("quality") == 1,
        evidence_complete=F.col("doc_id") % 10 != 0,
        timely=F.col("toxic") == 0,
        industry_clear=F.col("lang").isin("en", "fr"),
        support=(F.col("n_chars") % 20 - 2).cast("int"),
        leasing=(F.col("n_chars") % 40 - 5).cast("int"),
        actionable=F.col("doc_id") % 2 == 0,
    )
    return joined.select("doc_id", result.alias("r")).select(
        "doc_id",
        long("r.score").alias("score"),
        "r.grade",
        "r.sheet_name",
        "r.review_reason",
    )


# ---- contract of the analyzer's answers ----------------------------------------------------------

_OPPORTUNITY = {
    "section_code": "A",
    "section_name": "农业",
    "division_code": "A01",
    "division_name": "种植",
    "business_tags": ["食品加工"],
    "confidence": 1,
    "scenarios": ["设备更新"],
    "evidence": [{"quote": "ab", "location": "x"}],
    "leasing_relevance": "r",
    "recommended_action": "call",
    "opening_script": "hello",
}
_ANSWER = {
    "is_benefit_policy": True,
    "summary": "TITLE",
    "support_direction": "d",
    "opportunities": [_OPPORTUNITY],
}


def _answer(**changes) -> str:
    return json.dumps({**_ANSWER, **changes}, ensure_ascii=False)


def _altered(**changes) -> list[dict]:
    return [{**_OPPORTUNITY, **changes}]


_ANSWERS = [
    (_answer(risk_notes=None), ""),
    (
        _answer(opportunities=_altered(confidence="0.8")),
        "opportunities.confidence: a number from 0 to 1 is required",
    ),
    (_answer(extra=1), "$: unknown key"),
    (_answer(is_benefit_policy="true"), "is_benefit_policy: a boolean is required"),
    (
        _answer(is_benefit_policy=False),
        "opportunities: non-benefit policy cannot contain opportunities",
    ),
    (_answer()[:-1], "$: a JSON object is required"),
    (
        _answer(opportunities=_altered(evidence=[{"quote": "a", "location": "x"}])),
        "opportunities.evidence.quote: 2 to 240 characters required",
    ),
    (_answer(is_benefit_policy=False, opportunities=[]), ""),
    (
        _answer(opportunities=_altered(evidence=[{"quote": "ab", "location": "", "page": 1}])),
        "opportunities.evidence: unknown key; "
        "opportunities.evidence.location: 1 to 80 characters required",
    ),
    (
        _answer(opportunities=_altered(business_tags=[], scenarios=["x", 1])),
        "opportunities.business_tags: a nonempty list of strings is required; "
        "opportunities.scenarios: a nonempty list of strings is required",
    ),
    (_answer(opportunities=None), "opportunities: a list is required"),
    ("[1]", "$: a JSON object is required"),
]


def _sql_case(values, column: str) -> str:
    from noticeloom.workload.base import sql_text

    branches = " ".join(
        f"WHEN {index} THEN {sql_text(value)}" for index, value in enumerate(values)
    )
    return f"CASE {column} {branches} END"


@query(
    "analysis_contract",
    f"""WITH {SQL_DOCS},
    k AS (SELECT doc_id, title, doc_id % {len(_ANSWERS)} AS kind,
            {_sql_case([error for _, error in _ANSWERS], f"(doc_id % {len(_ANSWERS)})")} AS errors
          FROM notices)
    SELECT doc_id, errors, CASE WHEN errors = '' THEN title END AS summary,
           CASE WHEN errors = '' THEN CASE WHEN kind = 7 THEN 0 ELSE 1 END ELSE -1 END AS n_items
    FROM k""",
)
def analysis_contract(spark, folder):
    kind = (F.col("doc_id") % len(_ANSWERS) + 1).cast("int")
    template = F.element_at(F.array(*[F.lit(answer) for answer, _ in _ANSWERS]), kind)
    title = F.to_json(F.struct(F.col("title").alias("t")))
    escaped = F.expr("substring(j, 6, length(j) - 6)")
    docs = notices(spark, folder).select("doc_id", template.alias("a"), title.alias("j"))
    answers = docs.select(
        "doc_id", F.replace("a", F.lit('"TITLE"'), escaped).alias("analysis_json")
    )
    return analysis.parse_analysis(answers).select(
        "doc_id",
        F.coalesce("contract_errors", F.lit("")).alias("errors"),
        F.col("analysis.summary").alias("summary"),
        F.when(F.col("analysis").isNull(), -1)
        .otherwise(F.size("analysis.opportunities"))
        .cast("long")
        .alias("n_items"),
    )


@query(
    "events_contract",
    """SELECT event_id, user_id, CASE WHEN json_type(props, '$.k') = 'UBIGINT'
        THEN '$: unknown key; is_benefit_policy: a boolean is required; summary: a string is required'
          || '; support_direction: a string is required' ELSE 'other' END AS errors
    FROM events""",
)
def events_contract(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "props")
    return analysis.parse_analysis(events, "props").select(
        "event_id", "user_id", F.col("contract_errors").alias("errors")
    )


# ---- checks against catalog, tags, scenarios and text --------------------------------------------

_CATALOG = {"A": "农业", "A01": "种植", "B": "采矿", "B06": "煤炭"}
_TAGS = ("食品加工", "新能源")


def _opportunities():
    """Two opportunities per document whose faults depend on the document number."""
    number = F.col("doc_id")

    def opportunity(shift: int):
        kind = (number + shift) % 9
        good = F.expr("substring(text, 1 + cast(doc_id * 37 % greatest(char_length(text) - 25, 1) as int), 25)")
        return F.struct(
            F.when(kind == 1, "AB").otherwise("A").alias("section_code"),
            F.lit("农业").alias("section_name"),
            F.when(kind == 2, "B06").when(kind == 3, "A99").otherwise("A01").alias("division_code"),
            F.when(kind == 4, "煤炭").otherwise("种植").alias("division_name"),
            F.when(kind == 5, F.array(F.lit("新能源"), F.lit("x")))
            .otherwise(F.array(F.lit("新能源")))
            .alias("business_tags"),
            F.lit(0.9).alias("confidence"),
            F.when(kind == 6, F.array(F.lit("其他")))
            .otherwise(F.array(F.lit("扩产"), F.lit("设备更新")))
            .alias("scenarios"),
            F.array(
                F.struct(good.alias("quote"), F.lit("claimed").alias("location")),
                F.struct(
                    F.when(kind == 7, F.lit("not ☃")).otherwise(good).alias("quote"),
                    F.lit("claimed").alias("location"),
                ),
            ).alias("evidence"),
            F.lit("r").alias("leasing_relevance"),
            F.lit("call").alias("recommended_action"),
            F.lit("hello").alias("opening_script"),
        )

    return F.array(opportunity(0), opportunity(1)).cast("array<struct<{}>>".format(_ddl()))


def _ddl() -> str:
    return ",".join(
        f"{field.name}:{field.dataType.simpleString()}" for field in schemas.OPPORTUNITY
    )


_SQL_Q = sql_norm(
    "substr(text, 1 + CAST(doc_id * 37 % greatest(length(text) - 25, 1) AS BIGINT), 25)"
)


@query(
    "valid_opportunities",
    f"""WITH q AS (SELECT doc_id, {sql_norm("text")} AS t, {_SQL_Q} AS q FROM documents),
    k AS (SELECT *, unnest([doc_id % 9, (doc_id + 1) % 9]) AS kind FROM q)
    SELECT doc_id, count(*) AS kept,
           max('正文字符' || strpos(t, q) || '-' || (strpos(t, q) + length(q) - 1)) AS location
    FROM k WHERE kind IN (0, 8) AND q <> '' AND strpos(t, q) > 0 GROUP BY doc_id""",
)
def valid_opportunities(spark, folder):
    docs = table(spark, folder, "documents").withColumn("opportunities", _opportunities())
    kept = analysis.valid_opportunities(
        "opportunities", normalize_text("text"), _CATALOG, _TAGS, rules.SCENARIOS
    )
    checked = docs.select("doc_id", kept.alias("kept")).filter(F.size("kept") > 0)
    return checked.select(
        "doc_id",
        long(F.size("kept")).alias("kept"),
        F.col("kept")[0]["evidence"][1]["location"].alias("location"),
    )


@query(
    "ground_evidence",
    f"""WITH q AS (SELECT doc_id, {sql_norm("text")} AS t, {_SQL_Q} AS q, doc_id % 9 = 7 AS broken
                  FROM documents)
    SELECT doc_id, CASE WHEN q <> '' AND strpos(t, q) > 0
                   THEN '正文字符' || strpos(t, q) || '-' || (strpos(t, q) + length(q) - 1) END AS first,
           CASE WHEN NOT broken AND q <> '' AND strpos(t, q) > 0
                THEN '正文字符' || strpos(t, q) || '-' || (strpos(t, q) + length(q) - 1) END AS second
    FROM q""",
)
def ground_evidence(spark, folder):
    docs = table(spark, folder, "documents").withColumn("opportunities", _opportunities())
    grounded = analysis.ground_evidence(
        normalize_text("text"), F.col("opportunities")[0]["evidence"]
    )
    return docs.select("doc_id", grounded.alias("e")).select(
        "doc_id", F.col("e")[0]["location"].alias("first"), F.col("e")[1]["location"].alias("second")
    )


@query(
    "catalog_join",
    """SELECT c_custkey, r_name AS section_name, n_name AS division_name
    FROM customer JOIN region ON r_regionkey = c_nationkey % 7
    JOIN nation ON n_nationkey = c_nationkey + c_custkey % 2""",
)
def catalog_join(spark, folder):
    regions = table(spark, folder, "region").select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code"),
        F.col("r_name").alias("name"),
    )
    nations = table(spark, folder, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"),
        F.col("n_name").alias("name"),
    )
    customers = table(spark, folder, "customer").select(
        "c_custkey",
        F.concat(F.lit("R"), (F.col("c_nationkey") % 7).cast("string")).alias("section_code"),
        F.concat(
            F.lit("N"), (F.col("c_nationkey") + F.col("c_custkey") % 2).cast("string")
        ).alias("division_code"),
    )
    return analysis.join_catalog(customers, regions.unionByName(nations)).select(
        "c_custkey", "section_name", "division_name"
    )


@query(
    "tag_subset",
    """SELECT event_id, event_type IN ('click', 'view', 'error') AND value <= 50 AS allowed
    FROM events""",
)
def tag_subset(spark, folder):
    tags = F.when(F.col("value") > 50, F.array("event_type", F.lit("large"))).otherwise(
        F.array("event_type", "event_type")
    )
    return table(spark, folder, "events").select(
        "event_id", analysis.all_members(tags, ("click", "view", "error")).alias("allowed")
    )


@query(
    "analysis_join",
    """SELECT source, quality, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars
    FROM (SELECT d.source, coalesce(quality, -1) AS quality, n_chars
          FROM documents d LEFT JOIN labels USING (doc_id)) GROUP BY 1, 2""",
)
def analysis_join(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("policy_id"), "source", "n_chars"
    )
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("policy_id"), "quality")
    return (
        analysis.join_analysis(docs, labels)
        .groupBy("source", F.coalesce("quality", F.lit(-1)).alias("quality"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("chars"))
    )


# ---- gates and score of one document and opportunity ---------------------------------------------


@query(
    "evaluate",
    f"""WITH {SQL_DOCS},
    i AS (SELECT *, doc_id % 13 AS kind,
            normalized_text <> '' AND doc_id % 3 <> 0 AS located,
            publish_date + 60 AS end_date FROM notices),
    r AS (SELECT *, CASE
        WHEN kind = 0 THEN '附件解析不完整：bad file'
        WHEN title = '' OR kind = 1 THEN '政策追溯信息不完整：政策名称'
        WHEN kind = 2 THEN '政策追溯信息不完整：来源名称'
        WHEN kind = 3 THEN '标准行业分类信息不完整'
        WHEN kind = 4 THEN '缺少有效业务行业标签'
        WHEN kind = 5 THEN '缺少明确的机会场景'
        WHEN kind = 6 THEN '缺少可定位的行业原文依据'
        WHEN kind = 7 THEN '营销话术含过度承诺或政府背书表达'
        WHEN NOT located THEN '缺少可定位的行业原文依据'
        WHEN publish_date IS NULL THEN '政策时效信息不明确'
        WHEN kind = 8 THEN '政策日期存在矛盾' END AS gate,
        end_date >= DATE '2024-06-01' AS timely, kind <> 9 AS clear, kind <> 10 AS act,
        CASE WHEN kind = 11 THEN 15 ELSE 30 END AS lease FROM i),
    s AS (SELECT *, 15 + 3 + lease + CASE WHEN timely THEN 10 ELSE 0 END
        + CASE WHEN clear THEN 20 ELSE 0 END + CASE WHEN act THEN 10 ELSE 0 END AS total FROM r),
    p AS (SELECT *, CASE WHEN timely THEN total ELSE least(total, 59) END AS points FROM s)
    SELECT doc_id, CASE WHEN gate IS NULL THEN points ELSE 0 END AS score,
        CASE WHEN gate IS NOT NULL THEN '观察' WHEN points >= 80 THEN 'A' WHEN points >= 60 THEN 'B'
             WHEN points >= 40 THEN 'C' ELSE '观察' END AS grade,
        CASE WHEN gate IS NULL AND timely AND clear AND points >= 60 THEN '重点商机'
             ELSE '政策观察' END AS sheet_name,
        CASE WHEN gate IS NOT NULL THEN gate WHEN NOT timely THEN '政策申报已截止'
             WHEN clear AND points >= 60 THEN NULL WHEN NOT clear THEN '行业判断不明确'
        END AS review_reason
    FROM p""",
)
def evaluate(spark, folder):
    kind = F.col("doc_id") % 13
    # A quote from anywhere in the text; its first place is the true one.
    start = F.col("doc_id") * 37 % F.greatest(F.char_length("normalized_text") - 20, F.lit(1)) + 1
    quote = F.substr("normalized_text", start.cast("int"), F.lit(20))
    head = normalize_text(quote)
    place = F.instr("normalized_text", head)
    location = F.concat(
        F.lit("正文字符"), place.cast("string"), F.lit("-"), (place + F.char_length(head) - 1).cast("string")
    )
    evidence = F.array(
        F.struct(
            quote.alias("quote"),
            F.when(F.col("doc_id") % 3 == 0, "正文字符0-1").otherwise(location).alias("location"),
        )
    )
    nothing = F.lit(None).cast("date")
    end = F.when(kind == 8, F.date_sub("publish_date", 1)).otherwise(F.date_add("publish_date", 60))
    document = {
        "title": F.when(kind == 1, "　").otherwise(F.col("title")),
        "source_id": F.col("source_id"),
        "source_name": F.when(kind == 2, "").otherwise(F.col("source_name")),
        "detail_url": F.col("detail_url"),
        "raw_text": F.col("raw_text"),
        "normalized_text": F.col("normalized_text"),
        "attachment_errors": F.when(kind == 0, F.array(F.lit("bad file"))).otherwise(
            F.array().cast("array<string>")
        ),
        "publish_date": F.col("publish_date"),
        "effective_date": nothing,
        "application_start_date": nothing,
        "application_end_date": end,
    }
    opportunity = F.struct(
        F.lit("A").alias("section_code"),
        F.lit("农业").alias("section_name"),
        F.lit("A01").alias("division_code"),
        F.when(kind == 3, " ").otherwise("种植").alias("division_name"),
        F.when(kind == 4, F.array(F.lit(" "))).otherwise(F.array(F.lit("t"))).alias("business_tags"),
        F.when(kind == 9, 0.69).otherwise(0.7).alias("confidence"),
        F.when(kind == 5, F.array(F.lit("")))
        .when(kind == 11, F.array(F.lit("绿色转型")))
        .otherwise(F.array(F.lit("设备更新")))
        .alias("scenarios"),
        F.when(kind == 6, F.array().cast(evidence_type())).otherwise(evidence).alias("evidence"),
        F.when(kind == 7, "我们保证\n一次通过").otherwise("hello").alias("opening_script"),
        F.when(kind == 10, " ").otherwise("call").alias("recommended_action"),
    )
    docs = notices(spark, folder).withColumn("o", opportunity)
    result = quality.evaluate(document, F.col("o"), date(2024, 6, 1))
    return docs.select("doc_id", result.alias("r")).select(
        "doc_id", long("r.score").alias("score"), "r.grade", "r.sheet_name", "r.review_reason"
    )


def evidence_type() -> str:
    return f"array<{schemas.EVIDENCE.simpleString()}>"


# ---- the whole analysis of documents --------------------------------------------------------------


def _quote(document):
    """Twenty characters from anywhere in the text."""
    text = document["normalized_text"]
    start = document["doc_id"] * 37 % max(len(text) - 20, 1)
    return text[start : start + 20]


def _analyzer(document, note: str) -> str:
    """Answers by document number; some calls fail once, some always."""
    number = document["doc_id"]
    if number % 7 == 0 and (not note or number % 14 == 0):
        raise TimeoutError("slow")
    benefit = number % 2 == 1
    opportunities = []
    if benefit and number % 3:
        opportunities.append(
            {
                **_OPPORTUNITY,
                "confidence": 0.9 if number % 5 else 0.5,
                "evidence": [{"quote": _quote(document), "location": "?"}],
                "recommended_action": " " if number % 4 == 1 else "call",
                "opening_script": "官方背书" if number % 23 == 0 else "hello",
            }
        )
    return json.dumps(
        {**_ANSWER, "is_benefit_policy": benefit, "opportunities": opportunities},
        ensure_ascii=False,
    )


def _analyzed(spark, folder):
    nothing = F.lit(None).cast("date")
    empty = F.array().cast("array<string>")
    docs = notices(spark, folder).withColumns(
        {
            "document_number": F.lit(None).cast("string"),
            "effective_date": nothing,
            "application_start_date": nothing,
            "application_end_date": nothing,
            "attachment_urls": F.array(F.lit("https://a.example/x.pdf"), F.lit("ftp://b")),
            "attachment_errors": empty,
            "supplementary_urls": F.array(F.lit("https://m.example/1")),
            "collected_at": F.lit("2024-07-01 00:00:00").cast("timestamp"),
        }
    )
    columns = ("policy_id", "doc_id", "normalized_text")
    # The analyzer is the costly call: its answers are written before they are read.
    raw = staged(analysis.analyze(docs, _analyzer, columns), "answers")
    return analyzed_documents(docs, raw, {"A": "农业", "A01": "种植"}, ("食品加工",))


_SQL_RESULTS = f"""{SQL_DOCS},
q AS (SELECT *, trim(substr(normalized_text,
  1 + CAST(doc_id * 37 % greatest(length(normalized_text) - 20, 1) AS BIGINT), 20)) AS quote FROM notices),
k AS (SELECT *, CASE WHEN doc_id % 14 = 0 THEN 'failed' WHEN doc_id % 2 = 0 THEN 'none'
    WHEN doc_id % 3 = 0 THEN 'benefit' ELSE 'opportunity' END AS kind FROM q),
g AS (SELECT *, CASE WHEN title = '' THEN '政策追溯信息不完整：政策名称'
        WHEN doc_id % 23 = 0 THEN '营销话术含过度承诺或政府背书表达'
        WHEN publish_date IS NULL THEN '政策时效信息不明确' END AS gate,
        doc_id % 5 <> 0 AS clear, doc_id % 4 <> 1 AS act FROM k WHERE kind <> 'none'),
p AS (SELECT *, CASE WHEN kind = 'opportunity' AND gate IS NULL
        THEN 58 + CASE WHEN clear THEN 20 ELSE 0 END + CASE WHEN act THEN 10 ELSE 0 END ELSE 0 END
        AS points FROM g),
results AS (
  SELECT doc_id, publish_date, points AS score,
    CASE WHEN points >= 80 THEN 'A' WHEN points >= 60 THEN 'B' WHEN points >= 40 THEN 'C'
         ELSE '观察' END AS grade,
    CASE WHEN points >= 60 AND clear THEN '重点商机' ELSE '政策观察' END AS sheet_name,
    CASE WHEN kind = 'failed' THEN 'AI 分析失败，需人工复核（TimeoutError: slow）'
         WHEN kind = 'benefit' THEN '惠企政策未识别到可验证的机会行业'
         WHEN gate IS NOT NULL THEN gate
         WHEN NOT clear THEN '行业判断不明确' ELSE '' END AS reason,
    CASE WHEN kind = 'opportunity' THEN '正文字符' || strpos(normalized_text, quote) || '-'
         || (strpos(normalized_text, quote) + length(quote) - 1) ELSE '' END AS location,
    CASE WHEN kind = 'failed' THEN substr(normalized_text, 1, 32000) ELSE 'TITLE' END AS summary,
    CASE WHEN kind <> 'opportunity' THEN '' WHEN doc_id % 23 = 0 THEN '{rules.DISCLAIMER}'
         ELSE 'hello' || chr(10) || chr(10) || '{rules.DISCLAIMER}' END AS script,
    CASE WHEN kind = 'opportunity' THEN '种植' ELSE '待复核' END AS division,
    detail_url || '、https://m.example/1' AS links
  FROM p)"""


@query(
    "analyze_rows",
    f"""WITH {_SQL_RESULTS}
    SELECT doc_id, score, grade, sheet_name, reason, location, sha256(summary) AS summary_hash,
           script, division, links FROM results""",
)
def analyze_rows(spark, folder):
    result = rows.result_rows(_analyzed(spark, folder), date(2024, 7, 1))
    return result.select(
        F.col("seq").alias("doc_id"),
        long("商机评分").alias("score"),
        F.col("商机等级").alias("grade"),
        "sheet_name",
        F.col("复核原因").alias("reason"),
        F.col("依据位置").alias("location"),
        F.sha2("政策摘要", 256).alias("summary_hash"),
        F.col("行业营销开场白").alias("script"),
        F.col("国标行业大类名称").alias("division"),
        F.col("政策原文链接").alias("links"),
    )


@query(
    "export_files",
    f"""WITH {_SQL_RESULTS}
    SELECT replace(links, '、', chr(10)) AS links, score, reason,
           'https://a.example/x.pdf' AS attachments, '' AS level
    FROM results WHERE sheet_name = '政策观察' AND contains(lower(concat_ws(' ', reason)), '行业判断')""",
)
def export_files(spark, folder):
    """Write the export once and read one searched sheet back."""
    from noticeloom.sources.readers import read_export

    result = staged(rows.result_rows(_analyzed(spark, folder), date(2024, 7, 1)), "rows")
    path = writers.write_export(result, scratch(spark, "export"), date(2024, 7, 1))
    sheet = read_export(spark, path, rules.OBSERVATION_SHEET, " 行业判断 ")
    return sheet.filter(F.col("复核原因") == rules.REASON_INDUSTRY).select(
        F.col("政策原文链接").alias("links"),
        long("商机评分").alias("score"),
        F.col("复核原因").alias("reason"),
        F.col("附件链接").alias("attachments"),
        F.col("政策层级").alias("level"),
    )


@query(
    "export_sheets",
    f"""WITH {_SQL_RESULTS}
    SELECT sheet_name, replace(links, '、', chr(10)) AS links, score, reason,
           'https://a.example/x.pdf' AS attachments, '' AS level
    FROM results""",
)
def export_sheets(spark, folder):
    """Write the export once and read every row of both sheets back."""
    from noticeloom.sources.readers import read_export

    result = staged(rows.result_rows(_analyzed(spark, folder), date(2024, 7, 1)), "rows")
    path = writers.write_export(result, scratch(spark, "export"), date(2024, 7, 1))
    both = read_export(spark, path).unionByName(read_export(spark, path, rules.OBSERVATION_SHEET))
    return both.select(
        "sheet_name",
        F.col("政策原文链接").alias("links"),
        long("商机评分").alias("score"),
        F.col("复核原因").alias("reason"),
        F.col("附件链接").alias("attachments"),
        F.col("政策层级").alias("level"),
    )


@query(
    "failure_summary",
    f"""WITH {SQL_DOCS}
    SELECT doc_id, sha256(substr(normalized_text, 1, 32000)) AS summary_hash,
           'AI 分析失败，需人工复核（KeyError: ' || CASE WHEN doc_id % 2 = 0 THEN '无错误详情'
             ELSE 'd' || doc_id END || '）' AS reason FROM notices""",
)
def failure_summary(spark, folder):
    detail = F.when(F.col("doc_id") % 2 == 0, " ").otherwise(
        F.concat(F.lit(" d"), F.col("doc_id").cast("string"))
    )
    docs = notices(spark, folder).withColumn("detail", detail)
    return docs.select(
        "doc_id",
        F.sha2(rows.failure_summary("normalized_text", "raw_text"), 256).alias("summary_hash"),
        rows.failure_reason(F.lit("KeyError"), "detail").alias("reason"),
    )


@query(
    "document_listing",
    f"""WITH {SQL_DOCS}
    SELECT policy_id, title, region, publisher, length(normalized_text) AS text_length,
           doc_id % 3 AS attachment_count, strftime(publish_date, '%Y-%m-%d') AS published
    FROM notices""",
)
def document_listing(spark, folder):
    links = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (F.col("doc_id") % 3).cast("int"))
    docs = notices(spark, folder).withColumns(
        {"attachment_urls": links, "document_number": F.lit(None).cast("string")}
    )
    return rows.document_listing(docs).select(
        "policy_id",
        "title",
        "region",
        "publisher",
        long("text_length").alias("text_length"),
        long("attachment_count").alias("attachment_count"),
        iso("publish_date").alias("published"),
    )


@query(
    "documents_to_candidates",
    f"""WITH {SQL_DOCS}
    SELECT source_id, title, detail_url, strftime(publish_date, '%Y-%m-%d') AS published
    FROM notices WHERE publish_date IS NULL
       OR publish_date BETWEEN DATE '2024-02-01' AND DATE '2024-03-31'""",
)
def documents_to_candidates(spark, folder):
    found = rows.documents_to_candidates(
        notices(spark, folder), date(2024, 2, 1), date(2024, 3, 31)
    )
    return found.select("source_id", "title", "detail_url", iso("published_at").alias("published"))


@query(
    "local_documents",
    f"""WITH {SQL_DOCS},
    l AS (SELECT *, source_id || (doc_id // 4) AS url FROM notices),
    k AS (SELECT max(doc_id) AS doc_id FROM l GROUP BY source_id, url)
    SELECT doc_id, title FROM l JOIN k USING (doc_id) WHERE publish_date IS NULL
       OR publish_date BETWEEN DATE '2024-02-01' AND DATE '2024-03-31'""",
)
def local_documents(spark, folder):
    url = F.concat("source_id", F.floor(F.col("doc_id") / 4).cast("string"))
    docs = notices(spark, folder).withColumn("detail_url", url)
    found = rows.local_documents(docs, date(2024, 2, 1), date(2024, 3, 31))
    return found.select("doc_id", "title")


@query(
    "select_documents",
    f"""WITH {SQL_DOCS}
    SELECT policy_id, title FROM notices WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def select_documents(spark, folder):
    docs = notices(spark, folder)
    requested = docs.join(table(spark, folder, "labels"), "doc_id", "left_semi")
    return rows.select_documents(docs, requested).select("policy_id", "title")


@query(
    "missing_documents",
    "SELECT CAST(doc_id AS VARCHAR) AS policy_id FROM documents ANTI JOIN labels USING (doc_id)",
)
def missing_documents(spark, folder):
    def ids(name):
        return table(spark, folder, name).select(F.col("doc_id").cast("string").alias("policy_id"))

    return rows.missing_documents(ids("labels"), ids("documents"))


@query(
    "document_by_id",
    f"""WITH {SQL_DOCS} SELECT doc_id, title FROM notices
    WHERE policy_id = (SELECT policy_id FROM notices WHERE doc_id = 17)""",
)
def document_by_id(spark, folder):
    import hashlib

    seed = "{0}|url:https://{0}.example.org/d/17"
    docs = notices(spark, folder)
    source = "src17"
    wanted = hashlib.sha256(seed.format(source).encode()).hexdigest()[:24]
    return rows.document_by_id(docs, wanted).select("doc_id", "title")


@query(
    "compliant_share",
    """SELECT role, count(*) AS turns, count(*) FILTER (trim(text) <> '') AS compliant
    FROM conversations GROUP BY role""",
)
def compliant_share(spark, folder):
    """The default word lists over all conversation turns."""
    return (
        table(spark, folder, "conversations")
        .groupBy("role")
        .agg(
            F.count(F.lit(1)).alias("turns"),
            F.count_if(is_compliant_script("text")).alias("compliant"),
        )
    )


@query(
    "rows_by_kind",
    f"""WITH {_SQL_RESULTS}
    SELECT sheet_name, grade, count(*) AS n_rows, CAST(sum(score) AS BIGINT) AS points
    FROM results GROUP BY 1, 2""",
)
def rows_by_kind(spark, folder):
    """The three kinds of rows made one by one and put together."""
    analyzed, day = _analyzed(spark, folder), date(2024, 7, 1)
    whole = rows.union_rows(
        rows.opportunity_rows(analyzed, day),
        rows.benefit_observation_rows(analyzed, day),
        rows.failure_rows(analyzed, day),
    )
    return whole.groupBy("sheet_name", F.col("商机等级").alias("grade")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("商机评分").alias("points")
    )


def _second_try(document, note):
    """Right at once, right after a broken contract, never right, or not JSON at all."""
    kind = document["doc_id"] % 4
    right = json.dumps({**_ANSWER, "is_benefit_policy": False, "opportunities": []}, ensure_ascii=False)
    if kind == 0 or (kind == 1 and "ValidationError" in note):
        return right
    return "{" if kind == 3 else "{}"


@query(
    "checked_retry",
    """SELECT doc_id, doc_id % 4 < 2 AS valid, CASE WHEN doc_id % 4 = 3 THEN 'JSONDecodeError' END AS error_type
    FROM documents""",
)
def checked_retry(spark, folder):
    """Answers checked against the contract and asked again once."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("policy_id"), F.col("doc_id").alias("seq"), "doc_id"
    )
    answers = analysis.analyze_checked(docs, _second_try, columns=("policy_id", "doc_id"))
    parsed = analysis.parse_analysis(answers)
    return parsed.select(F.col("seq").alias("doc_id"), F.col("analysis").isNotNull().alias("valid"), "error_type")
