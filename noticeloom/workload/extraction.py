"""Records from markup and API payloads, over all pages and documents."""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from noticeloom import rules
from noticeloom.operators import extract, fill, listing
from noticeloom.session import scratch
from noticeloom.sources import api, html, readers, writers
from noticeloom.functions.urls import host
from noticeloom.workload.base import (
    SQL_DOCS,
    SQL_HOST,
    hosted_pages,
    iso,
    long,
    notices,
    query,
    sql_norm,
    sql_text,
    table,
)
from noticeloom.workload.dedupe import _SQL_BODY, _SQL_DECODED

_SQL_H1 = sql_norm(_SQL_DECODED.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))


@query("page_titles", f"SELECT page_id, {_SQL_H1} AS title FROM pages")
def page_titles(spark, folder):
    facts = html.detail_facts("html", "url", wanted=["heading"])
    return (
        table(spark, folder, "pages")
        .withColumn("facts", facts)
        .select("page_id", F.col("facts.heading").alias("title"))
    )


_SQL_ANCHORS = f"""anchors AS (
  SELECT page_id, url, {SQL_HOST} AS host,
         unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
         unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS label,
         unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">', 1)))) AS place
  FROM pages),
links AS (
  SELECT *, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href AS link FROM anchors)"""

_MARKERS = ("the", "que", "en", "sch")
_SQL_MARKED = "regexp_matches(label, 'the|que|en|sch')"


@query(
    "page_links",
    f"""WITH {_SQL_ANCHORS}
    SELECT host AS source_id, link AS detail_url, max_by(label, (page_id, place)) AS title,
           min(page_id) AS first_page
    FROM links WHERE length(label) >= 4 AND {_SQL_MARKED} AND NOT contains(host, 'blog')
    GROUP BY 1, 2""",
)
def page_links(spark, folder):
    pages = hosted_pages(spark, folder).select(
        F.col("host").alias("source_id"),
        "url",
        "html",
        F.col("page_id").alias("seq"),
        F.when(F.col("host").contains("blog"), F.array().cast("array<string>"))
        .otherwise(F.array("host"))
        .alias("allowed_domains"),
    )
    found = extract.extract_candidates(pages, date(2024, 1, 1), date(2024, 12, 31), _MARKERS)
    return found.select(
        "source_id", "detail_url", "title", F.col("first_position.page").alias("first_page")
    )


# A listing derived from each page: dated rows around its links, in a selected container.
@query(
    "listing_dates",
    f"""WITH {_SQL_ANCHORS},
    rows AS (
      SELECT *, DATE '2024-01-01' + CAST((page_id * 7 + place) % 300 AS INTEGER) AS day,
             place % 5 AS kind FROM links)
    SELECT page_id, place, strftime(
             CASE WHEN kind IN (0, 1, 2, 4) THEN day END, '%Y-%m-%d') AS published
    FROM rows""",
)
def listing_dates(spark, folder):
    pages = table(spark, folder, "pages")
    wanted = ["anchors.href", "anchors.label"]
    found = pages.withColumn("facts", html.portal_facts("html", "url", wanted)).select(
        "page_id", "url", F.posexplode("facts.anchors").alias("place", "a")
    )
    day = F.date_add(
        F.lit("2024-01-01").cast("date"),
        ((F.col("page_id") * 7 + F.col("place")) % 300).cast("int"),
    )
    text = F.date_format(day, "yyyy-M-d")
    kind = F.col("place") % 5
    link = F.concat(F.lit('<a href="'), "a.href", F.lit('">'), "a.label")
    item = (
        F.when(kind == 0, F.concat(link, F.lit(" "), text, F.lit("</a>")))
        .when(kind == 1, F.concat(link, F.lit("</a><b>x</b><span>"), text, F.lit("</span>")))
        .when(kind == 2, F.concat(F.lit("<i>"), text, F.lit("</i>"), link, F.lit("</a>")))
        # A link between the date and the item hides it; four siblings away is too far.
        .when(
            kind == 3,
            F.concat(F.lit("<i>"), text, F.lit('</i><u></u><a href="">n</a>'), link, F.lit("</a>")),
        )
        .otherwise(
            F.concat(
                link, F.lit("</a><b>1</b><b>2</b><b>3</b><b>"), text, F.lit("</b>")
            )
        )
    )
    markup = F.concat(
        F.lit('<html><body><div class="x"><ul class="list">'), F.lit("<li>"), item,
        F.lit("</ul></div>"),
    )
    listed = found.withColumn(
        "facts", html.listing_facts(markup, "url", F.array(F.lit(".x ul.list li a")), ["anchors.dates"])
    )
    return listed.select(
        "page_id",
        F.col("place").cast("long").alias("place"),
        iso(extract.listing_date(F.element_at("facts.anchors", -1)["dates"])).alias("published"),
    )


@query(
    "portal_pages",
    f"""WITH {_SQL_ANCHORS}
    SELECT page_id, {sql_norm(_SQL_DECODED.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))}
             AS page_title,
           (SELECT count(*) FROM links l WHERE l.page_id = p.page_id AND {_SQL_MARKED}) AS n_items,
           (SELECT string_agg(l.label || '=' || l.link, ' ' ORDER BY place) FROM links l
             WHERE l.page_id = p.page_id AND {_SQL_MARKED}) AS items
    FROM pages p""",
)
def portal_pages(spark, folder):
    parsed = extract.parse_portal_pages(table(spark, folder, "pages"), _MARKERS, "url")
    items = F.transform(
        "policy_items", lambda item: F.concat(item["title"], F.lit("="), item["url"])
    )
    return parsed.select(
        "page_id",
        "page_title",
        long(F.size("policy_items")).alias("n_items"),
        F.nullif(F.array_join(items, " "), F.lit("")).alias("items"),
    )


_SQL_SKIP = "'(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<!DOCTYPE[^>]*>'"


@query(
    "portal_text",
    f"""SELECT page_id, sha256({sql_norm(_SQL_DECODED.format(
        "regexp_replace(regexp_replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), "
        + _SQL_SKIP + ", '', 'g'), '<[^>]*>', ' ', 'g')"))}) AS text_hash
    FROM pages""",
)
def portal_text(spark, folder):
    from noticeloom.functions.text import content_hash

    parsed = extract.parse_portal_pages(table(spark, folder, "pages"), _MARKERS, "url")
    return parsed.select("page_id", content_hash("text_content").alias("text_hash"))


# Detail pages derived from the given pages: labelled metadata and attachments are added to them.
@query(
    "parse_pages",
    f"""WITH p AS (
      SELECT page_id, {SQL_HOST} AS host, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS root,
             DATE '2024-02-01' + CAST(page_id % 90 AS INTEGER) AS day, {_SQL_H1} AS title,
             {sql_norm(_SQL_DECODED.format(_SQL_BODY))} AS body, page_id % 3 AS kind FROM pages),
    d AS (SELECT *, CASE WHEN kind <> 2 THEN '国发〔2024〕' || page_id || '号' END AS number FROM p)
    SELECT page_id, title, number AS document_number, 'Office ' || page_id AS publisher,
           strftime(CASE WHEN kind = 0 THEN day ELSE DATE '2024-01-05' END, '%Y-%m-%d')
             AS publish_date,
           strftime(day, '%Y-%m-%d') AS effective_date,
           CASE WHEN kind = 1 THEN NULL ELSE strftime(day + 30, '%Y-%m-%d') END AS end_date,
           root || '/f/A%20b.PDF,' || root || '/f/A%20b.PDF,' || 'https://' || host || '/x.docx'
             AS attachments,
           sha256(trim(body || CASE WHEN number IS NULL THEN '' ELSE ' ' || number END))
             AS content_hash,
           CASE WHEN number IS NOT NULL
             THEN substr(sha256(host || '|document:' || number), 1, 24) END AS numbered_id
    FROM d""",
)
def parse_pages(spark, folder):
    kind = F.col("page_id") % 3
    day = F.date_add(F.lit("2024-02-01").cast("date"), (F.col("page_id") % 90).cast("int"))
    number = F.concat(F.lit("国发〔2024〕"), F.col("page_id").cast("string"), F.lit("号"))
    in_article = F.when(kind != 2, F.concat(F.lit("<p>"), number, F.lit("</p></article>"))).otherwise(
        F.lit("</article>")
    )
    end = F.when(kind == 1, F.lit("2024-02-31")).otherwise(
        F.date_format(F.date_add(day, 30), "yyyy-M-d")
    )
    meta = F.concat(
        F.lit("<dl><dd>发文机关：Office &nbsp;"),
        F.col("page_id").cast("string"),
        F.lit("</dd><dd>"),
        F.when(kind == 0, F.concat(F.lit("发布日期："), F.date_format(day, "yyyy年M月d日"))).otherwise(""),
        F.lit("</dd><dd>生效日期 "),
        F.date_format(day, "yyyy.M.d"),
        F.lit("</dd><dd>申报截止日期:"),
        end,
        F.lit(
            '</dd></dl><a href="/f/A%20b.PDF?v=1#p">a</a><a href="/f/A%20b.PDF?v=1#p">a</a>'
            '<a href="https://foreign.example/x.pdf">c</a><a href="/x.txt">d</a><a href="https://'
        ),
        "host",
        F.lit('/x.docx">e</a><footer>'),
    )
    markup = F.replace(F.replace("html", F.lit("</article>"), in_article), F.lit("<footer>"), meta)
    pages = hosted_pages(spark, folder).select(
        "page_id",
        markup.alias("html"),
        F.col("host").alias("source_id"),
        F.lit("listing title").alias("title"),
        F.col("url").alias("detail_url"),
        F.lit(date(2024, 1, 5)).alias("published_at"),
        F.array("host").alias("allowed_domains"),
    )
    links = F.transform("attachment_urls", lambda url: F.regexp_replace(url, r"\?v=1#p$", ""))
    return extract.parse_pages(pages).select(
        "page_id",
        "title",
        "document_number",
        "publisher",
        iso("publish_date").alias("publish_date"),
        iso("effective_date").alias("effective_date"),
        iso("application_end_date").alias("end_date"),
        F.array_join(links, ",").alias("attachments"),
        "content_hash",
        F.when(F.col("document_number").isNotNull(), F.col("policy_id")).alias("numbered_id"),
    )


@query(
    "parse_by_source",
    f"""SELECT page_id, CASE WHEN {SQL_HOST} = 'spam-farm.example.org' THEN 'skipped' ELSE {_SQL_H1} END
      AS title FROM pages""",
)
def parse_by_source(spark, folder):
    pages = hosted_pages(spark, folder).select(
        "page_id",
        "html",
        F.col("host").alias("source_id"),
        F.lit("").alias("title"),
        F.col("url").alias("detail_url"),
        F.lit(None).cast("date").alias("published_at"),
        F.array("host").alias("allowed_domains"),
    )

    def skipped(own):
        return own.select("page_id", F.lit("skipped").alias("title"))

    found = extract.parse_by_source(pages, {"spam-farm.example.org": skipped})
    return found.select("page_id", "title")


def _sql_list(values) -> str:
    return sql_text(" | ".join(values))


@query(
    "parser_profile",
    f"""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN {_sql_list(rules.EXTRACTION_PROFILES["miit"][1])}
             WHEN s_suppkey % 4 IN (1, 2) THEN {_sql_list(rules.GENERIC_PROFILE[1])} END AS content,
           CASE WHEN s_suppkey % 4 = 3 THEN 'no adapter: ' || s_name END AS profile_error
    FROM supplier""",
)
def parser_profile(spark, folder):
    kind = F.col("s_suppkey") % 4
    sources = table(spark, folder, "supplier").select(
        "s_suppkey",
        F.when(kind == 0, "miit").otherwise(F.col("s_name")).alias("source_id"),
        F.when(kind == 1, "discovery").otherwise("manual").alias("origin"),
        F.when(kind == 2, "generic").otherwise("v1").alias("adapter_version"),
    )
    return extract.parser_profile(sources).select(
        "s_suppkey",
        F.array_join("content_selectors", " | ").alias("content"),
        "profile_error",
    )


@query(
    "attachment_merge",
    f"""SELECT conv_id, turn // 1000 AS segment, count(*) AS n_parts,
           sha256(string_agg({sql_norm("'[附件 ' || (turn + 1) || '：' || role || '] ' || text")}, ' '
             ORDER BY turn)) AS text_hash
    FROM conversations GROUP BY 1, 2""",
)
def attachment_merge(spark, folder):
    attachments = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("policy_id"),
        (F.col("turn") + 1).alias("number"),
        F.col("role").alias("name"),
        "text",
        F.lit(None).cast("string").alias("error"),
    )
    parts = extract.attachment_parts(attachments).filter("part IS NOT NULL")
    merged = extract.merge_parts(parts, "policy_id", "number", "part")
    return merged.select(
        F.col("policy_id").alias("conv_id"),
        "segment",
        long("n_parts").alias("n_parts"),
        F.sha2("merged_text", 256).alias("text_hash"),
    )


@query(
    "merge_attachments",
    f"""WITH c AS (
      SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 'f' || turn || '.pdf'
               WHEN turn % 3 = 1 THEN 'g.DOC' ELSE 'h.docx' END AS name FROM conversations),
    d AS (SELECT conv_id,
           string_agg({sql_norm("' [附件 ' || (turn + 1) || '：' || name || '] ' || text")}, ' '
             ORDER BY turn) FILTER (turn % 3 = 0) AS body,
           string_agg(CASE WHEN turn % 3 = 1 THEN '旧版 Word .doc 附件不自动下载或解析（g.DOC）'
             ELSE '附件解析失败（h.docx）：ValueError: 附件未提取到文本，可能需要 OCR 或人工复核' END,
             ' ' ORDER BY turn) FILTER (turn % 3 <> 0) AS errors
      FROM c GROUP BY conv_id)
    SELECT conv_id, sha256('conv ' || conv_id || coalesce(' ' || body, '')) AS content_hash,
           coalesce(errors, '') AS errors FROM d""",
)
def merge_attachments(spark, folder):
    turns = table(spark, folder, "conversations")
    kind = F.col("turn") % 3
    attachments = turns.select(
        F.col("conv_id").alias("policy_id"),
        (F.col("turn") + 1).alias("number"),
        F.when(kind == 0, F.concat(F.lit("f"), F.col("turn").cast("string"), F.lit(".pdf")))
        .when(kind == 1, "g.DOC")
        .otherwise("h.docx")
        .alias("name"),
        F.when(kind != 2, F.col("text")).alias("text"),
        F.lit(None).cast("string").alias("error"),
    )
    docs = turns.select(
        F.col("conv_id").alias("policy_id"),
        F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("normalized_text"),
    ).distinct()
    return extract.merge_attachments(docs, attachments).select(
        F.col("policy_id").alias("conv_id"),
        "content_hash",
        F.array_join("attachment_errors", " ").alias("errors"),
    )


@query(
    "attachment_number",
    f"""WITH {_SQL_ANCHORS}
    SELECT page_id, place + 1 AS number, href AS name FROM links""",
)
def attachment_number(spark, folder):
    facts = html.portal_facts("html", "url", ["anchors.url"])
    pages = table(spark, folder, "pages").withColumn("facts", facts)
    listed = pages.select("page_id", F.col("facts.anchors.url").alias("attachment_urls"))
    numbered = extract.attachment_number(listed, "page_id")
    return numbered.select(
        "page_id",
        long("number").alias("number"),
        F.concat(F.lit("/"), extract.attachment_name("url", "number")).alias("name"),
    )


# ---- API payloads --------------------------------------------------------------------------------


def _list_pages(spark, folder):
    """One list payload per hundred documents: title and dates, with some unusable entries."""
    docs = notices(spark, folder).select("doc_id", "title", "source_id", "publish_date")
    entry = F.to_json(
        F.struct(
            F.col("doc_id").alias("id"),
            F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit(" "), "title")).alias("title"),
            F.concat(iso("publish_date"), F.lit(" 00:00:00")).alias("publishDate"),
        )
    )
    page = F.floor(F.col("doc_id") / 100)
    # A page holds at most a hundred entries.
    grouped = docs.select(page.alias("seq"), "doc_id", entry.alias("entry")).groupBy("seq")
    listed = grouped.agg(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))).alias("items"))
    status = F.when(F.col("seq") % 5 == 4, "0").otherwise("1")
    return listed.select(
        F.lit("api").alias("source_id"),
        "seq",
        F.concat(
            F.lit('{"status":'), status, F.lit(',"body":{"totalPage":9,"list":['),
            F.array_join("items.entry", ","), F.lit("]}}"),
        ).alias("payload"),
    )


@query(
    "api_list",
    f"""WITH {SQL_DOCS}
    SELECT title, 'https://api.example.org/detail?id=' || doc_id AS detail_url,
           strftime(publish_date, '%Y-%m-%d') AS published, doc_id // 100 AS page
    FROM notices WHERE doc_id % 7 <> 0 AND title <> '' AND (doc_id // 100) % 5 <> 4
      AND publish_date BETWEEN DATE '2024-01-20' AND DATE '2024-05-20'""",
)
def api_list(spark, folder):
    found = api.read_api_list(
        _list_pages(spark, folder),
        date(2024, 1, 20),
        date(2024, 5, 20),
        "https://api.example.org/detail",
    )
    return found.select(
        "title", "detail_url", iso("published_at").alias("published"),
        F.col("first_position.page").alias("page"),
    )


@query(
    "api_list_errors",
    """SELECT DISTINCT doc_id // 100 AS page, 'list API returned an unsuccessful status' AS error
    FROM documents WHERE (doc_id // 100) % 5 = 4""",
)
def api_list_errors(spark, folder):
    return api.api_list_errors(_list_pages(spark, folder)).select(
        F.col("seq").alias("page"), "error"
    )


@query(
    "api_detail",
    f"""WITH {SQL_DOCS}
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN title ELSE 'Detail ' || doc_id END AS title,
           CASE WHEN doc_id % 5 = 0 THEN 'N-' || doc_id END AS document_number,
           'Dept' AS publisher,
           sha256(CASE WHEN doc_id % 6 = 0 THEN '' ELSE normalized_text END) AS content_hash,
           CASE WHEN doc_id % 6 = 0 THEN '政策详情接口未返回可解析正文' ELSE '' END AS errors
    FROM notices""",
)
def api_detail(spark, folder):
    number = F.col("doc_id")
    docs = notices(spark, folder)
    empty = number % 6 == 0
    body = F.struct(
        number.alias("id"),
        F.when(number % 4 == 0, " ")
        .otherwise(F.concat(F.lit("Detail  "), number.cast("string")))
        .alias("title"),
        F.when(number % 5 == 0, F.concat(F.lit("N-"), number.cast("string"))).alias("code"),
        F.lit(" Dept").alias("department"),
        F.lit("2024-03-01").alias("publishdate"),
        F.lit(" ").alias("content_trim"),
        F.when(~empty & (number % 2 == 0), F.col("raw_text")).alias("content"),
        F.when(~empty & (number % 2 != 0), F.col("raw_text")).alias("intercontent"),
    )
    answers = docs.select(
        "doc_id",
        F.to_json(F.struct(F.lit(1).alias("status"), body.alias("body"))).alias("payload"),
        "source_id",
        "title",
        "detail_url",
        F.col("publish_date").alias("published_at"),
    )
    return api.read_api_detail(answers).select(
        "doc_id",
        "title",
        "document_number",
        "publisher",
        "content_hash",
        F.array_join("attachment_errors", ",").alias("errors"),
    )


@query(
    "unwrap_unit_html",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unit response is missing data'
             WHEN page_id % 5 = 1 THEN 'unit response is missing data.html' END AS error,
           CASE WHEN page_id % 5 > 1 THEN sha256(html) END AS html_hash,
           'p' || page_id AS column_id, '2' AS page_no FROM pages""",
)
def unwrap_unit_html(spark, folder):
    kind = F.col("page_id") % 5
    payload = (
        F.when(kind == 0, F.lit('{"data":[1]}'))
        .when(kind == 1, F.lit('{"data":{"html":" \\n"}}'))
        .otherwise(F.to_json(F.struct(F.struct("html").alias("data"))))
    )
    pages = table(spark, folder, "pages").select(
        "page_id",
        payload.alias("payload"),
        F.concat(
            F.lit("{'columnId':'p"), F.col("page_id").cast("string"), F.lit("','pageNo':2}")
        ).alias("raw_query"),
    )
    return api.unwrap_unit_html(pages).select(
        "page_id",
        "error",
        F.sha2("html", 256).alias("html_hash"),
        api.unit_query("raw_query")["columnId"].alias("column_id"),
        api.unit_query("raw_query")["pageNo"].alias("page_no"),
    )


# ---- listing rules ---------------------------------------------------------------------------------


@query(
    "restricted_stop",
    """WITH f AS (SELECT user_id, min(event_id) AS stop FROM events
                  WHERE event_type = 'error' AND value > 20 GROUP BY user_id)
    SELECT event_id, user_id, CASE WHEN stop IS NULL OR event_id < stop THEN 'kept'
             WHEN event_id = stop THEN 'restricted' ELSE 'dropped' END AS outcome
    FROM events LEFT JOIN f USING (user_id)""",
)
def restricted_stop(spark, folder):
    log = table(spark, folder, "events").select(
        "event_id", "user_id", ((F.col("event_type") == "error") & (F.col("value") > 20)).alias("hit")
    )
    return listing.stop_on_restricted(log, "user_id", "event_id", "hit").select(
        "event_id", "user_id", "outcome"
    )


@query(
    "fetch_counts",
    """WITH f AS (SELECT user_id, min(event_id) AS stop FROM events
                  WHERE event_type = 'error' AND value > 20 GROUP BY user_id),
    m AS (SELECT *, stop IS NULL OR event_id < stop AS reached FROM events LEFT JOIN f USING (user_id))
    SELECT user_id, count(*) FILTER (reached AND event_type <> 'error') AS fetched,
           count(*) FILTER (reached AND event_type = 'error') AS parse_failures,
           count(*) FILTER (event_id = stop) AS source_failures,
           count(*) FILTER (event_id > stop) AS dropped
    FROM m GROUP BY user_id""",
)
def fetch_counts(spark, folder):
    error = F.col("event_type") == "error"
    log = table(spark, folder, "events").select(
        "event_id", "user_id", (error & (F.col("value") > 20)).alias("hit"), error.alias("failed")
    )
    return listing.fetch_counts(log, "user_id", "event_id", "hit", "failed")


@query(
    "distinct_pages",
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source, md5(text)
                    ORDER BY doc_id) AS n FROM documents),
    s AS (SELECT source, min(doc_id) AS stop FROM r WHERE n > 1 GROUP BY source)
    SELECT d.source, d.doc_id FROM documents d LEFT JOIN s USING (source)
    WHERE stop IS NULL OR d.doc_id < stop""",
)
def distinct_pages(spark, folder):
    docs = table(spark, folder, "documents").select(
        "source", "doc_id", F.lit("u").alias("url"), F.col("text").alias("html")
    )
    return listing.distinct_pages(docs, "source", "doc_id").select("source", "doc_id")


@query(
    "pages_until_cutoff",
    """WITH e AS (SELECT o_custkey, o_orderkey, o_orderkey // 3000 AS page,
                         CAST(o_orderdate AS DATE) AS day FROM orders),
    s AS (SELECT o_custkey, min(page) AS stop FROM
            (SELECT o_custkey, page, min(day) AS oldest FROM e GROUP BY 1, 2)
          WHERE oldest < DATE '1997-01-01' GROUP BY 1)
    SELECT o_orderkey, o_custkey FROM e LEFT JOIN s USING (o_custkey)
    WHERE page <= 20 AND (stop IS NULL OR page <= stop)""",
)
def pages_until_cutoff(spark, folder):
    return _cutoff(spark, folder, "oldest_before", 20)


@query(
    "pages_while_current",
    """WITH e AS (SELECT o_custkey, o_orderkey, o_orderkey // 3000 AS page,
                         CAST(o_orderdate AS DATE) AS day FROM orders),
    s AS (SELECT o_custkey, min(page) AS stop FROM
            (SELECT o_custkey, page, max(day) AS newest FROM e GROUP BY 1, 2)
          WHERE newest < DATE '1997-01-01' GROUP BY 1)
    SELECT o_orderkey, o_custkey FROM e LEFT JOIN s USING (o_custkey)
    WHERE stop IS NULL OR page <= stop""",
)
def pages_while_current(spark, folder):
    return _cutoff(spark, folder, "none_current", None)


def _cutoff(spark, folder, rule, cap):
    entries = table(spark, folder, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.floor(F.col("o_orderkey") / 3000).alias("page"),
        F.col("o_orderdate").cast("date").alias("day"),
    )
    return listing.pages_until_cutoff(
        entries, date(1997, 1, 1), "o_custkey", "page", "day", rule, cap, "o_orderkey"
    ).select("o_orderkey", "o_custkey")


@query(
    "top_items",
    """SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars,
      row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5""",
)
def top_items(spark, folder):
    docs = table(spark, folder, "documents").select("source", "doc_id", "n_chars")
    return listing.top_per_group(docs, ["source"], ["doc_id"], 5).drop("place")


@query(
    "forward_fill",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER
      (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations""",
)
def forward_fill(spark, folder):
    turns = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("asked")
    )
    return fill.forward_fill(turns, "conv_id", "turn", "asked", "question").drop("asked")


@query(
    "classification_pairs",
    """WITH r AS (
      SELECT p_partkey, p_partkey % 50 = 3 AS opens, p_partkey % 2 = 0 AS paired,
             chr(CAST(65 + (p_partkey // 50) % 26 AS INTEGER)) AS letter, p_name AS name FROM part),
    s AS (SELECT *, last_value(CASE WHEN opens THEN letter END IGNORE NULLS)
            OVER (ORDER BY p_partkey) AS section FROM r),
    pairs AS (
      SELECT p_partkey, 0 AS n, letter AS code, name FROM s WHERE opens
      UNION ALL SELECT p_partkey, 0, section || lpad((p_partkey % 100)::VARCHAR, 2, '0'), name
        FROM s WHERE NOT opens AND section IS NOT NULL
      UNION ALL SELECT p_partkey, 1, section || (100 + p_partkey % 900),
                       CASE WHEN paired THEN name || ' b' ELSE name END
        FROM s WHERE NOT opens AND section IS NOT NULL)
    SELECT p_partkey AS row_no, CAST(n AS BIGINT) AS place, code, name FROM pairs""",
)
def classification_pairs(spark, folder):
    number = F.col("p_partkey")
    opens = number % 50 == 3
    letter = F.char((F.lit(65) + F.floor(number / 50) % 26).cast("int"))
    division = F.lpad((number % 100).cast("string"), 2, "0")
    group = (F.lit(100) + number % 900).cast("string")
    # One name for two codes is used for both of them, by position in each column.
    name = F.when(~opens & (number % 2 == 0), F.concat("p_name", F.lit("\n"), "p_name", F.lit(" b")))
    rows = table(spark, folder, "part").select(
        number.alias("row_no"),
        F.when(opens, letter).alias("section"),
        F.when(~opens, F.concat(F.lit(" "), division)).alias("division"),
        F.when(~opens, group).alias("group"),
        F.lit("").alias("class"),
        F.coalesce(name, F.col("p_name")).alias("name"),
    )
    pairs = fill.classification_pairs(rows)
    return pairs.select(long("seq.row_no").alias("row_no"), long("seq.n").alias("place"), "code", "name")


@query(
    "page_snapshots",
    """SELECT page_id AS snapshot_id, page_id % 3 AS copy, CASE WHEN page_id % 7 = 6 THEN 'bin' ELSE 'html' END AS extension,
      strftime(DATE '2024-05-01' + CAST(page_id % 4 AS INTEGER), '%Y-%m-%d') AS collected_on,
      CASE WHEN page_id % 7 <> 6 THEN sha256(CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '<!-- charset=gb2312 通知公告 €-->'
          ELSE '<!-- charset=utf-8 通知公告 €-->' END || html) END AS body_hash,
      CASE WHEN page_id % 3 <> 1 THEN strlen(html) + CASE page_id % 3 WHEN 0 THEN 0 ELSE strlen('<!-- charset=utf-8 通知公告 €-->') END
        END AS size
    FROM pages""",
)
def page_snapshots(spark, folder):
    """Pages as files of two kinds and two charsets, read back and decoded by the charset they declare."""
    number = F.col("page_id")
    opening = F.when(number % 3 == 0, "").when(number % 3 == 1, "<!-- charset=gb2312 通知公告 €-->")
    whole = F.concat(opening.otherwise("<!-- charset=utf-8 通知公告 €-->"), "html")
    pages = table(spark, folder, "pages").select(
        F.date_add(F.lit("2024-05-01").cast("date"), (number % 4).cast("int")).alias("collected_on"),
        number.alias("snapshot_id"),
        (number % 3).alias("copy"),
        F.when(number % 7 == 6, "bin").otherwise("html").alias("extension"),
        F.when(number % 3 == 1, _as_gb18030(whole)).otherwise(whole.cast("binary")).alias("content"),
    )
    root = scratch(spark, "snapshots")
    writers.write_snapshots(pages, root)
    found = readers.read_snapshots(spark, root)
    return found.select(
        F.col("snapshot_id").cast("long").alias("snapshot_id"),
        long("copy").alias("copy"),
        "extension",
        iso("collected_on").alias("collected_on"),
        F.sha2("body", 256).alias("body_hash"),
        # The size in the other charset has no SQL.
        F.when(F.col("copy") != 1, long("size")).alias("size"),
    )


@F.arrow_udf(T.BinaryType())
def _as_gb18030(texts: pa.Array) -> pa.Array:
    return pa.array((text.as_py().encode("gb18030") if text.is_valid else None for text in texts), pa.binary())
