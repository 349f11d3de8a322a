"""Text, URL, date and identity expressions over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from noticeloom.functions import dates, identity, text, urls
from noticeloom.workload.base import (
    SQL_DOCS,
    SQL_HOST,
    hosted_pages,
    iso,
    keyed_notices,
    long,
    notices,
    query,
    sql_any,
    sql_norm,
    sql_text,
    table,
)

_CANONICAL = (
    "regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?]utm_source=feed$', ''),"
    " '/+([?]|$)', '\\1')"
)


@query(
    "canonical_url",
    f"""WITH c AS (SELECT page_id, url, {_CANONICAL} AS canonical FROM pages)
    SELECT page_id, canonical,
           canonical || CASE WHEN contains(canonical, '?') THEN '&' ELSE '?' END
             || 'q=a+b%2A~&b=' AS canonical_variant
    FROM c""",
)
def canonical_url(spark, folder):
    base = F.regexp_replace("url", "#.*$", "")
    joiner = F.when(base.contains("?"), "&").otherwise("?")
    variant = F.concat(
        F.upper(F.substring_index(base, ":", 1)),
        F.expr("substring(regexp_replace(url, '#.*$', ''), instr(url, ':'))"),
        joiner,
        F.lit("Tracking=9&q=a b*~&UTM_x=1&b=#part"),
    )
    return table(spark, folder, "pages").select(
        "page_id",
        urls.canonical_url("url").alias("canonical"),
        urls.canonical_url(variant).alias("canonical_variant"),
    )


@query(
    "policy_id",
    f"""SELECT page_id, substr(sha256({SQL_HOST} || '|url:' || {_CANONICAL}), 1, 24) AS by_url,
           substr(sha256({SQL_HOST} || '|title-date:' || page_id || ' t|2024-05-06'), 1, 24)
             AS by_title,
           substr(sha256({SQL_HOST} || '|document:AB〔2024〕' || page_id || '号'), 1, 24) AS by_number
    FROM pages""",
)
def policy_id(spark, folder):
    number = F.col("page_id").cast("string")
    title = F.concat(F.lit(" "), number, F.lit("　t"))
    code = F.concat(F.lit("ａb ［2024］"), number, F.lit("号"))
    return hosted_pages(spark, folder).select(
        "page_id",
        identity.policy_id("host", "url", title).alias("by_url"),
        identity.policy_id(
            "host", F.lit(""), title, F.lit(date(2024, 5, 6))
        ).alias("by_title"),
        identity.policy_id("host", "url", title, None, code).alias("by_number"),
    )


@query(
    "content_hash",
    f"""SELECT doc_id, length({sql_norm("text")}) AS n_normalized,
           sha256({sql_norm("text")}) AS content_hash FROM documents""",
)
def content_hash(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        long(F.char_length(text.normalize_text("text"))).alias("n_normalized"),
        text.content_hash("text").alias("content_hash"),
    )


@query(
    "cross_source_key",
    f"""WITH {SQL_DOCS}
    SELECT doc_id, dedupe_key,
           sha256('title-date-content:' || title || '|'
                  || coalesce(strftime(publish_date, '%Y-%m-%d'), '') || '|' || content_hash)
             AS dated_key,
           sha256('document:NO.' || doc_id) AS numbered_key
    FROM notices""",
)
def cross_source_key(spark, folder):
    number = F.concat(F.lit("No. "), F.col("doc_id").cast("string"))
    return keyed_notices(spark, folder).select(
        "doc_id",
        "dedupe_key",
        identity.cross_source_key("title", "publish_date", "content_hash").alias("dated_key"),
        identity.cross_source_key("title", None, "content_hash", number).alias("numbered_key"),
    )


@query(
    "document_number",
    """SELECT p_partkey, upper(replace(p_brand, ' ', '')) || '〔20' || lpad(p_size::VARCHAR, 2, '0')
             || '〕' || p_partkey || '号' AS number
    FROM part""",
)
def document_number(spark, folder):
    wide = F.translate("p_brand", "0123456789#", "０１２３４５６７８９＃")
    raw = F.concat(
        F.lit(" "), wide, F.lit("　［20"), F.lpad(F.col("p_size").cast("string"), 2, "0"),
        F.lit("］ "), F.col("p_partkey").cast("string"), F.lit("号"),
    )
    return table(spark, folder, "part").select(
        "p_partkey", text.normalize_document_number(raw).alias("number")
    )


@query(
    "loose_date",
    """WITH parts AS (
      SELECT o_orderkey, year(o_orderdate) + 20 AS y, month(o_orderdate) AS m,
             day(o_orderdate) AS d, o_orderkey % 7 = 0 AS broken FROM orders)
    SELECT o_orderkey,
           CASE WHEN NOT broken THEN strftime(make_date(y, m, d), '%Y-%m-%d') END AS found,
           CASE WHEN NOT broken THEN strftime(make_date(y, m, d), '%Y-%m-%d') END AS prefix
    FROM parts""",
)
def loose_date(spark, folder):
    year = (F.year("o_orderdate") + 20).cast("string")
    month = F.month("o_orderdate") + F.when(F.col("o_orderkey") % 7 == 0, 12).otherwise(0)
    day = F.dayofmonth("o_orderdate").cast("string")
    first = F.element_at(
        F.array(*[F.lit(mark) for mark in "-/.年"]), (F.col("o_orderkey") % 4 + 1).cast("int")
    )
    second = F.element_at(
        F.array(*[F.lit(mark) for mark in "-/.月"]), (F.col("o_orderkey") % 4 + 1).cast("int")
    )
    loose = F.concat(F.lit("on 19-1-1: "), year, first, month.cast("string"), second, day)
    strict = F.concat_ws(
        "-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")
    )
    return table(spark, folder, "orders").select(
        "o_orderkey",
        iso(dates.loose_date(loose)).alias("found"),
        iso(dates.iso_date_prefix(F.concat(strict, F.lit("T10:00:00")))).alias("prefix"),
    )


@query(
    "labelled_dates",
    """WITH parts AS (
      SELECT o_orderkey, make_date(year(o_orderdate) + 20, month(o_orderdate), day(o_orderdate)) AS v,
             o_orderkey % 5 AS kind FROM orders)
    SELECT o_orderkey,
           CASE WHEN kind IN (0, 1) THEN strftime(v, '%Y-%m-%d') END AS publish_date,
           CASE WHEN kind = 3 THEN strftime(v, '%Y-%m-%d') END AS application_end_date,
           CASE WHEN kind <> 4 THEN 'Office ' || o_orderkey END AS publisher
    FROM parts""",
)
def labelled_dates(spark, folder):
    shifted = F.add_months(F.col("o_orderdate").cast("date"), 240)
    day = F.date_format(shifted, "yyyy-M-d")
    kind = F.col("o_orderkey") % 5
    office = F.concat(F.lit("\n发文机关： Office  "), F.col("o_orderkey").cast("string"), F.lit("\n"))
    body = (
        F.when(kind == 0, F.concat(F.lit("发布日期："), day, office))
        .when(kind == 1, F.concat(F.lit("印发日期 "), day, F.lit(" 发布机构"), office))
        # The first label that has a date ends the search, even when that date is invalid.
        .when(kind == 2, F.concat(F.lit("发布时间: 2024-13-01 发布日期："), day, office))
        .when(kind == 3, F.concat(F.lit("申请截止日期 : "), day, office))
        .otherwise(F.concat(F.lit("日期 "), day))
    )
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", body.alias("body"))
        .select(
            "o_orderkey",
            iso(dates.labelled_date("body", ("发布时间", "发布日期", "印发日期"))).alias("publish_date"),
            iso(dates.labelled_date("body", ("申报截止日期", "申请截止日期"))).alias(
                "application_end_date"
            ),
            dates.publisher("body").alias("publisher"),
        )
    )


@query(
    "timing_reason",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 3 = 0 THEN '政策时效信息不明确'
           WHEN l_partkey % 3 <> 0 AND l_suppkey % 3 <> 0 AND l_suppkey % 3 < l_partkey % 3
             THEN '政策日期存在矛盾' END AS reason
    FROM lineitem""",
)
def timing_reason(spark, folder):
    shipped = F.col("l_shipdate").cast("date")

    def day(value):
        return F.when(value != 0, F.date_add(shipped, value.cast("int")))

    start, end = day(F.col("l_partkey") % 3), day(F.col("l_suppkey") % 3)
    nothing = F.lit(None).cast("date")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        dates.timing_reason(nothing, nothing, start, end).alias("reason"),
    )


@query(
    "date_window",
    """SELECT o_orderkey, o_custkey FROM orders
    WHERE o_orderkey % 13 = 0 OR (CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-01'
      AND DATE '1998-09-30')""",
)
def date_window(spark, folder):
    orders = table(spark, folder, "orders")
    day = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate").cast("date"))
    inside = dates.date_window(day, date(1998, 3, 1), date(1998, 9, 30))
    return orders.filter(inside).select("o_orderkey", "o_custkey")


@query(
    "first_nonblank",
    f"""SELECT conv_id, turn,
           CASE WHEN turn % 3 = 1 AND {sql_norm("text")} <> '' THEN {sql_norm("text")}
                WHEN turn % 3 = 2 THEN role ELSE '' END AS chosen
    FROM conversations""",
)
def first_nonblank(spark, folder):
    kind = F.col("turn") % 3
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        text.first_nonblank(
            F.lit(" 　\n"), F.when(kind == 1, F.col("text")), F.when(kind == 2, F.col("role"))
        ).alias("chosen"),
    )


@query(
    "source_priority",
    f"""WITH {SQL_DOCS}
    SELECT doc_id, CASE WHEN priority = 0 THEN 0 WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END AS priority
    FROM notices""",
)
def source_priority(spark, folder):
    name = F.when(
        F.col("doc_id") % 5 == 0, F.concat("source_name", F.lit(" 人民政府"))
    ).otherwise(F.col("source_name"))
    return notices(spark, folder).select(
        "doc_id", identity.source_priority("publisher", name).cast("long").alias("priority")
    )


_TIERS = ((15, ("tion that", "queaux")), (8, ("and the", "der die")))
_LEASE = ((30, ("click", "purchase")), (15, ("view",)))


@query(
    "support_strength",
    f"""SELECT doc_id, CASE WHEN {sql_any("text", _TIERS[0][1])} THEN 15
             WHEN {sql_any("text", _TIERS[1][1])} THEN 8 ELSE 3 END AS support
    FROM documents""",
)
def support_strength(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", long(text.support_strength("text", _TIERS)).alias("support")
    )


@query(
    "leasing_strength",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 30
             WHEN event_type = 'view' THEN 15 WHEN event_id % 10 = 0 THEN 0 ELSE 5 END AS leasing
    FROM events""",
)
def leasing_strength(spark, folder):
    quiet = (F.col("event_id") % 10 == 0) & F.col("event_type").isin("error", "signup")
    scenarios = F.when(quiet, F.array(F.lit(" "))).otherwise(F.array(F.lit("a"), "event_type"))
    return table(spark, folder, "events").select(
        "event_id", long(text.leasing_strength(scenarios, _LEASE)).alias("leasing")
    )


_PROMISES, _BENEFITS = ("that", "leaux", "nicht"), ("the", "que", "sch")
_AUTHORITIES, _FINANCE, _BACKSTOP = ("and", "les"), ("for", "pour"), ("with", "avec")
_PHRASES = ("tion of", "der ein")


def _sql_flagged(column: str) -> str:
    near = text.overpromise_pattern(_PROMISES, _BENEFITS)
    back = text.backstop_pattern(_AUTHORITIES, _FINANCE, _BACKSTOP)
    return (
        f"({sql_any(column, _PHRASES)} OR regexp_matches({column}, {sql_text(near)})"
        f" OR regexp_matches({column}, {sql_text(back)}))"
    )


@query(
    "script_compliance",
    f"""SELECT conv_id, turn, {sql_norm("text")} <> '' AND NOT {_sql_flagged("text")} AS compliant
    FROM conversations""",
)
def script_compliance(spark, folder):
    compliant = text.is_compliant_script(
        "text", _PROMISES, _BENEFITS, _AUTHORITIES, _FINANCE, _BACKSTOP, _PHRASES
    )
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", compliant.alias("compliant")
    )


@query(
    "append_disclaimer",
    """SELECT conv_id, turn, 'x ' || role || turn || chr(10) || chr(10) || 'For reference only.'
         AS script FROM conversations""",
)
def append_disclaimer(spark, folder):
    script = F.concat(F.lit("　x "), "role", F.col("turn").cast("string"), F.lit(" \n"))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", text.append_disclaimer(script, "For reference only.").alias("script")
    )


@query(
    "title_filter",
    f"""WITH {SQL_DOCS}
    SELECT doc_id, title FROM docs WHERE length(title) >= 4 AND {sql_any("title", ("the", "eau"))}""",
)
def title_filter(spark, folder):
    return (
        notices(spark, folder)
        .filter(text.title_filter("title", ("the", "eau")))
        .select("doc_id", "title")
    )


@query(
    "text_search",
    f"""WITH {SQL_DOCS}
    SELECT doc_id, source_id FROM notices
    WHERE contains(replace(lower(concat_ws(' ', title, publisher, '', normalized_text)), 'ß', 'ss'), 'the an')""",
)
def text_search(spark, folder):
    columns = ["title", "publisher", F.lit(None).cast("string"), "normalized_text"]
    return (
        notices(spark, folder)
        .filter(text.search(" The AN ", columns))
        .select("doc_id", "source_id")
    )


@query(
    "text_search_folded",
    f"""WITH {SQL_DOCS}
    SELECT doc_id, source_id FROM notices
    WHERE contains(replace(lower(concat_ws(' ', title, normalized_text)), 'ß', 'ss'), 'enss')""",
)
def text_search_folded(spark, folder):
    """A query in capitals finds the German sharp s as two letters."""
    hit = text.search("ENSS", ["title", "normalized_text"])
    return notices(spark, folder).filter(hit).select("doc_id", "source_id")


@query(
    "text_search_source",
    f"""WITH {SQL_DOCS}
    SELECT doc_id, title FROM notices WHERE source_id = 'src7'
      AND contains(lower(title || ' ' || publisher), 'src1')""",
)
def text_search_source(spark, folder):
    hit = text.search("SRC1", ["title", "publisher"], "source_id", "src7")
    return notices(spark, folder).filter(hit).select("doc_id", "title")


@query(
    "evidence_location",
    f"""WITH n AS (SELECT doc_id, {sql_norm("text")} AS t,
           {sql_norm("substr(text, 1 + CAST(doc_id * 37 % greatest(length(text) - 30, 1) AS BIGINT), 30)")} AS q FROM documents)
    SELECT doc_id, CASE WHEN q <> '' AND strpos(t, q) > 0 THEN '正文字符' || strpos(t, q) || '-'
             || (strpos(t, q) + length(q) - 1) END AS location,
           CAST(NULL AS VARCHAR) AS missing
    FROM n""",
)
def evidence_location(spark, folder):
    quote = F.expr("substring(text, 1 + cast(doc_id * 37 % greatest(char_length(text) - 30, 1) as int), 30)")
    body = text.normalize_text("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        text.evidence_location(body, text.normalize_text(quote)).alias("location"),
        text.evidence_location(body, F.lit("not in any text ☃")).alias("missing"),
    )


_TEMPLATE = (
    " Text: {{document_text}}\nCodes: {{industry_catalog}} {{business_tags}}\n{{json_schema}} "
)


@query(
    "render_prompt",
    """SELECT doc_id, sha256('Text: ' || text || ' T [x]' || chr(10) || 'Codes: {A: [x]} [x]'
             || chr(10) || '{}') AS prompt_hash FROM documents""",
)
def render_prompt(spark, folder):
    marked = F.concat("text", F.lit(" T {{business_tags}}"))
    prompt = text.render_prompt(marked, "{A: {{business_tags}}}", "[x]", "{}", _TEMPLATE)
    return table(spark, folder, "documents").select(
        "doc_id", F.sha2(prompt, 256).alias("prompt_hash")
    )


@query(
    "template_missing",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '用户提示词模板不能为空'
             WHEN turn % 3 = 1 THEN '{{industry_catalog}},{{json_schema}}' ELSE '' END AS missing
    FROM conversations""",
)
def template_missing(spark, folder):
    kind = F.col("turn") % 3
    template = (
        F.when(kind == 0, F.lit(" \n"))
        .when(kind == 1, F.concat("text", F.lit("{{document_text}}{{business_tags}}")))
        .otherwise(F.concat("text", F.lit(_TEMPLATE)))
    )
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.array_join(text.template_missing_column(template), ",").alias("missing"),
    )


@query(
    "allowed_host",
    f"""SELECT page_id, {SQL_HOST} AS host FROM pages
    WHERE regexp_matches({SQL_HOST}, '^[a-z]+[.]example[.]org$')
       OR {SQL_HOST} = 'spam-farm.example.org'""",
)
def allowed_host(spark, folder):
    pages = hosted_pages(spark, folder)
    own = F.regexp_extract("host", r"^([a-z]+\.example\.org)$", 1)
    domains = F.array(own, F.lit("spam-farm.example.org"))
    return pages.filter(urls.allowed_host("url", domains)).select("page_id", "host")


@query(
    "safe_url",
    """SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^(https?://[^/]+)',
             '\\1:8443') AS safe FROM pages""",
)
def safe_url(spark, folder):
    secret = F.regexp_replace("url", r"^(https?)://([^/?#]+)", "$1://User:p@$2:8443")
    return table(spark, folder, "pages").select("page_id", urls.safe_url(secret).alias("safe"))


@query(
    "valid_links",
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'ftp://a、note'
             ELSE url || chr(10) || 'https://b.example/x' END AS links FROM pages""",
)
def valid_links(spark, folder):
    cell = F.when(F.col("page_id") % 4 == 0, F.lit("ftp://a、note")).otherwise(
        F.concat("url", F.lit("；ftp://a、 https://b.example/x \n;mailto:c、https://"))
    )
    return table(spark, folder, "pages").select("page_id", urls.valid_links(cell).alias("links"))


@query(
    "url_hosts",
    f"""SELECT page_id, CASE WHEN {SQL_HOST} = 'a.example.org' THEN 'a.example.org'
             ELSE {SQL_HOST} || ',a.example.org' END AS hosts FROM pages""",
)
def url_hosts(spark, folder):
    links = F.array("url", F.lit("https://A.example.org:443/x"), F.upper("url"), F.lit("no url"))
    return table(spark, folder, "pages").select(
        "page_id", F.array_join(urls.url_hosts(links), ",").alias("hosts")
    )


@query(
    "gov_domain",
    f"""SELECT {SQL_HOST} AS host, count(*) AS n_pages, {SQL_HOST} LIKE '%.example.org' AS official
    FROM pages GROUP BY 1""",
)
def gov_domain(spark, folder):
    hosts = hosted_pages(spark, folder).groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    return hosts.withColumn("official", urls.is_gov_domain("host", ".example.org"))


@query(
    "robots_allows",
    """SELECT page_id, NOT (regexp_matches(url, '^[a-z]+://[^/]+/(en|d)')) AS allowed FROM pages""",
)
def robots_allows(spark, folder):
    raw = F.lit("User-agent: x\r\nAllow: /\n disallow:  /en \nDISALLOW:/d\rDisallow:\n#Disallow: /")
    return table(spark, folder, "pages").select(
        "page_id", urls.robots_allows(raw, urls.path("url")).alias("allowed")
    )


@query(
    "restricted_reason",
    f"""WITH p AS (SELECT page_id, lower(html) AS low, {SQL_HOST} AS host FROM pages)
    SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'http_403'
             WHEN host LIKE '%.net' THEN 'cross_domain'
             WHEN contains(low, 'class="ad"') AND (contains(low, 'than') OR contains(low, 'leaux'))
               THEN 'login'
             WHEN contains(low, 'cheap') OR contains(low, 'eauou') THEN 'captcha' END AS reason,
           page_id % 9 = 0 OR contains(low, 'eauou') AS fetch_restricted
    FROM p""",
)
def restricted_reason(spark, folder):
    status = F.when(F.col("page_id") % 9 == 0, 403).otherwise(200)
    domains = F.when(F.col("host").endswith(".net"), F.array().cast("array<string>")).otherwise(
        F.array("host")
    )
    reason = urls.restricted_reason(
        status,
        "html",
        "host",
        domains,
        login_words=("than", "LEAUX"),
        captcha_markers=("Cheap", "eauou"),
        password_word='class="ad"',
    )
    return hosted_pages(spark, folder).select(
        "page_id",
        reason.alias("reason"),
        urls.fetch_restricted(status, "html", markers=("EAUOU",)).alias("fetch_restricted"),
    )
