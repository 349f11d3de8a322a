"""Keyword matches, checks, importance and candidate sources over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from noticeloom.operators import discovery, extract, listing, reports
from noticeloom.operators.keywords import keyword_links
from noticeloom.plans.search_sources import search_sources
from noticeloom.workload.base import (
    SQL_DOCS,
    SQL_HOST,
    hosted_pages,
    long,
    notices,
    query,
    sql_any,
    sql_norm,
    table,
)
from noticeloom.workload.extraction import _MARKERS, _SQL_ANCHORS, _SQL_MARKED, _SQL_SKIP
from noticeloom.workload.dedupe import _SQL_DECODED

_WORDS = ("nicht", "queaux", "tion", "hain")


def _sql_hits(*texts: str) -> str:
    cases = ", ".join(
        "CASE WHEN " + " OR ".join(f"contains({text}, '{word}')" for text in texts)
        + f" THEN '{word}' END"
        for word in sorted(_WORDS)
    )
    return f"list_filter([{cases}], lambda w: w IS NOT NULL)"


@query(
    "keyword_hits",
    f"""SELECT doc_id, source, array_to_string({_sql_hits("text")}, ',') AS hits
    FROM documents WHERE {sql_any("text", _WORDS)}""",
)
def keyword_hits(spark, folder):
    hits = discovery.keyword_hits("text", _WORDS)
    found = table(spark, folder, "documents").select("doc_id", "source", hits.alias("hits"))
    return found.filter(F.size("hits") > 0).withColumn("hits", F.array_join("hits", ","))


_SQL_TEXT = _SQL_DECODED.format(
    f"regexp_replace(regexp_replace(html, {_SQL_SKIP}, '', 'g'), '<[^>]*>', ' ', 'g')"
)
_SQL_MATCHES = f"""{_SQL_ANCHORS},
texts AS (SELECT page_id, {_SQL_TEXT} AS body FROM pages),
m AS (SELECT l.host, l.page_id, l.place, l.label, l.link,
             {_sql_hits("body", "label")} AS hits
      FROM links l JOIN texts USING (page_id) WHERE {_SQL_MARKED}),
top AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, place) AS n
        FROM m WHERE len(hits) > 0 QUALIFY n <= 5)"""


def _matches(spark, folder, words=_WORDS):
    pages = extract.parse_portal_pages(hosted_pages(spark, folder), _MARKERS, "url")
    return discovery.match_keywords(
        pages, words, "host", "policy_items", "text_content", ("page_id",)
    )


@query(
    "keyword_match",
    f"""WITH {_SQL_MATCHES}
    SELECT host, page_id, label AS title, link AS url, array_to_string(hits, ',') AS hits, n AS place
    FROM top""",
)
def keyword_match(spark, folder):
    return _matches(spark, folder).select(
        "host",
        "page_id",
        "title",
        "url",
        F.array_join("matched_keywords", ",").alias("hits"),
        long("place").alias("place"),
    )


@query(
    "keyword_match_all",
    f"""WITH {_SQL_ANCHORS}, m AS (SELECT host, page_id, label, row_number() OVER
        (PARTITION BY host ORDER BY page_id, place) AS n FROM links WHERE {_SQL_MARKED})
    SELECT host, page_id, label AS title FROM m WHERE n <= 5""",
)
def keyword_match_all(spark, folder):
    return _matches(spark, folder, ()).select("host", "page_id", "title")


_FIRST_WORD = r"[^\x20\x09-\x0D]+"
_SQL_PACK = f"""pack AS (
  SELECT DISTINCT lang, unnest([word, left(word, 2), left(word, 1)]) AS kw
  FROM (SELECT lang, regexp_extract(text, '{_FIRST_WORD}') AS word FROM documents))"""


def _pack(spark, folder):
    """Every document's first word, its first two letters and its first one, tagged by language."""
    docs = table(spark, folder, "documents")
    word = F.regexp_extract("text", f"({_FIRST_WORD})", 1)
    words = docs.select(F.col("lang").alias("tag"), word.alias("word")).filter("word <> ''")
    parts = F.array("word", F.left("word", F.lit(2)), F.left("word", F.lit(1)))
    return words.select("tag", F.explode(parts).alias("text"))


@query(
    "keyword_table",
    f"""WITH {_SQL_PACK}, k AS (SELECT DISTINCT kw FROM pack WHERE kw <> '')
    SELECT doc_id, count(*) AS n_hits, sha256(string_agg(kw, ',' ORDER BY kw)) AS hits_sha256
    FROM documents JOIN k ON contains(text, kw) GROUP BY doc_id""",
)
def keyword_table(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = keyword_links(docs, _pack(spark, folder), ["doc_id"])
    return found.select(
        "doc_id", F.size("hits").cast("long").alias("n_hits"), F.sha2(F.array_join("hits", ","), 256).alias("hits_sha256")
    )


@query(
    "keyword_table_match",
    f"""WITH {_SQL_ANCHORS}, {_SQL_PACK}, k AS (SELECT DISTINCT kw FROM pack WHERE kw <> '' AND lang = 'fr'),
    texts AS (SELECT page_id, {_SQL_TEXT} AS body FROM pages),
    m AS (SELECT l.host, l.page_id, l.place, l.label, l.link, array_agg(DISTINCT kw ORDER BY kw) AS hits
          FROM links l JOIN texts USING (page_id) JOIN k ON contains(body, kw) OR contains(label, kw)
          WHERE {_SQL_MARKED} GROUP BY ALL)
    SELECT host, page_id, label AS title, link AS url, sha256(array_to_string(hits, ',')) AS hits_sha256,
           row_number() OVER (PARTITION BY host ORDER BY page_id, place) AS place
    FROM m QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id, place) <= 5""",
)
def keyword_table_match(spark, folder):
    pages = extract.parse_portal_pages(hosted_pages(spark, folder), _MARKERS, "url")
    pack = discovery.chosen_keywords(_pack(spark, folder), ["fr"])
    found = discovery.match_keywords(pages, pack, "host", "policy_items", "text_content", ("page_id",))
    joined = F.sha2(F.array_join("matched_keywords", ","), 256).alias("hits_sha256")
    return found.select("host", "page_id", "title", "url", joined, long("place").alias("place"))


@query(
    "distinct_keywords",
    f"""WITH {_SQL_MATCHES}, w AS (SELECT DISTINCT host, unnest(hits) AS word FROM top)
    SELECT host, string_agg(word, ',' ORDER BY word) AS keywords FROM w GROUP BY host""",
)
def distinct_keywords(spark, folder):
    words = discovery.distinct_keywords(_matches(spark, folder), "host")
    return words.withColumn("keywords", F.array_join("keywords", ","))


@query(
    "distinct_tags",
    "SELECT event_type AS tag, min(event_id) AS first_seen FROM events GROUP BY event_type",
)
def distinct_tags(spark, folder):
    events = table(spark, folder, "events").select(F.col("event_type").alias("tag"), "event_id")
    return discovery.distinct_tags(events, "event_id")


@query(
    "selection",
    """SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events
    WHERE event_type IN ('click', 'view') GROUP BY event_type""",
)
def selection(spark, folder):
    events = table(spark, folder, "events")
    chosen = events.filter(
        discovery.selected("event_type", ("click", "view"))
        & discovery.selected("user_id", None)
    )
    return chosen.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users")
    )


_LEASE, _FINANCE, _INDUSTRY = ("queaux", "nicht"), ("tion", "sch"), ("the", "eau")


@query(
    "signal_density",
    f"""WITH {SQL_DOCS},
    c AS (SELECT source_id, count(*) AS samples,
                 count(*) FILTER ({sql_any("title", _LEASE + _FINANCE)}) AS hits
          FROM docs GROUP BY 1)
    SELECT source_id, samples, hits,
           CASE WHEN hits / samples >= 0.6 THEN 20 WHEN hits / samples >= 0.3 THEN 10 ELSE 5 END
             AS points
    FROM c""",
)
def signal_density(spark, folder):
    found = discovery.signal_density(
        notices(spark, folder), "source_id", "title", _LEASE + _FINANCE
    )
    return found.withColumn("points", long("points"))


_SQL_LISTED = f"""{SQL_DOCS},
five AS (SELECT source_id, doc_id, title FROM docs
         QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY doc_id) <= 5),
per AS (SELECT source_id, string_agg(title, '' ORDER BY doc_id) AS blob, count(*) AS n,
               count(*) FILTER ({sql_any("title", _LEASE + _FINANCE)}) AS hits,
               CAST(substr(source_id, 4) AS INTEGER) AS k
        FROM five GROUP BY source_id)"""


@query(
    "importance_score",
    f"""WITH {_SQL_LISTED},
    d AS (SELECT *, CASE k % 4 WHEN 0 THEN 30 WHEN 1 THEN 20 ELSE 10 END AS admin,
        CASE WHEN {sql_any("blob", _LEASE)} THEN 25 WHEN {sql_any("blob", _FINANCE)} THEN 15
             WHEN {sql_any("blob", _INDUSTRY)} THEN 10 ELSE 5 END AS rel,
        CASE WHEN hits / n >= 0.6 THEN 20 WHEN hits / n >= 0.3 THEN 10 ELSE 5 END AS dens,
        CASE k % 3 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 0 END AS acc,
        CASE WHEN k % 2 = 0 THEN 5 ELSE 0 END AS gov FROM per),
    t AS (SELECT *, admin + rel + dens + 5 + acc + gov AS total FROM d)
    SELECT source_id, total AS score,
           CASE WHEN total >= 80 THEN '高' WHEN total >= 60 THEN '中' ELSE '低' END AS level,
           admin || ',' || rel || ',' || dens || ',5,' || acc || ',' || gov AS parts,
           '样例密度 ' || CAST(floor(hits / n * 100) AS BIGINT) || '%（'
             || CASE dens WHEN 20 THEN '高' WHEN 10 THEN '中' ELSE '低' END || '）+' || dens
             AS density_reason
    FROM t""",
)
def importance_score(spark, folder):
    five = listing.top_per_group(
        notices(spark, folder).select("source_id", "doc_id", "title"), ["source_id"], ["doc_id"], 5
    )
    sources = five.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "title"))).alias("s")
    )
    k = F.substring("source_id", 4, 9).cast("int")
    score = discovery.importance_score(
        F.when(k % 4 == 0, "国家").when(k % 4 == 1, "省").otherwise("区"),
        F.when(k % 2 == 0, "www.x.gov.cn").otherwise("gov.cn.example"),
        F.lit(None).cast("string"),
        F.col("s.title"),
        F.when(k % 3 == 0, "pass").when(k % 3 == 1, "needs_attention").otherwise("other"),
        _LEASE,
        _FINANCE,
        _INDUSTRY,
    )
    scored = sources.select("source_id", score.alias("r"))
    parts = F.transform("r.score_breakdown", lambda item: item["score"].cast("string"))
    return scored.select(
        "source_id",
        F.col("r.priority_score").alias("score"),
        F.col("r.priority_level").alias("level"),
        F.array_join(parts, ",").alias("parts"),
        F.col("r.score_breakdown")[2]["reason"].alias("density_reason"),
    )


@query(
    "compliance_check",
    f"""WITH p AS (SELECT page_id, {SQL_HOST} AS host,
           CASE WHEN page_id % 8 = 0 THEN 404 ELSE 200 END AS status,
           CASE page_id % 11 WHEN 0 THEN 'login' WHEN 1 THEN 'captcha' WHEN 2 THEN 'http_404' END AS why
         FROM pages),
    r AS (SELECT *, CASE WHEN host NOT LIKE '%.org' OR why IN ('login', 'captcha')
             OR page_id % 7 = 0 OR status <> 200 THEN 'not_recommended'
             WHEN page_id % 5 < 3 OR page_id % 6 = 0 THEN 'needs_attention' ELSE 'pass' END AS result
          FROM p)
    SELECT page_id, result, CASE result WHEN 'pass' THEN '建议启用'
             WHEN 'needs_attention' THEN '需人工关注' ELSE '不建议' END AS advice,
           CASE WHEN host LIKE '%.org' THEN 'gov' ELSE 'other' END AS owner FROM r""",
)
def compliance_check(spark, folder):
    number = F.col("page_id")
    check = discovery.compliance_check(
        F.col("host"),
        F.when(number % 8 == 0, 404).otherwise(200),
        F.when(number % 11 == 0, "login").when(number % 11 == 1, "captcha").when(
            number % 11 == 2, "http_404"
        ),
        number % 7 != 0,
        F.when(number % 6 == 0, "120"),
        number % 5,
        ".org",
    )
    return hosted_pages(spark, folder).select("page_id", check.alias("c")).select(
        "page_id",
        F.col("c.check_result").alias("result"),
        F.col("c.recommendation").alias("advice"),
        F.col("c.check_details.domain_owner").alias("owner"),
    )


# ---- the whole discovery flow: every page is the entry page of a portal -----------------------------


def _searched(spark, folder):
    first = hosted_pages(spark, folder).select(
        F.concat_ws("/", "host", F.col("page_id").cast("string")).alias("portal_id"),
        "host", "page_id", "url", "html",
    )
    number = F.col("page_id")
    # Every other portal is a government's.
    domain = F.when(number % 2 == 0, F.concat("host", F.lit(".gov.cn"))).otherwise(F.col("host"))
    # The title rule looks for the default markers: put one in front of every link text.
    fetches = first.select(
        "portal_id",
        F.when(number % 9 == 0, 503).otherwise(200).alias("status_code"),
        F.when(number % 10 == 3, F.lit("https://elsewhere.example/"))
        .otherwise(F.replace("url", "host", domain))
        .alias("final_url"),
        F.regexp_replace("html", r'(<a href="[^"]*">)', "$1通知").alias("html"),
        F.when(number % 13 == 5, "timed out").alias("error"),
        F.lit("User-agent: *\nDisallow: /fr").alias("robots_txt"),
        F.when(number % 4 == 2, "30").alias("retry_after"),
        F.lit("").alias("snapshot_path"),
        number.alias("page_seq"),
    )
    portals = first.select(
        "portal_id",
        F.col("host").alias("display_name"),
        F.lit("r").alias("region"),
        F.concat(F.lit("https://"), domain, F.lit("/")).alias("entry_url"),
        F.lit("省").alias("admin_level"),
        domain.alias("gov_domain"),
    )
    # Keyword pack: the two-letter openings of the reference passages, bounded by the alphabet.
    keywords = table(spark, folder, "benchmark").select(
        F.concat(F.lower(F.substring("text", 1, 2)), F.lit("tion")).alias("text"),
        F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("tag"),
    )
    registry = table(spark, folder, "supplier").select(
        F.col("s_name").alias("source_id"), F.lit("verified").alias("phase")
    )
    return search_sources(
        portals, fetches, keywords, registry, date(2024, 7, 1), tags=("even",)
    )


_SQL_SEARCH = f"""{_SQL_ANCHORS},
texts AS (SELECT page_id, {_SQL_TEXT} AS body, html FROM pages),
firsts AS (SELECT {SQL_HOST} || '/' || page_id AS host, page_id FROM pages),
words AS (SELECT DISTINCT lower(substr(text, 1, 2)) || 'tion' AS word FROM benchmark
          WHERE item_id % 2 = 0),
state AS (SELECT host, page_id, CASE WHEN page_id % 13 = 5 THEN 'error'
    WHEN page_id % 9 = 0 OR page_id % 10 = 3 OR (contains(lower(html), 'password')
      AND contains(lower(html), 'login')) OR contains(lower(html), 'captcha') THEN 'restricted'
    ELSE 'ok' END AS status FROM firsts JOIN texts USING (page_id)),
hits AS (SELECT s.host, s.page_id, l.place, l.label, l.link, list_sort(list(DISTINCT word)) AS found
         FROM state s JOIN texts t USING (page_id) JOIN links l USING (page_id)
         JOIN words w ON contains(t.body, word) OR contains(l.label, word)
         WHERE status = 'ok' AND l.label <> '' GROUP BY ALL),
five AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY place) AS n FROM hits QUALIFY n <= 5),
per AS (SELECT host, count(*) AS n FROM five GROUP BY host)"""


@query(
    "portal_candidates",
    f"""WITH {_SQL_SEARCH},
    kw AS (SELECT host, string_agg(word, ',' ORDER BY word) AS keywords FROM
           (SELECT DISTINCT host, unnest(found) AS word FROM five) GROUP BY host)
    SELECT host AS source_id, n AS samples, keywords,
           CASE WHEN page_id % 2 = 1 OR starts_with(path, '/fr') THEN 'not_recommended' WHEN n < 3 OR page_id % 4 = 2 THEN 'needs_attention'
                ELSE 'pass' END AS check_result,
           '候选' AS marker FROM per JOIN kw USING (host) JOIN firsts USING (host)
           JOIN (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages) USING (page_id)""",
)
def portal_candidates(spark, folder):
    found = _searched(spark, folder)["candidates"]
    return found.select(
        "source_id",
        long(F.size("discovery.sample_policies")).alias("samples"),
        F.array_join("discovery.keywords", ",").alias("keywords"),
        F.col("discovery.check_result").alias("check_result"),
        F.when((F.col("phase") == "candidate") & ~F.col("enabled"), "候选").alias("marker"),
    )


@query(
    "portal_status",
    f"""WITH {_SQL_SEARCH}
    SELECT host AS portal_id, status, CASE WHEN status = 'ok' THEN coalesce(n, 0) ELSE 0 END
             AS policies_found,
           CASE WHEN status = 'error' THEN 'exception' WHEN status = 'ok' THEN NULL
                WHEN page_id % 9 = 0 THEN 'http_503' WHEN page_id % 10 = 3 THEN 'cross_domain'
                ELSE 'other' END AS reason
    FROM state LEFT JOIN per USING (host)""",
)
def portal_status(spark, folder):
    status = _searched(spark, folder)["status"]
    return status.select(
        "portal_id",
        "status",
        "policies_found",
        F.when(F.col("reason").isin("login", "captcha"), "other")
        .otherwise(F.col("reason"))
        .alias("reason"),
    )


@query(
    "discovery_report",
    f"""WITH {_SQL_SEARCH},
    s AS (SELECT status, CASE WHEN status = 'ok' THEN coalesce(n, 0) ELSE 0 END AS found
          FROM state LEFT JOIN per USING (host))
    SELECT count(*) AS portals_scanned, CAST(sum(found) AS BIGINT) AS policies_extracted,
           count(*) FILTER (found > 0) AS candidates_found,
           count(*) FILTER (status = 'restricted') AS restricted_stopped,
           (SELECT count(*) FROM supplier) + count(*) FILTER (found > 0) AS registry_rows
    FROM s""",
)
def discovery_report(spark, folder):
    found = _searched(spark, folder)
    registry = reports.stage_counts(registry=found["registry"])
    totals = found["report"].drop("keywords_used")
    # Both sides are one row; stacking and folding them avoids a join without a key.
    stacked = totals.unionByName(
        registry.select(F.col("n").alias("registry_rows")), allowMissingColumns=True
    )
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


@query(
    "top_titles",
    f"""WITH {SQL_DOCS}
    SELECT source_id, string_agg({sql_norm("title")}, '|' ORDER BY doc_id) AS titles FROM
      (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY doc_id) <= 5)
    GROUP BY source_id""",
)
def top_titles(spark, folder):
    five = listing.top_per_group(
        notices(spark, folder).select("source_id", "doc_id", "title"), ["source_id"], ["doc_id"], 5
    )
    grouped = five.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "title"))).alias("s")
    )
    return grouped.select("source_id", F.array_join("s.title", "|").alias("titles"))
