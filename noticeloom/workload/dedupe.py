"""Deduplication, incremental state and keyed updates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.functions.identity import cross_source_key
from noticeloom.functions.text import content_hash
from noticeloom.operators import dedupe, extract, incremental, latest
from noticeloom.sources import state as state_table
from noticeloom.session import scratch, staged
from noticeloom.workload.base import (
    SQL_DOCS,
    SQL_HOST,
    hosted_pages,
    keyed_notices,
    query,
    sql_norm,
    table,
)

_SQL_PRIMARY = f"""{SQL_DOCS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY priority, doc_id) AS place,
         count(*) OVER (PARTITION BY dedupe_key) AS group_size FROM notices),
primaries AS (SELECT * FROM ranked WHERE place = 1)"""


_SQL_BODY = (
    "regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')"
)
_SQL_DECODED = (
    "regexp_replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'),"
    " '&#x27;', ''''), '&amp;?', '&', 'g')"
)


@query(
    "pages_to_notices",
    f"""WITH p AS (
      SELECT page_id, {SQL_HOST} AS host,
             {sql_norm(_SQL_DECODED.format(_SQL_BODY))} AS body,
             {sql_norm(_SQL_DECODED.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS title
      FROM pages),
    k AS (SELECT *, sha256('title-date-content:' || title || '||' || sha256(body)) AS dedupe_key
          FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY page_id) AS place,
                 count(*) OVER (PARTITION BY dedupe_key) AS group_size FROM k)
    SELECT host, count(*) AS notices, CAST(sum(group_size - 1) AS BIGINT) AS folded,
           CAST(sum(length(body)) AS BIGINT) AS characters
    FROM r WHERE place = 1 GROUP BY host""",
)
def pages_to_notices(spark, folder):
    """Pages to ids, titles and text; reposts folded; counted per host."""
    pages = hosted_pages(spark, folder).select(
        F.col("page_id").alias("seq"),
        "html",
        F.col("host").alias("source_id"),
        F.col("host").alias("source_name"),
        F.lit("").alias("region"),
        F.lit("").alias("title"),
        F.col("url").alias("detail_url"),
        F.lit(None).cast("date").alias("published_at"),
        F.array("host").alias("allowed_domains"),
    )
    documents = extract.parse_pages(pages)
    keyed = documents.select(
        "seq",
        "source_id",
        F.char_length("normalized_text").alias("characters"),
        cross_source_key("title", None, "content_hash").alias("dedupe_key"),
        F.lit(2).alias("priority"),
    )
    # Grouping and joining both read the keys: parse every page only once.
    primaries = dedupe.dedupe(staged(keyed, "notices"))
    return primaries.groupBy(F.col("source_id").alias("host")).agg(
        F.count(F.lit(1)).alias("notices"),
        F.sum(F.col("group_size") - 1).alias("folded"),
        F.sum("characters").alias("characters"),
    )


def _narrow(spark, folder):
    """Keyed notices without their text, hashed once."""
    return staged(
        keyed_notices(spark, folder).select(
            "doc_id",
            "seq",
            "source_id",
            "policy_id",
            "detail_url",
            "content_hash",
            "dedupe_key",
            "priority",
        ),
        "notices",
    )


@query(
    "cross_source_dedupe",
    f"""WITH {_SQL_PRIMARY}
    SELECT doc_id, policy_id, dedupe_key, group_size FROM primaries""",
)
def cross_source_dedupe(spark, folder):
    primaries = dedupe.dedupe(_narrow(spark, folder))
    return primaries.select("doc_id", "policy_id", "dedupe_key", "group_size")


@query(
    "primary_levels",
    f"""WITH {SQL_DOCS},
    ranked AS (SELECT *, CASE WHEN doc_id % 6 < 5 THEN 7 - 3 * (doc_id % 6) END AS level FROM notices)
    SELECT dedupe_key, arg_min(doc_id, (level IS NULL, coalesce(level, 0), doc_id)) AS doc_id, count(*) AS group_size
    FROM ranked GROUP BY dedupe_key""",
)
def primary_levels(spark, folder):
    """Primaries under five levels, below and above zero, and an unknown one."""
    kind = F.col("doc_id") % 6
    docs = _narrow(spark, folder).withColumn("level", F.when(kind < 5, 7 - 3 * kind))
    return dedupe.primary_per_group(docs, priority="level", seq="doc_id")


@query(
    "duplicate_count",
    f"""WITH {_SQL_PRIMARY}
    SELECT source_id, CAST(sum(group_size - 1) AS BIGINT) AS duplicates
    FROM primaries GROUP BY source_id""",
)
def duplicate_count(spark, folder):
    primaries = dedupe.dedupe(_narrow(spark, folder))
    return primaries.groupBy("source_id").agg(
        F.sum(F.col("group_size") - 1).alias("duplicates")
    )


@query(
    "supplementary_links",
    f"""WITH {_SQL_PRIMARY},
    members AS (
      SELECT n.dedupe_key, n.doc_id, n.detail_url, n.policy_id, p.policy_id AS primary_id
      FROM notices n JOIN primaries p USING (dedupe_key)),
    links AS (
      SELECT dedupe_key, 'https://mirror.example.org/' || (doc_id % 3) AS link, 0 AS stage,
             doc_id, 0 AS place FROM primaries
      UNION ALL SELECT dedupe_key, detail_url, 1, doc_id, 0 FROM members
                WHERE policy_id <> primary_id
      UNION ALL SELECT dedupe_key, 'https://mirror.example.org/' || (doc_id % 3), 1, doc_id, 1
                FROM members WHERE policy_id <> primary_id),
    firsts AS (SELECT dedupe_key, link, min((stage, doc_id, place)) AS o FROM links GROUP BY 1, 2)
    SELECT dedupe_key, link,
           row_number() OVER (PARTITION BY dedupe_key ORDER BY o) AS place FROM firsts""",
)
def supplementary_links(spark, folder):
    mirror = F.concat(F.lit("https://mirror.example.org/"), (F.col("doc_id") % 3).cast("string"))
    docs = _narrow(spark, folder).withColumn("supplementary_urls", F.array(mirror))
    return dedupe.numbered_links(dedupe.supplementary_links(docs))


# State: the documents of some sources were processed; those of one have changed since.
_SQL_STATE = f"""{SQL_DOCS},
state AS (
  SELECT policy_id, CASE WHEN source_id = 'src5' THEN 'old' ELSE content_hash END AS content_hash,
         dedupe_key FROM notices WHERE source_id >= 'src2'),
done AS (SELECT * FROM notices SEMI JOIN labels USING (doc_id))"""


def _state(docs):
    stale = F.when(F.col("source_id") == "src5", "old").otherwise(F.col("content_hash"))
    return docs.filter("source_id >= 'src2'").select(
        "policy_id", stale.alias("content_hash"), "dedupe_key"
    )


@query(
    "changed_only",
    f"""WITH {_SQL_STATE},
    by_key AS (SELECT dedupe_key, min_by(content_hash, policy_id) AS h FROM state GROUP BY 1)
    SELECT n.doc_id, n.policy_id FROM notices n
    LEFT JOIN state s USING (policy_id) LEFT JOIN by_key k ON n.dedupe_key = k.dedupe_key
    WHERE n.content_hash IS DISTINCT FROM coalesce(s.content_hash, k.h)""",
)
def changed_only(spark, folder):
    docs = _narrow(spark, folder)
    return incremental.changed_only(docs, _state(docs)).select("doc_id", "policy_id")


@query(
    "changed_only_forced",
    f"""WITH {SQL_DOCS} SELECT count(*) AS documents FROM notices""",
)
def changed_only_forced(spark, folder):
    docs = _narrow(spark, folder)
    kept = incremental.changed_only(docs, _state(docs), force=True)
    return kept.agg(F.count(F.lit(1)).alias("documents"))


@query(
    "state_upsert",
    f"""WITH {_SQL_STATE}
    SELECT coalesce(n.policy_id, s.policy_id) AS policy_id,
           coalesce(n.content_hash, s.content_hash) AS content_hash,
           coalesce(n.dedupe_key, s.dedupe_key) AS dedupe_key
    FROM state s FULL JOIN done n USING (policy_id)""",
)
def state_upsert(spark, folder):
    docs = _narrow(spark, folder)
    done = docs.join(table(spark, folder, "labels"), "doc_id", "left_semi")
    return incremental.upsert_state(_state(docs), done)


@query(
    "state_log",
    f"""WITH {_SQL_STATE}
    SELECT coalesce(n.policy_id, s.policy_id) AS policy_id,
           coalesce(n.content_hash, s.content_hash) AS content_hash
    FROM state s FULL JOIN done n USING (policy_id)""",
)
def state_log(spark, folder):
    docs = _narrow(spark, folder)
    path = scratch(spark, "state")
    state_table.append_state(_state(docs), path, 0)
    done = docs.join(table(spark, folder, "labels"), "doc_id", "left_semi")
    state_table.append_state(done, path, 1)
    return state_table.read_state(spark, path).select("policy_id", "content_hash")


@query(
    "state_folded_between_runs",
    f"""WITH {_SQL_STATE}
    SELECT coalesce(n.policy_id, s.policy_id) AS policy_id,
           coalesce(n.content_hash, s.content_hash) AS content_hash
    FROM state s FULL JOIN done n USING (policy_id)""",
)
def state_folded_between_runs(spark, folder):
    """A run is recorded while a fold is under way, and half of the state is read by bucket afterwards."""
    docs = _narrow(spark, folder)
    path = scratch(spark, "state")
    state_table.append_state(_state(docs), path, 0)
    fold = state_table.plan_fold(spark, path, 1)
    done = docs.join(table(spark, folder, "labels"), "doc_id", "left_semi")
    state_table.append_state(done, path, 1)
    state_table.finish_fold(spark, path, fold)
    state_table.fold_state(spark, path, 1)
    wanted = docs.select("policy_id", F.lit("").alias("dedupe_key"))
    return state_table.read_state(spark, path, wanted=wanted).select("policy_id", "content_hash")


@query(
    "state_of_two_runs",
    f"""WITH {_SQL_STATE}
    SELECT coalesce(n.policy_id, s.policy_id) AS policy_id,
           coalesce(n.content_hash, s.content_hash) AS content_hash
    FROM state s FULL JOIN done n USING (policy_id)""",
)
def state_of_two_runs(spark, folder):
    """Two runs that begin from the same state: both stay, the later one counts."""
    docs = _narrow(spark, folder)
    path = scratch(spark, "state")
    first, second = state_table.next_version(spark, path), state_table.next_version(spark, path)
    state_table.append_state(_state(docs), path, first)
    done = docs.join(table(spark, folder, "labels"), "doc_id", "left_semi")
    state_table.append_state(done, path, second)
    return state_table.read_state(spark, path).select("policy_id", "content_hash")


@query(
    "last_per_key",
    """SELECT conv_id, max_by(role, turn) AS role, max_by(text, turn) AS text,
              max(turn) AS turn, min(turn) AS first_turn FROM conversations GROUP BY conv_id""",
)
def last_per_key(spark, folder):
    return latest.last_per_key(
        table(spark, folder, "conversations"), ["conv_id"], "turn", "first_turn"
    )


@query(
    "first_per_key",
    """SELECT user_id, event_type, min(event_id) AS event_id, min_by(value, event_id) AS value
    FROM events GROUP BY user_id, event_type""",
)
def first_per_key(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value")
    return latest.first_per_key(events, ["user_id", "event_type"], "event_id")


@query(
    "union_listings",
    """WITH l AS (
      SELECT 1 AS listing, c_nationkey AS s, c_mktsegment AS u, c_custkey AS o, c_name AS t
      FROM customer UNION ALL
      SELECT 0, s_nationkey, 'BUILDING', s_suppkey, s_name FROM supplier)
    SELECT 'n' || s AS source_id, u AS detail_url, max_by(t, (listing, o)) AS title,
           min({'listing': listing, 'o': o}).o AS first_order
    FROM l GROUP BY 1, 2""",
)
def union_listings(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source_id"),
        F.col("c_mktsegment").alias("detail_url"),
        F.col("c_name").alias("title"),
        F.col("c_custkey").alias("position"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("source_id"),
        F.lit("BUILDING").alias("detail_url"),
        F.col("s_name").alias("title"),
        F.col("s_suppkey").alias("position"),
    )
    return latest.union_listings(suppliers, customers).select(
        "source_id", "detail_url", "title", F.col("first_seen.position").alias("first_order")
    )


@query(
    "ordered_distinct",
    """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word,
                         unnest(range(len(string_split(text, ' ')))) AS place FROM conversations),
    f AS (SELECT conv_id, turn, word, min(place) AS first_place FROM w GROUP BY ALL)
    SELECT conv_id, turn, string_agg(word, ' ' ORDER BY first_place) AS words FROM f
    GROUP BY conv_id, turn""",
)
def ordered_distinct(spark, folder):
    words = latest.ordered_distinct(F.split("text", " "))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.array_join(words, " ").alias("words")
    )


@query(
    "duplicate_keys",
    f"""SELECT sha256({sql_norm("text")}) AS content_hash, count(*) AS n_rows FROM documents
    GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_keys(spark, folder):
    hashed = table(spark, folder, "documents").select(content_hash("text").alias("content_hash"))
    return latest.duplicate_keys(hashed, ["content_hash"])


@query(
    "removed_ids",
    """SELECT DISTINCT c_custkey FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)""",
)
def removed_ids(spark, folder):
    after = table(spark, folder, "orders").filter("o_totalprice > 250000")
    after = after.select(F.col("o_custkey").alias("c_custkey"))
    return latest.removed_ids(table(spark, folder, "customer"), after, "c_custkey")


@query(
    "replace_rows",
    """SELECT p_partkey, p_name, p_size FROM part
      WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)
    UNION ALL SELECT p_partkey, upper(p_name), 0 FROM part
      WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)""",
)
def replace_rows(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    sold = table(spark, folder, "lineitem").filter("l_quantity >= 50")
    edited = parts.join(
        sold.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi"
    ).select("p_partkey", F.upper("p_name").alias("p_name"), F.lit(0).alias("p_size"))
    return latest.replace_rows(parts, edited, "p_partkey")


@query(
    "append_candidates",
    """SELECT phase, count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM (
      SELECT 'verified' AS phase, s_nationkey AS id FROM supplier UNION ALL
      SELECT 'candidate', c_nationkey FROM customer) GROUP BY phase""",
)
def append_candidates(spark, folder):
    registry = table(spark, folder, "supplier").select(
        F.lit("verified").alias("phase"), F.col("s_nationkey").alias("id"), "s_name"
    )
    new = table(spark, folder, "customer").select(
        F.lit("candidate").alias("phase"), F.col("c_nationkey").alias("id")
    )
    return (
        latest.append_candidates(registry, new)
        .groupBy("phase")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"))
    )


@query(
    "code_table",
    """WITH r AS (SELECT trim(p_type) AS code, trim(p_name) AS name, p_partkey FROM part
                  WHERE p_size <> 1)
    SELECT code, max_by(name, p_partkey) AS name FROM r GROUP BY code""",
)
def code_table(spark, folder):
    code = F.when(F.col("p_size") == 1, F.lit(" 　")).otherwise(F.concat(F.lit(" "), "p_type"))
    rows = table(spark, folder, "part").select(
        code.alias("code"), F.concat("p_name", F.lit("\t")).alias("name"), "p_partkey"
    )
    return latest.code_table(rows, "p_partkey")
