"""Source registry rules, eligibility and lifecycle over the supplier and customer tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from noticeloom.operators import registry
from noticeloom.operators.latest import first_per_key
from noticeloom.sources import readers
from noticeloom.workload.base import iso, query, table

_TODAY = date(2024, 7, 1)


def _registry(spark, folder):
    """One registry record per supplier; its fields vary with the supplier number."""
    k = F.col("s_suppkey")
    day = F.lit("2024-04-10").cast("date")
    nothing = F.lit(None)
    limit = F.struct(
        F.when(k % 19 == 0, 0).otherwise(k % 7 + 1).cast("long").alias("max_requests"),
        F.lit(12).cast("long").alias("period_seconds"),
        F.when(k % 23 == 0, -1.0).otherwise(0.5).alias("minimum_interval_seconds"),
    )
    return table(spark, folder, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("source_id"),
        F.when(k % 17 == 0, " TBD ").otherwise(F.col("s_name")).alias("display_name"),
        F.when(k % 4 < 2, "verified").when(k % 4 == 2, "candidate").otherwise("old").alias("phase"),
        (k % 5 != 0).alias("enabled"),
        F.when(k % 6 == 0, nothing).when(k % 6 == 1, "unknown").otherwise("ok").alias("terms"),
        F.when(k % 7 != 0, k % 7 != 1).alias("terms_confirmed"),
        F.when(k % 8 == 0, "maybe").when(k % 8 == 1, "required").otherwise("completed").alias(
            "registration"
        ),
        (k % 9 != 0).alias("registration_completed"),
        F.when(k % 10 == 0, "none").otherwise("api_key").alias("authorization"),
        F.when(k % 11 != 0, limit).alias("rate_limit"),
        F.when(k % 12 != 0, "scope").alias("selected_data_scope"),
        F.lit(True).alias("field_permission_confirmed"),
        F.when(k % 13 == 0, nothing)
        .when(k % 13 == 1, "http://a.example")
        .otherwise("https://a.example/t")
        .alias("evidence_url"),
        F.when(k % 14 != 0, day).alias("verified_at"),
        F.when(k % 15 == 0, nothing)
        .when(k % 15 == 1, day)
        .when(k % 15 == 2, F.date_add(day, 91))
        .when(k % 15 == 3, F.date_add(day, 30))
        .otherwise(F.date_add(day, 90))
        .alias("review_due_at"),
        F.when(k % 16 == 0, "unassigned").otherwise("me").alias("owner"),
        F.when(k % 18 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("title")))
        .alias("available_fields"),
        F.when(k % 21 == 0, "other").when(k % 2 == 0, "discovery").otherwise("manual").alias(
            "origin"
        ),
        k.alias("seq"),
        k,
    )


_SQL_REGISTRY = """r AS (
  SELECT s_suppkey AS k, 's' || s_suppkey AS source_id, s_name,
    CASE WHEN s_suppkey % 4 < 2 THEN 'verified' WHEN s_suppkey % 4 = 2 THEN 'candidate' ELSE 'old' END
      AS phase,
    s_suppkey % 5 <> 0 AS enabled,
    CASE WHEN s_suppkey % 14 <> 0 THEN DATE '2024-04-10' END AS since,
    CASE s_suppkey % 15 WHEN 0 THEN NULL WHEN 1 THEN DATE '2024-04-10' WHEN 2 THEN DATE '2024-07-10'
      WHEN 3 THEN DATE '2024-05-10' ELSE DATE '2024-07-09' END AS due,
    CASE WHEN s_suppkey % 21 = 0 THEN 'other' WHEN s_suppkey % 2 = 0 THEN 'discovery'
         ELSE 'manual' END AS origin
  FROM supplier)"""

_V = "phase = 'verified' AND "
_SQL_RULES = ", ".join(
    f"CASE WHEN {test} THEN '{message}' END"
    for test, message in [
        ("k % 17 = 0", "display_name must be confirmed"),
        ("phase = 'old'", "phase must be one of [''candidate'', ''retired'', ''verified'']"),
        ("k % 21 = 0", "origin must be one of [''discovery'', ''manual'']"),
        (_V + "k % 6 = 1", "terms must be confirmed"),
        (
            "k % 8 = 0",
            "registration must be one of [''completed'', ''not_required'', ''per_dataset'', "
            "''required'', ''unknown'']",
        ),
        ("k % 13 = 1", "evidence_url must be a valid HTTPS URL"),
        ("k % 11 <> 0 AND k % 19 = 0", "rate_limit.max_requests must be a positive integer"),
        (
            "k % 11 <> 0 AND k % 23 = 0",
            "rate_limit.minimum_interval_seconds must be a positive number",
        ),
        ("due <= since", "review_due_at must be later than verified_at"),
        ("due > since + 90", "review_due_at must be no later than 90 days after verified_at"),
        (_V + "k % 6 = 0", "terms must be confirmed for phase=verified"),
        (_V + "k % 12 = 0", "selected_data_scope must be confirmed for phase=verified"),
        (_V + "k % 13 = 0", "evidence_url must be set for phase=verified"),
        (_V + "due IS NULL", "review_due_at must be set for phase=verified"),
        (_V + "NOT enabled", "enabled must be true for phase=verified"),
        (_V + "k % 7 IN (0, 1)", "terms_confirmed must be true for phase=verified"),
        (_V + "k % 8 IN (0, 1)", "registration must be completed or not_required"),
        (_V + "k % 9 = 0", "registration_completed must be true for phase=verified"),
        (_V + "k % 10 = 0", "authorization is not eligible for automatic access"),
        (_V + "k % 11 = 0", "rate_limit must be concrete for phase=verified"),
        (_V + "k % 18 = 0", "available_fields must be nonempty for phase=verified"),
        (_V + "since IS NULL", "verified_at must be set for phase=verified"),
        (_V + "k % 16 = 0", "owner must be assigned for phase=verified"),
    ]
)


@query(
    "registry_violations",
    f"""WITH {_SQL_REGISTRY}
    SELECT source_id, array_to_string(list_filter([{_SQL_RULES}], lambda v: v IS NOT NULL), '; ')
             AS violations FROM r""",
)
def registry_violations(spark, folder):
    records = _registry(spark, folder)
    columns = {name: F.col(name) for name in records.columns}
    found = registry.registry_violations(columns)
    return records.select("source_id", F.array_join(found, "; ").alias("violations"))


@query(
    "registry_types",
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'enabled must be a JSON boolean'
      WHEN 2 THEN 'terms_confirmed must be a JSON boolean or null; rate_limit must contain exactly '
        || '[''max_requests'', ''minimum_interval_seconds'', ''period_seconds'']'
      WHEN 3 THEN 'available_fields must be a JSON array' ELSE '' END AS violations
    FROM supplier""",
)
def registry_types(spark, folder):
    k = F.col("s_suppkey") % 4
    name = F.concat(F.lit('{"source_id":"'), "s_name", F.lit('",'))
    rest = (
        F.when(k == 0, F.lit('"enabled":true,"terms_confirmed":null,"available_fields":[]}'))
        .when(k == 1, F.lit('"enabled":"true"}'))
        .when(
            k == 2,
            F.lit('"enabled":false,"terms_confirmed":1,"rate_limit":{"max_requests":1,"x":2}}'),
        )
        .otherwise(F.lit('"enabled":true,"available_fields":"title"}'))
    )
    records = table(spark, folder, "supplier").select(
        "s_suppkey", F.concat(name, rest).alias("value")
    )
    return readers.registry_type_violations(records).select(
        "s_suppkey", F.array_join("type_violations", "; ").alias("violations")
    )


_SQL_INTERVAL = """i AS (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 = 0 THEN -1.0 WHEN s_suppkey % 6 = 1 THEN NULL
           ELSE (s_suppkey % 9) / 2.0 END AS pause,
         greatest(0.5, 12.0 / (s_suppkey % 7 + 1)) AS needed FROM supplier)"""


def _general_sql(column: str) -> str:
    text = f"printf('%.6f', {column})"
    return f"regexp_replace(regexp_replace({text}, '([.][0-9]*?)0+$', '\\1'), '[.]$', '')"


@query(
    "pacing",
    f"""WITH {_SQL_INTERVAL}
    SELECT k AS s_suppkey, round(needed, 6) AS needed, CASE WHEN pause IS NULL OR pause <= 0
        THEN 'request_interval_seconds must be a finite positive number'
        WHEN pause < needed THEN 'request_interval_seconds=' || {_general_sql("pause")}
          || ' below required=' || {_general_sql("needed")} END AS reason
    FROM i""",
)
def pacing(spark, folder):
    k = F.col("s_suppkey")
    limit = F.struct(
        (k % 7 + 1).alias("max_requests"),
        F.lit(12).alias("period_seconds"),
        F.lit(0.5).alias("minimum_interval_seconds"),
    )
    pause = F.when(k % 6 == 0, -1.0).when(k % 6 != 1, (k % 9) / 2.0)
    return table(spark, folder, "supplier").select(
        "s_suppkey",
        F.round(registry.required_interval(limit), 6).alias("needed"),
        registry.pacing_reason(limit, pause).alias("reason"),
    )


@query(
    "blocking_reason",
    f"""WITH {_SQL_REGISTRY}
    SELECT source_id, CASE WHEN phase <> 'verified' THEN 'phase=' || phase
      WHEN since IS NULL THEN 'verified_at=missing' WHEN k % 25 = 0 THEN 'verified_at=future'
      WHEN due IS NULL OR due <= DATE '2024-07-01' THEN 'review_due_at=expired' END AS reason
    FROM r""",
)
def blocking_reason(spark, folder):
    since = F.when(
        (F.col("s_suppkey") % 25 == 0) & F.col("verified_at").isNotNull(),
        F.lit("2024-08-01").cast("date"),
    ).otherwise(F.col("verified_at"))
    reason = registry.blocking_reason(F.col("phase"), since, F.col("review_due_at"), _TODAY)
    return _registry(spark, folder).select("source_id", reason.alias("reason"))


def _sources(spark, folder):
    """Source configuration: one per customer."""
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("s"), k.cast("string")).alias("source_id"),
        (k % 6 != 5).alias("enabled"),
        (F.lit(1.0) + k % 20).alias("request_interval_seconds"),
        F.when(k % 10 == 7, " Unregistered").otherwise("v1").alias("adapter_version"),
        k.alias("seq"),
        F.col("c_mktsegment").alias("segment"),
    )


_SQL_ELIGIBLE = f"""{_SQL_REGISTRY},
wanted AS (SELECT 's' || c_custkey AS source_id, c_custkey AS c, c_mktsegment AS segment FROM customer
  WHERE c_mktsegment <> 'BUILDING' OR c_custkey IN (SELECT s_suppkey FROM supplier)),
e AS (SELECT w.source_id, c, CASE
    WHEN r.k IS NULL THEN 'not compliance-registered'
    WHEN phase <> 'verified' THEN 'phase=' || phase
    WHEN since IS NULL THEN 'verified_at=missing'
    WHEN due IS NULL OR due <= DATE '2024-07-01' THEN 'review_due_at=expired'
    WHEN segment = 'BUILDING' THEN 'no adapter configured'
    WHEN c % 6 = 5 THEN 'adapter enabled=false'
    WHEN k % 11 = 0 THEN 'rate_limit=missing'
    WHEN 1.0 + c % 20 < greatest(0.5, 12.0 / (CASE WHEN k % 19 = 0 THEN NULL ELSE k % 7 + 1 END))
      THEN 'request_interval_seconds=' || (1 + c % 20) || ' below required='
        || {_general_sql("12.0 / (k % 7 + 1)")}
    WHEN c % 10 = 7 THEN 'adapter_version= Unregistered' END AS reason
  FROM wanted w LEFT JOIN r USING (source_id))"""


@query(
    "eligible_sources",
    f"""WITH {_SQL_ELIGIBLE}
    SELECT source_id, reason, CASE WHEN reason IS NULL THEN source_id || ' 2024-04-10 v1' END AS audit
    FROM e""",
)
def eligible_sources(spark, folder):
    sources = _sources(spark, folder).filter("segment <> 'BUILDING'")
    records = _registry(spark, folder)
    requested = sources.select("source_id").union(records.select("source_id"))
    found = registry.eligible_sources(requested, sources, records, _TODAY)
    audit = F.concat_ws(
        " ", "audit.source_id", iso("audit.verified_at"), "audit.adapter_version"
    )
    return found.select(
        "source_id", "reason", F.when(F.col("audit").isNotNull(), audit).alias("audit")
    )


@query(
    "default_request",
    """SELECT 's' || c_custkey AS source_id FROM customer
    WHERE c_custkey % 6 <> 5 AND c_custkey IN (SELECT s_suppkey FROM supplier)""",
)
def default_request(spark, folder):
    return registry.default_request(_sources(spark, folder), _registry(spark, folder))


@query(
    "dev_sources",
    """SELECT 's' || o AS source_id, CASE WHEN c_custkey IS NULL THEN 'no adapter configured'
      WHEN c_custkey % 6 = 5 THEN 'adapter enabled=false' END AS reason
    FROM (SELECT DISTINCT o_custkey * 2 AS o FROM orders) LEFT JOIN customer ON c_custkey = o""",
)
def dev_sources(spark, folder):
    requested = table(spark, folder, "orders").select(
        F.concat(F.lit("s"), (F.col("o_custkey") * 2).cast("string")).alias("source_id")
    )
    return registry.dev_sources(requested, _sources(spark, folder))


@query(
    "collectable",
    """WITH r AS (SELECT c_nationkey AS n, max(c_custkey) AS last FROM customer GROUP BY 1)
    SELECT s_suppkey FROM supplier LEFT JOIN r ON n = s_nationkey
    WHERE NOT coalesce(last % 2 = 0 AND NOT (last % 3 = 0 AND last % 5 <> 0), false)""",
)
def collectable(spark, folder):
    k = F.col("c_custkey")
    records = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("source_id"),
        F.when(k % 2 == 0, "discovery").otherwise("manual").alias("origin"),
        F.when(k % 3 == 0, "verified").otherwise("candidate").alias("phase"),
        (k % 5 != 0).alias("enabled"),
        k.alias("seq"),
    )
    sources = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("source_id"), "s_suppkey"
    )
    return registry.collectable(sources, records).select("s_suppkey")


@query(
    "source_violations",
    """WITH k AS (SELECT s_suppkey AS k FROM supplier)
    SELECT k AS s_suppkey, array_to_string(list_filter([
      CASE WHEN k % 2 = 1 AND k % 3 <> 0 THEN 'only generic discovery sources may be added' END,
      CASE WHEN k % 2 = 0 AND k % 3 <> 0 AND k % 4 <> 0 THEN 'source_id needs an existing adapter' END,
      CASE WHEN k % 5 = 0 THEN 'list_urls and allowed_domains must be nonempty' END,
      CASE WHEN k % 5 = 1 THEN 'list_urls must be valid HTTPS URLs' END,
      CASE WHEN k % 5 = 2 THEN 'list_urls must be on an allowed domain' END,
      CASE WHEN k % 7 = 0 THEN 'request_interval_seconds must not be negative' END,
      CASE WHEN k % 11 = 0 THEN 'display_name and region must be nonempty' END],
      lambda v: v IS NOT NULL), '; ') AS violations
    FROM k""",
)
def source_violations(spark, folder):
    k = F.col("s_suppkey")
    generic = k % 3 == 0
    row = {
        "source_id": F.when(k % 4 == 0, "miit").otherwise(F.col("s_name")),
        "origin": F.when(generic, "discovery").otherwise("manual"),
        "adapter_version": F.when(generic, "generic").otherwise("v1"),
        "list_urls": F.when(k % 5 == 0, F.array(F.lit(" ")))
        .when(k % 5 == 1, F.array(F.lit("http://a.example/x")))
        .when(k % 5 == 2, F.array(F.lit("https://b.example/x")))
        .otherwise(F.array(F.lit(" https://a.example/x "))),
        "allowed_domains": F.array(F.lit("a.example")),
        "request_interval_seconds": F.when(k % 7 == 0, -1.0).otherwise(0.0),
        "display_name": F.when(k % 11 == 0, " ").otherwise("name"),
        "region": F.lit("r"),
    }
    found = registry.source_violations(row, k % 2 == 0, ("miit", "ndrc"))
    return table(spark, folder, "supplier").select(
        "s_suppkey", F.array_join(found, "; ").alias("violations")
    )


# ---- lifecycle -------------------------------------------------------------------------------------


def _records(spark, folder):
    """Several records per id, in customer order."""
    k = F.col("c_custkey")
    meta = F.struct(
        F.when(k % 2 == 0, "pass").otherwise("not_recommended").alias("check_result")
    )
    return table(spark, folder, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source_id"),
        F.col("c_name").alias("display_name"),
        F.col("c_mktsegment").alias("region"),
        F.when(k % 3 == 2, "manual").otherwise("discovery").alias("origin"),
        F.when(k % 4 == 3, "retired").otherwise("candidate").alias("phase"),
        F.lit(False).alias("enabled"),
        F.lit(None).cast("date").alias("verified_at"),
        F.lit("unassigned").alias("owner"),
        F.lit(None).cast("string").alias("verification_notes"),
        F.lit(None).cast("string").alias("reviewer"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
        F.array(
            F.concat(
                F.lit("https://www.n"), F.col("c_nationkey").cast("string"), F.lit(".example/l")
            )
        ).alias(
            "official_urls"
        ),
        meta.alias("discovery"),
        k.alias("seq"),
    )


@query(
    "list_candidates",
    """SELECT 'n' || c_nationkey AS source_id, max(c_custkey) AS seq,
              max_by(c_name, c_custkey) AS display_name
    FROM customer WHERE c_custkey % 3 <> 2 AND c_custkey % 4 <> 3 GROUP BY c_nationkey""",
)
def list_candidates(spark, folder):
    return registry.list_candidates(_records(spark, folder)).select(
        "source_id", "seq", "display_name"
    )


def _first_candidate(records) -> str:
    """Id of customer 0, whose first record is an open candidate in every data set."""
    return records.filter("seq = 0").first()["source_id"]


@query(
    "promote",
    """SELECT c_custkey AS seq, CASE WHEN c_custkey = 0 THEN 'verified'
        WHEN c_custkey % 4 = 3 THEN 'retired' ELSE 'candidate' END AS phase,
      c_custkey = 0 AS enabled, CASE WHEN c_custkey = 0 THEN '2024-07-01' END AS verified,
      CASE WHEN c_custkey = 0 THEN 'me' ELSE 'unassigned' END AS owner FROM customer""",
)
def promote(spark, folder):
    records = _records(spark, folder)
    changed = registry.promote(records, _first_candidate(records), "me", _TODAY)
    return changed.select("seq", "phase", "enabled", iso("verified_at").alias("verified"), "owner")


@query(
    "review",
    """SELECT c_custkey AS seq, CASE WHEN c_custkey = 0 THEN 'retired'
        WHEN c_custkey % 4 = 3 THEN 'retired' ELSE 'candidate' END AS phase,
      CASE WHEN c_custkey = 0 THEN '驳回:dup; twice' END AS notes,
      CASE WHEN c_custkey = 0 THEN 'me' END AS reviewer FROM customer""",
)
def review(spark, folder):
    records = _records(spark, folder)
    changed = registry.review(
        records, _first_candidate(records), "reject", "me", _TODAY, "dup", "twice"
    )
    return changed.select("seq", "phase", F.col("verification_notes").alias("notes"), "reviewer")


@query(
    "review_actions",
    """WITH firsts AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
    wanted AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS turn FROM firsts
               WHERE n = 1 AND c_custkey % 2 = 0 AND c_custkey % 3 <> 2),
    told AS (SELECT c_custkey, (ARRAY['confirm', 'reject', 'watch'])[turn] AS told FROM wanted WHERE turn <= 3)
    SELECT c.c_custkey AS seq,
      CASE WHEN told = 'confirm' THEN 'verified' WHEN told = 'reject' THEN 'retired'
           WHEN c.c_custkey % 4 = 3 THEN 'retired' ELSE 'candidate' END AS phase,
      coalesce(told = 'confirm', false) AS enabled,
      CASE WHEN told = 'confirm' THEN '2024-07-01' END AS verified,
      CASE WHEN told = 'confirm' THEN 'me' ELSE 'unassigned' END AS owner,
      CASE WHEN told IN ('reject', 'watch') THEN 'me' END AS reviewer,
      coalesce(told IN ('reject', 'watch'), false) AS reviewed,
      CASE told WHEN 'reject' THEN '驳回:dup; twice' WHEN 'watch' THEN '关注:later;' END AS notes
    FROM customer c LEFT JOIN told USING (c_custkey)""",
)
def review_actions(spark, folder):
    """The first three ids whose first record may be promoted: one confirmed, one rejected, one watched."""
    records = _records(spark, folder)
    firsts = first_per_key(records, ["source_id"], "seq")
    open_ones = firsts.filter("origin = 'discovery' AND phase = 'candidate' AND discovery.check_result = 'pass'")
    wanted = open_ones.orderBy("seq").limit(3).collect()
    told = [("confirm", {}), ("reject", {"reason": "dup", "comment": "twice"}), ("watch", {"comment": "later"})]
    for record, (action, words) in zip(wanted, told, strict=False):
        records = registry.review(records, record["source_id"], action, "me", _TODAY, **words)
    return records.select(
        "seq",
        "phase",
        "enabled",
        iso("verified_at").alias("verified"),
        "owner",
        "reviewer",
        F.col("reviewed_at").isNotNull().alias("reviewed"),
        F.col("verification_notes").alias("notes"),
    )


@query(
    "sync_sources",
    """WITH p AS (SELECT 's' || c_nationkey AS id, min(c_custkey) AS seq, c_nationkey AS n
                  FROM customer WHERE c_custkey % 3 <> 2 GROUP BY c_nationkey)
    SELECT 's' || s_suppkey AS source_id, 'v1' AS adapter_version, 'old.example' AS domains
      FROM supplier WHERE 's' || s_suppkey NOT IN (SELECT id FROM p)
    UNION ALL SELECT id, 'generic', 'www.n' || n || '.example' FROM p""",
)
def sync_sources(spark, folder):
    sources = table(spark, folder, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"),
        F.lit("v1").alias("adapter_version"),
        F.array(F.lit("old.example")).alias("allowed_domains"),
    )
    open_records = _records(spark, folder).filter("origin = 'discovery'")
    renamed = open_records.withColumn("source_id", F.regexp_replace("source_id", "^n", "s"))
    promoted = first_per_key(renamed, ["source_id"], "seq")
    synced = registry.sync_sources(sources, promoted)
    return synced.select(
        "source_id", "adapter_version", F.array_join("allowed_domains", ",").alias("domains")
    )
