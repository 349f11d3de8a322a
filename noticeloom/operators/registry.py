"""Source registry: rules, eligibility, audit rows and lifecycle."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from noticeloom import rules
from noticeloom.functions.text import col, is_blank, strip
from noticeloom.functions.urls import host, url_hosts
from noticeloom.operators.latest import first_per_key, last_per_key, replace_rows, require_none



def _general(value: Column) -> Column:
    """Six significant digits without trailing zeros."""
    rounded = F.format_string("%.6f", value)
    return F.regexp_replace(F.regexp_replace(rounded, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def required_interval(rate_limit: Column) -> Column:
    """The stricter of the minimum interval and the window's average interval."""
    window = rate_limit["period_seconds"] / F.nullif(rate_limit["max_requests"], F.lit(0))
    return F.greatest(rate_limit["minimum_interval_seconds"].cast("double"), window)


def pacing_reason(rate_limit: Column, interval: Column | str) -> Column:
    """Why a request interval cannot respect the rate limit."""
    pause = col(interval).cast("double")
    needed = required_interval(rate_limit)
    finite = ~F.isnan(pause) & (F.abs(pause) != float("inf"))
    usable = F.coalesce(finite & (pause > 0), F.lit(False))
    return F.when(
        ~usable, "request_interval_seconds must be a finite positive number"
    ).when(
        pause < needed,
        F.concat(
            F.lit("request_interval_seconds="),
            _general(pause),
            F.lit(" below required="),
            _general(needed),
        ),
    )


def blocking_reason(
    phase: Column, verified_at: Column, review_due_at: Column, today: date | Column
) -> Column:
    """Why a registered source may not be used today."""
    now = F.lit(today)
    return (
        F.when(phase != "verified", F.concat(F.lit("phase="), phase))
        .when(verified_at.isNull(), "verified_at=missing")
        .when(verified_at > now, "verified_at=future")
        .when(F.coalesce(review_due_at <= now, F.lit(True)), "review_due_at=expired")
    )


def version_placeholder(version: Column | str) -> Column:
    return F.coalesce(
        F.lower(strip(version)).isin(list(rules.VERSION_PLACEHOLDERS)), F.lit(True)
    )


def _https(url: Column) -> Column:
    shape = r"^[hH][tT][tT][pP][sS]://(?![^/?#]*@)[^/?#]+"
    return F.coalesce(url.rlike(shape) & host(url).isNotNull(), F.lit(False))


def _unconfirmed(value: Column, allow_unknown: Column, allow_none: bool = False) -> Column:
    folded = F.lower(strip(value))
    words = [word for word in rules.PLACEHOLDERS if not (allow_none and word == "none")]
    return is_blank(value) | folded.isin(words) | (~allow_unknown & (folded == "unknown"))


def registry_violations(record: dict[str, Column]) -> Column:
    """All broken rules of a registry record, as text; empty for a valid record."""
    verified = F.coalesce(record["phase"] == "verified", F.lit(False))
    relaxed, strict = ~verified, F.lit(False)

    def broken(test: Column, message: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), message)

    def given(name: str) -> Column:
        return record[name].isNotNull()

    def outside(name: str, allowed: Sequence[str]) -> Column:
        return broken(
            ~F.coalesce(record[name].isin(list(allowed)), F.lit(False)),
            f"{name} must be one of {sorted(allowed)}",
        )

    def needed(test: Column, message: str) -> Column:
        return broken(verified & test, message)

    def not_true(name: str) -> Column:
        return needed(
            ~F.coalesce(record[name], F.lit(False)), f"{name} must be true for phase=verified"
        )

    due, since = record["review_due_at"], record["verified_at"]
    limit = record["rate_limit"]
    pause = limit["minimum_interval_seconds"]
    checks = [
        broken(_unconfirmed(record["source_id"], strict), "source_id must be confirmed"),
        broken(_unconfirmed(record["display_name"], strict), "display_name must be confirmed"),
        outside("phase", rules.PHASES),
        outside("origin", rules.ORIGINS),
        broken(record["enabled"].isNull(), "enabled must be a JSON boolean"),
        broken(
            given("terms") & _unconfirmed(record["terms"], relaxed), "terms must be confirmed"
        ),
        outside("registration", rules.REGISTRATION_STATUSES),
        outside("authorization", rules.AUTHORIZATION_TYPES),
        broken(
            given("selected_data_scope") & _unconfirmed(record["selected_data_scope"], relaxed),
            "selected_data_scope must be confirmed",
        ),
        broken(
            given("evidence_url") & ~_https(record["evidence_url"]),
            "evidence_url must be a valid HTTPS URL",
        ),
        broken(_unconfirmed(record["owner"], relaxed), "owner must be confirmed"),
        broken(
            F.exists(record["available_fields"], lambda item: _unconfirmed(item, strict)),
            "available_fields must be confirmed",
        ),
        broken(
            limit.isNotNull()
            & ~F.coalesce(limit["max_requests"] > 0, F.lit(False)),
            "rate_limit.max_requests must be a positive integer",
        ),
        broken(
            limit.isNotNull()
            & ~F.coalesce(limit["period_seconds"] > 0, F.lit(False)),
            "rate_limit.period_seconds must be a positive integer",
        ),
        broken(
            limit.isNotNull()
            & ~F.coalesce((pause > 0) & ~F.isnan(pause) & (pause != float("inf")), F.lit(False)),
            "rate_limit.minimum_interval_seconds must be a positive number",
        ),
        broken(due <= since, "review_due_at must be later than verified_at"),
        broken(
            due > F.date_add(since, rules.REVIEW_WINDOW_DAYS),
            "review_due_at must be no later than 90 days after verified_at",
        ),
        needed(~given("terms"), "terms must be confirmed for phase=verified"),
        needed(
            ~given("selected_data_scope"),
            "selected_data_scope must be confirmed for phase=verified",
        ),
        needed(~given("evidence_url"), "evidence_url must be set for phase=verified"),
        needed(~given("review_due_at"), "review_due_at must be set for phase=verified"),
        not_true("enabled"),
        not_true("terms_confirmed"),
        needed(
            ~record["registration"].isin(list(rules.ELIGIBLE_REGISTRATION)),
            "registration must be completed or not_required",
        ),
        not_true("registration_completed"),
        needed(
            ~record["authorization"].isin(list(rules.ELIGIBLE_AUTHORIZATION)),
            "authorization is not eligible for automatic access",
        ),
        needed(limit.isNull(), "rate_limit must be concrete for phase=verified"),
        not_true("field_permission_confirmed"),
        needed(
            F.coalesce(F.size(record["available_fields"]) <= 0, F.lit(True)),
            "available_fields must be nonempty for phase=verified",
        ),
        needed(~given("verified_at"), "verified_at must be set for phase=verified"),
        needed(
            F.lower(strip(record["owner"])).isin("unassigned", "unknown"),
            "owner must be assigned for phase=verified",
        ),
    ]
    return F.filter(F.array(*checks), lambda item: item.isNotNull())


def audit_snapshot(record: dict[str, Column], version: Column, today: date | Column) -> Column:
    """Evidence row of a source that passes the gate, else NULL."""
    blocked = blocking_reason(
        record["phase"], record["verified_at"], record["review_due_at"], today
    )
    return F.when(
        blocked.isNull() & ~version_placeholder(version),
        F.struct(
            record["source_id"].alias("source_id"),
            record["verified_at"].alias("verified_at"),
            record["evidence_url"].alias("evidence_url"),
            version.alias("adapter_version"),
        ),
    )


def default_request(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Enabled and registered source ids, used when nothing is requested."""
    enabled = sources.filter("enabled").select("source_id")
    return enabled.join(registry.select("source_id").distinct(), "source_id", "left_semi")


def eligible_sources(
    requested: DataFrame, sources: DataFrame, registry: DataFrame, today: date | Column
) -> DataFrame:
    """Per requested source: the first failing reason (NULL when eligible) and its audit row."""
    registered = registry.select(
        "source_id",
        F.lit(True).alias("is_registered"),
        F.struct("phase", "verified_at", "review_due_at", "evidence_url", "rate_limit").alias("reg"),
    )
    configured = sources.select(
        "source_id",
        F.lit(True).alias("is_configured"),
        F.col("enabled").alias("is_enabled"),
        "request_interval_seconds",
        "adapter_version",
    )
    joined = (
        requested.select("source_id")
        .distinct()
        .join(registered, "source_id", "left")
        .join(configured, "source_id", "left")
    )
    limit = F.col("reg.rate_limit")
    version = F.col("adapter_version")
    reason = F.coalesce(
        F.when(F.col("is_registered").isNull(), "not compliance-registered"),
        blocking_reason(
            F.col("reg.phase"), F.col("reg.verified_at"), F.col("reg.review_due_at"), today
        ),
        F.when(F.col("is_configured").isNull(), "no adapter configured"),
        F.when(~F.col("is_enabled"), "adapter enabled=false"),
        F.when(limit.isNull(), "rate_limit=missing"),
        pacing_reason(limit, "request_interval_seconds"),
        F.when(
            version_placeholder(version),
            F.concat(
                F.lit("adapter_version="),
                F.coalesce(F.nullif(version, F.lit("")), F.lit("missing")),
            ),
        ),
    )
    record = {
        "source_id": F.col("source_id"),
        "phase": F.col("reg.phase"),
        "verified_at": F.col("reg.verified_at"),
        "review_due_at": F.col("reg.review_due_at"),
        "evidence_url": F.col("reg.evidence_url"),
    }
    return joined.withColumn("reason", reason).select(
        "source_id",
        "reason",
        F.when(F.col("reason").isNull(), audit_snapshot(record, version, today)).alias("audit"),
    )


def require_eligible(found: DataFrame) -> DataFrame:
    """Audit rows of the selected sources; every problem is an error, and so is no source."""
    problems = found.filter("reason IS NOT NULL").select("source_id", "reason")
    require_none(problems, "not eligible", ["source_id", "reason"])
    if not found.limit(1).count():
        raise ValueError("no verified enabled compliance source is configured")
    return found.select("audit.*") if "audit" in found.columns else found.select("source_id")


def dev_sources(requested: DataFrame, sources: DataFrame) -> DataFrame:
    """As above for development runs: only configured and enabled count."""
    joined = (
        requested.select("source_id")
        .distinct()
        .join(sources.select("source_id", F.col("enabled").alias("on")), "source_id", "left")
    )
    reason = F.when(F.col("on").isNull(), "no adapter configured").when(
        ~F.col("on"), "adapter enabled=false"
    )
    return joined.select("source_id", reason.alias("reason"))


def collectable(sources: DataFrame, registry: DataFrame, seq: str = "seq") -> DataFrame:
    """Drop sources whose last registry record is a discovery that is not verified and enabled."""
    last = last_per_key(
        registry.select("source_id", "origin", "phase", F.col("enabled").alias("on"), seq),
        ["source_id"],
        seq,
    )
    usable = F.coalesce((F.col("phase") == "verified") & F.col("on"), F.lit(False))
    blocked = last.filter((F.col("origin") == "discovery") & ~usable).select("source_id")
    return sources.join(blocked, "source_id", "left_anti")


def source_violations(
    row: dict[str, Column], known: Column, dedicated: Sequence[str]
) -> Column:
    """Broken edit rules of a source row; ``known`` says whether the id existed before."""
    generic = (row["origin"] == "discovery") & (strip(row["adapter_version"]) == "generic")
    urls = F.filter(F.transform(row["list_urls"], strip), lambda item: item != "")
    domains = F.filter(F.transform(row["allowed_domains"], strip), lambda item: item != "")

    def broken(test: Column, message: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), message)

    checks = [
        broken(~known & ~generic, "only generic discovery sources may be added"),
        broken(
            known & ~row["source_id"].isin(list(dedicated)) & ~generic,
            "source_id needs an existing adapter",
        ),
        broken(
            (F.size(urls) <= 0) | (F.size(domains) <= 0),
            "list_urls and allowed_domains must be nonempty",
        ),
        broken(
            F.exists(urls, lambda url: ~(url.rlike("^[hH][tT][tT][pP][sS]://") & host(url).isNotNull())),
            "list_urls must be valid HTTPS URLs",
        ),
        broken(
            F.exists(
                urls, lambda url: ~F.coalesce(F.array_contains(domains, host(url)), F.lit(True))
            ),
            "list_urls must be on an allowed domain",
        ),
        broken(
            F.coalesce(row["request_interval_seconds"], F.lit(0.0)) < 0,
            "request_interval_seconds must not be negative",
        ),
        broken(
            is_blank(row["display_name"]) | is_blank(row["region"]),
            "display_name and region must be nonempty",
        ),
        broken(is_blank(row["adapter_version"]), "adapter_version must be a nonempty string"),
        broken(~row["origin"].isin(list(rules.ORIGINS)), "origin must be one of the known ones"),
    ]
    return F.filter(F.array(*checks), lambda item: item.isNotNull())


# ---- lifecycle -------------------------------------------------------------------------------


def list_candidates(registry: DataFrame, seq: str = "seq") -> DataFrame:
    """Discovered candidates, the last record per id."""
    open_records = registry.filter("origin = 'discovery' AND phase = 'candidate'")
    return last_per_key(open_records, ["source_id"], seq)


def _first_record(registry: DataFrame, source_id: str, seq: str) -> DataFrame:
    return first_per_key(registry.filter(F.col("source_id") == source_id), ["source_id"], seq)


def _one(registry: DataFrame, source_id: str, seq: str):
    found = _first_record(registry, source_id, seq).take(1)
    if not found:
        raise ValueError(f"source not found: {source_id}")
    return found[0]


def promote(
    registry: DataFrame,
    source_id: str,
    reviewer: str,
    today: date,
    override: bool = False,
    seq: str = "seq",
) -> DataFrame:
    """Registry with the first record of the id verified; refuses what may not be promoted."""
    record = _one(registry, source_id, seq)
    if record["origin"] != "discovery" or record["phase"] != "candidate":
        raise ValueError(f"not a candidate: {source_id}")
    rejected = (record["discovery"] or {})["check_result"] == "not_recommended"
    if rejected and not override:
        raise ValueError("a not_recommended source needs an override")
    target = (F.col("source_id") == source_id) & (F.col(seq) == record[seq])
    notes = F.coalesce("verification_notes", F.lit(""))
    changed = {
        "phase": F.lit("verified"),
        "enabled": F.lit(True),
        "verified_at": F.lit(today),
        "owner": F.lit(reviewer),
    }
    if rejected:
        changed["verification_notes"] = F.concat(F.lit("override not_recommended; "), notes)
    return _rewrite(registry, target, changed)


def review(
    registry: DataFrame,
    source_id: str,
    action: str,
    reviewer: str,
    today: date,
    reason: str | None = None,
    comment: str = "",
    seq: str = "seq",
) -> DataFrame:
    """Confirm (promote), reject with a reason, or watch with a note."""
    if action == "confirm":
        return promote(registry, source_id, reviewer, today, seq=seq)
    record = _one(registry, source_id, seq)
    target = (F.col("source_id") == source_id) & (F.col(seq) == record[seq])
    changed = {"reviewer": F.lit(reviewer), "reviewed_at": F.current_timestamp()}
    if action == "reject":
        if not reason:
            raise ValueError("a rejection needs a reason")
        changed |= {
            "phase": F.lit("retired"),
            "enabled": F.lit(False),
            "verification_notes": F.lit(f"驳回:{reason}; {comment}"),
        }
    elif action == "watch":
        notes = F.coalesce("verification_notes", F.lit(""))
        changed["verification_notes"] = F.concat(notes, F.lit(f"关注:{comment};"))
    else:
        raise ValueError(f"unknown action: {action}")
    return _rewrite(registry, target, changed)


def _rewrite(table: DataFrame, target: Column, changed: dict[str, Column]) -> DataFrame:
    return table.select(
        *[
            F.when(target, changed[name]).otherwise(F.col(name)).alias(name)
            if name in changed
            else F.col(name)
            for name in table.columns
        ]
    )


def sync_sources(sources: DataFrame, promoted: DataFrame) -> DataFrame:
    """Source list with promoted records as generic sources, replacing rows of the same id."""
    urls = F.coalesce("official_urls", F.array().cast("array<string>"))
    rows = promoted.select(
        "source_id",
        "display_name",
        "region",
        urls.alias("list_urls"),
        url_hosts(urls).alias("allowed_domains"),
        F.lit(True).alias("enabled"),
        F.lit(1.5).alias("request_interval_seconds"),
        F.lit("generic").alias("adapter_version"),
        F.lit("discovery").alias("origin"),
    )
    return replace_rows(sources, rows, "source_id")
