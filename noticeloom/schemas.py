"""Fixed row types; input is read with these and never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in types.items()])


STRING = T.StringType()
BOOLEAN = T.BooleanType()
DATE = T.DateType()
LONG = T.LongType()
DOUBLE = T.DoubleType()
STRINGS = T.ArrayType(STRING)

CANDIDATE = _fields(source_id=STRING, title=STRING, detail_url=STRING, published_at=DATE)

DOCUMENT = _fields(
    policy_id=STRING,
    source_id=STRING,
    source_name=STRING,
    region=STRING,
    title=STRING,
    detail_url=STRING,
    publisher=STRING,
    document_number=STRING,
    publish_date=DATE,
    effective_date=DATE,
    application_start_date=DATE,
    application_end_date=DATE,
    raw_text=STRING,
    normalized_text=STRING,
    attachment_urls=STRINGS,
    attachment_snapshot_paths=STRINGS,
    attachment_errors=STRINGS,
    supplementary_urls=STRINGS,
    collected_at=T.TimestampType(),
    content_hash=STRING,
    snapshot_path=STRING,
)

EVIDENCE = _fields(quote=STRING, location=STRING)
OPPORTUNITY = _fields(
    section_code=STRING,
    section_name=STRING,
    division_code=STRING,
    division_name=STRING,
    business_tags=STRINGS,
    confidence=DOUBLE,
    scenarios=STRINGS,
    evidence=T.ArrayType(EVIDENCE),
    leasing_relevance=STRING,
    recommended_action=STRING,
    opening_script=STRING,
)
ANALYSIS = _fields(
    is_benefit_policy=BOOLEAN,
    summary=STRING,
    support_direction=STRING,
    eligible_conditions=STRING,
    risk_notes=STRING,
    opportunities=T.ArrayType(OPPORTUNITY),
)

SOURCE = _fields(
    source_id=STRING,
    display_name=STRING,
    region=STRING,
    list_urls=STRINGS,
    allowed_domains=STRINGS,
    enabled=BOOLEAN,
    request_interval_seconds=DOUBLE,
    adapter_version=STRING,
    origin=STRING,
)

RATE_LIMIT = _fields(max_requests=LONG, period_seconds=LONG, minimum_interval_seconds=DOUBLE)
AUDIT = _fields(source_id=STRING, verified_at=DATE, evidence_url=STRING, adapter_version=STRING)
SAMPLE = _fields(title=STRING, url=STRING, matched_keywords=STRINGS)
SCORE_ITEM = _fields(dimension=STRING, score=LONG, max=LONG, reason=STRING)
DISCOVERY = _fields(
    keywords=STRINGS,
    discovered_at=DATE,
    portal_seed_id=STRING,
    admin_level=STRING,
    sample_policies=T.ArrayType(SAMPLE),
    snapshots=STRINGS,
    check_result=STRING,
    recommendation=STRING,
    priority_score=LONG,
    priority_level=STRING,
    score_breakdown=T.ArrayType(SCORE_ITEM),
)
REGISTRY = _fields(
    source_id=STRING,
    display_name=STRING,
    region=STRING,
    phase=STRING,
    enabled=BOOLEAN,
    terms=STRING,
    terms_confirmed=BOOLEAN,
    registration=STRING,
    registration_completed=BOOLEAN,
    authorization=STRING,
    rate_limit=RATE_LIMIT,
    selected_data_scope=STRING,
    field_permission_confirmed=BOOLEAN,
    evidence_url=STRING,
    verified_at=DATE,
    review_due_at=DATE,
    owner=STRING,
    available_fields=STRINGS,
    official_urls=STRINGS,
    verification_notes=STRING,
    reviewer=STRING,
    reviewed_at=T.TimestampType(),
    origin=STRING,
    discovery=DISCOVERY,
)

COLLECTION_REPORT = _fields(
    discovered=LONG, collected=LONG, skipped=LONG, source_failures=LONG, parse_failures=LONG
)
BATCH = _fields(
    schema_version=LONG,
    created_at=STRING,
    start_date=DATE,
    end_date=DATE,
    source_ids=STRINGS,
    development_mode=BOOLEAN,
    compliance_audit=T.ArrayType(AUDIT),
    report=COLLECTION_REPORT,
    documents=T.ArrayType(DOCUMENT),
)
RUN_REPORT = _fields(
    discovered=LONG,
    changed=LONG,
    skipped=LONG,
    source_failures=LONG,
    parse_failures=LONG,
    analysis_failures=LONG,
    priority_rows=LONG,
    observation_rows=LONG,
    compliance_audit=T.ArrayType(AUDIT),
)
STATE = _fields(policy_id=STRING, content_hash=STRING, dedupe_key=STRING)
KEYWORD = _fields(text=STRING, tag=STRING, signal_strength=STRING)
PORTAL = _fields(
    portal_id=STRING,
    display_name=STRING,
    region=STRING,
    entry_url=STRING,
    admin_level=STRING,
    gov_domain=STRING,
)
CODE = _fields(code=STRING, name=STRING)
