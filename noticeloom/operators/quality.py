"""Review gates, scoring and routing of one document and opportunity."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from noticeloom import rules
from noticeloom.functions.dates import timing_reason
from noticeloom.functions.text import (
    bind,
    col,
    evidence_location,
    is_blank,
    is_compliant_script,
    leasing_strength,
    normalize_text,
    support_strength,
)


def _result(score: Column, grade: Column, sheet: Column, reason: Column) -> Column:
    return F.struct(
        score.cast("int").alias("score"),
        grade.alias("grade"),
        sheet.alias("sheet_name"),
        reason.alias("review_reason"),
    )


def _observation(reason: Column) -> Column:
    return _result(
        F.lit(0), F.lit(rules.OBSERVATION_GRADE), F.lit(rules.OBSERVATION_SHEET), reason
    )


def grade(score: Column) -> Column:
    return (
        F.when(score >= 80, "A")
        .when(score >= 60, "B")
        .when(score >= 40, "C")
        .otherwise(rules.OBSERVATION_GRADE)
    )


def score(
    source_complete: Column,
    evidence_complete: Column,
    timely: Column,
    industry_clear: Column,
    support: Column,
    leasing: Column,
    actionable: Column,
) -> Column:
    """Points, grade, sheet and reason; at most 100, and at most 59 once the deadline passed."""

    def points(flag: Column, value: int) -> Column:
        return F.when(flag, value).otherwise(0)

    def clamp(value: Column, top: int) -> Column:
        return F.greatest(F.lit(0), F.least(value, F.lit(top)))

    lease = clamp(leasing, 30)
    total = (
        points(source_complete, 15)
        + points(timely, 10)
        + points(industry_clear, 20)
        + clamp(support, 15)
        + lease
        + points(actionable, 10)
    )
    inputs = F.struct(
        evidence_complete.alias("evidence"),
        timely.alias("timely"),
        source_complete.alias("source"),
        industry_clear.alias("clear"),
        lease.alias("lease"),
        F.when(timely, total).otherwise(F.least(total, F.lit(59))).alias("points"),
    )
    # The strengths search the whole text: evaluate them once for points, grade and reason.
    return bind(inputs, _route)


def _route(given: Column) -> Column:
    letter = grade(given["points"])
    scored = given["lease"] > 0
    priority = (
        given["timely"] & letter.isin("A", "B") & given["source"] & given["clear"] & scored
    )
    reason = (
        F.when(~given["timely"], rules.REASON_EXPIRED)
        .when(priority, F.lit(None).cast("string"))
        .when(~given["source"], rules.REASON_SOURCE)
        .when(~given["clear"], rules.REASON_INDUSTRY)
        .when(~scored, rules.REASON_SCENARIO)
    )
    sheet = F.when(priority, rules.PRIORITY_SHEET).otherwise(rules.OBSERVATION_SHEET)
    return F.when(
        ~given["evidence"], _observation(F.lit(rules.REASON_NO_EVIDENCE))
    ).otherwise(_result(given["points"], letter, sheet, reason))


def required_fields_reason(document: dict[str, Column], opportunity: Column) -> Column:
    """First trace, classification, tag or scenario field that is missing."""
    errors = document["attachment_errors"]
    reasons = [F.when(F.size(errors) > 0, F.concat(F.lit(rules.REASON_ATTACHMENT), F.get(errors, F.lit(0))))]
    reasons += [
        F.when(is_blank(document[name]), rules.REASON_TRACE + label)
        for name, label in rules.TRACE_LABELS.items()
    ]
    codes = ("section_code", "section_name", "division_code", "division_name")
    blank_code = F.lit(False)
    for name in codes:
        blank_code = blank_code | is_blank(opportunity[name])

    def none_given(name: str) -> Column:
        return ~F.coalesce(F.exists(opportunity[name], lambda item: ~is_blank(item)), F.lit(False))

    reasons += [
        F.when(blank_code, rules.REASON_CLASSIFICATION),
        F.when(none_given("business_tags"), rules.REASON_TAGS),
        F.when(none_given("scenarios"), rules.REASON_SCENARIO),
    ]
    return F.coalesce(*reasons)


def opportunity_reason(opportunity: Column) -> Column:
    no_evidence = F.coalesce(F.size(opportunity["evidence"]) <= 0, F.lit(True))
    return F.when(no_evidence, rules.REASON_NO_EVIDENCE).when(
        ~F.coalesce(is_compliant_script(opportunity["opening_script"]), F.lit(False)),
        rules.REASON_SCRIPT,
    )


def evidence_verifiable(normalized_text: Column, evidence: Column) -> Column:
    """Every quote is in the text, exactly at its stated location."""

    def located(text: Column) -> Column:
        return (text != "") & F.forall(
            evidence,
            lambda item: F.coalesce(
                evidence_location(text, normalize_text(item["quote"])) == item["location"],
                F.lit(False),
            ),
        )

    return bind(normalized_text, located)


def evaluate(document: dict[str, Column], opportunity: Column, reference: date | Column) -> Column:
    """Gates in order - fields, opportunity, evidence, timing - then the score."""
    text = normalize_text(document["normalized_text"])
    end = document["application_end_date"]
    gate = F.coalesce(
        required_fields_reason(document, opportunity),
        opportunity_reason(opportunity),
        F.when(
            ~evidence_verifiable(text, opportunity["evidence"]), rules.REASON_NO_EVIDENCE
        ),
        timing_reason(
            document["publish_date"],
            document["effective_date"],
            document["application_start_date"],
            end,
        ),
    )
    scored = score(
        source_complete=F.lit(True),
        evidence_complete=F.size(opportunity["evidence"]) > 0,
        timely=end.isNull() | (end >= F.lit(reference)),
        industry_clear=opportunity["confidence"] >= 0.7,
        support=support_strength(document["normalized_text"]),
        leasing=leasing_strength(opportunity["scenarios"]),
        actionable=~is_blank(opportunity["recommended_action"]),
    )
    # The gates read the whole text: evaluate them once.
    return bind(
        gate, lambda reason: F.when(reason.isNotNull(), _observation(reason)).otherwise(scored)
    )


def document_columns(prefix: str | None = None) -> dict[str, Column]:
    """The document columns the gates read, from a table or from one struct of it."""
    names = (
        *rules.TRACE_LABELS,
        "attachment_errors",
        "publish_date",
        "effective_date",
        "application_start_date",
        "application_end_date",
    )
    return {name: col(f"{prefix}.{name}" if prefix else name) for name in names}
