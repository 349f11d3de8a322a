"""Analyzer plug-in, strict reading of its JSON, and checks against catalogs and the text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from noticeloom import rules, schemas
from noticeloom.functions.text import bind, col, evidence_location, normalize_text
from noticeloom.session import staged

Analyzer = Callable[[Mapping[str, str], str], str]
RETRYABLE = (TimeoutError, json.JSONDecodeError, KeyError, TypeError)
RAW_ANALYSIS = T.StructType(
    [
        T.StructField("policy_id", T.StringType()),
        T.StructField("analysis_json", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def static_analyzer(answer: str) -> Analyzer:
    """An analyzer that gives every document the same answer; for tests."""
    return lambda document, note: answer


def with_retry(
    analyzer: Analyzer, validate: Callable[[str], object] = json.loads, attempts: int = 2
) -> Callable[[Mapping[str, str]], tuple[str | None, str | None, str | None]]:
    """Call again with the error appended when an answer is not usable, then give the error."""

    def call(document: Mapping[str, str], note: str = ""):
        for attempt in range(1, attempts + 1):
            try:
                answer = analyzer(document, note)
                validate(answer)
                return answer, None, None
            except Exception as error:  # noqa: BLE001 - an error becomes a row
                if attempt == attempts or not isinstance(error, RETRYABLE):
                    return None, type(error).__name__, str(error)
                note = f"{rules.RETRY_NOTE}{type(error).__name__}: {error}"

    return call


def analyze(
    docs: DataFrame,
    analyzer: Analyzer,
    columns: Sequence[str] = ("policy_id", "normalized_text"),
    validate: Callable[[str], object] = json.loads,
    attempts: int = 2,
) -> DataFrame:
    """Run the analyzer over documents in Arrow batches: (policy_id, analysis_json, error), ``seq``.

    Only ``columns`` travel to Python, and ``seq`` and ``note`` where the documents have them; a
    note is handed to the analyzer's first attempt. The analyzer is costly, so write or checkpoint
    the result before several readers use it.
    """
    call = with_retry(analyzer, validate, attempts)
    extra = [name for name in ("seq", "note") if name in docs.columns]
    keyed = "seq" in extra
    fields = [T.StructField("seq", T.LongType())] if keyed else []
    schema = T.StructType([*RAW_ANALYSIS.fields, *fields])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for document in frame.to_dict("records"):
                number, note = document.pop("seq", None), document.pop("note", None) or ""
                rows.append((document["policy_id"], *call(document, note), *([number] if keyed else [])))
            yield pd.DataFrame(rows, columns=schema.names)

    chosen = [F.col(name).cast("long") if name == "seq" else F.col(name) for name in dict.fromkeys([*columns, *extra])]
    return docs.select(*chosen).mapInPandas(batches, schema)


def analyze_checked(
    docs: DataFrame,
    analyzer: Analyzer,
    columns: Sequence[str] = ("policy_id", "normalized_text"),
    key: str = "seq",
) -> DataFrame:
    """Answers of the analyzer, asked again once where the first one fails or breaks the contract.

    The contract is the one of ``parse_analysis``. What is wrong goes along as a note. Both rounds
    are written, so each document is asked twice at most, whatever is read how often.
    """
    first = staged(parse_analysis(analyze(docs, analyzer, columns, attempts=1)).drop("analysis"), "answers")
    names = [error.__name__ for error in RETRYABLE]
    broken = F.col("contract_errors").isNotNull() & F.col("error_type").isNull()
    retried = broken | F.coalesce(F.col("error_type").isin(names), F.lit(False))
    told = F.when(broken, F.concat(F.lit("ValidationError: "), F.col("contract_errors"))).otherwise(
        F.concat_ws(": ", "error_type", "error")
    )
    note = F.concat(F.lit(rules.RETRY_NOTE), told).alias("note")
    again = docs.join(first.filter(retried).select(key, note), key)
    second = staged(analyze(again, analyzer, columns, attempts=1), "second_answers")
    return first.filter(~retried).drop("contract_errors").unionByName(second)


# ---- strict contract ------------------------------------------------------------------------

_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _kind(members: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_element_at(members, F.lit(name)))


def _text(members: Column, name: str) -> Column:
    return F.try_variant_get(F.try_element_at(members, F.lit(name)), "$", "string")


def _violation(path: str, ok: Column, message: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{path}: {message}"))


def _strings(members: Column, path: str, *names: str) -> list[Column]:
    return [
        _violation(path + name, _kind(members, name) == "STRING", "a string is required")
        for name in names
    ]


def _string_list(members: Column, path: str, name: str) -> Column:
    values = _items(F.try_element_at(members, F.lit(name)))
    ok = (F.size(values) > 0) & F.forall(
        values, lambda item: F.coalesce(F.schema_of_variant(item) == "STRING", F.lit(False))
    )
    return _violation(path + name, ok, "a nonempty list of strings is required")


def _known_keys(members: Column, path: str, names: Sequence[str]) -> Column:
    extra = F.array_except(F.map_keys(members), F.array(*[F.lit(name) for name in names]))
    return _violation(path or "$", F.size(extra) == 0, "unknown key")


def _found(*checks: Column) -> Column:
    return F.filter(F.array(*checks), lambda check: check.isNotNull())


def _evidence_violations(members: Column, path: str) -> Column:
    quote, location = _text(members, "quote"), _text(members, "location")
    return _found(
        _violation(path[:-1], members.isNotNull(), "an object is required"),
        _known_keys(members, path[:-1], schemas.EVIDENCE.names),
        *_strings(members, path, "quote", "location"),
        _violation(
            path + "quote", F.char_length(quote).between(2, 240), "2 to 240 characters required"
        ),
        _violation(
            path + "location",
            F.char_length(location).between(1, 80),
            "1 to 80 characters required",
        ),
    )


def _opportunity_violations(members: Column, path: str) -> Column:
    evidence = _items(F.try_element_at(members, F.lit("evidence")))
    confidence = F.try_variant_get(
        F.try_element_at(members, F.lit("confidence")), "$", "double"
    )
    own = _found(
        _violation(path[:-1], members.isNotNull(), "an object is required"),
        _known_keys(members, path[:-1], schemas.OPPORTUNITY.names),
        *_strings(
            members,
            path,
            "section_code",
            "section_name",
            "division_code",
            "division_name",
            "leasing_relevance",
            "recommended_action",
            "opening_script",
        ),
        _string_list(members, path, "business_tags"),
        _string_list(members, path, "scenarios"),
        _violation(
            path + "confidence",
            _kind(members, "confidence").rlike(_NUMBER) & confidence.between(0, 1),
            "a number from 0 to 1 is required",
        ),
        _violation(path + "evidence", F.size(evidence) > 0, "a nonempty list is required"),
    )
    nested = F.flatten(
        F.transform(
            evidence,
            lambda each: bind(
                _members(each), lambda inner: _evidence_violations(inner, path + "evidence.")
            ),
        )
    )
    return F.concat(own, F.coalesce(nested, F.array().cast("array<string>")))


def contract_violations(document: Column) -> Column:
    """Every way a parsed answer breaks the contract: types, keys, lengths and ranges.

    A variant keeps the JSON type of each value, so nothing is coerced before it is checked.
    Each object is split into its members once; all checks read that.
    """
    return bind(_members(document), _analysis_violations)


def _analysis_violations(members: Column) -> Column:
    has_items = F.array_contains(F.map_keys(members), "opportunities")
    items = _items(F.try_element_at(members, F.lit("opportunities")))
    benefit = F.try_variant_get(
        F.try_element_at(members, F.lit("is_benefit_policy")), "$", "boolean"
    )
    optional = [
        _violation(
            name,
            F.coalesce(_kind(members, name), F.lit("VOID")).isin("STRING", "VOID"),
            "a string or null is required",
        )
        for name in ("eligible_conditions", "risk_notes")
    ]
    own = _found(
        _known_keys(members, "", schemas.ANALYSIS.names),
        _violation(
            "is_benefit_policy",
            _kind(members, "is_benefit_policy") == "BOOLEAN",
            "a boolean is required",
        ),
        *_strings(members, "", "summary", "support_direction"),
        *optional,
        _violation("opportunities", ~has_items | items.isNotNull(), "a list is required"),
        _violation(
            "opportunities",
            F.coalesce(benefit, F.lit(True)) | F.coalesce(F.size(items) <= 0, F.lit(True)),
            "non-benefit policy cannot contain opportunities",
        ),
    )
    nested = F.flatten(
        F.transform(
            items,
            lambda each: bind(
                _members(each), lambda inner: _opportunity_violations(inner, "opportunities.")
            ),
        )
    )
    return F.when(members.isNull(), F.array(F.lit("$: a JSON object is required"))).otherwise(
        F.concat(own, F.coalesce(nested, F.array().cast("array<string>")))
    )


def parse_analysis(df: DataFrame, json_column: str = "analysis_json") -> DataFrame:
    """Add ``analysis`` (typed, NULL when invalid) and ``contract_errors`` (NULL when valid)."""
    found = contract_violations(F.try_parse_json(json_column))
    parsed = F.from_json(F.col(json_column), schemas.ANALYSIS)
    complete = parsed.withField(
        "opportunities", F.coalesce(parsed["opportunities"], F.array().cast(_OPPORTUNITIES))
    )
    given = F.col(json_column).isNotNull()
    marked = df.withColumn("_found", F.when(given, F.array_distinct(found)))
    valid = F.size("_found") == 0
    return (
        marked.withColumn("analysis", F.when(valid, complete))
        .withColumn(
            "contract_errors", F.when(given & ~valid, F.array_join("_found", "; "))
        )
        .drop("_found")
    )


_OPPORTUNITIES = T.ArrayType(schemas.OPPORTUNITY)


# ---- catalog, tags, scenarios and evidence ---------------------------------------------------


def all_members(values: Column | str, allowed: Sequence[str] | Column) -> Column:
    """Every item of the list is allowed."""
    permitted = (
        allowed if isinstance(allowed, Column) else F.array(*[F.lit(item) for item in allowed])
    )
    return F.size(F.array_except(col(values), permitted)) == 0


def codes_well_formed(opportunity: Column) -> Column:
    """One capital letter, and that letter with two digits."""
    section, division = opportunity["section_code"], opportunity["division_code"]
    return (
        section.rlike(r"\A[A-Z]\z")
        & division.rlike(r"\A[A-Z]\d{2}\z")
        & division.startswith(section)
    )


def ground_evidence(text: Column, evidence: Column) -> Column:
    """Overwrite each claimed location; a quote that is not in the text has location NULL."""

    def located(body: Column) -> Column:
        return F.transform(
            evidence,
            lambda item: F.struct(
                item["quote"].alias("quote"),
                evidence_location(body, normalize_text(item["quote"])).alias("location"),
            ),
        )

    return bind(text, located)


def valid_opportunities(
    opportunities: Column | str,
    normalized_text: Column,
    catalog: Mapping[str, str] | Sequence[str],
    tags: Sequence[str] | None = None,
    scenarios: Sequence[str] = rules.SCENARIOS,
) -> Column:
    """Keep the opportunities whose codes, names, tags, scenarios and quotes all check out.

    The catalog is a parameter of bounded size and becomes a literal; ``normalized_text`` is
    normalised already.
    """
    codes = list(catalog)
    names = catalog if isinstance(catalog, Mapping) else None
    permitted = F.array(*[F.lit(code) for code in codes])
    if names is not None:
        lookup = F.create_map(*[F.lit(item) for pair in names.items() for item in pair])

    def keep(item: Column) -> Column:
        checks = [
            codes_well_formed(item),
            F.array_contains(permitted, item["section_code"]),
            F.array_contains(permitted, item["division_code"]),
            all_members(item["scenarios"], scenarios),
            F.forall(item["evidence"], lambda each: each["location"].isNotNull()),
        ]
        if names is not None:
            checks += [
                F.try_element_at(lookup, item["section_code"]) == item["section_name"],
                F.try_element_at(lookup, item["division_code"]) == item["division_name"],
            ]
        if tags is not None:
            checks += [F.size(item["business_tags"]) > 0, all_members(item["business_tags"], tags)]
        return F.coalesce(reduce(and_, checks), F.lit(False))

    def grounded(text: Column) -> Column:
        return F.transform(
            col(opportunities),
            lambda item: item.withField("evidence", ground_evidence(text, item["evidence"])),
        )

    return F.filter(bind(normalized_text, grounded), keep)


def join_catalog(
    opportunities: DataFrame,
    catalog: DataFrame,
    section: str = "section_code",
    division: str = "division_code",
) -> DataFrame:
    """Look both codes up in a catalog table; rows with an unknown code drop out."""
    codes = catalog.select("code", "name")
    sections = codes.select(F.col("code").alias(section), F.col("name").alias("section_name"))
    divisions = codes.select(F.col("code").alias(division), F.col("name").alias("division_name"))
    return opportunities.join(sections, section).join(divisions, division)


def join_analysis(docs: DataFrame, analysis: DataFrame) -> DataFrame:
    """Documents with their analysis, one row each.

    With ``seq`` on both sides that number decides, so documents may share an id; an analysis
    without it is matched by policy_id, the last one by its text if an id has several.
    """
    if "seq" in docs.columns and "seq" in analysis.columns:
        return docs.join(analysis.drop("policy_id"), "seq", "left")
    rest = [name for name in analysis.columns if name != "policy_id"]
    one = analysis.groupBy("policy_id").agg(F.max(F.struct(*rest)).alias("found"))
    joined = docs.join(one, "policy_id", "left")
    return joined.select(*docs.columns, *[F.col(f"found.{name}").alias(name) for name in rest])
