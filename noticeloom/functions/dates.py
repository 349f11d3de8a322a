"""Date expressions; invalid text gives NULL, never an error."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

from noticeloom import rules
from noticeloom.functions.text import WHITESPACE, col, normalize_text


def loose_date(text: Column | str) -> Column:
    """First year-month-day in the text, with any of the accepted separators."""
    found = F.nullif(F.regexp_extract(col(text), rules.DATE_PATTERN, 0), F.lit(""))
    return F.try_to_date(F.translate(found, "/.年月", "----"), "yyyy-M-d")


def iso_date_prefix(text: Column | str) -> Column:
    """First ten characters as an ISO date."""
    head = F.substring(col(text), 1, 10)
    return F.coalesce(
        F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd")),
        F.when(head.rlike(r"^\d{8}$"), F.try_to_date(head, "yyyyMMdd")),
    )


def labelled_date(text: Column | str, labels: Sequence[str]) -> Column:
    """Date after the first label that has one; an invalid date there ends the search."""
    stretches = [
        F.nullif(
            F.regexp_extract(
                col(text), f"{label}{WHITESPACE}*[：:]?{WHITESPACE}*{rules.DATE_PATTERN}", 0
            ),
            F.lit(""),
        )
        for label in labels
    ]
    return loose_date(F.coalesce(*stretches))


def publisher(text: Column | str, labels: Sequence[str] = rules.PUBLISHER_LABELS) -> Column:
    """Value after a publisher label up to the line end, NULL when there is no label."""
    names = "|".join(labels)
    pattern = f"(?:{names}){WHITESPACE}*[：:]{WHITESPACE}*([^\\n]+)"
    return F.when(col(text).rlike(pattern), normalize_text(F.regexp_extract(col(text), pattern, 1)))


def document_number(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(text), rules.DOCUMENT_NUMBER_PATTERN, 0), F.lit(""))


def date_window(value: Column | str, start: date | Column, end: date | Column) -> Column:
    """Inclusive on both ends; an unknown date passes."""
    return col(value).isNull() | col(value).between(F.lit(start), F.lit(end))


def resolve_window(start: date | None = None, end: date | None = None) -> tuple[date, date]:
    """Default window: the thirty days up to today in UTC."""
    last = end or datetime.now(timezone.utc).date()
    first = start or last - timedelta(days=rules.DEFAULT_WINDOW_DAYS)
    if first > last:
        raise ValueError("start date must not be later than end date")
    return first, last


def timing_reason(publish: Column, effective: Column, start: Column, end: Column) -> Column:
    """Why the dates cannot be used: none known, or the end precedes start or publication."""
    unknown = F.coalesce(publish, effective, start, end).isNull()
    return F.when(unknown, rules.REASON_TIMING_UNCLEAR).when(
        (end < start) | (end < publish), rules.REASON_TIMING_CONFLICT
    )

