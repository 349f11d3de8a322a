"""Stable identifiers and source priority."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from noticeloom import rules
from noticeloom.functions.text import (
    col,
    contains_any,
    is_blank,
    normalize_document_number,
    normalize_text,
)
from noticeloom.functions.urls import canonical_url


def _iso(value: Column | str | None) -> Column:
    if value is None:
        return F.lit("")
    return F.coalesce(F.date_format(col(value), "yyyy-MM-dd"), F.lit(""))


def policy_id(
    source_id: Column | str,
    url: Column | str,
    title: Column | str,
    published: Column | str | None = None,
    number: Column | str | None = None,
) -> Column:
    """Source-scoped id from the document number, else the URL, else title and date.

    Pass no ``number`` where the table has none: that keeps the plan free of Python.
    """
    by_title = F.concat(
        F.lit("title-date:"), normalize_text(title), F.lit("|"), _iso(published)
    )
    identity = F.when(
        ~is_blank(url), F.concat(F.lit("url:"), canonical_url(url))
    ).otherwise(by_title)
    if number is not None:
        code = normalize_document_number(number)
        identity = F.when(
            F.coalesce(code, F.lit("")) != "", F.concat(F.lit("document:"), code)
        ).otherwise(identity)
    return F.substring(F.sha2(F.concat(col(source_id), F.lit("|"), identity), 256), 1, 24)


def cross_source_key(
    title: Column | str,
    published: Column | str | None,
    content_hash: Column | str,
    number: Column | str | None = None,
) -> Column:
    """Key shared by reposts: the document number, else title, date and content."""
    identity = F.concat(
        F.lit("title-date-content:"),
        normalize_text(title),
        F.lit("|"),
        _iso(published),
        F.lit("|"),
        col(content_hash),
    )
    if number is not None:
        given = F.coalesce(col(number), F.lit("")) != ""
        identity = F.when(
            given, F.concat(F.lit("document:"), normalize_document_number(number))
        ).otherwise(identity)
    return F.sha2(identity, 256)


def source_priority(
    publisher: Column | str,
    source_name: Column | str,
    phrases: tuple[str, ...] = rules.GOVERNMENT_NAME_PHRASES,
) -> Column:
    """0 for the issuer's own site, 1 for a government portal, 2 otherwise."""
    issuer = normalize_text(F.coalesce(col(publisher), F.lit("")))
    site = normalize_text(source_name)
    own = (issuer != "") & (site.contains(issuer) | issuer.contains(site))
    return F.when(own, 0).when(contains_any(site, phrases), 1).otherwise(2)
