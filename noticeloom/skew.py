"""Joins to per-key facts that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from noticeloom.session import staged


def join_facts(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], row_id: Sequence[str]
) -> DataFrame:
    """Add the facts of a row's key, null where there are none.

    ``keys`` and ``row_id`` together identify a row; ``facts`` has one row per key. Only the
    identifying columns meet the facts, in a plain join of two tables, whose hot keys adaptive
    execution splits; the facts are written first, so that they are a table and no aggregation
    stands in the way of splitting. The wide rows then move once, by row, which no key can skew.
    Rows with a null key have no facts.
    """
    own = list(dict.fromkeys([*keys, *row_id]))
    found = rows.select(*own).join(staged(facts, "facts"), list(keys))
    return rows.join(found, own, "left")
