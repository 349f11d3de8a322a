"""Merkle manifest beside plain trees, for several shapes, and what tampering does to it."""

from __future__ import annotations

import brute
import pytest

from noticeloom.llm.merkle import fold, lowered_leaf, manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree long, path string"


def _found(frame):
    names = ["_row.doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(repr, map(tuple, frame.select(*names).collect())))


def _rows():
    """One language of many rows, some of few, null languages, ids and texts, equal ids, repeated rows."""
    rows = [(key, "s", "en", key, f"Text {key} ÄB") for key in range(150)]
    rows += [(200 + key, None, f"l{key % 11}", None, None if key % 3 else "") for key in range(40)]
    rows += [(None, "s", None, 1, "A"), (None, "s", None, 1, "B"), (3, "s", None, 2, "C"), (3, "s", None, 2, "C")]
    return [*rows, (999, "s", "語", 3, "long " * 40000)]


@pytest.mark.parametrize(("fanout", "depth"), [(2, 1), (2, 3), (3, 2), (8, 1), (8, 4)])
def test_equals_plain_trees(spark, fanout, depth):
    rows = _rows()
    docs = spark.createDataFrame([(*row, 1, "p") for row in rows], SCHEMA).repartition(5)
    found = manifest(docs, COLUMNS, tampered=lowered_leaf(COLUMNS, "text", "doc_id"), fanout=fanout, depth=depth)
    assert _found(found) == sorted(map(repr, brute.manifest(rows, fanout)))
    for row in found.collect():
        assert fold(row["leaf"], [step.asDict() for step in row["path"]]) == row["root"]


def test_untampered_rows_are_verified(spark, awkward, doubtful):
    for docs in (awkward, doubtful):
        found = manifest(docs, COLUMNS, keep_path=False).collect()
        assert len(found) == docs.count() and all(row["verified"] for row in found)


def test_nothing(spark, nothing):
    assert manifest(nothing, COLUMNS).count() == 0


def test_any_change_of_order_or_value_changes_the_root(spark):
    rows = _rows()
    other = [*rows[:-1], (*rows[-1][:4], "other")]
    docs = [spark.createDataFrame([(*row, 1, "p") for row in part], SCHEMA) for part in (rows, rows[::-1], other)]
    roots = [manifest(part, COLUMNS, keep_path=False).first()["root"] for part in docs]
    assert roots[0] == roots[1] != roots[2]


def test_query(spark):
    from noticeloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [tuple(row) for row in spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS).collect()]
    found = QUERIES["op13_merkle_manifest"](spark, folder).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute.manifest(rows)))
