"""Every registered query beside its SQL on the smallest data."""

from __future__ import annotations

import pytest
from compare import compare, connect

from noticeloom.workload import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    problem = compare(spark, con, FOLDER, QUERIES[name], ORACLES.get(name))
    assert problem in (None, "both empty")


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_lost_from_the_priority_sheet_are_seen(spark, con, monkeypatch):
    from noticeloom import rules
    from noticeloom.sources import writers

    whole = writers.write_export
    lossy = lambda rows, *rest: whole(rows.filter(rows["sheet_name"] != rules.PRIORITY_SHEET), *rest)
    monkeypatch.setattr(writers, "write_export", lossy)
    problems = [compare(spark, con, FOLDER, QUERIES[name], ORACLES[name]) for name in sorted(QUERIES) if name.startswith("export_")]
    assert any(problems)
