"""Run registered queries beside their SQL and compare the rows."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda index: names[index])
    return sorted(repr([_cell(row[index]) for index in order]) for row in rows)


def compare(spark, con, folder, query, sql):
    """Return None when rows agree, else a short description."""
    frame = query(spark, folder)
    mine = frame.collect()
    if len(set(frame.columns)) != len(frame.columns):
        return "duplicate column names"
    if sql is None:
        return None if mine is not None else "no rows"
    result = con.execute(sql)
    names = [item[0] for item in result.description]
    theirs = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    left, right = rows_of(frame.columns, mine), rows_of(names, theirs)
    if left == right:
        return None if left else "both empty"
    missing = [row for row in right if row not in set(left)][:2]
    extra = [row for row in left if row not in set(right)][:2]
    return f"{len(left)} rows against {len(right)}; only spark {extra}; only sql {missing}"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from noticeloom.session import build_session
    from noticeloom.workload import ORACLES, QUERIES

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        "compare",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = 0
    for name, query in QUERIES.items():
        if wanted and not any(part in name for part in wanted):
            continue
        started = time.time()
        try:
            problem = compare(spark, con, folder, query, ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        mark = "ok" if problem is None else "BAD"
        note = "" if name in ORACLES else " (no sql)"
        print(f"{mark:4}{name}{note} {time.time() - started:.2f}s {problem or ''}"[:2500], flush=True)
    print("bad:", bad, "of", len(QUERIES), "with sql", len(ORACLES))
