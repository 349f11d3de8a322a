"""Stored pages written as files and read back."""

from __future__ import annotations

from datetime import date

import pytest

from noticeloom.sources.readers import read_snapshots
from noticeloom.sources.writers import write_snapshots

SCHEMA = "collected_on date, snapshot_id string, copy int, extension string, content binary"


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_snapshots_round_trip(spark, tmp_path, prefix):
    """Charsets, broken bytes, other kinds, copies of one id, names with blanks, empty and null contents."""
    day, other = date(2024, 5, 1), date(2024, 5, 2)
    chinese = '<meta charset="gbk">通知公告'
    rows = [
        (day, "a", 0, "html", "plain é".encode()),
        (day, "a", 1, "html", chinese.encode("gb18030")),
        (other, "a", 0, "html", "﻿marked".encode()),
        (other, "b 1%", 2, "html", b"broken \xff"),
        (other, "c", 0, "pdf", b"%PDF\x00\xff"),
        (other, "d", 0, "txt", b""),
        (other, "e-2", 3, "json", None),
        (other, "f", 0, "html", b"<meta charset=no-such-one>x"),
    ]
    root = f"{tmp_path}/out"
    assert write_snapshots(spark.createDataFrame(rows, SCHEMA).repartition(3), prefix + root) == len(rows)
    found = {tuple(row)[1:5]: (row["size"], bytes(row["content"]), row["body"]) for row in read_snapshots(spark, root).collect()}
    bodies = ["plain é", chinese, "marked", "broken �", None, "", "", "<meta charset=no-such-one>x"]
    # Files without a byte are written, but Spark's file source opens none of them.
    assert found == {
        tuple(row[:4]): (len(row[4]), row[4], body) for row, body in zip(rows, bodies, strict=True) if row[4]
    }
    assert (tmp_path / "out/20240502/e-2-3.json").read_bytes() == b""
    # A task that runs again writes the same files.
    assert write_snapshots(spark.createDataFrame(rows, SCHEMA), root) == len(rows)
    assert read_snapshots(spark, root).count() == len(found)


def test_no_snapshots(spark, tmp_path):
    assert write_snapshots(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none") == 0
