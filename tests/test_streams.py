"""Streams of given tables and of batch files."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest

from noticeloom.session import STREAM_LOGS, fold_stream_logs_rarely
from noticeloom.streaming.batches import shares, stream_batches
from noticeloom.workload import QUERIES, reports

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def foldered(spark, tmp_path):
    """The given tables, with documents and events as folders of several files."""
    for name in os.listdir(FOLDER):
        if name.split(".")[0] in ("documents", "events"):
            spark.read.parquet(f"{FOLDER}/{name}").repartition(3).write.parquet(str(tmp_path / name))
        else:
            os.symlink(f"{FOLDER}/{name}", tmp_path / name)
    return str(tmp_path)


@pytest.mark.parametrize("name", ["stream_changed", "stream_run_counts"])
def test_a_table_may_be_a_folder_of_files(spark, foldered, name):
    found, expected = (sorted(map(tuple, QUERIES[name](spark, folder).collect())) for folder in (foldered, FOLDER))
    assert found == expected and found


def test_logs_of_a_stream_name_every_file_once(spark, tmp_path):
    """Folded every ten micro-batches they would name a file again in each fold, more often as the stream ages."""
    inbox, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))
    os.mkdir(inbox)
    files = 12
    for number in range(files):
        batch = {"schema_version": 1, "documents": [{"policy_id": str(number)}]}
        with open(f"{inbox}/policy-batch-{number}.json", "w") as file:
            json.dump(batch, file)
    for key in STREAM_LOGS:
        spark.conf.unset(key)
    docs = stream_batches(spark, inbox, max_files_per_trigger=1).select("policy_id")
    run = docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
    run.trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(out).distinct().count() == files
    for log in (f"{mark}/sources/0", f"{out}/_spark_metadata"):
        # The first line of a log file is its version.
        named = [line for name in os.listdir(log) if name[0] != "." for line in open(f"{log}/{name}").readlines()[1:]]
        assert len(named) == files


def test_own_settings_of_a_session_stay(spark):
    key = next(iter(STREAM_LOGS))
    spark.conf.set(key, "7")
    try:
        fold_stream_logs_rarely(spark)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, STREAM_LOGS[key])


def test_batch_files_are_streamed_side_by_side(spark, tmp_path, monkeypatch):
    """Every file once, four a micro-batch, and no stream has to take all of them one after the other."""
    made = spark.range(4000).selectExpr(
        "id AS doc_id", "concat('t', id) AS text", "'en' AS lang", "concat('s', id % 3) AS source", "1L AS n_chars"
    )
    made.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(reports, "scratch", lambda _, name: str(tmp_path / name))
    got = sorted(map(tuple, QUERIES["stream_batches"](spark, str(tmp_path)).collect()))
    whole = [[n % 100 for n in range(4000) if n % 3 == part] for part in range(3)]
    assert got == [(f"s{part}", len(places), sum(places)) for part, places in enumerate(whole)]
    root = tmp_path / "files"
    streams = {}
    for log in root.glob("checkpoint/**/sources/0/[0-9]*"):
        named = [json.loads(line)["path"].rsplit("/", 1)[1] for line in log.read_text().splitlines()[1:]]
        assert 0 < len(named) <= 4
        streams.setdefault(log.parent, []).append(named)
    read = sorted(name for batches in streams.values() for named in batches for name in named)
    assert read == sorted(path.name for path in root.glob("in/*.json")) and len(read) == 40
    assert max(map(len, streams.values())) < 10


@pytest.mark.parametrize("pattern", ["*.json", "policy-batch-*.json", "policy-batch-*", "p?licy-batch-?*.json"])
def test_every_name_has_one_share(spark, tmp_path, pattern):
    """Names with and without a digit, and with nothing in place of the star."""
    names = [f"policy-batch-{name}.json" for name in ("", *range(12), "a", "-8", "-81", "8-8", "-8x", "9-89", "é", "!", "0 ]", "]")]
    for name in [*names, "other.json", "7.json", "policy-batch-3.txt"]:
        (tmp_path / name).write_text("x")

    def fitting(glob):
        read = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(str(tmp_path))
        return [Path(row["path"]).name for row in read.select("path").collect()]

    assert sorted(name for share in shares(pattern) for name in fitting(share)) == sorted(fitting(pattern))


@pytest.mark.parametrize("pattern", ["policy-batch.json", "*-8*.json", "[a-c]*.json", "{a,b}*.json", "\\*.json"])
def test_other_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        shares(pattern)
