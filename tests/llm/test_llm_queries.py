"""Registered queries and the pipeline on the smallest tables, beside SQL or brute force."""

from __future__ import annotations

import zlib
from collections import Counter

import brute
import pytest
from compare import compare, connect

import corpus_pipeline
from noticeloom.llm.licenses import BASE
from noticeloom.llm.pieces import MODEL
from noticeloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    return {row["doc_id"]: row for row in docs}, {row["item_id"]: row["text"] for row in items}


def _rows(spark, name):
    return {row["doc_id"]: tuple(row)[1:] for row in QUERIES[name](spark, FOLDER).collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name]) is None


def test_exact_queries_equal_brute_force(spark, tables):
    texts = {key: row["text"] for key, row in tables[0].items()}
    assert _rows(spark, "op4_suffix_dedup") == brute.suffix_dedup(texts)
    assert _rows(spark, "op8_minhash_near_dedup") == brute.near_groups(texts)
    assert _rows(spark, "op9_substring_dedup") == brute.substring_dedup(texts)
    base = {key: row[:5] for key, row in _rows(spark, "op5_license_scan").items()}
    assert base == {key: brute.license_base(text, BASE) for key, text in texts.items()}


def test_pieces_query_equals_the_library(spark, tables):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    for key, row in _rows(spark, "op1_sentencepiece").items():
        text = tables[0][key]["text"]
        ids = library.encode(text)
        assert row == (len(ids), ids, brute.sha(text.replace("▁", " ")), True)


def test_sharding_query(spark, tables):
    rows = QUERIES["op3_sharding"](spark, FOLDER).collect()
    texts = {key: row["text"] or "" for key, row in tables[0].items()}
    assert {row["doc_id"]: (row["size"], row["text_crc32"]) for row in rows} == {
        key: (len(text.encode()) + 16, zlib.crc32(text.encode())) for key, text in texts.items()
    }
    assert {row["law"] for row in rows} == {"bytes"} and {row["grown_shard"] for row in rows} == {None}
    places = {}
    for row in rows:
        places.setdefault(texts[row["doc_id"]], set()).add(row["shard"])
    assert all(len(shards) == 1 for shards in places.values())
    groups, loads = Counter(), Counter()
    for text in (row["text"] for row in tables[0].values()):
        groups[text] += len((text or "").encode()) + 16
    for row in rows:
        loads[row["shard"]] += row["size"]
    plain = [0] * 40
    for size in sorted(groups.values(), reverse=True):
        plain[plain.index(min(plain))] += size
    assert [loads[shard] for shard in range(40)] == plain
    for shard in range(40):
        slots = sorted(row["slot"] for row in rows if row["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_language_query(spark, tables):
    rows = _rows(spark, "op10_language_id")
    held = {key: zlib.crc32(str(key).encode()) % 5 == 0 for key in tables[0]}
    assert {key: row[0] for key, row in rows.items()} == held
    texts = {key: row["text"] for key, row in tables[0].items()}
    plain = brute.languages(texts, {key: row["lang"] for key, row in tables[0].items() if not held[key] and row["text"] is not None})
    assert {key: row[1] for key, row in rows.items()} == {key: one[0] for key, one in plain.items()}
    assert all(abs(row[2] - plain[key][1]) < 1e-6 for key, row in rows.items())
    right = [row[1] == tables[0][key]["lang"] for key, row in rows.items() if row[0]]
    assert sum(right) >= 0.95 * len(right)


def test_noise_is_unlike_any_language(spark, tables):
    """The posterior of noise may be high; its letters are still unlike what the model has seen."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    noise = ["qzxv kjwq wvxz qqjx zzkw", "日本語のテキストです", "xkcd plmq wrtz bnvc", "ЖЩЪ ыэюя", "ﬀﬁ ზღ"]
    strange = spark.createDataFrame([(10**6 + at, text) for at, text in enumerate(noise)], "doc_id long, text string")
    mixed = docs.unionByName(strange, allowMissingColumns=True)
    kept = {row["doc_id"] for row in corpus_pipeline.language_id(spark, mixed, FOLDER).collect()}
    assert kept == {key for key, row in tables[0].items() if any(map(str.isalpha, row["text"] or ""))}


def _collected(frame):
    return {row["doc_id"]: row for row in frame.collect()}


def test_pipeline_stage_by_stage(spark, tables, tmp_path):
    """Every stage against brute force on what the stage before it wrote."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {key: row["text"] for key, row in tables[0].items()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = _collected(docs)
        if name == "language_id":
            assert rows.keys() == {key for key, text in before.items() if any(map(str.isalpha, text or ""))}
        elif name == "near_dedup":
            assert rows.keys() == {key for key, row in brute.near_groups(before, width=5).items() if row[2]}
        elif name == "substring_dedup":
            cut = brute.substring_dedup(before)
            for key, row in rows.items():
                kept = row["text"] if cut[key][1] else " ".join(brute.white_words(row["text"]))
                assert brute.sha(kept) == cut[key][2] and row["n_chars"] == len(row["text"])
        elif name == "decontamination":
            found = brute.decontaminate(before, tables[1])
            assert rows.keys() == {key for key, row in found.items() if not row[4]}
        else:
            assert rows.keys() == before.keys() and all(row["round_trip"] for row in rows.values())
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            before = {key: row["text"] for key, row in rows.items()}


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    left = sorted(map(str, docs.collect()))
    assert left == sorted(map(str, corpus_pipeline.run(spark, FOLDER).collect()))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_rows(spark, awkward, doubtful, nothing, name):
    """Null and repeated ids, null texts, extra columns named like the operators' own, no rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (awkward, doubtful, nothing):
        found = stage(spark, docs, FOLDER)
        assert found.count() <= docs.count()
        if name != "sentencepiece":
            assert found.columns == docs.columns
