"""Substring, suffix-array and near-duplicate operators beside brute force."""

from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from noticeloom.llm import bwt, minhash, repeats as runs, suffix_dedup as suffix
from noticeloom.llm.components import components
from noticeloom.llm.minhash import fast_sketch, minhash_dedup
from noticeloom.llm.rolling import mix, sliding_min, word_chunks
from noticeloom.llm.substring_dedup import substring_dedup
from noticeloom.llm.suffix_dedup import suffix_dedup


def _by_id(found, *names):
    return {row["doc_id"]: tuple(row)[1:] for row in found.select("_row.doc_id", *names).collect()}


def test_substring_dedup(awkward, texts):
    found = substring_dedup(awkward)
    assert _by_id(found, "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(texts)


def test_substring_dedup_short_windows(awkward, texts):
    found = substring_dedup(awkward, length=3, gram=2)
    assert _by_id(found, "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(texts, 3)
    for row in found.collect():
        assert row["n_removed"] == sum(span["end"] - span["start"] for span in row["spans"])
        expected = row["kept_sha256"]
        assert row["n_removed"] == 0 or brute.sha(row["kept_text"]) == expected


def test_suffix_dedup(awkward, texts):
    found = suffix_dedup(awkward).selectExpr("*", "cast(size(spans) as long) as count")
    assert _by_id(found, "n_bytes", "n_removed", "count", "kept_sha256") == brute.suffix_dedup(texts)
    assert all(brute.sha(bytes(row["kept"])) == row["kept_sha256"] for row in found.collect())


def test_suffix_dedup_crowded_anchors_give_the_same(awkward, texts, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_CONTEXTS", 1)
    found = suffix_dedup(awkward, spell=False).selectExpr("*", "cast(size(spans) as long) as count")
    assert _by_id(found, "n_bytes", "n_removed", "count", "kept_sha256") == brute.suffix_dedup(texts)


@pytest.mark.parametrize("limit", [2, 20])
def test_suffix_dedup_one_passage_in_many_surroundings(spark, monkeypatch, limit):
    """A passage shorter than a window, with few and many different bytes at either side, is refined level by level."""
    source, texts = random.Random(7), {}
    passage = "".join(source.choices("abcdefgh ", k=72))
    sides = ["".join(source.choices("xyz", k=60)) for _ in range(6)]
    for key in range(160):
        before, after = source.choice(sides)[source.randrange(40) :], source.choice(sides)[: source.randrange(60)]
        texts[key] = before + passage + after if key % 3 else before + passage + after + str(key) + before + passage + after
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    levels, halves = [], suffix._halves
    monkeypatch.setattr(suffix, "_halves", lambda *rest: levels.append(rest) or halves(*rest))
    monkeypatch.setattr(suffix, "BLOCK_CONTEXTS", limit)
    found = suffix_dedup(docs, spell=False).selectExpr("*", "cast(size(spans) as long) as count")
    assert _by_id(found, "n_bytes", "n_removed", "count", "kept_sha256") == brute.suffix_dedup(texts)
    assert 1 <= len(levels) <= 7


def test_halves_of_equal_windows_share_their_name():
    """Every window of a context lies in one half; equal windows of different contexts in halves of one name."""
    source = random.Random(3)
    middle = "".join(source.choices("abcd", k=110)).encode()
    contexts = [bytes(source.choices(b"xyz", k=9)) + middle + bytes(source.choices(b"xyz", k=5)) for _ in range(8)]
    least, gram = 100, 32
    place = [suffix._anchor_place(text, gram) for text in contexts]
    rows, names = [], ["_key", "first", "place", "low", "high", "context"]
    for key, text in enumerate(contexts):
        first, last = max(0, place[key] - (least - gram)), min(len(text) - least, place[key])
        rows.append((key, first, None, 0, least - gram, text[first : last + least]))
    for level in range(7):
        types = [pa.int64()] * 5 + [pa.binary()]
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), types, strict=True)]
        found = list(suffix._halves(least, gram)([pa.RecordBatch.from_arrays(columns, names=names)]))
        table = [row for batch in found for row in batch.to_pylist()]
        under: dict[bytes, set[int]] = {}
        starts = set()
        for row in table:
            for at in range(row["end"] - least - row["first"] + 1):
                starts.add((row["_key"], row["first"] + at))
                under.setdefault(row["context"][at : at + least], set()).add(row["anchor"])
        assert starts == {(row[0], row[1] + at) for row in rows for at in range(len(row[5]) - least + 1)}
        assert all(len(anchors) == 1 for anchors in under.values())
        rows = [tuple(row[name] for name in names) for row in table]
    assert all(len(row[5]) == least for row in rows)


def test_near_groups(awkward, texts):
    found = minhash_dedup(awkward, width=2)
    assert _by_id(found, "n_shingles", "component_id", "kept") == brute.near_groups(texts)
    assert _by_id(minhash_dedup(awkward), "n_shingles", "component_id", "kept") == brute.near_groups(texts, width=5)


def test_near_groups_keep_every_link(spark):
    """Chains of edits whose ends are apart, and dissimilar texts in crowded buckets."""
    source, texts = random.Random(4), {}
    for chain in range(6):
        words = [f"c{chain}x{at}" for at in range(60)]
        for step in range(12):
            texts[len(texts)] = " ".join(words)
            words[source.randrange(60)] = f"new{chain}y{step}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute.near_groups(texts)
    for options in ({}, {"bands": 64, "rows": 1}):
        found = minhash_dedup(docs, width=2, **options)
        assert _by_id(found, "n_shingles", "component_id", "kept") == expected


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup, minhash_dedup])
def test_empty_table(nothing, operator):
    assert operator(nothing).collect() == []


def test_repeated_and_null_ids(doubtful):
    """Each row has a result: equal rows the same, different texts of one id their own."""
    cut = substring_dedup(doubtful, spell=False)
    assert sorted((row["_row"]["doc_id"] or -1, row["n_words"], row["n_removed"]) for row in cut.collect()) == [
        (-1, 0, 0), (-1, 160, 0), (5, 160, 0), (5, 160, 160), (5, 160, 160), (7, 160, 160), (7, 160, 160),
    ]
    bytes_cut = suffix_dedup(doubtful, spell=False)
    assert sum(row["n_removed"] == row["n_bytes"] for row in bytes_cut.collect()) == 5
    near = minhash_dedup(doubtful).collect()
    assert len(near) == 7 and sum(row["kept"] for row in near) == 3


def test_components(spark):
    path = [(at, at + 1) for at in range(40)]
    star = [(100, at) for at in range(101, 130)]
    links = spark.createDataFrame([*path, *star, (7, 7)], "a long, b long")
    roots = {row["node"]: row["root"] for row in components(links).collect()}
    assert roots == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(links.limit(0)).collect() == []


def test_sketch_is_filled_and_estimates():
    source = np.random.default_rng(1)
    for size in (1, 3, 50, 2000):
        codes = mix(source.integers(0, 2**63, size).astype(np.uint64))
        sketch = fast_sketch(np.zeros(size, np.int64), codes, 1, 128)
        assert (sketch != minhash._FILLED).all()
    codes = mix(source.integers(0, 2**63, 1200).astype(np.uint64))
    one, other = codes[:1000], codes[200:]
    both = fast_sketch(np.repeat([0, 1], 1000), np.concatenate([one, other]), 2, 1024)
    assert abs((both[0] == both[1]).mean() - 800 / 1200) < 0.06


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=6), st.integers(1, 8))
def test_equal_windows_of_a_block(parts, least):
    texts = [part.encode() for part in parts if part]
    if not texts:
        return
    seen, expected = set(), []
    for number, text in enumerate(texts):
        for at in range(len(text) - least + 1):
            if text[at : at + least] in seen:
                expected.append((number, at))
            seen.add(text[at : at + least])
    owner, start = bwt.repeats(texts, least)
    assert sorted(zip(owner.tolist(), start.tolist(), strict=True)) == expected


def test_long_texts_are_hashed_in_pieces():
    texts = [" ".join(f"w{at % 97}" for at in range(5000)).encode(), b"x " * 10, None, b""]
    whole = [words for words in word_chunks(texts)]
    pieces = [words for words in word_chunks(texts, limit=500)]
    for name in ("document", "code", "start", "end"):
        joined = [np.concatenate([getattr(words, name) for words in part]) for part in (whole, pieces)]
        assert (joined[0] == joined[1]).all()


def test_every_window_lies_in_one_run():
    texts = [b"abcabcabcabcabc" * 20, b"x" * 400, bytes(range(256)) * 3]
    kind = runs.Windows(30, 7, words=False)
    for number, text in enumerate(texts):
        starts = []
        for document, shift, found in kind.runs(texts):
            mine = document == number
            for first, last in zip((found.first + shift)[mine], (found.last + shift)[mine], strict=True):
                starts += range(first, last + 1)
        assert sorted(starts) == list(range(len(text) - 29))


def test_sliding_min():
    values = np.random.default_rng(2).integers(0, 99, 200).astype(np.uint64)
    for width in (1, 2, 5, 41, 200):
        expected = [values[at : at + width].min() for at in range(200 - width + 1)]
        assert sliding_min(values, width).tolist() == expected
