"""Source mixing: targets beside a plain water level, quotas used up exactly, every word in its place."""

from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pytest

from noticeloom.llm.mixing import mix_sources, mixed_texts, permuted, split_quotas, taken_words

SCHEMA = "doc_id long, text string, source string, size long, start long, draw long"


def _docs(spark):
    source = random.Random(4)
    rows = [(None, None, "a"), (1, "", "a"), (2, " \n", None), (3, "one", "é"), (3, "one", "é"), (3, "two words", "é")]
    sizes = {"hot": 3000, "b": 40, None: 25, "z": 500, "empty": 0}
    key = 10
    for name, count in sizes.items():
        for _ in range(max(1, count // 25)):
            rows.append((key, " ".join(f"{name}{key}w{at}" for at in range(source.randrange(50))) if count else "", name))
            key += 1
    rows.append((key, " ".join(f"long{at}" for at in range(9000)), "hot"))
    source.shuffle(rows)
    return rows, spark.createDataFrame([(*row, 1, 2, 3) for row in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block_words", [1, 7, 1024])
def test_targets_and_words(spark, block_words):
    rows, docs = _docs(spark)
    mix = mix_sources(docs, shards=5, block_words=block_words)
    found = taken_words(mix).select("_row.source", "size", "source_size", "target", "taken").collect()
    assert len(found) == len(rows)
    names = sorted({row[2] for row in rows}, key=lambda name: (name is None, (name or "").encode()))
    sizes = [sum(len(brute.white_words(row[1])) for row in rows if row[2] == name) for name in names]
    targets = dict(zip(names, brute.water_level(sizes, [at % 3 + 1 for at in range(len(names))]), strict=True))
    for name, size in zip(names, sizes, strict=True):
        own = [row for row in found if row["source"] == name]
        assert {row["source_size"] for row in own} == {size}
        assert all(abs(row["target"] - targets[name]) < 1e-6 * max(1, size) for row in own)
        assert abs(sum(row["taken"] for row in own) - targets[name]) <= 0.5
        assert all(row["taken"] <= 3 * row["size"] for row in own)
    written = mixed_texts(mix).collect()
    words = Counter(word for row in written for word in row["text"].split(" "))
    assert sum(words.values()) == sum(row["taken"] for row in found)
    # A word comes as often as its block is drawn; passes differ by one at most.
    for name in ("hot", "z"):
        times = {words[word] for row in rows if row[2] == name for word in brute.white_words(row[1])}
        assert max(times) - min(times) <= 1
    draws = {(row["source_no"], row["draw"], row["shard"]) for row in written}
    assert len({draw[:2] for draw in draws}) == len(draws)
    shards = Counter(draw[2] for draw in draws)
    assert max(shards.values()) - min(shards[at] for at in range(5)) <= 1


def test_reruns_agree(spark):
    docs = _docs(spark)[1]
    first, second = (sorted(map(repr, mixed_texts(mix_sources(docs.repartition(n), 4, block_words=9)).collect())) for n in (2, 7))
    assert first == second


def test_split_uses_up_all_quotas():
    quotas, sizes = np.array([5, 0, 1000, 37]), np.array([300, 300, 300, 142])
    parts = dict(split_quotas(quotas, sizes, [1]))
    assert (sum(parts.values()) == quotas).all() and [parts[at].sum() for at in range(4)] == sizes.tolist()


def test_permutation():
    for count in (1, 2, 3, 16, 17, 1000):
        places = permuted(np.arange(count), np.full(count, count), np.full(count, 99))
        assert sorted(places.tolist()) == list(range(count))


def test_nothing(spark):
    docs = _docs(spark)[1]
    for rows in (docs.limit(0), docs.filter("text is null")):
        mix = mix_sources(rows)
        assert mix.draws.count() == 0 and taken_words(mix).count() == rows.count()
        assert all(row["target"] == 0 and row["taken"] == 0 for row in taken_words(mix).collect())


def test_query(spark):
    from noticeloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = {row["doc_id"]: row for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op12_source_mixing"](spark, folder).collect()
    assert {row["doc_id"]: row["size"] for row in found} == {key: len(brute.white_words(row["text"])) for key, row in docs.items()}
    names = sorted({row["source"] for row in docs.values()}, key=lambda name: (name is None, (name or "").encode()))
    own = {name: [row for row in found if docs[row["doc_id"]]["source"] == name] for name in names}
    sizes = [sum(row["size"] for row in own[name]) for name in names]
    for name, target in zip(names, brute.water_level(sizes, [at % 3 + 1 for at in range(len(names))]), strict=True):
        assert abs(sum(row["taken"] for row in own[name]) - target) <= 0.5
        assert {round(row["target"], 6) for row in own[name]} == {round(target, 6)}
