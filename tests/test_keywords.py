"""The keyword join beside a plain search: short, hot, awkward and missing keywords."""

from __future__ import annotations

import random

import pytest

from noticeloom.operators import discovery
from noticeloom.operators.keywords import keyword_links


def _found(spark, texts, words):
    left = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    right = spark.createDataFrame([(word,) for word in words], "text string")
    return {row["id"]: row["hits"] for row in keyword_links(left, right, ["id"]).collect()}


def _expected(texts, words):
    distinct = sorted({word for word in words if word is not None}, key=lambda word: word.encode())
    found = {at: [word for word in distinct if word in text] for at, text in enumerate(texts) if text is not None}
    return {at: hits for at, hits in found.items() if hits}


@pytest.mark.parametrize("words", [
    ["租赁", "融资租赁", "设", "贷款贴息", "🙂", "é", "a", "ab", "abc", "abcd", "zzzz", "", None, "租赁"],
    ["zzz", "qqqq"], [], [None], [""], ["中"], ["a.c", "\n", " "],
])
def test_equals_a_plain_search(spark, words):
    texts = ["融资租赁与设备", "xxabcdxx", "ab", "a", "", None, "né🙂🙂", "贷款\n贴息", "a.c abc", "贷款贴息" * 3000, " "]
    assert _found(spark, texts, words) == _expected(texts, words)


def test_hot_grams_and_random_texts(spark):
    """One gram stands in every text and in most keywords."""
    source = random.Random(2)
    letters = "abc租"
    texts = ["aaa" + "".join(source.choice(letters) for _ in range(source.randrange(60))) for _ in range(300)]
    words = ["aaa" + "".join(source.choice(letters) for _ in range(source.randrange(1, 4))) for _ in range(120)]
    words += ["".join(source.choice(letters) for _ in range(source.randrange(1, 7))) for _ in range(200)]
    assert _found(spark, texts, words) == _expected(texts, words)


def test_a_table_matches_like_a_list(spark):
    rows = [("p", at, "全文提到租赁" if at % 2 else "无", [("设备通知", f"u{at}"), ("租赁通知", f"v{at}")]) for at in range(4)]
    pages = spark.createDataFrame(
        rows, "portal_id string, page_seq int, text_content string, policy_items array<struct<title:string,url:string>>"
    )
    words = ["租赁", "设备", "通"]
    table = spark.createDataFrame([(word,) for word in words], "text string")
    for limit in (3, 100):
        one = discovery.match_keywords(pages, words, limit=limit)
        other = discovery.match_keywords(pages, table, limit=limit)
        assert sorted(map(repr, other.select(one.columns).collect())) == sorted(map(repr, one.collect()))
    assert discovery.match_keywords(pages, table.limit(0)).count() == discovery.match_keywords(pages, []).count()


@pytest.mark.parametrize("block, chunk", [(7, 100), (10**6, 100), (7, 10**8)])
def test_blocks_and_chunks_lose_nothing(spark, monkeypatch, block, chunk):
    from noticeloom.operators import keywords

    monkeypatch.setattr(keywords, "BLOCK_WORDS", block)
    monkeypatch.setattr(keywords, "CHUNK_BYTES", chunk)
    source = random.Random(3)
    letters = "ab🙂租"
    texts = ["".join(source.choice(letters) for _ in range(source.randrange(40))) for _ in range(120)] + [None]
    words = ["".join(source.choice(letters) for _ in range(source.randrange(6))) for _ in range(60)] + [None]
    assert _found(spark, texts, words) == _expected(texts, words)


def test_no_grams_of_texts_are_shuffled(spark):
    """Texts are written once and keywords once a chunk: long texts of different letters cost no more rows."""
    from noticeloom.operators import keywords

    source = random.Random(4)
    texts = [(at, "".join(chr(source.randrange(0x4E00, 0x9000)) for _ in range(5000))) for at in range(20)]
    rows = spark.createDataFrame(texts, "id long, text string")
    words = spark.createDataFrame([(text[100:104],) for _, text in texts], "text string")
    plan = keywords.keyword_links(rows, words, ["id"])
    assert plan.count() == 20
    tree = plan._jdf.queryExecution().executedPlan().toString()
    assert "explode(_gram" not in tree and "_gram" not in tree
