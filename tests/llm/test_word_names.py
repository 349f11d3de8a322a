"""Words and windows over two letters: a linear hash modulo a power of two cannot tell some of them apart."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from noticeloom.llm.minhash import minhash_dedup
from noticeloom.llm.rolling import PRIME, prime_product, window_hashes, word_codes
from noticeloom.llm.substring_dedup import substring_dedup
from noticeloom.llm.suffix_dedup import suffix_dedup


def _twins(letters: int, a: str = "a", b: str = "b") -> tuple[str, str]:
    """The word whose letter says how many ones its place has in binary, odd or even, and its swapped twin."""
    word = [bin(at).count("1") % 2 for at in range(letters)]
    return "".join((a, b)[bit] for bit in word), "".join((b, a)[bit] for bit in word)


@pytest.fixture(scope="module")
def cases():
    source = random.Random(5)
    texts = [*_twins(1024), *_twins(2048), " ".join(_twins(1024, "a ", "b ")[0].split()), " ".join(_twins(1024, "a ", "b ")[1].split())]
    head = " ".join(f"w{at}" for at in range(49))
    texts += [f"{head} {word}" for word in _twins(1024)]
    texts += [" ".join(source.choice("xy") * source.randrange(1, 4) for _ in range(source.randrange(40, 120))) for _ in range(30)]
    texts += ["".join(source.choice("xy") for _ in range(source.randrange(90, 260))) for _ in range(30)]
    return dict(enumerate(texts))


def _docs(spark, cases):
    return spark.createDataFrame(list(cases.items()), "doc_id long, text string").repartition(3)


def test_near_groups(spark, cases):
    found = minhash_dedup(_docs(spark, cases), width=2).select("_row.doc_id", "n_shingles", "component_id", "kept").collect()
    assert {row[0]: tuple(row)[1:] for row in found} == brute.near_groups(cases)


def test_substrings(spark, cases):
    found = substring_dedup(_docs(spark, cases)).select("_row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert {row[0]: tuple(row)[1:] for row in found} == brute.substring_dedup(cases)


def test_suffixes(spark, cases):
    found = suffix_dedup(_docs(spark, cases)).selectExpr("_row.doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256")
    assert {row[0]: tuple(row)[1:] for row in found.collect()} == brute.suffix_dedup(cases)


def test_word_codes_follow_the_bytes():
    source = random.Random(6)
    words = ["".join(source.choice("ab") for _ in range(source.choice([1, 2, 7, 8, 9, 16, 17, 511, 512, 513, 700]))) for _ in range(500)]
    text = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(word) for word in words])
    codes = word_codes(text, end - [len(word) for word in words], end).tolist()
    assert len(set(zip(words, codes, strict=True))) == len(set(words)) == len(set(codes))


def test_prime_arithmetic():
    source = random.Random(7)
    pairs = [(source.randrange(PRIME), source.randrange(PRIME)) for _ in range(300)] + [(PRIME - 1, PRIME - 1), (0, 5)]
    a, b = (np.array(side, np.uint64) for side in zip(*pairs, strict=True))
    assert prime_product(a, b).tolist() == [x * y % PRIME for x, y in pairs]
    codes = np.array([source.randrange(1 << 64) for _ in range(50)] * 2, np.uint64)
    hashes = window_hashes(codes, 20, 1)
    assert (hashes[:31] == hashes[50:]).all() and len(set(hashes.tolist())) == 50
