"""The registered fingerprint query beside a plain winnowing."""

from __future__ import annotations

import brute
from conftest import prose

from noticeloom.llm.fingerprints import GRAM, WINDOW, compare_edited
from noticeloom.llm.queries import QUERIES

_MASK = 0xFFFFFFFF


def _turned(value: int, by: int) -> int:
    return (value << by | value >> (32 - by)) & _MASK


def _mixed(code: int, value: int) -> int:
    value = _turned(value * 0xCC9E2D51 & _MASK, 15) * 0x1B873593 & _MASK
    return (_turned(code ^ value, 13) * 5 + 0xE6546B64) & _MASK


def _spark_hash(words: list[str]) -> int:
    """Spark's 32-bit Murmur hash of the words, each the seed of the next."""
    code = 42
    for word in words:
        data = word.encode()
        whole = len(data) // 4 * 4
        for at in range(0, whole, 4):
            code = _mixed(code, int.from_bytes(data[at : at + 4], "little"))
        for byte in data[whole:]:
            code = _mixed(code, (byte - 256 if byte > 127 else byte) & _MASK)
        code ^= len(data)
        code = (code ^ code >> 16) * 0x85EBCA6B & _MASK
        code = (code ^ code >> 13) * 0xC2B2AE35 & _MASK
        code ^= code >> 16
    return code


def _winnowed(text: str | None) -> list[tuple[int, int]]:
    """(place, hash) of the rightmost least gram of every window."""
    words = brute.plain_words(text)
    starts = range(max(len(words) - GRAM + 1, min(len(words), 1)))
    codes = [_spark_hash(words[at : at + GRAM]) & 0x7FFFFFFF for at in starts]
    chosen = set()
    for start in range(max(len(codes) - WINDOW + 1, min(len(codes), 1))):
        code, place = min((code, -at) for at, code in enumerate(codes[start : start + WINDOW], start))
        chosen.add((-place, code))
    return sorted(chosen)


def _spelled(chosen: list[tuple[int, int]]) -> str:
    return " ".join(f"{code:X}:{at}" for at, code in chosen)


def _alike(one: list[tuple[int, int]], other: list[tuple[int, int]]) -> float:
    left, right = ({code for _, code in chosen} for chosen in (one, other))
    return len(left & right) / len(left | right) if left | right else 1.0


def test_query_equals_plain_winnowing(spark, tmp_path):
    """All capitals, capitals at word heads, letters beyond ASCII, and the awkward texts' kinds."""
    capitals = [" ".join(prose(seed, 90)).upper().replace("W", "WORD") for seed in (1, 2)]
    texts = [None, "", "!!! ???", "ONE", "STOP NOW", "The End", "Übung MACHT Ärger É x Ü", *capitals, capitals[0].lower()]
    texts += ["ABC DEF GHI JKL MNO PQR STU VWX YZ " * 5, " ".join(prose(3, 300)).title(), " ".join(prose(4, 40)), "x A " * 60]
    docs = dict(enumerate(texts))
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {row["doc_id"]: row for row in QUERIES["op7_document_fingerprints"](spark, str(tmp_path)).collect()}
    assert rows.keys() == docs.keys()
    for key, row in rows.items():
        text, after = docs[key] or "", docs[(key - 1) % len(docs)] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, changed = _winnowed(text), _winnowed(edited)
        assert (row["fingerprint"], row["edited_fingerprint"]) == (_spelled(own), _spelled(changed))
        assert row["near_edited"] == _alike(own, changed) and row["near_next"] == _alike(own, _winnowed(after))
        assert bool(row["fingerprint"]) == any(map(str.isalnum, text))


def test_short_texts_keep_a_shared_run(spark):
    """Fourteen words, the first nine of them kept by the edit: enough for a shared fingerprint."""
    docs = [(at, " ".join(f"{at:02}{word:02}" for word in range(14))) for at in range(30)]
    found = compare_edited(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(found) == 30 and all(row["near_edited"] > 0 for row in found)
