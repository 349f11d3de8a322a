from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor string, n_words int, spans int"


def prose(seed: int, count: int, vocabulary: int = 400) -> list[str]:
    source = random.Random(seed)
    return ["w" + format(source.randrange(vocabulary), "x") for _ in range(count)]


def awkward_texts() -> list[str | None]:
    """Null, empty, wordless, short, periodic, copied, nearly copied and very long texts."""
    shared = prose(1, 160)
    near = list(shared)
    near[80] = "changed"
    texts: list[str | None] = [None, "", "   \n\t ", "!!! ???", "one", "One", "Übung macht Ärger É x", "a" * 500, "ab" * 300]
    texts += [" ".join(shared), " ".join(shared), " ".join(near), "\n".join(shared[:70]) + " tail"]
    texts += [" ".join(prose(2, 40) + shared[30:110] + prose(3, 40)), " ".join(prose(4, 30) + shared[40:95] + prose(5, 9))]
    texts += ["same line again and again\n" * 60, " ".join(prose(6, 6000)), " ".join(prose(6, 3000) + prose(7, 500))]
    texts += ["\x00 control </s> \\l", "日本語 の テキスト 🙂 " * 30, " ".join(["x"] * 120), " ".join(["x"] * 121)]
    return texts


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with awkward texts and columns named like the operators' own."""
    rows = [
        (number, text, ["en", "de", None][number % 3], "s", len(text or ""), "a", 1, 2)
        for number, text in enumerate(awkward_texts())
    ]
    random.Random(9).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def texts():
    return dict(enumerate(awkward_texts()))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def doubtful(spark):
    """Repeated rows, one id with two texts, and null ids."""
    text = " ".join(prose(1, 160))
    other = " ".join(prose(8, 160))
    rows = [(5, text), (5, text), (5, other), (None, text), (None, None), (7, other), (7, other)]
    return spark.createDataFrame([(key, value, None, None, None, "a", 1, 2) for key, value in rows], SCHEMA)
