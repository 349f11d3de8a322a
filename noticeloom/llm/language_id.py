"""Language identification: word frequencies first, shorter and shorter character n-grams after."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from noticeloom.llm.common import small

#: Labelled documents of a language the model is fitted on, at most about so many, chosen by a hash of id
#: and text. The model holds every word and n-gram of these and no other, so this bounds it.
SAMPLE_ROWS = 2_500
LONGEST_GRAM = 5
#: Scores of unseen words kept in a Python worker, and letters of these words.
KEPT_WORDS = 100_000
KEPT_LETTERS = 4_000_000
#: Letters of the n-grams by which an unseen word is more or less like the known ones.
FAMILIAR_GRAM = 3

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _grams(word: str, length: int) -> list[str]:
    """The n-grams of a word between marks; the word itself, marked, when it is shorter."""
    marked = f" {word} "
    return [marked[at : at + length] for at in range(max(1, len(marked) - length + 1))]


@dataclass(frozen=True)
class Model:
    """Log frequencies: row i of a table belongs to line i of its entries, column j to language j."""

    languages: tuple[str, ...]
    words: str
    word_scores: np.ndarray
    grams: str
    gram_scores: np.ndarray


def _entries(text: str) -> dict[str, int]:
    return {entry: number for number, entry in enumerate(text.split("\n"))} if text else {}


class _Scorer(dict):
    """Word to row of ``rows``; an unseen word gets a row by backoff, kept until space runs out."""

    def __init__(self, model: Model):
        super().__init__(_entries(model.words))
        self.grams = _entries(model.grams)
        self.gram_scores = model.gram_scores
        self.known = len(self)
        self.rows = np.zeros((self.known + KEPT_WORDS, len(model.languages)))
        self.rows[: self.known] = model.word_scores
        self.like = np.ones(self.known + KEPT_WORDS)
        self.unseen: list[str] = []
        self.letters = 0
        self.floor = model.word_scores.min(axis=0) if self.known else np.zeros(len(model.languages))

    def __missing__(self, word: str) -> int:
        row = self.known + len(self.unseen)
        self[word] = row
        self.unseen.append(word)
        self.letters += len(word)
        self.rows[row] = self._backoff(word)
        grams = _grams(word, FAMILIAR_GRAM)
        self.like[row] = sum(gram in self.grams for gram in grams) / len(grams)
        return row

    def _backoff(self, word: str) -> np.ndarray:
        for length in range(LONGEST_GRAM, 0, -1):
            found = [self.grams[gram] for gram in _grams(word, length) if gram in self.grams]
            if found:
                return self.gram_scores[found].mean(axis=0)
        return self.floor * 0 + self.floor.mean()

    def make_room(self, count: int) -> None:
        """Forget unseen words when fewer than ``count`` rows are left."""
        if len(self.unseen) + count > KEPT_WORDS or self.letters > KEPT_LETTERS:
            for word in self.unseen:
                del self[word]
            self.unseen, self.letters = [], 0
            if self.known + count > len(self.like):
                self.rows = np.concatenate([self.rows[: self.known], np.zeros((count, self.rows.shape[1]))])
                self.like = np.ones(self.known + count)


def _predict(model: Model, keep_text: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in small(batches):
            languages, scores, like = [], [], []
            for text in batch.column(1).to_pylist():
                counts = Counter(_words(text))
                if not model.languages or not any(any(map(str.isalpha, word)) for word in counts):
                    languages.append(UNKNOWN)
                    scores.append(0.0)
                    like.append(0.0)
                    continue
                scorer.make_room(len(counts))
                rows = np.fromiter(map(scorer.__getitem__, counts), np.int64, len(counts))
                weights = np.fromiter(counts.values(), np.float64, len(counts))
                totals = weights @ scorer.rows[rows]
                best = int(totals.argmax())
                languages.append(model.languages[best])
                scores.append(float(1 / np.exp(totals - totals[best]).sum()))
                like.append(float(weights @ scorer.like[rows] / weights.sum()))
            columns = [batch.column(0), batch.column(1)] if keep_text else [batch.column(0)]
            names = ["_row", "_text"] if keep_text else ["_row"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(languages, pa.string()), *(pa.array(one, pa.float64()) for one in (scores, like))],
                names=[*names, "lang_pred", "score", "familiar"],
            )

    return emit


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 2_000):
        counts: Counter = Counter()
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, count in Counter(_words(text)).items():
                counts[language, word] += count
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key[0] for key in counts], pa.string()),
                pa.array([key[1] for key in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            names=["lang", "entry", "n"],
        )


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for language, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for length in range(1, LONGEST_GRAM + 1):
                for gram in set(_grams(word, length)):
                    counts[language, gram] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key[0] for key in counts], pa.string()),
                pa.array([key[1] for key in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            names=["lang", "entry", "n"],
        )


def _table(counts: DataFrame, languages: tuple[str, ...]) -> tuple[str, np.ndarray]:
    """All entries with their smoothed log frequency per language."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("entries")).collect()
    per_language = {row["lang"]: row["n"] for row in totals}
    each = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"n{at}") for at, name in enumerate(languages)]
    wide = counts.groupBy("entry").agg(F.sum("n").alias("total"), *each)
    top = sorted(wide.collect(), key=lambda row: row["entry"])
    seen = np.array([[row[f"n{at}"] for at in range(len(languages))] for row in top], float).reshape(len(top), len(languages))
    sizes = np.array([per_language.get(name, 0) for name in languages], float)
    scores = np.log(seen + 0.5) - np.log(sizes + 0.5 * (len(top) + 1))
    return "\n".join(row["entry"] for row in top), scores


def train(
    docs: DataFrame, label: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS
) -> Model:
    """Fit on the labelled documents given; rows without label or text are passed over.

    Of a language with more than ``sample_rows`` of them, about that many are chosen by a hash of id and
    text, so a rare language is learned from all its rows. Without any, the model knows no language and
    every prediction is ``und``.
    """
    labelled = docs.select(
        F.col(f"`{label}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("id")
    ).filter("lang is not null and text is not null")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    chosen = F.pmod(F.xxhash64("id", "text"), F.col("rows")) < sample_rows
    # One row per language, as the model has one column per language; texts of a language stay where they are.
    labelled = labelled.join(F.broadcast(counts), "lang").filter(chosen)
    schema = "lang string, entry string, n long"
    counted = labelled.select("lang", "text").mapInArrow(_count_words, schema)
    words = counted.groupBy("lang", "entry").agg(F.sum("n").alias("n")).persist()
    languages = tuple(sorted(row["lang"] for row in words.select("lang").distinct().collect()))
    grams = words.select("lang", "entry").mapInArrow(_count_grams, schema)
    grams = grams.groupBy("lang", "entry").agg(F.sum("n").alias("n")).persist()
    model = Model(languages, *_table(words, languages), *_table(grams, languages))
    words.unpersist()
    grams.unpersist()
    return model


def held_out(id_col: str = "doc_id", parts: int = 5) -> Column:
    """Rows kept out of training: the CRC-32 of the id's text is divisible by ``parts``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == 0


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None, keep_text: bool = False
) -> DataFrame:
    """Per row: ``_row`` (the carried columns; all but the text by default), lang_pred, score, familiar.

    ``score`` is the model's posterior of the predicted language, from the words of the whole text
    alone; ties go to the first language by name. A null text, or one without a letter, is ``und``
    with score 0. ``familiar`` is how much the text is like what the model has seen, in whatever language:
    the mean over its words, 1 for a known one, else the share of its 3-grams that are known. The
    posterior compares languages with each other, this one the text with all of them. ``keep_text`` adds
    the text as ``_text``. An empty table gives an empty result.
    """
    names = [name for name in docs.columns if name != text_col] if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    text = ", _text string" if keep_text else ""
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}{text}, lang_pred string, score double, familiar double"
    return rows.mapInArrow(_predict(model, keep_text), schema)
