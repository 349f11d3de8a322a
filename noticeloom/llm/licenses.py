"""License scans: exact phrases, and short notices found again with a few edits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from noticeloom.llm.common import bytes_of, small

#: Phrases whose places are counted, with the label each one gives.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Short notices looked for with edits, with the label each one gives.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}

#: One edit (a letter more, less or other) is allowed for so many letters of a notice.
LETTERS_PER_EDIT = 12

_TABLE = bytes(
    byte | 0x20 if 0x41 <= byte <= 0x5A else byte if byte >= 0x80 or chr(byte).isalnum() else 0x20
    for byte in range(256)
)


class _Notice:
    """A notice cut into one more piece than it may have edits: one piece at least stands unharmed."""

    def __init__(self, phrase: str, label: str, letters_per_edit: int):
        self.text, self.label = phrase.encode(), label
        self.edits = len(phrase) // letters_per_edit
        cuts = np.linspace(0, len(phrase), self.edits + 2).astype(int).tolist()
        self.seeds = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        pattern = rb"(?e)(?:%s){e<=%d}" % (regex.escape(self.text, special_only=True), self.edits)
        self.pattern = regex.compile(pattern)

    def find(self, line: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the matches in a line, each place once."""
        slack, found = self.edits, []
        size = len(self.text)
        windows: list[tuple[int, int]] = []
        for at, seed in self.seeds:
            place = line.find(seed)
            while place >= 0:
                windows.append((max(0, place - at - slack), min(len(line), place - at + size + slack)))
                place = line.find(seed, place + 1)
        done = 0
        for low, high in _joined(windows):
            low = max(low, done)
            while match := self.pattern.search(line, low, high):
                found.append((match.start(), match.end(), sum(match.fuzzy_counts)))
                low = done = max(match.end(), match.start() + 1)
        return found


def _joined(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    spans.sort()
    low = high = None
    for a, b in spans:
        if high is None or a > high:
            if high is not None:
                yield low, high
            low, high = a, b
        else:
            high = max(high, b)
    if high is not None:
        yield low, high


def _places(line: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which the phrase's words stand; ``line`` has one space around every word."""
    wanted, seen, words = b" " + phrase + b" ", 0, 0
    at = line.find(wanted)
    while at >= 0:
        words += line.count(b" ", seen, at)
        seen = at
        yield words
        at = line.find(wanted, at + 1)


def _scan(base: Mapping[str, str], notices: Mapping[str, str], letters_per_edit: int):
    span = pa.struct(
        [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64()), ("text", pa.string())]
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [(phrase.encode(), label) for phrase, label in base.items()]
        kinds = [_Notice(phrase, label, letters_per_edit) for phrase, label in notices.items()]
        for batch in small(batches):
            out: list[list] = [[] for _ in range(7)]
            out_spans: list[list[dict]] = []
            for text in bytes_of(batch.column(1)):
                words = (text or b"").translate(_TABLE).split()
                line = b" %s " % b" ".join(words)
                exact, places = set(), []
                for phrase, label in phrases:
                    found = list(_places(line, phrase))
                    if found:
                        places += found
                        exact.add(label)
                spans, best = [], 1.0 if exact else 0.0
                for kind in kinds:
                    for start, end, edits in kind.find(line):
                        start += line[start : start + 1] == b" "
                        first = line.count(b" ", 0, start) - 1
                        last = first + len(line[start:end].split())
                        spelled = line[start:end].strip().decode("utf-8", "replace")
                        spans.append({"label": kind.label, "start": first, "end": last, "edits": edits, "text": spelled})
                        best = max(best, 1 - edits / len(kind.text))
                values = (
                    len(words),
                    len(places),
                    min(places, default=None),
                    max(places, default=None),
                    ",".join(sorted(exact)),
                    ",".join(sorted(exact | {one["label"] for one in spans})),
                    best,
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                out_spans.append(spans)
            kinds_of = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array(column, kind) for column, kind in zip(out, kinds_of, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(out_spans, pa.list_(span))],
                names=["_row", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return emit


def scan_licenses(
    docs: DataFrame,
    text_col: str = "text",
    base: Mapping[str, str] = BASE,
    notices: Mapping[str, str] = NOTICES,
    letters_per_edit: int = LETTERS_PER_EDIT,
    carry: list[str] | None = None,
) -> DataFrame:
    """Per row: ``_row`` (the carried columns), n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text, A-Z lowered; a null text is
    empty. Base phrases are counted wherever their words stand consecutively. Notices are matched
    in the words joined by one space, with at most one edit for ``letters_per_edit`` letters: one of
    the notice's pieces must stand unharmed, its places are the candidates, and a bounded-error
    match decides. ``spans`` holds label, first word, word after the last, edits and text of every
    such match. ``score`` is the best likeness of a match: 1 for a base phrase, else 1 less the
    edits' share of the notice's letters; 0 without a match.
    """
    names = [name for name in docs.columns if name != text_col] if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    schema = (
        f"_row {rows.schema['_row'].dataType.simpleString()}, n_words long, n_base long, first_word long, "
        "last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,start:long,end:long,edits:long,text:string>>"
    )
    return rows.mapInArrow(_scan(base, notices, letters_per_edit), schema)
