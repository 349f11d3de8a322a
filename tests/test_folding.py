"""Case folding against Python's, for every letter that folding changes, alone and inside words."""

from __future__ import annotations

import sys

from noticeloom.functions.text import case_folded, search


def test_every_letter_folds_as_in_python(spark):
    letters = [chr(code) for code in range(sys.maxunicode + 1) if not 0xD800 <= code <= 0xDFFF and chr(code).casefold() != chr(code)]
    texts = [form.format(letter) for letter in letters for form in ("{}", "a{}b", "A{} Σ")]
    texts += ["ΟΔΥΣΣΕΥΣ ὈΔΥΣΣΕΎΣ", "STRASSE Straße ẞ", "İstanbul Iı", "ﬁn ﬃ ﬆ", "Ǆ ǅ ǆ", "Ꭰ ꭰ ᏸ", "ＡＢＣ Ⅷ ⓐⒷ", "", "租赁 ABC", "ſ µ K Å"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {row["id"]: row["folded"] for row in rows.select("id", case_folded("text").alias("folded")).collect()}
    wrong = [(text, found[at], text.casefold()) for at, text in enumerate(texts) if found[at] != text.casefold()]
    assert not wrong, wrong[:5]


def test_search_folds_both_sides(spark):
    rows = spark.createDataFrame([(0, "Große STRASSE"), (1, "ὀδυσσεύς"), (2, None), (3, "eﬃcient")], "id long, text string")
    ask = lambda query: [row["id"] for row in rows.filter(search(query, ["text"])).orderBy("id").collect()]
    assert ask("STRAẞE") == ask("strasse") == [0] and ask("ὈΔΥΣΣΕΎΣ") == [1] and ask("EFFI") == [3]
    assert ask("  ") == [0, 1, 2, 3]
