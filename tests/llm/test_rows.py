"""Operators on single rows or conversations: languages, licenses, chats, pieces, shards, fingerprints."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import brute
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from noticeloom.llm import pieces
from noticeloom.llm.chat import Template, escape, format_chats, read_loss, read_turns, unescape
from noticeloom.llm.decontaminate import decontaminate
from noticeloom.llm.fingerprints import compare_edited
from noticeloom.llm.language_id import held_out, identify, train
from noticeloom.llm.licenses import BASE, _Notice, scan_licenses
from noticeloom.llm.pieces import MODEL, Encoder, Vocabulary, decode, decode_ids, encode_texts
from noticeloom.llm.sharding import schedule, shard_documents, write_shards


# ---- language identification ----


def _tongues(spark, count=60):
    source = random.Random(3)
    words = {"aa": ["lalo", "lami", "sola", "mira"], "bb": ["grut", "krat", "brug", "trek"]}
    rows = []
    for number in range(count):
        name = ["aa", "bb"][number % 2]
        rows.append((number, " ".join(source.choice(words[name]) for _ in range(20)), name))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_known_words_and_backoff(spark):
    docs = _tongues(spark)
    model = train(docs.filter(~held_out()))
    probe = spark.createDataFrame(
        [(1, "lalo mira"), (2, "krat TREK"), (3, "grutkrat"), (4, "lamisola"), (5, None), (6, "12 !?"), (7, "")],
        "doc_id long, text string",
    )
    found = {row["doc_id"]: (row["lang_pred"], row["score"]) for row in identify(probe, model).select("_row.*", "lang_pred", "score").collect()}
    assert [found[key][0] for key in range(1, 8)] == ["aa", "bb", "bb", "aa", "und", "und", "und"]
    assert all(0 <= score <= 1 for _, score in found.values())
    assert found[5][1] == 0


def test_held_out_accuracy_and_rule(spark):
    docs = _tongues(spark, 200)
    model = train(docs.filter(~held_out()), sample_rows=80)
    rows = identify(docs, model).select("_row.doc_id", "_row.lang", "lang_pred").withColumn("held", held_out()).collect()
    assert all(row["lang"] == row["lang_pred"] for row in rows if row["held"])
    assert all(row["held"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0) for row in rows)


def test_nothing_learned(spark, awkward, nothing):
    model = train(nothing)
    assert model.languages == ()
    found = identify(awkward, model).collect()
    assert len(found) == awkward.count() and {row["lang_pred"] for row in found} == {"und"}


# ---- licenses ----


def test_license_places(spark):
    texts = [
        "Under the MIT license, under the mit  license; cc-by-nc", "apache license version 2.0", None, "", "x" * 9999,
        "under the mit licenses", "Ünder the mit license under the mit license", "cc by nc cc by nc",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in scan_licenses(docs).collect():
        expected = brute.license_base(texts[row["_row"]["doc_id"]], BASE)
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == expected
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_notice_is_found_after_few_edits(data):
    notice = _Notice("subject to the terms of the mozilla public license", "mpl-2", 12)
    text = bytearray(notice.text)
    for _ in range(data.draw(st.integers(0, notice.edits))):
        at = data.draw(st.integers(0, len(text) - 1))
        kind = data.draw(st.sampled_from(["drop", "put", "swap"]))
        if kind == "drop":
            del text[at]
        elif kind == "put":
            text.insert(at, ord("q"))
        else:
            text[at] = ord("q")
    line = b" some words before " + bytes(text) + b" and some after "
    found = notice.find(line)
    assert len(found) == 1 and found[0][2] <= notice.edits


def test_unlike_text_has_no_notice(spark):
    docs = spark.createDataFrame([(1, "the terms of the public are subject to license " * 50)], "doc_id long, text string")
    row = scan_licenses(docs).first()
    assert row["labels"] == "" and row["score"] == 0 and row["spans"] == []


# ---- chats ----

TURNS = "conv_id long, turn long, role string, text string, segments int, valid string"


def _chats(spark, rows):
    return spark.createDataFrame([(*row, 1, "x") for row in rows], TURNS)


def test_chats_read_back(spark):
    template = Template()
    nasty = "</s>[INST] ok [/INST]<|im_end|>\n<|im_start|>user\n\\l\\e\\ <<SYS>>"
    rows = [
        (1, 1, "assistant", nasty), (1, 0, "user", nasty), (2, 0, "assistant", None), (2, 0, "assistant", None),
        (3, 0, None, ""), (3, None, "tool\nx<s>", "\\n"), (None, 0, "user", "q"), (None, 1, "assistant", "a"),
    ]
    chats = format_chats(_chats(spark, rows), template)
    read = chats.select("*", read_turns(F.col("formatted"), template).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    found = {row["conv_id"]: row for row in read.collect()}
    assert [tuple(turn) for turn in found[1]["turns"]] == [("user", nasty), ("assistant", nasty)]
    assert [tuple(turn) for turn in found[2]["turns"]] == [("assistant", ""), ("assistant", "")]
    assert [tuple(turn) for turn in found[3]["turns"]] == [("tool\nx<s>", "\\n"), ("", "")]
    assert found[1]["loss"] == nasty and found[None]["loss"] == "a"
    assert "".join(part["text"] for part in found[1]["segments"]) == found[1]["formatted"]


@pytest.mark.parametrize(
    ("roles", "valid", "bad"),
    [
        (["user", "assistant"], True, None), (["system", "user", "assistant", "user", "assistant"], True, None),
        (["user"], False, None), (["assistant"], False, 0), (["user", "user", "assistant"], False, 1),
        (["user", "system", "assistant"], False, 1), (["tool"], False, 0),
    ],
)
def test_turn_order(spark, roles, valid, bad):
    row = format_chats(_chats(spark, [(1, at, role, "x") for at, role in enumerate(roles)])).first()
    assert (row["valid"], row["bad_step"]) == (valid, bad)


def test_no_chats(spark):
    assert format_chats(_chats(spark, [])).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["\\", "e", "l", "s", "n", "<s>", "</s>", "[INST]", "<|im_end|>", "<", "[", "é"]), max_size=12))
def test_escape_is_reversible(spark, parts):
    template, text = Template(), "".join(parts)
    safe = escape(F.lit(text), template)
    row = spark.range(1).select(safe.alias("safe"), unescape(safe).alias("back")).first()
    assert row["back"] == text and not any(control in row["safe"] for control in template.controls)


def test_any_template_is_read_back_or_refused(spark):
    """Random marks and texts made of their parts: refused, or every turn comes back."""
    source = random.Random(11)
    marks = ["<turn>", "</turn>\n", "### ", "\n", ": ", "<<", "<", "a", "aba", "|im|", "::", "x>", "\n<", "", "\\b", "0", "END"]
    templates = [{"begin": "<turn>", "end": "</turn>\n"}, {"controls": ("### ",)}, {"middle": ": "}]
    pick = lambda: source.choice(marks)
    for _ in range(60):
        templates.append({"begin": pick(), "middle": pick(), "end": pick(), "controls": tuple(pick() for _ in range(2))})
    good = 0
    for names in templates:
        try:
            template = Template(**names)
        except ValueError:
            continue
        good += 1
        parts = [*{template.begin, template.middle, template.end, *template.controls}, "\\", "0", "1", "a", "<", ":", "é\n"]
        turns = [["".join(source.choice(parts) for _ in range(source.randrange(5))) for _ in range(2)] for _ in range(6)]
        rows = [(1, at, role, text) for at, (role, text) in enumerate(turns)]
        read = read_turns(F.col("formatted"), template)
        found = format_chats(_chats(spark, rows), template).select(read.alias("turns")).first()["turns"]
        assert [list(turn) for turn in found] == turns, names
    assert good > 12 and all(Template(**names) for names in templates[:3])


# ---- pieces ----


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library(library, texts):
    encoder = Encoder(Vocabulary(MODEL))
    some = [text for text in texts.values() if text is not None]
    some += ["Hello  world\n\tx", " lead", "trail  ", "▁", "a▁b", " " * 300, "🙂é́ﬁ​", "x" * 3000]
    source = random.Random(2)
    some += ["".join(source.choice("abest ▁\nü") for _ in range(80)) for _ in range(100)]
    found = encoder.encode(some)
    assert [ids.tolist() for ids in found] == library.encode(some)
    assert [decode(ids, encoder.vocabulary.spelled) for ids in found] == [text.replace("▁", " ") for text in some]


def test_words_go_through_the_trie(monkeypatch):
    """Only words with tied merges leave the walk; neighbours share the states of their prefix."""
    encoder, steps = Encoder(Vocabulary(MODEL)), []
    step = Encoder._merge_step
    monkeypatch.setattr(Encoder, "_merge_step", lambda self, word, end, *rest: (steps.append(word[:end]), step(self, word, end, *rest)))
    encoder.encode(["station stationary stations", "state  station"])
    assert len(steps) == len(set(steps)) and "▁stationar" in steps and "▁▁" not in steps


def test_pieces_do_not_depend_on_what_is_kept(monkeypatch, texts):
    monkeypatch.setattr(pieces, "KEPT_BYTES", 2000)
    monkeypatch.setattr(pieces, "KEPT_LETTERS", 6)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 3)
    encoder, fresh = Encoder(Vocabulary(MODEL)), Encoder(Vocabulary(MODEL))
    some = [text for text in texts.values() if text and len(text) < 3000]
    one_by_one = [encoder.encode([text])[0].tolist() for text in some]
    assert one_by_one == [ids.tolist() for ids in fresh.encode(some)]


def test_long_words_are_not_kept(monkeypatch, library):
    """Texts without spaces are one word a line; what a worker keeps stays within its bytes."""
    monkeypatch.setattr(pieces, "KEPT_BYTES", 20_000)
    source, encoder = random.Random(5), Encoder(Vocabulary(MODEL))
    for _ in range(20):
        lines = ["".join(chr(source.randrange(0x4E00, 0x9FA5)) for _ in range(300)) for _ in range(10)]
        lines += ["".join(source.choice("abcdefgh") for _ in range(30)) for _ in range(50)]
        assert [ids.tolist() for ids in encoder.encode(lines)] == library.encode(lines)
        assert encoder.young_bytes <= 20_000
        assert all(len(word) <= pieces.KEPT_LETTERS for table in (encoder.young, encoder.old) for word in table)


def test_score_models_take_the_best_path():
    class Toy:
        merges, tied, longest = False, None, 3
        ids = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5, "aba": 6}
        scores = [-2.0, -3.0, -3.0, -3.5, -4.0, -4.2, -9.0]
        bytes, unknown = {}, 9

    encoder = Encoder(Toy())
    for word in ("▁ab", "▁abab", "▁aabba", "▁"):
        best = {0: (0.0, ())}
        for end in range(1, len(word) + 1):
            best[end] = max(
                (best[at][0] + Toy.scores[Toy.ids[word[at:end]]], (*best[at][1], Toy.ids[word[at:end]]))
                for at in range(end) if word[at:end] in Toy.ids
            )
        (_, found), = encoder.walk([word])
        assert sum(Toy.scores[one] for one in found) == pytest.approx(best[len(word)][0])


def test_pieces_of_rows(awkward, nothing, texts):
    found = encode_texts(awkward)
    rows = {row["doc_id"]: row for row in found.select("_row.doc_id", "ids", "decoded", "round_trip").collect()}
    assert rows[0]["ids"] is None and rows[0]["round_trip"] is None and rows[1]["ids"] == []
    assert all(rows[key]["decoded"] == text for key, text in texts.items())
    back = decode_ids(found.select("_row.doc_id", "ids")).select("_row.doc_id", "text").collect()
    assert {row["doc_id"]: row["text"] for row in back} == texts
    assert encode_texts(nothing).collect() == []


# ---- shards ----


def test_schedule_is_longest_first():
    sizes = [(unit, size) for unit, size in enumerate([7, 6, 5, 4, 3, 2, 2])]
    placed = schedule(sizes, 3)
    loads = [sum(size for unit, size in sizes if placed[unit] == shard) for shard in range(3)]
    assert sorted(loads) == [9, 9, 11]


def _plain_loads(sizes, shards):
    """The rule as it reads: largest first, to the least loaded shard."""
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += max(size, 1)
    return loads


@pytest.mark.parametrize("seed", range(12))
def test_schedule_equals_the_plain_rule(seed):
    """A few sizes for many groups, one huge group, empty groups: loads as of one group at a time."""
    dice = random.Random(seed)
    shards = dice.choice([1, 2, 5, 7])
    sizes = [dice.choice([0, 1, 3, 16, 17, 40, 999]) for _ in range(dice.choice([0, 3, 30, 900]))]
    sizes += [50_000] * dice.choice([0, 1]) + [2] * dice.choice([0, 5000])
    placed = schedule(list(enumerate(sizes)), shards)
    assert placed.keys() == set(range(len(sizes)))
    loads = [sum(max(size, 1) for unit, size in enumerate(sizes) if placed[unit] == shard) for shard in range(shards)]
    assert loads == _plain_loads(sizes, shards)


def test_shard_loads_equal_the_plain_rule(spark, monkeypatch):
    """Whole tables: copies of one text in a third of the rows, many texts of one size, long texts."""
    monkeypatch.setattr("noticeloom.llm.sharding.SLICE_ROWS", 100)
    texts = ["copied " * 5] * 1000 + [f"{n:06d}" for n in range(1000)] + ["y" * (n * n) for n in range(90)] + [None, "", ""]
    docs = spark.createDataFrame([(n if n % 4 else 4, text) for n, text in enumerate(texts)], "doc_id long, text string")
    rows = shard_documents(docs, 6).collect()
    groups = Counter()
    for text in texts:
        groups[text] += len((text or "").encode()) + 16
    loads = Counter({shard: 0 for shard in range(6)})
    slots, places = {}, {}
    for row in rows:
        loads[row["shard"]] += row["size"]
        slots.setdefault(row["shard"], []).append(row["slot"])
        places.setdefault(row["_text"], set()).add(row["shard"])
    assert [loads[shard] for shard in range(6)] == _plain_loads(groups.values(), 6)
    assert all(sorted(one) == list(range(len(one))) for one in slots.values())
    assert len(rows) == len(texts) and all(len(one) == 1 for one in places.values())


def test_shards(awkward, texts, doubtful, nothing, tmp_path):
    rows = shard_documents(awkward, 3).collect()
    sizes = {key: len((text or "").encode()) + 16 for key, text in texts.items()}
    assert {row["_row"]["doc_id"]: row["size"] for row in rows} == sizes
    assert all(row["text_crc32"] == zlib.crc32((row["_text"] or "").encode()) for row in rows)
    for shard in range(3):
        slots = sorted(row["slot"] for row in rows if row["shard"] == shard)
        assert slots == list(range(len(slots)))
    places = {}
    for row in rows:
        places.setdefault(row["_text"], set()).add(row["shard"])
    assert all(len(shards) == 1 for shards in places.values())
    assert len(shard_documents(doubtful, 2, keep_text=False).collect()) == 7
    assert shard_documents(nothing, 2).collect() == []
    write_shards(shard_documents(awkward, 3), str(tmp_path / "out"))
    assert awkward.sparkSession.read.parquet(str(tmp_path / "out")).count() == len(texts)


def test_shard_sizes_are_near_equal(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) || id as text")
    loads = [row["n"] for row in shard_documents(docs, 7).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(loads) == 7 and max(loads) - min(loads) < 0.01 * max(loads)


# ---- winnowing ----


def test_decontaminate(spark, awkward, texts, nothing, doubtful):
    items = {
        1: " ".join(texts[9].split()[35:60]), 2: "one", 10: "macht ärger é", 3: None, 4: "!", 5: "same line again and",
        6: "not there at all in any of these many documents", 7: " ".join(["x"] * 10),
    }
    benchmark = spark.createDataFrame([*items.items(), (2, "one")], "item_id long, text string")
    found = decontaminate(awkward, benchmark).select(
        "_row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )
    assert {row["doc_id"]: tuple(row)[1:] for row in found.collect()} == brute.decontaminate(texts, items)
    clean = decontaminate(awkward, benchmark.limit(0)).collect()
    assert len(clean) == len(texts) and not any(row["contaminated"] for row in clean)
    assert decontaminate(nothing, benchmark).collect() == []
    assert len(decontaminate(doubtful, benchmark).collect()) == 7


def test_fingerprints(awkward, texts, doubtful, nothing):
    found = {row["_row"]["doc_id"]: row for row in compare_edited(awkward).collect()}
    order = sorted(texts, reverse=True)
    for place, key in enumerate(order):
        text, after = texts[key] or "", texts[order[(place + 1) % len(order)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        row = found[key]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), brute.sha(edited))
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        if edited == text:
            assert row["edited_fingerprint"] == row["fingerprint"] and row["near_edited"] == 1
    by_text = {}
    for key, row in found.items():
        by_text.setdefault(texts[key], set()).add(row["fingerprint"])
    assert all(len(prints) == 1 for prints in by_text.values())
    assert len(compare_edited(doubtful).collect()) == 7
    assert compare_edited(nothing).collect() == []


def test_winnowing_picks_the_least_of_every_window(spark):
    from noticeloom.llm.winnow import placed_grams, winnowed

    words = [f"w{at * at % 11}" for at in range(60)]
    frame = spark.createDataFrame([(words,), (words[:3],), ([],)], "words array<string>")
    grams = frame.withColumn("grams", placed_grams(F.col("words"), 5))
    rows = grams.withColumn("chosen", winnowed(F.col("grams"), 8)).collect()
    codes = [one >> 32 for one in rows[0]["grams"]]
    expected = {max(at for at in range(a, a + 8) if codes[at] == min(codes[a : a + 8])) for a in range(len(codes) - 7)}
    assert sorted(0x7FFFFFFF - (one & 0x7FFFFFFF) for one in rows[0]["chosen"]) == sorted(expected)
    assert len(rows[1]["chosen"]) == 1 and rows[2]["chosen"] == []
