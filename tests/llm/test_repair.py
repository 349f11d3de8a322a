"""Conversation repair beside a plain search, on short, long, awkward and missing rows."""

from __future__ import annotations

import random

import brute
import pytest

from noticeloom.llm.repair import Machine, audits, damaged, repair_conversations, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, start long, place string"
ROLES = ["user", "assistant", "system", None, "", "tool", "ufo", "a"]
TEXTS = ["A.", "b", "", " \t", "c!", "What?\n ", None, "A.", "語。", "x" * 5000 + "."]


def _frame(spark, rows):
    return spark.createDataFrame([(*row, 1, "p") for row in rows], SCHEMA).repartition(3)


def _digests(fixed):
    found = fixed.conversations.join(audits(fixed), "start")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {row["conv_id"]: tuple(row[name] for name in names) for row in found.collect()}


def _expected(rows):
    return {conv: found for conv, found in brute.repair(rows).items() if any(row[0] == conv for row in brute.damaged(rows))}


@pytest.fixture(scope="module")
def mixed():
    """Ties of turns, null ids, turns, roles and texts, repeated rows, unknown roles."""
    source = random.Random(1)
    pick = source.choice
    rows = [(pick([1, 2, None, 4]), pick([None, *range(30)]), pick(ROLES), pick(TEXTS)) for _ in range(240)]
    rows += rows[:20]
    for conv in range(100, 200):
        rows += [(conv, at, pick(ROLES[:3]), f"t{source.randrange(9)}" + pick(["", ".", "."])) for at in range(source.randrange(1, 12))]
    return rows


@pytest.mark.parametrize("block_rows", [2, 7, 2048])
def test_equals_a_plain_search(spark, mixed, block_rows):
    fixed = repair_conversations(damaged(_frame(spark, mixed)), block_rows=block_rows)
    assert _digests(fixed) == _expected(mixed)


def test_long_conversation_in_blocks(spark):
    source = random.Random(3)
    rows = [(1, at, source.choice(ROLES[:3]), f"t{source.randrange(1500)}.") for at in range(1500)]
    rows += [(2, 0, "user", "x."), (2, 1, "assistant", "y.")]
    fixed = repair_conversations(damaged(_frame(spark, rows)), block_rows=64)
    assert _digests(fixed) == _expected(rows)


def test_turns_are_written_in_order(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, 2, "user", "Why?"), (2, 0, "system", "Be good.")]
    fixed = repair_conversations(_frame(spark, rows))
    texts = {}
    for row in repaired_turns(fixed).orderBy("start", "step").collect():
        texts.setdefault(row["start"], []).append((row["edit"], row["role"], row["text"]))
    # Deleting the first turn as well costs 12, as does this; the second turn is a duplicate.
    assert texts == {1: [("I", "user", ""), ("K", "assistant", "Hi."), ("K", "user", "Why?"), ("I", "assistant", "")]}


def test_other_costs_and_roles(spark):
    machine = Machine(rerole=1, delete=9, insert=9)
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Ho.")]
    fixed = repair_conversations(_frame(spark, rows), machine)
    assert {row["audit"] for row in audits(fixed).collect()} == {"RK"}
    with pytest.raises(ValueError):
        Machine(follows={"": "ua", "u": "a", "a": "u"})


def test_nothing(spark):
    fixed = repair_conversations(_frame(spark, []))
    assert fixed.conversations.count() == audits(fixed).count() == repaired_turns(fixed).count() == 0


def test_query(spark):
    from noticeloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = {row[0]: tuple(row)[1:] for row in QUERIES["op11_conversation_repair"](spark, folder).collect()}
    assert found == brute.repair([tuple(row) for row in rows])


def test_damage(spark, mixed):
    rows = [tuple(row) for row in damaged(_frame(spark, mixed)).select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, brute.damaged(mixed)))
