"""Conversation structure repair: the cheapest edits that give a legal order of roles.

A cost DP runs over places between turns and states of the role machine. The arcs that lie on a cheapest
way form a graph; its nodes are ranked by the audit letters of their next 1, 2, 4, ... edits, with pointers
that double each time. The ranks pick the least audit of all cheapest ones, the doubled pointers its edits.

Conversations are worked on in blocks of bounded length. Where one has several, a block is first reduced to
a small matrix (cost from every state at its start to every state at its end); the matrices, one row a
block, are folded along the conversation, so all blocks of a long conversation are solved side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticeloom.llm.streams import Rows, whole_runs
from noticeloom.operators.ordering import with_global_position
from noticeloom.session import staged

#: Turns of a block.
BLOCK_ROWS = 2048
_WHITE = r"\x20\x09-\x0D"
_FAR = np.int64(1) << 40
#: Audit letters in ASCII order; 0 stands for the end of an audit.
LETTERS = "DIKR"
_DELETE, _INSERT, _KEEP, _REROLE = 1, 2, 3, 4


@dataclass(frozen=True)
class Machine:
    """Which role may follow which, by role initials, and what an edit costs.

    The state is the last initial, at first ``""``. ``roles`` gives the roles that turns may be given and
    that may be inserted. No state may allow two of them, so an audit letter leads to one state alone.
    """

    follows: dict[str, str] = field(default_factory=lambda: {"": "su", "s": "u", "u": "a", "a": "u"})
    final: tuple[str, ...] = ("", "a")
    roles: dict[str, str] = field(default_factory=lambda: {"u": "user", "a": "assistant"})
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3

    def __post_init__(self) -> None:
        if any(sum(one in self.roles for one in after) > 1 for after in self.follows.values()):
            raise ValueError("a state may allow one role to be given or inserted, not two")
        if min(self.rerole, self.delete, self.insert) < 1 or self.truncated < 0:
            raise ValueError("edits cost 1 or more")

    @property
    def states(self) -> list[str]:
        return sorted(self.follows)

    def code(self, initial: str | None) -> int:
        """Number of the state that a role of this initial leads to; -1 for a role without one."""
        return self.states.index(initial) if initial and initial in self.follows else -1

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """May state q take the role of state r; which state an insertion leads to, or -1; cost of ending."""
        states = self.states
        take = np.array([[r != "" and r in self.follows[q] for r in states] for q in states])
        given = [next((states.index(r) for r in self.follows[q] if r in self.roles), -1) for q in states]
        end = np.array([0 if q in self.final else _FAR for q in states], np.int64)
        return take, np.array(given), end


class _Solver:
    """Costs and ways through many blocks at a time, in numpy.

    A block has a line for each of its rows and one more behind the last; a node is line * states + state.
    """

    def __init__(self, machine: Machine):
        self.machine = machine
        self.take, self.given, self.stop = machine.tables()
        self.count = len(self.given)
        self.end = self.closed(self.stop)

    def closed(self, costs: np.ndarray) -> np.ndarray:
        """Costs with insertions allowed first; the last axis goes by state."""
        for _ in range(self.count):
            inserted = np.where(self.given >= 0, costs[..., self.given] + self.machine.insert, _FAR)
            costs = np.minimum(costs, inserted)
        return np.minimum(costs, _FAR)

    def row_edits(self, role, gone, cut, after):
        """Costs by state of deleting, keeping and giving a role, with the costs ``after`` the rows."""
        extra, fixed = (cut * self.machine.truncated)[:, None], ~gone[:, None]
        known = np.maximum(role, 0)
        kept = np.take_along_axis(after, known[:, None], 1) + extra
        kept = np.where(self.take.T[known] & fixed & (role >= 0)[:, None], kept, _FAR)
        given = np.where((self.given >= 0) & fixed, after[:, self.given] + self.machine.rerole + extra, _FAR)
        return after + self.machine.delete, kept, given

    def costs(self, role, gone, cut, edges, ends):
        """Cost to go at every node, backwards through all blocks in step; ``ends`` are those behind each."""
        length, blocks = np.diff(edges), np.arange(len(edges) - 1)
        first = edges[:-1] + blocks
        out = np.empty((edges[-1] + len(blocks), self.count), np.int64)
        out[first + length] = ends
        order = np.argsort(-length, kind="stable")
        alive = np.searchsorted(-length[order], -np.arange(1, length.max(initial=0) + 1), "right")
        for step, many in enumerate(alive.tolist(), 1):
            block = order[:many]
            row, line = edges[block] + length[block] - step, first[block] + length[block] - step
            edits = self.row_edits(role[row], gone[row], cut[row], out[line + 1])
            out[line] = self.closed(np.minimum.reduce(edits))
        return out

    def ways(self, role, gone, cut, edges, costs, last):
        """(letter, pointers): the chosen arc's letter of every node and where 1, 2, 4, ... arcs lead.

        Nodes behind an inner block, or where a conversation may end, lead to themselves with letter 0.
        """
        lines, blocks = len(costs), np.arange(len(edges) - 1)
        owner = np.repeat(blocks, np.diff(edges))
        row_line, end_line = np.arange(edges[-1]) + owner, edges[1:] + blocks
        target = np.full((5, lines, self.count), -1)
        below = ((row_line + 1) * self.count)[:, None]
        edits = self.row_edits(role, gone, cut, costs[row_line + 1])
        to = (below + np.arange(self.count), below + np.maximum(role, 0)[:, None], below + np.maximum(self.given, 0))
        for letter, cost, node in zip((_DELETE, _KEEP, _REROLE), edits, to, strict=True):
            target[letter, row_line] = np.where((cost == costs[row_line]) & (cost < _FAR), node, -1)
        inserted = costs[:, self.given] + self.machine.insert
        node = np.arange(lines)[:, None] * self.count + np.maximum(self.given, 0)
        target[_INSERT] = np.where((self.given >= 0) & (inserted == costs) & (costs < _FAR), node, -1)
        target[_INSERT, end_line[~last]] = -1
        target = target.reshape(5, -1)
        there = target >= 0
        nodes = np.arange(lines * self.count)
        letter = np.where(there.any(0), there.argmax(0), 0)
        rank, pointer = letter, np.where(letter > 0, target[letter, nodes], nodes)
        pointers = _doubled(pointer)
        for step in pointers:
            # By the next 2, 4, 8, ... letters: own rank first, then that of the node half way.
            rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[step], return_inverse=True)[1]
        worth = np.where(there, np.arange(5)[:, None] * (len(nodes) + 1) + rank[target], np.iinfo(np.int64).max)
        best = worth.argmin(0)
        chosen = np.where(letter > 0, target[best, nodes], nodes)
        return np.where(letter > 0, best, 0), pointers if (chosen == pointer).all() else _doubled(chosen)

    def followed(self, pointers, entry_nodes):
        """Which nodes lie on the ways from the given ones."""
        on = np.zeros(len(pointers[0]), bool)
        on[entry_nodes] = True
        for step in reversed(pointers):
            on[step[on]] = True
        return on


def _doubled(pointer: np.ndarray) -> list[np.ndarray]:
    out = [pointer]
    while (out[-1][out[-1]] != out[-1]).any():
        out.append(out[-1][out[-1]])
    return out


_FACTS = ["start", "block", "place", "last", "role", "gone", "cut"]


def _blocks(batches: Iterator[pa.RecordBatch], solver: _Solver):
    """Per chunk of blocks: start and number of each, rows' arrays, edges, ends, entries, last.

    A row of place -1 before a block's rows tells the costs behind it and, where known, its entry state;
    a block without one is a whole conversation.
    """
    for table, edges in whole_runs(batches, ["start", "block"]):
        arrays = {name: table.column(name).to_numpy() for name in _FACTS}
        told = arrays["place"] < 0
        heads = np.flatnonzero(told)
        blocks = len(edges) - 1
        ends = np.tile(solver.end, (blocks, 1))
        entry = np.zeros(blocks, np.int64)
        if len(heads):
            block = np.searchsorted(edges, heads, "right") - 1
            ends[block] = np.array([row.as_py() for row in table.column("ends").take(pa.array(heads))], np.int64)
            entry[block] = table.column("entry").to_numpy()[heads]
            edges = edges - np.searchsorted(heads, edges, "left")
            arrays = {name: values[~told] for name, values in arrays.items()}
        first = edges[:-1]
        known = arrays["role"].astype(np.int64), arrays["gone"].astype(bool), arrays["cut"].astype(np.int64)
        yield arrays["start"][first], arrays["block"][first], arrays, known, edges, ends, entry, arrays["last"][first].astype(bool)


def _dealt(facts: DataFrame, told: DataFrame | None) -> DataFrame:
    """Rows of facts by block, in order, with what is told of a block before them."""
    none = [F.lit(None).cast("array<long>").alias("ends"), F.lit(None).cast("long").alias("entry")]
    rows = facts.select(*_FACTS, *none)
    if told is not None:
        rows = rows.unionByName(
            told.select(
                "start", "block", F.lit(-1).cast("long").alias("place"), F.lit(0).alias("last"), F.lit(-1).alias("role"),
                F.lit(0).alias("gone"), F.lit(0).alias("cut"), "ends", "entry",
            )
        )
    return rows.repartition("start", "block").sortWithinPartitions("start", "block", "place")


def _long_plan(facts: DataFrame, machine: Machine) -> DataFrame:
    """(start, block, ends, entry) for the blocks of conversations that have several.

    Blocks become matrices side by side; folding these takes one short row a block.
    """
    solver = _Solver(machine)
    size = solver.count

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, numbers, _, known, edges, _, _, last in _blocks(batches, solver):
            first = edges[:-1] + np.arange(len(starts))
            columns = []
            for state in range(size):
                inner = np.where(np.arange(size) == state, 0, _FAR)
                final = solver.end if state == 0 else np.full(size, _FAR)
                ends = np.where(last[:, None], final, inner)
                columns.append(solver.costs(*known, edges, ends)[first])
            matrix = np.stack(columns, 2).reshape(len(starts), -1)
            yield _batch(starts, numbers, last.astype(np.int32), matrix.tolist(), names=["start", "block", "last", "matrix"])

    def folded_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = None
        for batch in batches:
            starts, numbers, last, matrices = (column.to_pylist() for column in batch.columns)
            ends = []
            for final, matrix in zip(last, matrices, strict=True):
                after = np.where(np.arange(size) == 0, 0, _FAR) if final else after
                ends.append(solver.end.tolist() if final else after.tolist())
                after = np.minimum((np.array(matrix).reshape(size, size) + after).min(1), _FAR)
            yield _batch(starts, numbers, ends, names=["start", "block", "ends"])

    def left_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, numbers, _, known, edges, ends, _, last in _blocks(batches, solver):
            costs = solver.costs(*known, edges, ends)
            far = solver.ways(*known, edges, costs, last)[1][-1]
            first = (edges[:-1] + np.arange(len(starts)))[:, None] * size + np.arange(size)
            yield _batch(
                starts, numbers, ends.tolist(), (far[first] % size).tolist(), names=["start", "block", "ends", "exits"]
            )

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = 0
        for batch in batches:
            starts, numbers, ends, exits = (column.to_pylist() for column in batch.columns)
            entry = []
            for number, after in zip(numbers, exits, strict=True):
                state = 0 if number == 0 else state
                entry.append(state)
                state = after[state]
            yield _batch(starts, numbers, ends, entry, names=["start", "block", "ends", "entry"])

    matrices = _dealt(facts, None).mapInArrow(reduced, "start long, block long, last int, matrix array<long>")
    back = matrices.repartition("start").sortWithinPartitions("start", F.col("block").desc())
    ends = staged(back.mapInArrow(folded_back, "start long, block long, ends array<long>"), "ends")
    told = ends.withColumn("entry", F.lit(0).cast("long"))
    exits = _dealt(facts, told).mapInArrow(left_through, "start long, block long, ends array<long>, exits array<long>")
    forth = exits.repartition("start").sortWithinPartitions("start", "block")
    return staged(forth.mapInArrow(entered, "start long, block long, ends array<long>, entry long"), "entries")


def _batch(*columns, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=names)


def _edits(facts: DataFrame, told: DataFrame | None, machine: Machine) -> DataFrame:
    """(start, position, inserted, edit, given, cost) per row and for what is inserted behind the last.

    ``inserted`` has the initials put before the row, ``edit`` its letter, ``given`` the initial it gets.
    """
    solver = _Solver(machine)
    size, states, letters = solver.count, machine.states, ["", *LETTERS]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, _, arrays, known, edges, ends, entry, last in _blocks(batches, solver):
            blocks = np.arange(len(starts))
            costs = solver.costs(*known, edges, ends)
            letter, pointers = solver.ways(*known, edges, costs, last)
            on = solver.followed(pointers, (edges[:-1] + blocks) * size + entry)
            node = np.flatnonzero(on & (letter > 0))
            line, code = node // size, letter[node]
            inserted: dict[int, str] = {}
            puts = node[code == _INSERT]
            entered = set(pointers[0][puts].tolist())
            for at in (one for one in puts.tolist() if one not in entered):
                while letter[at] == _INSERT:
                    at = int(pointers[0][at])
                    inserted[at // size] = inserted.get(at // size, "") + states[at % size]
            row_line = np.arange(edges[-1]) + np.repeat(blocks, np.diff(edges))
            edit, state = np.zeros(len(costs), np.int64), np.zeros(len(costs), np.int64)
            taken = code != _INSERT
            edit[line[taken]], state[line[taken]] = code[taken], pointers[0][node[taken]] % size
            end_line = edges[1:] + blocks
            tail = np.flatnonzero([at in inserted for at in end_line.tolist()])
            where = np.concatenate([row_line, end_line[tail]])
            start = np.concatenate([arrays["start"], starts[tail]])
            place = np.concatenate([arrays["place"], arrays["place"][edges[1:][tail] - 1] + 1])
            put = [inserted.get(at, "") for at in where.tolist()]
            gave = np.where(edit[where] == _REROLE, state[where], 0)
            price = np.array([0, machine.delete, 0, 0, machine.rerole])[edit[where]]
            price += machine.insert * np.array([len(one) for one in put], np.int64)
            price[: len(row_line)] += np.where(edit[row_line] == _DELETE, 0, known[2] * machine.truncated)
            yield _batch(
                start, start + place, put, [letters[one] for one in edit[where].tolist()],
                [states[one] for one in gave.tolist()], price,
                names=["start", "position", "inserted", "edit", "given", "cost"],
            )

    schema = "start long, position long, inserted string, edit string, given string, cost long"
    return _dealt(facts, told).mapInArrow(solved, schema)


@dataclass(frozen=True)
class Repair:
    """``turns``: position, conv_id, role, text. ``edits``: start, position, inserted, edit, given, cost.
    ``conversations``: start, conv_id, gaps, blank, duplicate, truncated, cost; start is its first position."""

    turns: DataFrame
    edits: DataFrame
    conversations: DataFrame
    machine: Machine


def repair_conversations(
    turns: DataFrame,
    machine: Machine | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> Repair:
    """Find the faults of every conversation and the cheapest edits to a legal order of roles.

    Turns stand by turn (null first), then role, then text; a null role or text is one space. A row is
    blank without any visible character, else a duplicate if role and text came before, else truncated if
    its last visible character does not end a sentence. Blank and duplicate rows must go. A role that is
    empty or has an unknown initial cannot be kept. Of equally cheap edits those with the least audit count. A null
    conversation id is a conversation of its own; an empty table has none. Other columns are not read.
    """
    machine = machine or Machine()
    filled = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        filled(role_col).alias("role"), filled(text_col).alias("text"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    numbered = with_global_position(rows, order)
    visible = F.col("text").rlike(f"[^{_WHITE}]")
    narrow = staged(
        numbered.select(
            "conv_id", "turn", "position", F.substring("role", 1, 1).alias("initial"), (~visible).alias("blank"),
            (~F.col("text").rlike(f"[.!?][{_WHITE}]*\\z")).alias("open"), F.sha2(F.col("role"), 256).alias("role_tag"),
            F.sha2(F.col("text"), 256).alias("text_tag"),
        ),
        "turns",
    )
    conversations = staged(_conversations(narrow), "conversations")
    # A position is unique, so this join has no hot key, however often a text repeats.
    firsts = narrow.groupBy("conv_id", "role_tag", "text_tag").agg(F.min("position").alias("position"))
    marked = narrow.join(firsts.select("position", F.lit(True).alias("first")), "position", "left")
    duplicate = ~F.col("blank") & F.col("first").isNull()
    named = conversations.select(F.col("conv_id").alias("_conv"), "start", "n")
    placed = marked.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")))
    states = F.create_map(*[F.lit(one) for state in machine.states if state for one in (state, machine.code(state))])
    place = F.col("position") - F.col("start")
    facts = staged(
        placed.select(
            "start", place.alias("place"),
            F.floor(place / block_rows).alias("block"),
            (F.floor(place / block_rows) == F.floor((F.col("n") - 1) / block_rows)).cast("int").alias("last"),
            F.coalesce(F.try_element_at(states, "initial"), F.lit(-1)).cast("int").alias("role"),
            (F.col("blank") | duplicate).cast("int").alias("gone"),
            (~F.col("blank") & ~duplicate & F.col("open")).cast("int").alias("cut"),
            F.col("blank").cast("int").alias("blank"), duplicate.cast("int").alias("duplicate"),
            (F.col("n") > block_rows).alias("several"),
        ),
        "facts",
    )
    long = facts.filter("several")
    told = None if long.isEmpty() else _long_plan(long, machine)
    edits = staged(_edits(facts, told, machine), "edits")
    faults = facts.groupBy("start").agg(
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("cut").alias("truncated")
    )
    costs = edits.groupBy("start").agg(F.sum("cost").alias("cost"))
    summed = conversations.drop("n").join(faults, "start").join(costs, "start")
    return Repair(numbered.select("position", "conv_id", "role", "text"), edits, summed, machine)


def _stream(repair: Repair) -> DataFrame:
    """Edits and turns of a conversation in one sorted stream, the edit of a row just before it."""
    named = repair.edits.join(repair.conversations.select("start", "conv_id"), "start")
    none = lambda *names: [F.lit(None).cast("string").alias(name) for name in names]
    edits = named.select("conv_id", "position", F.lit(0).alias("kind"), "start", "inserted", "edit", "given", *none("role", "text"))
    turns = repair.turns.select(
        "conv_id", "position", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("start"),
        *none("inserted", "edit", "given"), "role", "text",
    )
    rows = edits.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "position", "kind")
    return rows.drop("conv_id", "position")


def _steps(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[tuple]:
    """(start, letter, role before, role after, text) per edit; a letter of None ends a conversation.

    Only one row is looked at a time, so the length of a conversation does not matter.
    """
    at, edit, given = None, "", ""
    for batch in batches:
        for kind, start, inserted, letter, new, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind:
                after = {"D": None, "K": role, "R": machine.roles.get(given)}[edit]
                yield at, edit, role, after, text
                continue
            if at is not None and start != at:
                yield at, None, None, None, None
            at, edit, given = start, letter, new
            for initial in inserted:
                yield at, "I", None, machine.roles[initial], ""
    if at is not None:
        yield at, None, None, None, None


def audits(repair: Repair) -> DataFrame:
    """(start, illegal, audit, repaired_sha256) per conversation, read from the sorted stream."""
    machine = repair.machine
    pairs = {state + after for state, afters in machine.follows.items() if state for after in afters}
    schema = pa.schema([("start", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        before, illegal, audit, digest, mark = None, 0, [], hashlib.sha256(), b""
        for start, letter, role, after, text in _steps(batches, machine):
            if letter is None:
                out.add(start, illegal, "".join(audit), digest.hexdigest())
                before, illegal, audit, digest, mark = None, 0, [], hashlib.sha256(), b""
                if out.full():
                    yield out.take()
                continue
            audit.append(letter)
            if role is not None:
                illegal += before is not None and before + role[:1] not in pairs
                before = role[:1]
            if after is not None:
                digest.update(mark + f"{after}:{text}".encode())
                mark = b"\n"
        yield out.take()

    return _stream(repair).mapInArrow(summed, "start long, illegal long, audit string, repaired_sha256 string")


def repaired_turns(repair: Repair) -> DataFrame:
    """(start, step, edit, role, text): the turns of every repaired conversation, from step 0."""
    machine = repair.machine
    schema = pa.schema([("start", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, step = Rows(schema), 0
        for start, letter, _, after, text in _steps(batches, machine):
            if letter is None:
                step = 0
            elif after is not None:
                out.add(start, step, letter, after, text)
                step += 1
                if out.full():
                    yield out.take()
        yield out.take()

    return _stream(repair).mapInArrow(spelled, "start long, step long, edit string, role string, text string")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by the checksum of conversation and turn modulo 20.

    0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it a user's; a null is
    one space.
    """
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    key = F.concat(filled("conv_id"), F.lit(":"), filled("turn"))
    fate = F.crc32(key.cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    role = F.when(fate == 4, "user").otherwise(filled("role"))
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.array_repeat(F.lit(0), times).alias("_copy"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("_copy")).drop("col")


def _conversations(narrow: DataFrame) -> DataFrame:
    """(conv_id, start, n, gaps); turns are made distinct before a conversation is summed up."""
    by_turn = narrow.groupBy("conv_id", "turn").agg(F.min("position").alias("start"), F.count(F.lit(1)).alias("n"))
    found = by_turn.groupBy("conv_id").agg(
        F.min("start").alias("start"), F.sum("n").alias("n"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("turns"),
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return found.select("conv_id", "start", "n", gaps.alias("gaps"))
