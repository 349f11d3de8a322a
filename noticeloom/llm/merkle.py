"""Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups' roots.

Leaves are dealt into aligned blocks of ``FANOUT ** DEPTH``. A block hashes its own levels; above
them blocks exchange roots in the pattern of a butterfly: in round r the up to ``FANOUT`` blocks whose
numbers differ in digit r alone meet, each of them takes the roots of all and hashes their parent. After
the last round every block holds the root and all upper siblings of its leaves; nothing is sent down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from noticeloom.llm.streams import Rows, whole_runs
from noticeloom.llm.winnow import ascii_lower
from noticeloom.operators.ordering import with_global_position
from noticeloom.session import staged

FANOUT = 8
#: Levels that a block of FANOUT ** DEPTH leaves hashes by itself.
DEPTH = 4

_PATH = pa.list_(pa.struct([("own", pa.int32()), ("run", pa.list_(pa.string()))]))
_PATH_SQL = "array<struct<own:int,run:array<string>>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Hash of the values in order: ``-`` for null, else UTF-8 length, ``:`` and the value."""
    texts = [column.cast("string") for column in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _levels(leaves: list[str], fanout: int, depth: int, alone: bool) -> list[list[str]]:
    """Digests by level; a block alone in its tree stops at its root, others after ``depth`` levels."""
    levels = [leaves]
    while len(levels[-1]) > 1 if alone else len(levels) <= depth:
        below = levels[-1]
        levels.append([digest(*below[at : at + fanout]) for at in range(0, len(below), fanout)])
    return levels


def _block_roots(leaves: DataFrame, fanout: int, depth: int) -> DataFrame:
    """(tree, block, blocks, digest, path): every block's root, with no siblings yet."""
    schema = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("blocks", pa.int64()), ("digest", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for table, edges in whole_runs(batches, ["tree", "block"]):
            digests, blocks = table.column("digest").to_pylist(), table.column("blocks").to_pylist()
            trees, numbers = table.column("tree").to_pylist(), table.column("block").to_pylist()
            for at, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                top = _levels(digests[at:end], fanout, depth, blocks[at] == 1)[-1][0]
                out.add(trees[at], numbers[at], blocks[at], top)
            if out.full():
                yield out.take()
        yield out.take()

    narrow = leaves.select("tree", "block", "blocks", "place", "digest").repartition("tree", "block")
    rows = narrow.sortWithinPartitions("tree", "block", "place").mapInArrow(
        hashed, "tree long, block long, blocks long, digest string"
    )
    return rows.withColumn("path", F.array().cast(_PATH_SQL))


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, digest, path): the root of the block's tree and the siblings on the way to it.

    One shuffle a round, by tree and all digits but the round's: at most ``fanout`` roots meet. Where
    the last subtree of a tree is cut short, its last block also speaks for the blocks it lacks.
    """
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    width = 1
    while width < most:
        span = F.lit(width).cast("long")
        low, digit = F.col("block") % span, F.floor(F.col("block") / span) % fanout
        high = F.floor(F.col("block") / (span * fanout))
        short = (F.col("block") == F.col("blocks") - 1) & (digit > 0)
        sent = blocks.withColumn(
            "low", F.explode(F.when(short, F.sequence(low, span - 1)).otherwise(F.array(low)))
        ).select("tree", high.alias("high"), "low", F.struct(
            digit.cast("int").alias("own"),
            F.col("digest"),
            F.when(F.col("low") == low, F.struct("block", "blocks", "path")).alias("block"),
        ).alias("member"))
        met = sent.groupBy("tree", "high", "low").agg(F.sort_array(F.collect_list("member")).alias("members"))
        run = F.transform("members", lambda member: member["digest"])
        got = met.select("tree", run.alias("run"), F.explode("members").alias("member"))
        at = F.col("member.block")
        parent = F.sha2(F.array_join("run", ""), 256)
        step = F.array(F.struct(F.col("member.own").alias("own"), F.col("run")))
        higher = at["blocks"] > width
        blocks = got.filter(at.isNotNull()).select(
            "tree",
            at["block"].alias("block"),
            at["blocks"].alias("blocks"),
            F.when(higher, parent).otherwise(F.col("member.digest")).alias("digest"),
            F.when(higher, F.concat(at["path"], step)).otherwise(at["path"]).alias("path"),
        )
        width *= fanout
    return blocks.select("tree", "block", "digest", "path")


def _sides(run: list[str], own: int) -> tuple[str, str]:
    """What is hashed before and after the own digest."""
    return "".join(run[:own]), "".join(run[own + 1 :])


def fold(leaf: str, path: list[dict]) -> str:
    """The root that follows from a leaf and the siblings of its path."""
    for step in path:
        before, after = _sides(step["run"], step["own"])
        leaf = digest(before, leaf, after)
    return leaf


def _climb(leaves: DataFrame, tops: DataFrame, fanout: int, depth: int, keep_path: bool) -> DataFrame:
    """Leaves with all that ``tops`` says of their block, the proof and what the shown digest folds to.

    ``leaves``: tree, block, blocks, place, digest, shown, own; ``tops``: tree, block, subroot, root, path.
    The row of a block comes first in the stream of its leaves.
    """
    kind = dict(leaves.dtypes)["own"]
    none = lambda name, of: F.lit(None).cast(of).alias(name)
    first = tops.select(
        "tree", "block", none("blocks", "long"), F.lit(-1).cast("long").alias("place"), none("digest", "string"),
        none("shown", "string"), none("own", kind), "subroot", "root", "path",
    )
    rows = leaves.select(
        "tree", "block", "blocks", "place", "digest", "shown", "own",
        none("subroot", "string"), none("root", "string"), none("path", _PATH_SQL),
    )
    names = ["tree", "place", "digest", "own"]
    made = {"subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string()}
    made |= {"path": _PATH} if keep_path else {}

    def climbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_runs(batches, ["tree", "block"]):
            digests, shown, blocks = (table.column(name).to_pylist() for name in ("digest", "shown", "blocks"))
            subroots, roots, paths = (table.column(name) for name in ("subroot", "root", "path"))
            out, keep = Rows(pa.schema(list(made.items()))), []
            for at, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                subroot, root, upper = subroots[at].as_py(), roots[at].as_py(), paths[at].as_py()
                above = [_sides(step["run"], step["own"]) for step in upper]
                levels = _levels(digests[at + 1 : end], fanout, depth, blocks[at + 1] == 1)[:-1]
                sides = [
                    [_sides(level[node - node % fanout :][:fanout], node % fanout) for node in range(len(level))]
                    for level in levels
                ]
                for index in range(end - at - 1):
                    way = [level[index // fanout**number] for number, level in enumerate(sides)] + above
                    leaf = shown[at + 1 + index]
                    for before, after in way:
                        leaf = digest(before, leaf, after)
                    row = [subroot, root, digest(*[part for pair in way for part in pair]), leaf]
                    if keep_path:
                        nodes = [(level, index // fanout**number) for number, level in enumerate(levels)]
                        steps = [{"own": at % fanout, "run": level[at - at % fanout :][:fanout]} for level, at in nodes]
                        row.append(steps + upper)
                    out.add(*row)
                    keep.append(at + 1 + index)
                    if out.full():
                        yield _beside(table, names, keep, out)
                        keep = []
            if keep:
                yield _beside(table, names, keep, out)

    types = {"path": _PATH_SQL}
    schema = f"tree long, place long, digest string, own {kind}, " + ", ".join(
        f"{name} {types.get(name, 'string')}" for name in made
    )
    spread = first.unionByName(rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    return spread.mapInArrow(climbed, schema)


def _beside(table: pa.Table, names: list[str], keep: list[int], made: Rows) -> pa.RecordBatch:
    part = table.select(names).take(pa.array(keep)).combine_chunks().to_batches()[0]
    new = made.take()
    return pa.RecordBatch.from_arrays([*part.columns, *new.columns], names=[*names, *new.schema.names])


def _dealt(leaves: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Leaves (tree, place, n, ...) in aligned blocks; ``place`` counts a tree's leaves from 0, all ``n``."""
    size = fanout**depth
    block, blocks = F.floor(F.col("place") / size), F.ceil(F.col("n") / size)
    return leaves.withColumn("block", block).withColumn("blocks", blocks).drop("n")


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "lang",
    id_col: str = "doc_id",
    carry: list[str] | None = None,
    tampered: Column | None = None,
    keep_path: bool = True,
    fanout: int = FANOUT,
    depth: int = DEPTH,
) -> DataFrame:
    """Per row: _row (carried columns), place, leaf, subroot, root, proof_sha256, folded_root, verified, path.

    The leaf hashes ``columns``; rows of a group stand by id, null first, equal ids by leaf, so repeated
    rows are leaves side by side. A null group is a group of its own and comes first. ``path`` runs through
    the group's tree and the tree of the groups: for every level the run of digests hashed together and the
    own place in it; ``proof_sha256`` hashes the other digests of all runs. ``folded_root`` follows from the
    siblings and the leaf, or ``tampered`` where that is not null; ``verified`` says whether it is the root.
    A table without rows has no root and gives no rows. Columns not named are only carried along.
    """
    names = docs.columns if carry is None else carry
    rows = docs.select(
        F.col(f"`{group_col}`").alias("_group"),
        F.col(f"`{id_col}`").alias("_order"),
        leaf_digest([F.col(f"`{name}`") for name in columns]).alias("digest"),
        (F.lit(None).cast("string") if tampered is None else tampered).alias("shown"),
        F.struct(*[F.col(f"`{name}`") for name in names]).alias("own"),
    )
    order = [F.col("_group").asc_nulls_first(), F.col("_order").asc_nulls_first(), F.col("digest").asc()]
    numbered = with_global_position(rows, order).drop("_order")
    # A group goes by the number of its first row, so groups stand in order, too.
    counted = numbered.groupBy("_group").agg(F.min("position").alias("tree"), F.count(F.lit(1)).alias("n"))
    groups = staged(counted.withColumnRenamed("_group", "_named"), "groups")
    leaves = numbered.join(groups, F.col("_group").eqNullSafe(F.col("_named"))).select(
        "tree", "n", (F.col("position") - F.col("tree")).alias("place"), "digest",
        F.coalesce("shown", "digest").alias("shown"), "own",
    )
    leaves = _dealt(leaves, fanout, depth)
    tops = staged(butterfly(staged(_block_roots(leaves, fanout, depth), "blocks"), fanout), "tops")
    above = staged(_above(tops.filter("block = 0"), fanout, depth), "above")
    whole = tops.join(above, "tree").select(
        "tree", "block", F.col("digest").alias("subroot"), "root", F.concat("path", "rest").alias("path")
    )
    found = _climb(leaves, whole, fanout, depth, keep_path)
    return found.select(
        F.col("own").alias("_row"), "place", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256",
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *(["path"] if keep_path else []),
    )


def _above(heads: DataFrame, fanout: int, depth: int) -> DataFrame:
    """(tree, root, rest): the root over all groups' roots, and the siblings on the way there."""
    placed = with_global_position(heads.select("tree", "digest"), [F.col("tree").asc()])
    leaves = placed.select(
        F.col("tree").alias("own"), F.lit(0).cast("long").alias("tree"), (F.col("position") - 1).alias("place"),
        F.lit(placed.count()).cast("long").alias("n"), "digest", F.col("digest").alias("shown"),
    )
    leaves = _dealt(leaves, fanout, depth)
    tops = butterfly(staged(_block_roots(leaves, fanout, depth), "blocks"), fanout)
    named = tops.select("tree", "block", F.col("digest").alias("subroot"), F.col("digest").alias("root"), "path")
    found = _climb(leaves, named, fanout, depth, True)
    return found.select(F.col("own").alias("tree"), "root", F.col("path").alias("rest"))


def lowered_leaf(columns: Sequence[str], text_col: str, id_col: str) -> Column:
    """Digest of the row with its text's A-Z lowered where 3 divides the id's checksum, else null."""
    values = [ascii_lower(F.col(f"`{name}`")) if name == text_col else F.col(f"`{name}`") for name in columns]
    chosen = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, leaf_digest(values))
