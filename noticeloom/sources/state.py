"""State table as a log of entries in hash buckets: added by runs, folded while others write.

An entry is a run's records or a fold of earlier entries. Its files go to a folder of their own and count
only once its commit, a file of one row, is there; nothing is ever replaced. A fold's commit names exactly
the entries it has taken in, so an entry that was committed meanwhile is not among them and stays in force.
Records keep the version and name of their run through all folds, so the order of writing does not matter:
the last record of an id is the same whichever entries hold it. Two folds at a time do no harm either.

Records lie in buckets of their id, and beside them (dedupe key, id) in buckets of the key, so a reader that
knows its ids and keys opens only the buckets of these. A run writes its records as they come; a fold has as
many buckets as its rows need, so buckets stay of a bounded size while the state grows.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from noticeloom import schemas

VERSION = "version"
RUN = "run"
#: Most buckets of an entry, and rows of one. Numbers of buckets are powers of two, so the bucket of an id
#: among few follows from its bucket among the most.
MOST_BUCKETS, BUCKET_ROWS = 4096, 100_000
LOG = T.StructType(
    [
        *schemas.STATE.fields,
        T.StructField(VERSION, T.LongType()),
        T.StructField(RUN, T.StringType()),
        T.StructField("of", T.IntegerType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)
KEYS = T.StructType(
    [
        T.StructField("dedupe_key", T.StringType()),
        T.StructField("policy_id", T.StringType()),
        T.StructField("of", T.IntegerType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)
COMMITS = T.StructType(
    [
        T.StructField("rows", T.LongType()),
        T.StructField("covers", T.ArrayType(T.StringType())),
        T.StructField("kind", T.StringType()),
        T.StructField(VERSION, T.LongType()),
        T.StructField(RUN, T.StringType()),
        T.StructField("entry", T.StringType()),
    ]
)


class Fold(NamedTuple):
    """What a fold takes in: the version it stands for, the entries it found committed and their rows."""

    version: int
    entries: list[str]
    rows: int


def _bucket(column: str, of: int = MOST_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(of)).cast("int")


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    """Commits with the facts their folders name; of an entry written again only the last one counts."""
    try:
        found = spark.read.schema(COMMITS).json(f"{path.rstrip('/')}/commits")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    last = F.max_by(F.struct("entry", "covers", "rows"), "entry").alias("last")
    return found.groupBy("kind", VERSION, RUN).agg(last).select("kind", VERSION, RUN, "last.*")


def live_entries(spark: SparkSession, path: str, before: int | None = None) -> dict[str, int]:
    """Entries, and the rows of each, that hold the state of the versions below ``before``: the last folds and the runs since."""
    commits = _commits(spark, path)
    if commits is None:
        return {}
    if before is not None:
        commits = commits.filter(F.col(VERSION) < before)
    taken = commits.filter("kind = 'fold'").select(F.explode("covers").alias("entry"))
    rows = commits.join(taken, "entry", "left_anti").select("entry", "rows")
    # One name per run since the last fold.
    return {row["entry"]: row["rows"] for row in sorted(rows.collect())}


def _entries(spark: SparkSession, path: str, table: str, schema: T.StructType, entries: Iterable[str]) -> DataFrame:
    entries = list(entries)
    if not entries:
        return spark.createDataFrame([], schema)
    base = f"{path.rstrip('/')}/{table}"
    read = spark.read.schema(schema).option("basePath", base)
    return read.parquet(*[f"{base}/entry={entry}" for entry in entries]).select(*schema.names)


def _buckets(rows: DataFrame, column: str) -> Column:
    """Whether the files' bucket is one of these rows' buckets: at most MOST_BUCKETS numbers."""
    some = [row["b"] for row in rows.select(_bucket(column).alias("b")).distinct().collect()]
    # Columns of the folders alone, so folders are pruned by it.
    return F.expr(f"exists(cast(array({', '.join(map(str, sorted(some)))}) as array<int>), one -> one % of = bucket)")


def _wanted_records(spark: SparkSession, path: str, entries: Iterable[str], wanted: DataFrame) -> DataFrame:
    """Records of the wanted ids and of all ids that once had one of the wanted keys."""
    keys = wanted.select("dedupe_key").filter("dedupe_key <> ''").distinct()
    known = _entries(spark, path, "keys", KEYS, entries).filter(_buckets(keys, "dedupe_key"))
    sharing = known.join(keys, "dedupe_key", "left_semi").select("policy_id")
    ids = wanted.select("policy_id").unionByName(sharing).distinct()
    return _entries(spark, path, "records", LOG, entries).filter(_buckets(ids, "policy_id")).join(ids, "policy_id", "left_semi")


def _last(log: DataFrame) -> DataFrame:
    # Runs that began from the same state share a version: the one that ended later counts.
    order = F.struct(F.col(VERSION), F.col(RUN), F.col("content_hash"), F.col("dedupe_key"))
    last = log.groupBy("policy_id").agg(F.max(order).alias("last"))
    return last.select("policy_id", "last.content_hash", "last.dedupe_key", f"last.{VERSION}", f"last.{RUN}")


def read_state(
    spark: SparkSession, path: str, before: int | None = None, wanted: DataFrame | None = None
) -> DataFrame:
    """Last record per policy_id among the committed versions below ``before``.

    With ``wanted`` (policy_id, dedupe_key) only records that could match one of its rows are read, from
    the buckets of its ids and keys alone. What a fold has taken in is not read again.
    """
    entries = live_entries(spark, path, before)
    if wanted is not None and entries:
        log = _wanted_records(spark, path, entries, wanted)
    else:
        log = _entries(spark, path, "records", LOG, entries)
    return _last(log).select(*schemas.STATE.names)


def next_version(spark: SparkSession, path: str) -> int:
    commits = _commits(spark, path)
    last = None if commits is None else commits.agg(F.max(VERSION).alias("last")).first()["last"]
    return 0 if last is None else last + 1


def _name() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def write_entry(records: DataFrame, path: str, of: int = 1) -> tuple[str, int]:
    """Write the records of an entry that nobody sees before its commit; returns its name and rows."""
    spark, entry, base = records.sparkSession, _name(), path.rstrip("/")
    names = [*schemas.STATE.names, VERSION, RUN]
    _bucketed(records.select(*names, _bucket("policy_id", of).alias("bucket")), f"{base}/records/entry={entry}", of)
    written = _entries(spark, path, "records", LOG, [entry])
    keys = written.filter("dedupe_key <> ''").select("dedupe_key", "policy_id", _bucket("dedupe_key", of).alias("bucket"))
    _bucketed(keys, f"{base}/keys/entry={entry}", of)
    return entry, written.count()


def _bucketed(rows: DataFrame, place: str, of: int) -> None:
    spread = rows if of == 1 else rows.repartition("bucket")
    spread.write.partitionBy("bucket").parquet(f"{place}/of={of}")


def commit_entry(
    spark: SparkSession, path: str, entry: str, rows: int, kind: str, version: int, run: str, covers: Iterable[str] = ()
) -> None:
    """Make an entry count, in one file."""
    place = f"{path.rstrip('/')}/commits/kind={kind}/{VERSION}={version}/{RUN}={run}/entry={entry}"
    taken = F.array(*map(F.lit, covers)).cast("array<string>")
    row = spark.range(1).select(F.lit(rows).cast("long").alias("rows"), taken.alias("covers"))
    row.coalesce(1).write.json(place)


def append_state(successes: DataFrame, path: str, version: int, run: str | None = None) -> None:
    """Add the successes of one run.

    A run that can be repeated, such as a micro-batch, names itself; of its repeats the last one counts.
    """
    own = run or _name()
    rows = successes.select(*schemas.STATE.names, F.lit(version).cast("long").alias(VERSION), F.lit(own).alias(RUN))
    commit_entry(successes.sparkSession, path, *write_entry(rows, path), "run", version, own)


def plan_fold(spark: SparkSession, path: str, version: int) -> Fold:
    """The entries that a fold of all versions up to ``version`` would take in now."""
    entries = live_entries(spark, path, before=version + 1)
    return Fold(version, list(entries), sum(entries.values()))


def finish_fold(spark: SparkSession, path: str, fold: Fold) -> None:
    """Write what the planned entries come to and commit it in their place."""
    of = 1
    while of < MOST_BUCKETS and of * BUCKET_ROWS < fold.rows:
        of *= 2
    records = _last(_entries(spark, path, "records", LOG, fold.entries))
    entry, rows = write_entry(records, path, of)
    commit_entry(spark, path, entry, rows, "fold", fold.version, entry, fold.entries)


def fold_state(spark: SparkSession, path: str, version: int) -> None:
    """Write what all versions up to ``version`` come to; later reads begin there.

    Runs and other folds may be under way: what they commit meanwhile is not taken in and stays in force.
    """
    finish_fold(spark, path, plan_fold(spark, path, version))


def compact_state(spark: SparkSession, path: str, target: str) -> None:
    """Write the folded state as the first version of a new folder."""
    append_state(read_state(spark, path), target, 0)
