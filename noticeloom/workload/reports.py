"""Reports, order, paging, files and streams over whole tables."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from noticeloom import schemas
from noticeloom.operators import ordering, reports
from noticeloom.sources import readers, writers
from noticeloom.sources.state import append_state, read_state
from noticeloom.streaming import batches as batch_stream
from noticeloom.streaming import changed as change_stream
from noticeloom.streaming.counts import stream_run_counts
from noticeloom.session import scratch
from noticeloom.workload.base import SQL_DOCS, iso, long, notices, query, table
from noticeloom.workload.dedupe import _SQL_STATE, _narrow, _state

_STAGES = {
    "click": "changed",
    "view": "duplicate",
    "error": "parse_failure",
    "signup": "priority_row",
    "purchase": "unchanged",
}


def _stages(events):
    stage = F.lit(None).cast("string")
    for kind, name in _STAGES.items():
        stage = F.when(F.col("event_type") == kind, name).otherwise(stage)
    return events.withColumn("stage", stage)


@query(
    "run_report",
    """SELECT 0::BIGINT AS discovered, count(*) FILTER (event_type = 'click') AS changed,
      count(*) FILTER (event_type IN ('view', 'purchase')) AS skipped, 0::BIGINT AS source_failures,
      count(*) FILTER (event_type = 'error') AS parse_failures, 0::BIGINT AS analysis_failures,
      count(*) FILTER (event_type = 'signup') AS priority_rows, 0::BIGINT AS observation_rows
    FROM events""",
)
def run_report(spark, folder):
    return reports.run_report(_stages(table(spark, folder, "events").select("event_type")))


@query(
    "collection_report",
    """SELECT 0::BIGINT AS discovered,
      CAST(sum(user_id) FILTER (event_type = 'click') AS BIGINT) AS collected,
      CAST(sum(user_id) FILTER (event_type IN ('view', 'purchase')) AS BIGINT) AS skipped,
      0::BIGINT AS source_failures,
      CAST(sum(user_id) FILTER (event_type = 'error') AS BIGINT) AS parse_failures
    FROM events""",
)
def collection_report(spark, folder):
    events = table(spark, folder, "events").select("event_type", "user_id")
    return reports.collection_report(_stages(events), amount="user_id")


@query(
    "run_status",
    """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 30) AS bad,
                         user_id % 5 AS code FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN code = 4 THEN 'running' WHEN code = 3 THEN 'failed'
             WHEN bad > 0 THEN 'warning' ELSE 'success' END AS status FROM c""",
)
def run_status(spark, folder):
    bad = (F.col("event_type") == "error") & (F.col("value") > 30)
    counted = (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(F.count_if(bad).alias("parse_failures"))
        .withColumns(
            {"source_failures": F.lit(0), "analysis_failures": F.lit(None).cast("long")}
        )
    )
    kind = F.col("user_id") % 5
    code = F.when(kind == 3, 1).when(kind != 4, 0)
    return counted.select("user_id", reports.run_status(code).alias("status"))


def _batch_tables(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("batch_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 97).cast("int")).alias(
            "created_at"
        ),
    )
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("batch_id"))
    return customers, orders


@query(
    "batch_summary",
    """SELECT c_custkey AS batch_id,
      strftime(DATE '2024-01-01' + CAST(c_custkey % 97 AS INTEGER), '%Y-%m-%d') AS created,
      (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS document_count FROM customer""",
)
def batch_summary(spark, folder):
    summary = reports.batch_summary(*_batch_tables(spark, folder))
    return summary.select("batch_id", iso("created_at").alias("created"), "document_count")


@query(
    "dashboard_summary",
    """WITH b AS (SELECT c_custkey, c_custkey % 97 AS d FROM customer),
    l AS (SELECT max_by(c_custkey, (d, c_custkey)) AS latest FROM b)
    SELECT (SELECT count(*) FROM supplier) AS source_count, (SELECT count(*) FROM b) AS batch_count,
      latest AS latest_batch, (SELECT count(*) FROM orders WHERE o_custkey = latest) AS latest_documents,
      (SELECT count(*) FROM part) AS report_count,
      (SELECT max_by(p_partkey, (p_size, p_partkey)) FROM part) AS latest_report
    FROM l""",
)
def dashboard_summary(spark, folder):
    summary = reports.batch_summary(*_batch_tables(spark, folder))
    runs = table(spark, folder, "part").select(
        F.col("p_partkey").alias("report_id"), F.col("p_size").alias("created_at")
    )
    return reports.dashboard_summary(table(spark, folder, "supplier"), summary, runs)


# ---- order and pages -------------------------------------------------------------------------------


def _priced(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 17 == 0, "n/a")
        .otherwise(F.floor(F.col("o_totalprice") / 50000).cast("string"))
        .alias("score"),
        F.when(F.col("o_orderkey") % 19 == 0, "")
        .otherwise(iso("o_orderdate"))
        .alias("published"),
    )


_SQL_PRICED = """p AS (SELECT o_orderkey AS seq,
    CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE floor(o_totalprice / 50000) END AS points,
    CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders),
placed AS (SELECT seq, row_number() OVER (ORDER BY points DESC, day DESC NULLS LAST, seq) AS position
           FROM p)"""


@query("export_order", f"WITH {_SQL_PRICED} SELECT seq, position FROM placed")
def export_order(spark, folder):
    keys = ordering.export_keys("score", "published", "seq")
    return ordering.with_global_position(_priced(spark, folder), keys).select("seq", "position")


@query(
    "export_page", f"WITH {_SQL_PRICED} SELECT seq FROM placed WHERE position BETWEEN 101 AND 150"
)
def export_page(spark, folder):
    keys = ordering.export_keys("score", "published", "seq")
    path = scratch(spark, "ordered")
    ordering.write_ordered(_priced(spark, folder), keys, path)
    return ordering.read_page(spark, path, 3, 50).select("seq")


@query(
    "stored_pages",
    f"""WITH {_SQL_PRICED}, c AS (SELECT count(*) AS n FROM placed),
    paged AS (SELECT *, (position - 1) // 40 + 1 AS page, (n - 1) // 40 + 1 AS pages FROM placed, c)
    SELECT seq, position, page FROM paged WHERE page IN (1, 2, pages // 2, pages)""",
)
def stored_pages(spark, folder):
    """The first pages, one from the middle and the last of an order stored in many small ranges."""
    path = scratch(spark, "ordered")
    keys = ordering.export_keys("score", "published", "seq")
    ordering.write_ordered(_priced(spark, folder), keys, path, rows_per_range=500)
    pages = ordering.page_count(spark, path, 40)
    parts = [
        ordering.read_page(spark, path, number, 40, position="position").select("seq", "position", F.lit(number).cast("long").alias("page"))
        for number in sorted({1, min(2, pages), max(1, pages // 2), pages})
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "last_page",
    """SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n,
      count(*) OVER () AS total FROM supplier) WHERE n > (total - 1) // 30 * 30""",
)
def last_page(spark, folder):
    return ordering.page(
        table(spark, folder, "supplier"), [F.col("s_suppkey").asc()], 3000, 30
    ).select("s_suppkey")


@query(
    "last_runs",
    """SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12""",
)
def last_runs(spark, folder):
    runs = table(spark, folder, "orders").withColumn(
        "started", F.struct("o_orderdate", "o_orderkey")
    )
    return ordering.last_n_runs(runs, "started").select("o_orderkey", "o_custkey")


@query(
    "newest_first",
    """SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS modified, count(*) AS n,
      row_number() OVER (ORDER BY max(o_orderdate) DESC, o_custkey DESC) AS place
    FROM orders GROUP BY o_custkey""",
)
def newest_first(spark, folder):
    files = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("name"))
        .agg(F.max("o_orderdate").alias("modified_at"), F.count(F.lit(1)).alias("n"))
    )
    return ordering.newest_first(files, position="place").select(
        F.col("name").alias("o_custkey"), iso("modified_at").alias("modified"), "n", long("place").alias("place")
    )


# ---- files -------------------------------------------------------------------------------------------


def _write_batch_files(spark, folder, path):
    """Documents as batch files of at most a hundred documents, one JSON object per file."""
    docs = notices(spark, folder)
    document = F.struct(
        "policy_id",
        "source_id",
        "source_name",
        "region",
        "title",
        "detail_url",
        "publisher",
        "publish_date",
        "raw_text",
        "normalized_text",
        "content_hash",
    )
    grouped = docs.groupBy(F.floor(F.col("doc_id") / 100).alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", document.alias("d")))).alias("items")
    )
    batches = grouped.select(
        F.lit(1).cast("long").alias("schema_version"),
        F.lit("2024-07-01T00:00:00+00:00").alias("created_at"),
        F.lit(date(2024, 6, 1)).alias("start_date"),
        F.date_add(F.lit(date(2024, 7, 1)), (F.col("n") % 30).cast("int")).alias("end_date"),
        F.array(F.lit("a")).alias("source_ids"),
        F.col("items.d").alias("documents"),
    )
    batches.write.option("maxRecordsPerFile", 1).mode("errorifexists").json(path)


@query(
    "batch_files",
    f"""WITH {SQL_DOCS}
    SELECT policy_id, title, strftime(publish_date, '%Y-%m-%d') AS published, content_hash,
           doc_id % 100 AS place, false AS development_mode,
           strftime(DATE '2024-07-01' + CAST(doc_id // 100 % 30 AS INTEGER), '%Y-%m-%d') AS end_date
    FROM notices""",
)
def batch_files(spark, folder):
    """Batch files written once and read back with their documents."""
    path = scratch(spark, "batches")
    _write_batch_files(spark, folder, path)
    batches = readers.read_batches(spark, path, "*.json")
    headers = batches.select(
        F.col("name").alias("batch_id"), "development_mode", iso("end_date").alias("end_date")
    )
    docs = readers.batch_documents(batches).select(
        "batch_id",
        "policy_id",
        "title",
        iso("publish_date").alias("published"),
        "content_hash",
        long("place").alias("place"),
    )
    return docs.join(headers, "batch_id").drop("batch_id")


@query(
    "written_batch",
    f"""WITH {SQL_DOCS} SELECT policy_id, content_hash FROM notices""",
)
def written_batch(spark, folder):
    docs = notices(spark, folder)
    path = writers.write_batch(
        docs.select("policy_id", "content_hash"), {"n": F.lit(1)}, scratch(spark, "batch"), date(2024, 7, 1)
    )
    return writers.read_batch(spark, path)


@query(
    "batch_loop",
    f"""WITH {SQL_DOCS} SELECT policy_id, content_hash, doc_id % 2 AS batch, doc_id % 2 = 1 AS newest FROM notices""",
)
def batch_loop(spark, folder):
    """Two batches written, found, listed and read again by their folders."""
    docs, root = notices(spark, folder), scratch(spark, "batches")
    paths = []
    for number in (0, 1):
        part = docs.filter(F.col("doc_id") % 2 == number).select("policy_id", "content_hash")
        header = {"start_date": F.lit(date(2024, 6, 1)), "development_mode": F.lit(False)}
        paths.append(writers.write_batch(part, header, root, date(2024, 7, 1 + number)))
    newest = readers.latest_batch(spark, root)
    found = readers.written_documents(spark, root)
    day = F.regexp_extract("batch_id", "([0-9]+)$", 1).cast("long")
    return found.select(
        "policy_id", "content_hash", (day - 1).alias("batch"), F.lit(newest).endswith(F.col("batch_id")).alias("newest")
    )


@query(
    "stream_written",
    f"""WITH {SQL_DOCS} SELECT policy_id, content_hash FROM notices""",
)
def stream_written(spark, folder):
    """Batches the engine wrote, read as a stream."""
    root = scratch(spark, "written")
    docs = notices(spark, folder).select("policy_id", "content_hash")
    writers.write_batch(docs, {"n": F.lit(1)}, f"{root}/in", date(2024, 7, 1))
    _finish(batch_stream.stream_written(spark, f"{root}/in", f"{root}/out", f"{root}/mark", docs.schema))
    return spark.read.schema(docs.schema).parquet(f"{root}/out").select("policy_id", "content_hash")


@query(
    "stream_incomplete",
    f"""WITH {SQL_DOCS} SELECT policy_id, content_hash,
      CASE WHEN doc_id % 2 = 0 THEN 'policy-batch-2024-07-01-1' ELSE 'policy-batch-2024-07-02' END AS batch_id
    FROM notices""",
)
def stream_incomplete(spark, folder):
    """A batch left without header, its rerun beside it, and a later one: every document comes once."""
    root = scratch(spark, "incomplete")
    docs = notices(spark, folder).select("policy_id", "content_hash", "doc_id")
    even, odd = (docs.filter(F.col("doc_id") % 2 == part).drop("doc_id") for part in (0, 1))
    writers.write_documents(even, writers.batch_path(spark, f"{root}/in", date(2024, 7, 1)))

    def go():
        _finish(batch_stream.stream_written(spark, f"{root}/in", f"{root}/out", f"{root}/mark", even.schema))

    for part, day in ((even, date(2024, 7, 1)), (odd, date(2024, 7, 2))):
        writers.write_batch(part, {"n": F.lit(1)}, f"{root}/in", day)
        go()
    found = spark.read.schema("policy_id string, content_hash string, batch_id string").parquet(f"{root}/out")
    return found.drop("batch")


@query(
    "report_files",
    """SELECT count(*) FILTER (event_type = 'click') AS changed,
      count(*) FILTER (event_type IN ('view', 'purchase')) AS skipped,
      count(*) FILTER (event_type = 'error') AS parse_failures FROM events""",
)
def report_files(spark, folder):
    """A run report written as JSON and listed again."""
    report = reports.run_report(_stages(table(spark, folder, "events").select("event_type")))
    path = scratch(spark, "reports")
    writers.write_report(report, path, date(2024, 7, 1))
    listed = readers.read_reports(spark, path, schemas.RUN_REPORT, "*.json")
    return listed.select("changed", "skipped", "parse_failures")


# ---- streams -----------------------------------------------------------------------------------------


def _finish(*writers):
    """Run streams side by side to their end; when one fails, the others are stopped."""
    runs = []
    try:
        for writer in writers:
            runs.append(writer.trigger(availableNow=True).start())
        for run in runs:
            run.awaitTermination()
    finally:
        for run in runs:
            run.stop()


def _stream(spark, folder, name):
    """A table as a stream, be it one file or a folder of files."""
    schema = table(spark, folder, name).schema
    # A pattern of one name: of a plain path the file stream takes folders only.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


@query(
    "stream_changed",
    f"""WITH {_SQL_STATE},
    by_key AS (SELECT dedupe_key, min_by(content_hash, policy_id) AS h FROM state GROUP BY 1),
    c AS (SELECT n.policy_id, n.content_hash FROM notices n
      LEFT JOIN state s USING (policy_id) LEFT JOIN by_key k ON n.dedupe_key = k.dedupe_key
      WHERE n.content_hash IS DISTINCT FROM coalesce(s.content_hash, k.h))
    SELECT policy_id, c.content_hash IS NOT NULL AS emitted,
           coalesce(c.content_hash, s.content_hash) AS content_hash
    FROM c FULL JOIN state s USING (policy_id)""",
)
def stream_changed(spark, folder):
    """Documents streamed past a seeded state: what was emitted, and the state afterwards."""
    root = scratch(spark, "stream")
    docs = _narrow(spark, folder)
    append_state(_state(docs), f"{root}/state", -1)
    from noticeloom.functions.identity import cross_source_key, policy_id
    from noticeloom.functions.text import content_hash, normalize_text

    raw = _stream(spark, folder, "documents")
    url = F.concat(
        F.lit("https://"), "source", F.lit(".example.org/d/"), F.col("doc_id").cast("string")
    )
    title = normalize_text(F.substring_index("text", "\n", 1))
    incoming = raw.select(
        F.col("doc_id").alias("seq"),
        policy_id("source", url, title).alias("policy_id"),
        title.alias("title"),
        content_hash("text").alias("content_hash"),
    ).withColumn("dedupe_key", cross_source_key("title", None, "content_hash"))
    _finish(
        change_stream.stream_changed(
            incoming.drop("title"), f"{root}/state", f"{root}/out", f"{root}/checkpoint"
        )
    )
    emitted = spark.read.parquet(f"{root}/out").select("policy_id", F.lit(True).alias("hit"))
    final = read_state(spark, f"{root}/state")
    return final.join(emitted, "policy_id", "left").select(
        "policy_id", F.coalesce("hit", F.lit(False)).alias("emitted"), "content_hash"
    )


@query(
    "stream_batches",
    f"""WITH {SQL_DOCS} SELECT source_id, count(*) AS n, CAST(sum(doc_id % 100) AS BIGINT) AS places
    FROM notices GROUP BY source_id""",
)
def stream_batches(spark, folder):
    """Batch files as streams side by side, four files a micro-batch of each, counted per source."""
    root = scratch(spark, "files")
    _write_batch_files(spark, folder, f"{root}/in")
    # Four files are one task's work, read one at a time, and one file of output.
    streams = [
        batch_stream.stream_batches(spark, f"{root}/in", share, 4).select("batch_id", "place", "source_id").coalesce(1)
        for share in batch_stream.shares("*.json")
    ]
    _finish(
        *(
            docs.writeStream.format("parquet")
            .option("path", f"{root}/out/{number}")
            .option("checkpointLocation", f"{root}/checkpoint/{number}")
            for number, docs in enumerate(streams)
        )
    )
    # Each stream's output is read by its own log; a share without files has none to take a schema from.
    read = [spark.read.schema(docs.schema).parquet(f"{root}/out/{number}") for number, docs in enumerate(streams)]
    return (
        reduce(DataFrame.unionByName, read)
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("places"))
    )


@query(
    "stream_run_counts",
    "SELECT event_type AS stage, count(*) AS n FROM events GROUP BY event_type",
)
def stream_run_counts_query(spark, folder):
    root = scratch(spark, "counts")
    counts = stream_run_counts(_stream(spark, folder, "events"), "event_type")
    _finish(
        counts.writeStream.outputMode("complete")
        .foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{root}/out"))
        .option("checkpointLocation", f"{root}/checkpoint")
    )
    return spark.read.parquet(f"{root}/out")
