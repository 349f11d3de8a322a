"""Whole flows on small fixtures: collect, analyse, repeat, search, stream."""

from __future__ import annotations

import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noticeloom import rules, schemas
from noticeloom.operators import reports
from noticeloom.plans import analyze, collect
from noticeloom.plans.search_sources import search_sources
from noticeloom.sources import readers, writers
from noticeloom.sources import state as state_table
from noticeloom.streaming.batches import stream_batches
from noticeloom.streaming.changed import stream_changed

START, END = date(2026, 7, 1), date(2026, 7, 30)
CATALOG = {"C": "制造业", "C34": "通用设备"}


def page(number, source, body, code=None, day="2026-07-10", host="a.example"):
    meta = f"<p>发布日期：{day}</p><p>发布单位：某部</p>" + (f"<p>{code}</p>" if code else "")
    markup = f"<h1>标题{number}</h1>{meta}<article>{body}</article>"
    return (number, source, f"标题{number}", f"https://{host}/{number}", None, markup)


@pytest.fixture
def sources(spark):
    rows = [("s1", "转载网", "全国", ["a.example"], "discovery", "generic"),
            ("s2", "某部政策", "全国", ["b.example"], "discovery", "generic")]
    return spark.createDataFrame(
        rows, "source_id string, display_name string, region string, allowed_domains array<string>, "
        "origin string, adapter_version string")


def pages_of(spark, rows):
    frame = spark.createDataFrame(
        rows, "seq long, source_id string, title string, detail_url string, published_at date, html string")
    return frame.select(
        "*", F.lit("2026-07-29 00:00:00").cast("timestamp").alias("collected_at"), F.lit("x").alias("snapshot_path"))


def test_collect_then_repeat(spark, sources, tmp_path):
    rows = [
        page(1, "s1", "支持设备更新", "甲发〔2026〕1号"),
        page(2, "s2", "支持设备更新", "甲发[2026]1号", host="b.example"),
        page(3, "s1", "其他内容"),
        page(4, "s1", "过期内容", day="2026-06-01"),
        page(5, "s1", "坏页 <![broken[ x"),
    ]
    folder, state = str(tmp_path / "batches"), str(tmp_path / "state")
    path, report = collect.collect_batch(spark, pages_of(spark, rows), sources, folder, state, START, END)
    docs = {row["seq"]: row for row in writers.read_batch(spark, path).collect()}
    assert set(docs) == {2, 3}
    assert docs[2]["supplementary_urls"] == ["https://a.example/1"]
    assert tuple(report.first()) == (5, 2, 1, 0, 1)
    header = spark.read.json(f"{path}/header").first()
    assert header["report"]["collected"] == 2
    assert {row["source_id"] for row in spark.read.parquet(f"{path}/sources").collect()} == {"s1", "s2"}
    assert {row["link"] for row in spark.read.parquet(f"{path}/links").collect()} == {"https://a.example/1"}
    # The engine finds, lists and reads its own batches.
    assert readers.latest_batch(spark, folder).endswith(path)
    listed = readers.written_batches(spark, folder).collect()
    assert [(row["batch_id"], row["report"]["discovered"]) for row in listed] == [(path.rsplit("/", 1)[1], 5)]
    assert {row["seq"] for row in readers.written_documents(spark, folder).collect()} == {2, 3}
    assert state_table.read_state(spark, state).count() == 2

    rows[2] = page(3, "s1", "改过的内容")
    again, report = collect.collect_batch(spark, pages_of(spark, rows), sources, folder, state, START, END)
    assert again != path
    assert [row["seq"] for row in writers.read_batch(spark, again).collect()] == [3]
    assert tuple(report.first()) == (5, 1, 2, 0, 1)


def test_a_restricted_page_ends_its_source(spark, sources, tmp_path):
    rows = [page(1, "s1", "甲"), page(2, "s1", "请输入验证码"), page(3, "s1", "丙"),
            *[page(number, "s2", body, host="b.example") for number, body in ((4, "丁"), (5, "戊"), (6, "己"))]]
    pages = pages_of(spark, rows).withColumn("status_code", F.when(F.col("seq") == 6, 429).otherwise(200))
    path, report = collect.collect_batch(
        spark, pages, sources, str(tmp_path / "b"), str(tmp_path / "s"), START, END)
    assert {row["seq"] for row in writers.read_batch(spark, path).collect()} == {1, 4, 5}
    assert tuple(report.first()) == (6, 3, 0, 2, 0)


def test_failed_foreign_and_unconfigured_pages_are_counted(spark, sources, tmp_path):
    rows = [page(1, "s1", "甲"), page(2, "s1", "乙"), page(3, "s1", "丙", host="c.example"), page(4, "s3", "丁")]
    pages = pages_of(spark, rows).withColumn("status_code", F.when(F.col("seq") == 2, 404).otherwise(200))
    bare = spark.createDataFrame([("s3", "没有适配器", "全国", ["a.example"], "manual", "other")], sources.schema)
    attachments = spark.createDataFrame(
        [(F_ID, 1, "a.pdf", "附件文字", None) for F_ID in ["none"]],
        "policy_id string, number long, name string, text string, error string",
    )
    path, report = collect.collect_batch(
        spark, pages, sources.unionByName(bare), str(tmp_path / "b"), str(tmp_path / "s"), START, END, attachments=attachments)
    assert {row["seq"] for row in writers.read_batch(spark, path).collect()} == {1}
    assert tuple(report.first()) == (4, 1, 0, 0, 3)


def test_two_runs_from_one_state_both_stay(spark, tmp_path):
    path = str(tmp_path / "state")
    first, second = state_table.next_version(spark, path), state_table.next_version(spark, path)
    for version, name in ((first, "a"), (second, "b")):
        row = spark.createDataFrame([(name, "1", None), ("both", name, None)], schemas.STATE)
        state_table.append_state(row, path, version)
    state = {row["policy_id"]: row["content_hash"] for row in state_table.read_state(spark, path).collect()}
    assert state == {"a": "1", "b": "1", "both": "b"}


def _documents(spark):
    def row(number, text, **changes):
        base = {
            "policy_id": f"p{number}", "source_id": "s", "source_name": "某部政策", "region": "全国",
            "title": f"标题{number}", "detail_url": f"https://a.example/{number}", "publisher": "某部",
            "publish_date": date(2026, 7, number), "raw_text": text, "normalized_text": text,
            "attachment_urls": [], "attachment_errors": [], "supplementary_urls": [],
            "content_hash": f"h{number}",
        }
        return {**base, **changes}

    rows = [row(1, "给予补贴支持设备更新"), row(2, "一般通知"), row(3, "惠企无行业"), row(4, "出错")]
    frame = spark.createDataFrame(rows, schemas.DOCUMENT)
    return frame.withColumn("seq", F.substring("policy_id", 2, 3).cast("long"))


def _analyzer():
    """Made inside a function, so that it travels to the workers by value."""

    def answer(document, note):
        text = document["normalized_text"]
        if text == "出错":
            raise PermissionError("denied")
        opportunities = []
        if "设备" in text:
            opportunities = [
                {"section_code": "C", "section_name": "制造业", "division_code": "C34", "division_name": "通用设备",
                 "business_tags": ["装备"], "confidence": 0.9, "scenarios": ["设备更新"],
                 "evidence": [{"quote": "设备更新", "location": "?"}], "leasing_relevance": "强",
                 "recommended_action": "电话", "opening_script": "您好"},
                {"section_code": "Z", "section_name": "x", "division_code": "Z99", "division_name": "x",
                 "business_tags": ["装备"], "confidence": 0.9, "scenarios": ["设备更新"],
                 "evidence": [{"quote": "设备更新", "location": "?"}], "leasing_relevance": "强",
                 "recommended_action": "电话", "opening_script": "您好"},
            ]
        return json.dumps(
            {"is_benefit_policy": text != "一般通知", "summary": "s", "support_direction": "d", "opportunities": opportunities})

    return answer


def test_analyze_then_repeat(spark, tmp_path):
    output, state = str(tmp_path / "out"), str(tmp_path / "state")

    audit = spark.createDataFrame([("s", END, "https://a.example/e", "v1")], schemas.AUDIT)

    def run():
        return analyze.run(
            spark, _documents(spark), _analyzer(), CATALOG, ["装备"], output, state, START, END, audit=audit)

    export, report = run()
    top = readers.read_export(spark, export).collect()
    assert [row["政策名称"] for row in top] == ["标题1"]
    assert (top[0]["商机评分"], top[0]["商机等级"]) == (100, "A")
    assert top[0]["依据位置"] == "正文字符7-10" and top[0]["政策层级"] == ""
    rest = readers.read_export(spark, export, rules.OBSERVATION_SHEET).collect()
    assert {row["政策名称"]: row["复核原因"] for row in rest} == {
        "标题3": rules.REASON_NO_OPPORTUNITY,
        "标题4": "AI 分析失败，需人工复核（PermissionError: denied）",
    }
    assert readers.read_export(spark, export, "?", "标题1").count() == 1
    counters = spark.read.schema(schemas.RUN_REPORT).json(report).first()
    assert tuple(counters)[:8] == (4, 4, 0, 0, 0, 1, 1, 2)
    assert spark.read.parquet(f"{report}-audit").first()["verified_at"] == END

    export, report = run()
    counters = spark.read.schema(schemas.RUN_REPORT).json(report).first()
    # Only the failed document is tried again.
    assert tuple(counters)[:8] == (4, 1, 3, 0, 0, 1, 0, 1)


def test_search(spark, tmp_path):
    portals = spark.createDataFrame(
        [(f"p{n}", "名", "国家", f"https://p{n}.gov.cn/", "国家", f"p{n}.gov.cn") for n in range(5)], schemas.PORTAL)
    items = "".join(f"<a href='/{n}'>融资租赁通知{n}</a>" for n in range(7))
    rows = [
        ("p0", 200, "https://p0.gov.cn/", f"<title>融资租赁</title>{items}", None),
        ("p1", 403, "https://p1.gov.cn/", "", None),
        ("p2", 200, "https://p2.gov.cn/", "<a href='/x'>其他通知</a>", None),
        ("p3", None, None, None, "timed out"),
    ]
    fetches = spark.createDataFrame(
        rows, "portal_id string, status_code int, final_url string, html string, error string"
    ).select("*", F.lit("").alias("robots_txt"), F.lit(None).cast("string").alias("retry_after"),
             F.lit("snap").alias("snapshot_path"), F.lit(0).alias("page_seq"))
    keywords = spark.createDataFrame([("租赁", "a", None), ("通知", "b", None)], schemas.KEYWORD)
    registry = spark.createDataFrame([{"source_id": "p0", "phase": "verified"}], schemas.REGISTRY)
    found = search_sources(
        portals, fetches, keywords, registry, END, tags=["a"], portal_ids=["p0", "p1", "p2", "p3"])
    candidate = found["candidates"].first()
    assert candidate["source_id"] == "p0" and not candidate["enabled"]
    meta = candidate["discovery"]
    assert (meta["priority_score"], meta["priority_level"], meta["check_result"]) == (95, "高", "pass")
    assert len(meta["sample_policies"]) == 5 and meta["keywords"] == ["租赁"]
    assert meta["sample_policies"][0]["url"] == "https://p0.gov.cn/0"
    assert {tuple(row) for row in found["status"].select("portal_id", "status", "policies_found").collect()} == {
        ("p0", "ok", 5), ("p1", "restricted", 0), ("p2", "ok", 0), ("p3", "error", 0)}
    assert {tuple(row) for row in found["errors"].collect()} == {
        ("p1", "http_403", ""), ("p3", "exception", "timed out")}
    assert tuple(found["report"].first()) == (4, 5, 1, 1, ["租赁"])
    saved = writers.write_discovery(found, str(tmp_path), "disc-1")
    assert spark.read.json(f"{saved}/portals").count() == 4
    assert writers.write_discovery(found, str(tmp_path), "disc-1") == f"{saved}-1"
    assert found["registry"].count() == 2


def _batch(path: Path, documents, **changes):
    payload = {
        "schema_version": 1, "created_at": "2026-07-29T00:00:00+00:00", "start_date": "2026-07-01",
        "end_date": "2026-07-30", "source_ids": ["s"], "compliance_audit": [],
        "report": {"discovered": 1, "collected": 1, "skipped": 0, "source_failures": 0, "parse_failures": 0},
        "documents": documents, **changes,
    }
    path.write_text(json.dumps(payload, ensure_ascii=False, indent=2), encoding="utf-8")


def test_batch_files(spark, tmp_path):
    import os

    _batch(tmp_path / "policy-batch-2026-07-29.json", [{"policy_id": "a", "title": "t"}])
    _batch(tmp_path / "policy-batch-2026-07-30.json", [{"policy_id": "b", "collected_at": "2026-07-29T01:02:03Z"}])
    (tmp_path / "other.json").write_text("{}")
    os.utime(tmp_path / "policy-batch-2026-07-30.json", (1, 1))
    batches = readers.read_batches(spark, str(tmp_path))
    docs = {row["policy_id"]: row for row in readers.batch_documents(batches).collect()}
    assert set(docs) == {"a", "b"} and docs["b"]["collected_at"].second == 3
    assert batches.select("development_mode").distinct().first()[0] is False
    assert readers.latest_batch(spark, str(tmp_path)).endswith("policy-batch-2026-07-29.json")
    summary = reports.batch_summary(batches.withColumn("batch_id", F.col("name")), readers.batch_documents(batches))
    assert [row["document_count"] for row in summary.collect()] == [1, 1]
    _batch(tmp_path / "policy-batch-2026-07-31.json", [], schema_version=2)
    # The check holds when only documents are asked for.
    with pytest.raises(Exception, match="unsupported policy batch schema"):
        readers.batch_documents(readers.read_batches(spark, str(tmp_path))).select("policy_id").collect()
    (tmp_path / "policy-batch-2026-07-31.json").write_text('{"schema_version": 1, "documents": [{"policy_id": "c"')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.batch_documents(readers.read_batches(spark, str(tmp_path))).select("policy_id").collect()
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(ValueError, match="no policy batch"):
        readers.latest_batch(spark, str(empty))


def test_sources_file(spark, tmp_path):
    path = tmp_path / "sources.json"
    base = {"source_id": "a", "display_name": "n", "region": "r", "list_urls": [], "allowed_domains": []}

    def read(*items):
        path.write_text(json.dumps(items, ensure_ascii=False, indent=1), encoding="utf-8")
        return readers.read_sources(spark, str(path)).collect()

    row = read(base)[0]
    assert (row["enabled"], row["request_interval_seconds"], row["adapter_version"], row["origin"]) == (
        True, 1.0, "unregistered", "manual")
    assert read({**base, "enabled": False})[0]["enabled"] is False
    for bad, message in (({"enabled": "true"}, "enabled"), ({"enabled": None}, "enabled"),
                         ({"adapter_version": " "}, "adapter_version"), ({"origin": "x"}, "origin")):
        with pytest.raises(Exception, match=message):
            read({**base, **bad})
    with pytest.raises(ValueError, match="duplicate source_id: 1, first a"):
        read(base, base)
    path.write_text('[{"source_id": "a"')
    with pytest.raises(Exception, match="not a JSON array"):
        readers.read_sources(spark, str(path)).select("source_id").collect()


def test_dimension_files(spark, tmp_path):
    def write(name, value):
        (tmp_path / name).write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
        return str(tmp_path / name)

    assert readers.read_codes(spark, write("c", [{"code": "A", "name": "农"}])).first()["name"] == "农"
    assert [r["tag"] for r in readers.read_tags(spark, write("t", ["x", "y"])).collect()] == ["x", "y"]
    words = readers.read_keywords(spark, write("k", [{"text": "a", "tag": "b"}])).first()
    assert (words["text"], words["signal_strength"]) == ("a", None)
    assert readers.read_portals(spark, write("p", [{"portal_id": "p"}])).first()["portal_id"] == "p"
    (tmp_path / "broken").write_text('[{"text": "a", ')
    for read in (readers.read_keywords, readers.read_codes, readers.read_tags, readers.read_portals):
        with pytest.raises(Exception, match="not a JSON array"):
            read(spark, str(tmp_path / "broken")).collect()
    with pytest.raises(ValueError, match="duplicate source_id"):
        readers.read_registry(spark, write("r", [{"source_id": "x"}, {"source_id": "x"}]))


def test_snapshots(spark, tmp_path):
    day = tmp_path / "20260729"
    day.mkdir()
    (day / "abc.html").write_text("<p>政</p>", encoding="utf-8")
    (day / "abc-2.html").write_text("x")
    (day / "abc-attachment-1.pdf").write_bytes(b"%PDF\xff\xfe")
    (day / "gbk.html").write_bytes('<meta charset="gbk"><p>政策</p>'.encode("gbk"))
    (day / "cut.html").write_bytes("<p>政</p>".encode()[:4])
    got = {row["path"].rsplit("/", 1)[1]: row for row in readers.read_snapshots(spark, str(tmp_path)).collect()}
    first = got["abc.html"]
    assert (first["snapshot_id"], first["copy"], first["collected_on"]) == ("abc", 0, date(2026, 7, 29))
    assert first["body"] == "<p>政</p>"
    assert got["gbk.html"]["body"].endswith("<p>政策</p>") and got["cut.html"]["body"].startswith("<p>")
    pdf = got["abc-attachment-1.pdf"]
    assert pdf["body"] is None and bytes(pdf["content"]) == b"%PDF\xff\xfe"
    assert (got["abc-2.html"]["snapshot_id"], got["abc-2.html"]["copy"]) == ("abc", 2)


def test_nothing_is_overwritten(spark, tmp_path):
    report = spark.range(1).select(F.col("id").alias("changed"))
    first = writers.write_report(report, str(tmp_path), END)
    second = writers.write_report(report, str(tmp_path), END)
    assert second == f"{first}-1"
    listed = readers.read_reports(spark, str(tmp_path), schemas.RUN_REPORT, "*.json")
    assert listed.count() == 2


def test_stream_equals_batch_and_repeats_are_harmless(spark, tmp_path):
    from noticeloom.operators.incremental import changed_only

    inbox = tmp_path / "in"
    inbox.mkdir()
    _batch(inbox / "policy-batch-1.json", [{"policy_id": x, "content_hash": "1"} for x in "abc"])
    state, out, mark = (str(tmp_path / name) for name in ("state", "out", "mark"))

    def run():
        docs = stream_batches(spark, str(inbox)).withColumn("dedupe_key", F.concat(F.lit("k"), "policy_id"))
        narrow = docs.select(
            F.concat_ws("/", "batch_id", F.col("place").cast("string")).alias("seq"),
            "policy_id", "content_hash", "dedupe_key")
        query = stream_changed(narrow, state, out, mark).trigger(availableNow=True).start()
        query.awaitTermination(120)

    run()
    assert spark.read.parquet(out).count() == 3
    known = state_table.read_state(spark, state)
    second = spark.createDataFrame([("a", "1", "ka"), ("b", "2", "kb"), ("d", "1", "kd")], "policy_id string, content_hash string, dedupe_key string")
    expected = {row["policy_id"] for row in changed_only(second, known, row_id="policy_id").collect()}
    _batch(inbox / "policy-batch-2.json", [
        {"policy_id": row["policy_id"], "content_hash": row["content_hash"]} for row in second.collect()])
    run()
    got = spark.read.parquet(out)
    newest = got.agg(F.max("batch")).first()[0]
    assert {row["policy_id"] for row in got.filter(F.col("batch") == newest).collect()} == expected == {"b", "d"}
    final = {row["policy_id"]: row["content_hash"] for row in state_table.read_state(spark, state).collect()}
    assert final == {"a": "1", "b": "2", "c": "1", "d": "1"}
    run()
    assert spark.read.parquet(out).count() == 5
    state_table.compact_state(spark, state, str(tmp_path / "state2"))
    assert state_table.read_state(spark, str(tmp_path / "state2")).count() == 4
    assert state_table.next_version(spark, str(tmp_path / "none")) == 0


@pytest.mark.parametrize("fold_every", [1, 3, 100])
def test_many_small_batches_equal_one_by_one_runs(spark, tmp_path, fold_every):
    """However often the log is folded, the stream finds what batch runs with a whole state find."""
    from noticeloom.operators.incremental import changed_only

    inbox = tmp_path / "in"
    inbox.mkdir()
    state, out, mark, plain = (str(tmp_path / name) for name in ("state", "out", "mark", "plain"))
    expected = []
    for number in range(5):
        rows = [(f"p{(number * 3 + n) % 7}", f"k{(number + n) % 4}", str((number * n) % 3), f"{number}-{n}") for n in range(4)]
        frame = spark.createDataFrame(rows, "policy_id string, dedupe_key string, content_hash string, seq string")
        changed = changed_only(frame, state_table.read_state(spark, plain)).select("policy_id", "dedupe_key", "content_hash", "seq")
        expected += sorted(map(tuple, changed.collect()))
        state_table.append_state(changed, plain, number, run="stream")
        frame.coalesce(1).write.mode("append").parquet(str(inbox))
        docs = spark.readStream.schema(frame.schema).parquet(str(inbox))
        stream_changed(docs, state, out, mark, fold_every=fold_every).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(out).orderBy("batch", "policy_id", "dedupe_key", "content_hash", "seq")
    assert [tuple(row)[:4] for row in got.select("policy_id", "dedupe_key", "content_hash", "seq").collect()] == expected
    final = lambda path: sorted(map(tuple, state_table.read_state(spark, path).collect()))
    assert final(state) == final(plain)


def test_stream_of_written_batches_waits_for_the_header(spark, tmp_path):
    """Documents of a batch without header are never emitted; its rerun's come once, late headers too."""
    from noticeloom.streaming.batches import stream_written

    folder, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))
    docs = [spark.createDataFrame([(key, "h")], "policy_id string, content_hash string") for key in "abc"]

    def go():
        stream_written(spark, folder, out, mark, docs[0].schema).trigger(availableNow=True).start().awaitTermination(120)
        read = spark.read.schema("policy_id string, batch_id string").parquet(out)
        return sorted((row["policy_id"], row["batch_id"]) for row in read.collect())

    late = writers.batch_path(spark, folder, END)
    writers.write_documents(docs[0], late)
    first = writers.write_batch(docs[0], {"n": F.lit(1)}, folder, END)
    assert first == f"{late}-1"
    name = first.rsplit("/", 1)[1]
    assert go() == [("a", name)] == go()
    second = writers.batch_path(spark, folder, START)
    writers.write_documents(docs[1], second)
    assert go() == [("a", name)]
    writers.write_header(spark, second, START, {"n": F.lit(1)})
    assert go() == go() == [("a", name), ("b", second.rsplit("/", 1)[1])]
