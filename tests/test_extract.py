from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from noticeloom import rules
from noticeloom.functions import dates
from noticeloom.operators import extract, fill
from noticeloom.operators.latest import code_table
from noticeloom.sources import api, html, readers

START, END = date(2026, 7, 1), date(2026, 7, 30)


def listing(spark, markup, selectors=None, domains=("a.example",)):
    rows = [("s", "https://a.example/list", markup, 0, list(domains), selectors)]
    pages = spark.createDataFrame(
        rows,
        "source_id string, url string, html string, seq long, allowed_domains array<string>, "
        "selectors array<string>",
    )
    found = extract.extract_candidates(pages, START, END, selectors="selectors")
    return [
        (row["title"], row["detail_url"], row["published_at"])
        for row in found.orderBy("first_position").collect()
    ]


def test_only_configured_hosts_are_kept(spark):
    """The same link under four hosts: only exact members of the list stay."""
    hosts = ("a.example", "www.a.example", "a.example.net", "c.example")
    markup = "".join(f'<p><a href="https://{host}/n/7">港口补贴管理办法</a> 2026-07-11</p>' for host in hosts)
    found = listing(spark, markup, domains=("c.example", "a.example"))
    assert [row[1] for row in found] == ["https://a.example/n/7", "https://c.example/n/7"]


@pytest.mark.parametrize("days", [(27, 28, 29, 30), (1, 2, 3, 4)])
def test_links_of_one_block_are_dated_one_by_one(spark, days):
    """Every link of a block takes the date beside it, and the window judges each alone."""
    month = 6 if days[-1] > 4 else 7
    valid = [day for day in days if (month, day) >= (7, 1) and day <= 30]
    cells = "".join(f'<a href="/m/{day}">渔业扶持实施方案{day}</a><em>2026-0{month}-{day:02}</em>' for day in days)
    assert [(row[1], row[2]) for row in listing(spark, f"<section>{cells}</section>")] == [
        (f"https://a.example/m/{day}", date(2026, month, day)) for day in valid
    ]


def test_listing_rules(spark):
    markup = (
        '<ul class="list box"><li><i>2026年7月2日</i><a href="/a" title=" 全称通知公告 ">短</a></li>'
        '<li><a href="/b">通知</a></li><li><a href="/c">四个字的</a></li>'
        '<li><p>2026.7.3</p><p>1</p><p>2</p><p>3</p><a href="/d">管理办法全文</a></li>'
        '<li><a href="/a">同一链接的通知</a></li><li><a href="">空链接的通知</a></li></ul>'
        '<a href="/e">外面的通知公告</a>'
    )
    assert listing(spark, markup, [".list li"]) == [
        ("同一链接的通知", "https://a.example/a", None),
        # Four siblings away is too far, but the parent has only this link.
        ("管理办法全文", "https://a.example/d", date(2026, 7, 3)),
    ]


def detail(spark, markup, title="候选标题", published=None, selectors=None):
    rows = [("s", "来源", "全国", title, "https://a.example/x/1.html", published, ["a.example"], markup)]
    pages = spark.createDataFrame(
        rows,
        "source_id string, source_name string, region string, title string, detail_url string, "
        "published_at date, allowed_domains array<string>, html string",
    )
    if selectors:
        pages = pages.withColumn("sel", F.array(*[F.lit(s) for s in selectors]))
    return extract.parse_pages(pages, "sel" if selectors else None).first()


PAGE = """<html><head><title>t</title></head><body><nav>导航</nav><h1>设备 <b>更新</b>通知</h1>
<p>发布机关：某 部</p><p>某部〔2026〕1号</p><p>发布时间：2026-07-20</p><p>施行日期：2026年8月1日</p>
<main>摘要</main><article><p>第一段。<br>第二段。</p><script>var x="<p>no</p>"</script>
<a href="f/1.pdf">附</a><a href="/2.DOCX?x=1">附</a><a href="https://b.example/3.pdf">外</a></article>
</body></html>"""


def test_detail_page(spark):
    row = detail(spark, PAGE)
    assert row["title"] == "设备 更新 通知"
    assert row["publisher"] == "某 部"
    assert row["document_number"] == "某部〔2026〕1号"
    assert row["publish_date"] == date(2026, 7, 20)
    assert row["effective_date"] == date(2026, 8, 1)
    assert row["raw_text"] == row["normalized_text"] == "第一段。 第二段。 附 附 外"
    assert row["attachment_urls"] == ["https://a.example/x/f/1.pdf", "https://a.example/2.DOCX?x=1"]


def test_unknown_metadata_stays_unknown(spark):
    row = detail(spark, "<main><p>正文。</p></main>", published=date(2026, 7, 1))
    assert (row["title"], row["publisher"], row["document_number"]) == ("候选标题", None, None)
    assert row["publish_date"] == date(2026, 7, 1) and row["effective_date"] is None
    assert row["raw_text"] == "正文。" and row["attachment_urls"] == []


def test_selector_order_and_fallback(spark):
    assert detail(spark, PAGE, selectors=["main", "article"])["raw_text"] == "摘要"
    whole = detail(spark, "<body><div class='page-title'>题</div>文</body>", selectors=[".none"])
    assert (whole["title"], whole["raw_text"]) == ("题", "题 文")


def test_first_label_with_a_date_decides(one):
    text = "发布时间 2026-02-31 发布日期：2026-07-01"
    assert one(dates.labelled_date(F.lit(text), rules.PUBLISH_DATE_LABELS)) is None
    text = "发布日期：2026-07-01 印发日期：2026-07-02"
    assert one(dates.labelled_date(F.lit(text), rules.PUBLISH_DATE_LABELS)) == date(2026, 7, 1)


def test_broken_markup_keeps_its_text_order(spark):
    markup = "</div><p>a<b>b<i>c</p>d</x><!-- e --><br/>f<style>g</style>&amp;h<td>i"
    row = spark.createDataFrame([(markup,)], "html string").select(
        html.portal_facts("html", F.lit("u")).alias("f")
    ).first()["f"]
    assert row["page_text"].split("\n") == ["a", "b", "c", "d", "f", "&h", "i"]


def test_portal_items(spark):
    markup = "<title> 门户 </title><a href='/1'>关于<b>通知</b></a><a href='/1'>关于通知</a><a>通知</a>"
    pages = spark.createDataFrame([(markup, "https://a.example/")], "html string, final_url string")
    row = extract.parse_portal_pages(pages).first()
    assert row["page_title"] == "门户"
    assert [tuple(item) for item in row["policy_items"]] == [
        ("关于通知", "https://a.example/1")
    ] * 2


def test_profiles(spark):
    rows = [("miit", "manual", "x"), ("d", "discovery", "x"), ("g", "manual", "generic"), ("u", "manual", "x")]
    sources = spark.createDataFrame(rows, "source_id string, origin string, adapter_version string")
    got = {row["source_id"]: row for row in extract.parser_profile(sources).collect()}
    assert got["miit"]["listing_selectors"] == [".page-content li"]
    assert got["d"]["content_selectors"] == list(rules.GENERIC_PROFILE[1])
    assert got["g"]["listing_selectors"] == list(rules.GENERIC_PROFILE[0])
    assert got["u"]["content_selectors"] is None and got["u"]["profile_error"] == "no adapter: u"


def test_attachments(spark):
    docs = spark.createDataFrame([("p", "正文"), ("q", "无附件")], "policy_id string, normalized_text string")
    rows = [("p", 1, "a.pdf", "甲 乙", None), ("p", 2, "b.doc", None, None), ("p", 3, "c.docx", "", None),
            ("p", 4, "d.pdf", None, "ValueError: bad"), ("p", 5, "e.pdf", "丙", None)]
    attachments = spark.createDataFrame(
        rows, "policy_id string, number long, name string, text string, error string"
    )
    got = {row["policy_id"]: row for row in extract.merge_attachments(docs, attachments).collect()}
    assert got["p"]["normalized_text"] == "正文 [附件 1：a.pdf] 甲 乙 [附件 5：e.pdf] 丙"
    assert got["p"]["attachment_errors"] == [
        "旧版 Word .doc 附件不自动下载或解析（b.doc）",
        "附件解析失败（c.docx）：ValueError: 附件未提取到文本，可能需要 OCR 或人工复核",
        "附件解析失败（d.pdf）：ValueError: bad",
    ]
    assert got["q"]["normalized_text"] == "无附件" and got["q"]["attachment_errors"] == []


def test_every_attachment_counts(spark):
    """1,201 attachments: all of their text, all of their errors, and a hash that sees the last one."""
    docs = spark.createDataFrame([("p", "正文")], "policy_id string, normalized_text string")

    def merged(last):
        parts = spark.range(1, 1202).select(
            F.lit("p").alias("policy_id"), F.col("id").alias("number"), F.concat("id", F.lit(".pdf")).alias("name"),
            F.when(F.col("id") == 1201, last).when(F.col("id") % 400 != 0, F.concat(F.lit("t"), "id")).alias("text"),
            F.lit(None).cast("string").alias("error"),
        )
        return extract.merge_attachments(docs, parts).first()

    one, other = merged("old"), merged("new")
    assert one["normalized_text"].endswith("[附件 1201：1201.pdf] old") and " t1199 " in one["normalized_text"]
    assert one["normalized_text"].count("附件 ") == 1201 - 3 and len(one["attachment_errors"]) == 3
    assert one["content_hash"] != other["content_hash"]


def test_segments_together_are_the_whole_text(spark):
    parts = spark.range(1, 26).select(F.lit("k").alias("k"), F.col("id").alias("n"), F.concat(F.lit("p"), "id").alias("p"))
    merged = extract.merge_parts(parts, "k", "n", "p", per_segment=10).orderBy("segment").collect()
    assert [row["n_parts"] for row in merged] == [10, 10, 5]
    assert " ".join(row["merged_text"] for row in merged) == " ".join(f"p{n}" for n in range(1, 26))


def test_attachment_name(one):
    assert one(extract.attachment_name(F.lit("https://a.example/f/%E5%8A%9E%20a+b.pdf?x"), F.lit(1))) == "办 a+b.pdf"
    assert one(extract.attachment_name(F.lit("https://a.example"), F.lit(2))) == "attachment-2"


def test_classification_rows(spark):
    rows = [(0, None, None, "9", None, "dropped"), (1, "C", None, None, None, "制造业"),
            (2, None, None, "277\n\n278", "2770\n\n2780", "卫生材料制造\n\n药用辅料制造"),
            (3, None, "28", "281", None, "x\ny")]
    table = spark.createDataFrame(
        rows, "row_no long, section string, division string, group string, class string, name string"
    )
    pairs = fill.classification_pairs(table)
    assert [tuple(row) for row in code_table(pairs, "seq").collect()] == [
        ("C", "制造业"), ("C277", "卫生材料制造"), ("C2770", "卫生材料制造"), ("C278", "药用辅料制造"),
        ("C2780", "药用辅料制造"), ("C28", "x"), ("C281", "y"),
    ]


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "codes.csv").write_bytes("﻿code,name\nB,二\nA,一\nB,三\n ,空\n".encode())
    rows = readers.read_industry_csv(spark, str(tmp_path / "codes.csv"))
    assert [tuple(row) for row in code_table(rows, "seq").collect()] == [("A", "一"), ("B", "三")]


def test_api_list(spark):
    def payload(*entries, status=1):
        return json.dumps({"status": status, "body": {"totalPage": 1, "list": list(entries)}})

    good = {"id": 7, "title": " 标题 ", "publishDate": "2026-07-02 10:00"}
    rows = [
        ("s", 0, payload(good, {"id": None, "title": "x", "publishDate": "2026-07-02"}, 5,
                         {"id": 8, "title": 9, "publishDate": "2026-07-02"},
                         {"id": 9, "title": "old", "publishDate": "2026-06-30"},
                         {"id": "a b", "title": "t", "publishDate": "2026-07-30"})),
        ("s", 1, payload({**good, "title": "新标题"})),
        ("s", 2, payload(good, status=0)),
        ("s", 3, '{"status":1,"body":[]}'),
        ("s", 4, '{"status":1,"body":{"list":{}}}'),
        ("s", 5, "broken"),
    ]
    pages = spark.createDataFrame(rows, "source_id string, seq long, payload string")
    found = api.read_api_list(pages, START, END, "https://a.example/d").orderBy("first_position")
    assert [(row["title"], row["detail_url"]) for row in found.collect()] == [
        ("新标题", "https://a.example/d?id=7"), ("t", "https://a.example/d?id=a+b")
    ]
    errors = api.api_list_errors(pages).orderBy("seq").select("seq", "error").collect()
    assert [row["seq"] for row in errors] == [2, 3, 4, 5]


def test_api_detail(spark):
    body = {"title": "详情", "code": " 1 号 ", "department": "部", "publishdate": "2026-07-03",
            "content_trim": " ", "content": "正 文", "intercontent": "x"}
    rows = [(json.dumps({"status": 1, "body": body}), date(2026, 7, 1)),
            (json.dumps({"status": 1, "body": {"title": 5}}), date(2026, 7, 1)),
            (json.dumps({"status": 2}), None)]
    answers = spark.createDataFrame(rows, "payload string, published_at date").select(
        "*", F.lit("s").alias("source_id"), F.lit("列表标题").alias("title"),
        F.lit("https://a.example/d?id=1").alias("detail_url"),
    )
    first, second, third = api.read_api_detail(answers).collect()
    assert (first["title"], first["document_number"], first["raw_text"]) == ("详情", "1 号", "正 文")
    assert first["publish_date"] == date(2026, 7, 3) and first["attachment_errors"] == []
    assert (second["title"], second["raw_text"]) == ("列表标题", "")
    assert second["attachment_errors"] == [rules.API_NO_TEXT_ERROR]
    assert second["publish_date"] == date(2026, 7, 1)
    assert third["error"] is not None


@pytest.mark.parametrize("selector", ["a > b", "a:hover", "*"])
def test_other_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        list(html._select(html._tree("<a></a>"), selector))


def test_only_wanted_facts_are_read(monkeypatch):
    """A heading costs one text; the page text and the anchors are neither read nor built."""
    calls = []
    plain, near = html._Element.text, html._date_snippets
    monkeypatch.setattr(html._Element, "text", lambda self, *rest: calls.append(self.tag) or plain(self, *rest))
    monkeypatch.setattr(html, "_date_snippets", lambda anchor: calls.append("dates") or near(anchor))
    page = "<body><h1>H</h1>" + '<p><a href="/x">x</a> 2026-07-11</p>' * 50
    read = html._read("detail", *html._split("detail", ["heading"]), page, "https://a.example/", None)
    assert read == {"problem": None, "heading": "H"} and calls == ["h1"]
    calls.clear()
    read = html._read("detail", *html._split("detail", ["anchors.url"]), page, "https://a.example/", None)
    assert read["anchors"] == [{"url": "https://a.example/x"}] * 50 and not calls
    html._read("listing", *html._split("listing", None), page, "https://a.example/", None)
    assert calls.count("dates") == 50


def test_wanted_facts_equal_all_facts(spark):
    rows = [(1, "<title>T</title><h1>H</h1><a href='/x' title=' t '>l <b>m</b></a>"), (2, None), (3, "")]
    pages = spark.createDataFrame(rows, "id int, html string")
    names = ["page_title", "page_text", "anchors.packed"]
    whole = pages.select("id", html.portal_facts("html", F.lit("u")).alias("f"))
    part = pages.select("id", html.portal_facts("html", F.lit("u"), names).alias("f"))
    assert part.select("f.*").columns == ["problem", "page_title", "page_text", "anchors"]
    chosen = [f"f.{name}" for name in names]
    assert part.select("id", *chosen).orderBy("id").collect() == whole.select("id", *chosen).orderBy("id").collect()


def test_unknown_facts_are_refused():
    for kind, name in (("portal", "heading"), ("detail", "anchors.size"), ("listing", "anchors")):
        with pytest.raises(ValueError, match=name):
            html._split(kind, [name])


def test_selectors_are_read_once(monkeypatch):
    html._steps.cache_clear()
    seen, compound = [], html._compound
    monkeypatch.setattr(html, "_compound", lambda part: seen.append(part) or compound(part))
    for _ in range(20):
        list(html._select(html._tree("<div class='k'><i></i></div>"), "div.k i"))
    assert seen == ["div.k", "i"]
