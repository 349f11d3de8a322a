"""The short ways of reading pages give what the long ones give."""

from __future__ import annotations

import random
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from noticeloom.functions.urls import restricted_reason
from noticeloom.sources import html

PIECES = [
    "<p>", "</p>", "<P>", "</P >", '<a href="/x">', "<a href='/y'>", '<a href="/q?a=1&amp;b=2" title="">', "</a>",
    '<a href="/1" href="/2">', "<a href=/z>", "<a\nhref=\"/n\">", '<a  href="/s" >', '<img src="i">', "<br/>", '<br class="b"/>',
    "<br />", '<div class="a>b" id="c">', "</div>", "</div x>", "</ div>", "<div", '<div class="a', "<!-- c -->", "<!doctype html>",
    "<script>", "</script>", "<script>if (a<b) '</p>'</script>", '<style media="x">p{}</style>', "<title>", "</title>", "<textarea>",
    "</textarea>", "<noscript>", "</noscript>", "&amp;", "&lt", "&#65;", "a < b", "文 é", "\n", "</>", "<>", "<?pi?>", "<![CDATA[x]]>",
    '<p data-a="1" b>', '<p a="1"b="2">', "<h1>", "</h1>", "<my-tag>", "</my-tag>", "<p/>", "</", "<",
]


class _Long(html._Builder):
    """Every tag goes the parser's own way."""

    updatepos = HTMLParser.updatepos
    parse_starttag = HTMLParser.parse_starttag
    parse_endtag = HTMLParser.parse_endtag


def _shape(element):
    return (
        element.tag,
        element.attrs,
        [_shape(child) if isinstance(child, html._Element) else (type(child), str(child)) for child in element.children],
    )


def _read(builder, markup):
    builder.feed(markup)
    builder.close()
    builder.flush()
    return _shape(builder.root)


def test_trees_are_those_of_the_parsers_own_way():
    chance = random.Random(7)
    for _ in range(6000):
        markup = "".join(chance.choices(PIECES, k=chance.randrange(1, 25)))
        assert _read(html._Builder(), markup) == _read(_Long(), markup), markup


def test_plain_tags_are_read_in_one_step(monkeypatch):
    def refused(*_):
        raise AssertionError("the long way")

    monkeypatch.setattr(HTMLParser, "parse_starttag", refused)
    monkeypatch.setattr(HTMLParser, "parse_endtag", refused)
    root = html._tree('<div class="a b"><a href="/x" title="">t</a></div>')
    assert [anchor.attrs for anchor in html._select(root, "div.a a[href]")] == [{"href": "/x", "title": ""}]


BASES = ["", "https://h.example/a/b?c#d", "http://u:p@h:80", "//h/a", "/a/b", "mailto:x@y", "file:///a/b", "ftp://h/x", "HTTP://H/A",
         "x-y://h/a", "http://[::1]/a", "http://[::1/a", "data:,x", "a/b", "https://h.example/a;p?q"]
ADDRESSES = ["/", "/x", "/x/y/", "/x//y", "//h2/x", "/é文", "/a b", "/x y ", " /x", "/x\n", "/\tx", "/x.html", "/./x", "/../x", "/x;p",
             "/x?y", "/x#z", "/x:y", "/:", "x", "", "http://z/x", "/[x]", "/x\u00a0", "/%20", "/x\\y", "/x\x7f"]


@pytest.mark.parametrize("base", BASES)
def test_addresses_are_those_of_urljoin(base):
    for address in ADDRESSES:
        try:
            expected = urljoin(base, address)
        except ValueError:
            expected = None
        assert html._join(base, address) == expected, address


def test_a_page_is_lowered_once(spark):
    rows = [(200, "PASSWORD LogIn"), (200, "验证码"), (200, "Captcha login"), (404, "captcha"), (200, None), (None, "x")]
    pages = spark.createDataFrame(rows, "status int, html string")
    reason = pages.select("html", restricted_reason("status", "html", F.lit("h")).alias("reason"))
    assert [row["reason"] for row in reason.collect()] == ["login", "captcha", "captcha", "http_404", None, None]
    assert reason._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
