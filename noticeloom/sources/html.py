"""Page facts: the one place where markup is read, as an Arrow-batched function.

The function only turns markup into plain columns (texts, headings, anchors). Every rule on top
of them - filters, dates, ids, hashes - is a Column expression, so Catalyst sees it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from noticeloom import rules
from noticeloom.functions.text import col

#: Pages whose facts are Python objects at a time; those of the pages before are Arrow data.
SLICE = 64
_VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr".split()
)
_TEXTLESS = frozenset(("script", "style", "template", "rt", "rp"))
_DATE = re.compile(rules.DATE_PATTERN)
#: Tags as they are spelt most often; what they hold needs no more reading. All others go the parser's own way.
_PLAIN_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&]*")*)>')
_PLAIN_ATTRIBUTE = re.compile(r' ([a-z][a-z-]*)="([^"&]*)"')
_PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")
#: An address under the root of its host, of plain letters only, is that root and itself.
_ROOTED = re.compile(r"/[^/\x00-\x20.;?#][^\x00-\x20.;?#]*")
#: Elements whose content may be read by rules of its own.
_OWN_CONTENT = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext".split())
_COMPOUND = re.compile(r"(?P<tag>[a-zA-Z][\w-]*)?(?P<rest>(?:[.#][\w-]+|\[[\w-]+\])*)$")


class _Text(str):
    __slots__ = ()


class _Comment(str):
    __slots__ = ()


class _Element:
    __slots__ = ("attrs", "children", "parent", "place", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Element | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.place = len(parent.children) if parent is not None else 0

    def walk(self) -> Iterator[_Element]:
        """Descendant elements in document order, without recursion."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, _Element):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self, separator: str, skip: frozenset[str] = _TEXTLESS) -> str:
        """Stripped text pieces joined; scripts, styles and templates do not count."""
        pieces, stack = [], [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, _Text):
                    if piece := child.strip():
                        pieces.append(piece)
                elif isinstance(child, _Element) and child.tag not in skip:
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()
        return separator.join(pieces)


class _Builder(HTMLParser):
    """Forgiving tree: an end tag closes back to its nearest open start tag, if there is one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = _Element("", {}, None)
        self.open: dict[str, int] = {}
        self.pending: list[str] = []

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns are not counted; nobody asks for them."""
        return j

    def parse_starttag(self, i: int) -> int:
        plain = None if self.cdata_elem else _PLAIN_START.match(self.rawdata, i)
        if plain is None or (tag := plain[1]) in _OWN_CONTENT:
            return super().parse_starttag(i)
        self.handle_starttag(tag, _PLAIN_ATTRIBUTE.findall(plain[2]) if plain[2] else ())
        return plain.end()

    def parse_endtag(self, i: int) -> int:
        plain = None if self.cdata_elem else _PLAIN_END.match(self.rawdata, i)
        if plain is None or plain[1] in _OWN_CONTENT:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def flush(self) -> None:
        if self.pending:
            self.top.children.append(_Text("".join(self.pending)))
            self.pending = []

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()
        self.top.children.append(_Comment(data))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.flush()
        element = _Element(tag, {key: value or "" for key, value in attrs}, self.top)
        self.top.children.append(element)
        if tag not in _VOID:
            self.top = element
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        while self.open.get(tag):
            closed, self.top = self.top, self.top.parent
            self.open[closed.tag] -= 1
            if closed.tag == tag:
                break


def _release(root: _Element) -> None:
    """Take a tree apart, so that it is freed at once; linked both ways it would wait for the collector."""
    stack = [root]
    while stack:
        element = stack.pop()
        stack.extend(child for child in element.children if isinstance(child, _Element))
        element.children, element.parent = [], None


def _tree(markup: str) -> _Element:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    builder.flush()
    return builder.root


def _compound(part: str):
    """One step of a selector: tag, classes, id and required attributes."""
    match = _COMPOUND.match(part)
    if match is None:
        raise ValueError(f"unsupported selector: {part}")
    marks = re.findall(r"([.#])([\w-]+)|\[([\w-]+)\]", match["rest"])
    return (
        match["tag"],
        [name for mark, name, _ in marks if mark == "."],
        [name for mark, name, _ in marks if mark == "#"],
        [attribute for _, _, attribute in marks if attribute],
    )


def _matches(element: _Element, step) -> bool:
    tag, classes, ids, attributes = step
    if tag and element.tag != tag:
        return False
    if classes and not set(classes) <= set(element.attrs.get("class", "").split()):
        return False
    return all(element.attrs.get("id") == name for name in ids) and all(
        name in element.attrs for name in attributes
    )


@lru_cache(maxsize=4096)
def _steps(selector: str) -> tuple:
    """The steps of a selector, read once per worker and not once per page."""
    return tuple(_compound(part) for part in selector.split())


def _select(root: _Element, selector: str) -> Iterator[_Element]:
    """Descendants that match a descendant-combinator selector, in document order."""
    *outer, last = _steps(selector)
    for element in root.walk():
        if not _matches(element, last):
            continue
        ancestor, missing = element.parent, list(outer)
        while missing and ancestor is not None:
            if _matches(ancestor, missing[-1]):
                missing.pop()
            ancestor = ancestor.parent
        if not missing:
            yield element


def _first(root: _Element, selectors: Iterable[str]) -> _Element | None:
    for selector in selectors:
        if (found := next(_select(root, selector), None)) is not None:
            return found
    return None


def _date_snippets(anchor: _Element) -> list[str]:
    """Date texts near a link, nearest place first."""
    texts = [anchor.text(" ")]
    siblings, place = anchor.parent.children, anchor.place
    for near in (siblings[place + 1 : place + 4], siblings[max(place - 3, 0) : place][::-1]):
        for sibling in near:
            if not isinstance(sibling, _Element):
                texts.append(str(sibling))
            elif sibling.tag == "a" or any(inner.tag == "a" for inner in sibling.walk()):
                break
            else:
                texts.append(sibling.text(" ", frozenset()))
    holder = anchor.parent
    if holder.tag not in ("", "body", "html"):
        links = (True for inner in holder.walk() if inner.tag == "a" and "href" in inner.attrs)
        if next(links, False) and not next(links, False):
            texts.append(holder.text(" "))
    return [found.group(0) for text in texts if (found := _DATE.search(text))]


def _listing_anchors(root: _Element, selectors: list[str]) -> Iterator[_Element]:
    if not selectors:
        yield from _select(root, "a[href]")
    for selector in selectors:
        for item in _select(root, selector):
            if item.tag == "a" and item.attrs.get("href"):
                yield item
            elif (inner := next(_select(item, "a[href]"), None)) is not None:
                yield inner


@lru_cache(maxsize=64)
def _root(base: str) -> str:
    return urljoin(base, "/")[:-1]


def _join(base: str, href: str) -> str | None:
    try:
        return _root(base) + href if _ROOTED.fullmatch(href) else urljoin(base, href)
    except ValueError:
        return None


def _anchor_title(anchor: _Element, _base: str) -> str | None:
    return anchor.attrs.get("title", "").strip() or None


def _anchor_label(anchor: _Element, _base: str) -> str:
    return anchor.text(" ")


def _anchor_packed(anchor: _Element, _base: str) -> str:
    return anchor.text("")


def _anchor_href(anchor: _Element, _base: str) -> str:
    return anchor.attrs.get("href", "")


def _anchor_url(anchor: _Element, base: str) -> str | None:
    return _join(base, anchor.attrs.get("href", ""))


def _anchor_dates(anchor: _Element, _base: str) -> list[str]:
    return _date_snippets(anchor)


def _links(root: _Element, _selectors) -> Iterator[_Element]:
    return _select(root, "a[href]")


def _listed(root: _Element, selectors) -> Iterator[_Element]:
    return _listing_anchors(root, [] if selectors is None else list(selectors))


def _body(root: _Element) -> _Element:
    return _first(root, ("body",)) or root


def _heading(root: _Element, _selectors) -> str | None:
    heading = _first(root, ("h1", ".page-title"))
    return None if heading is None else heading.text(" ")


def _metadata_text(root: _Element, _selectors) -> str:
    return _body(root).text("\n")


def _content_text(root: _Element, selectors) -> str:
    return (_first(root, [] if selectors is None else selectors) or _body(root)).text(" ")


def _page_title(root: _Element, _selectors) -> str:
    title = _first(root, ("title",))
    pieces = [] if title is None else title.children
    return pieces[0].strip() if len(pieces) == 1 and isinstance(pieces[0], _Text) else ""


def _page_text(root: _Element, _selectors) -> str:
    return root.text("\n")


_ANCHOR = {
    "title": _anchor_title,
    "label": _anchor_label,
    "packed": _anchor_packed,
    "href": _anchor_href,
    "url": _anchor_url,
    "dates": _anchor_dates,
}
#: Facts by kind of page; of ``anchors`` the elements, whose own facts are those of ``_ANCHOR``.
_KINDS: dict[str, dict[str, Callable]] = {
    "listing": {"anchors": _listed},
    "detail": {
        "heading": _heading,
        "metadata_text": _metadata_text,
        "content_text": _content_text,
        "anchors": _links,
    },
    "portal": {"page_title": _page_title, "page_text": _page_text, "anchors": _links},
}


def _split(kind: str, wanted: Sequence[str] | None) -> tuple[list[str], list[str]]:
    """Page facts and anchor facts that are asked for; ``anchors.url`` is a fact of every anchor."""
    if wanted is None:
        dated = kind == "listing"
        return list(_KINDS[kind]), [name for name in _ANCHOR if dated or name != "dates"]
    outer = list(dict.fromkeys(name.split(".")[0] for name in wanted))
    inner = list(dict.fromkeys(name.split(".")[1] for name in wanted if "." in name))
    known = {*_KINDS[kind], *(f"anchors.{name}" for name in _ANCHOR)} - {"anchors"}
    if unknown := sorted(set(wanted) - known):
        raise ValueError(f"no such facts of a {kind} page: {', '.join(unknown)}")
    return outer, inner


def _schema(outer: list[str], inner: list[str]) -> tuple[T.StructType, pa.StructType]:
    """Facts as Spark's and as Arrow's type."""
    texts = T.ArrayType(T.StringType())
    anchor = T.StructType([T.StructField(name, texts if name == "dates" else T.StringType()) for name in inner])
    kinds = {"anchors": T.ArrayType(anchor)}
    names = ("problem", *outer)
    link = pa.struct([(name, pa.list_(pa.string()) if name == "dates" else pa.string()) for name in inner])
    arrow = pa.struct([(name, pa.list_(link) if name == "anchors" else pa.string()) for name in names])
    return T.StructType([T.StructField(name, kinds.get(name, T.StringType())) for name in names]), arrow


def _read(
    kind: str, outer: list[str], inner: list[str], page: str | None, base: str | None, selectors
) -> dict[str, object]:
    """The facts asked for, and no others, of one page; ``problem`` says why there are none."""
    row: dict[str, object] = dict.fromkeys(("problem", *outer))
    root = None
    try:
        root, found = _tree(page or ""), {}
        for name in outer:
            value = _KINDS[kind][name](root, selectors)
            if name == "anchors":
                value = [{part: _ANCHOR[part](anchor, base or "") for part in inner} for anchor in value]
            found[name] = value
        row.update(found)
    except Exception as error:  # noqa: BLE001 - one unreadable page must not stop the job
        row["problem"] = f"{type(error).__name__}: {error}"
    finally:
        if root is not None:
            _release(root)
    return row


def _page_function(kind: str, wanted: Sequence[str] | None):
    outer, inner = _split(kind, wanted)
    schema, arrow = _schema(outer, inner)

    @F.arrow_udf(schema)
    def facts(markup: pa.Array, base: pa.Array, selectors: pa.Array) -> pa.Array:
        done = [pa.array([], arrow)]
        for start in range(0, len(markup), SLICE):
            parts = (column.slice(start, SLICE) for column in (markup, base, selectors))
            rows = [
                _read(kind, outer, inner, page.as_py(), url.as_py(), chosen.as_py())
                for page, url, chosen in zip(*parts, strict=True)
            ]
            done.append(pa.array(rows, arrow))
        return pa.concat_arrays(done)

    # Parsing is the costly step: never let a filter on its result run it a second time.
    return facts.asNondeterministic()


def _selectors(value: Column | str | None) -> Column:
    return F.lit(None).cast("array<string>") if value is None else col(value)


def listing_facts(html, url, selectors=None, wanted: Sequence[str] | None = None) -> Column:
    """Anchors of a listing page under the selectors, or all links.

    ``wanted`` names the facts to work out, here and in the other two functions: fields of the page, and
    fields of its anchors as ``anchors.url``. Nothing else is read from the page, so nothing else can fail;
    ``problem`` is always there. Without it all facts come, ``anchors.dates`` on listing pages only.
    """
    return _page_function("listing", wanted)(col(html), col(url), _selectors(selectors))


def detail_facts(html, url, selectors=None, wanted: Sequence[str] | None = None) -> Column:
    """Heading, whole-body text, content text and links of a detail page, or what is wanted of them."""
    return _page_function("detail", wanted)(col(html), col(url), _selectors(selectors))


def portal_facts(html, url, wanted: Sequence[str] | None = None) -> Column:
    """Title, visible text and links of a portal page, or what is wanted of them."""
    return _page_function("portal", wanted)(col(html), col(url), _selectors(None))
