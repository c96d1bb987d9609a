"""Tree-accurate HTML work, where patterns can't follow nesting: a small parser inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements that stay, elements that go with all they hold, void elements, and page chrome.
ALLOWED = frozenset("p br hr blockquote pre h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr th td a strong b em i u s mark small sub sup abbr cite code kbd q img figure figcaption".split())
STRIPPED = frozenset("script style iframe form input textarea select option button noscript svg math object embed link meta template canvas audio video map area ins fieldset legend dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
KEPT_ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "alt"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan"), "abbr": ("title",)}
DROPPED_IF_EMPTY = frozenset("p li h2 h3 h4 h5 h6 blockquote dt dd figcaption".split())
HOLDS_CONTENT = frozenset("img br ul ol table".split())
# What surrounds a page's content, and what holds it (tag, role, class or id, in order of preference).
CHROME = frozenset("script style noscript nav header footer aside form".split())
CHROME_CLASSES = frozenset("breadcrumb region-breadcrumb skip-link skip-to-content visually-hidden sr-only element-invisible menu main-menu region-header region-footer tabs pager sidebar social-links".split())
CHROME_CLASS_PARTS = ("breadcrumb", "skip-link", "sidebar", "cookie", "social-share", "share-buttons")
CHROME_ROLES = frozenset("navigation banner contentinfo search".split())
SKIP_LINKS = frozenset(("#main-content", "#content", "#main"))
CONTENT = (
    ("tag", "article"), ("tag", "main"), ("role", "main"), ("class", "entry-content"), ("class", "job-description"), ("class", "job-details"), ("class", "vacancy-details"),
    ("class", "post-content"), ("class", "node__content"), ("class", "node-content"), ("class", "field--name-body"), ("class", "field-name-body"), ("id", "block-system-main"),
    ("class", "region-content"), ("id", "content"), ("class", "content"),
)
DENSE = 200


_NO_CLASSES: frozenset[str] = frozenset()


class _Node:
    """An element.  Elements written alike share their attributes, which nobody changes."""

    __slots__ = ("attrs", "children", "classes", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], classes: frozenset[str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.classes = classes if classes is not None else frozenset(attrs["class"].split()) if attrs.get("class") else _NO_CLASSES

    def text(self) -> str:
        return "".join([c if isinstance(c, str) else c.text() for c in self.children])

    def walk(self) -> Iterator[_Node]:
        stack: list[_Node] = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]


class _Builder(HTMLParser):
    """A tree of elements; an end tag closes the nearest open element of its name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_ITSELF and self.open[-1].tag == tag:
            self.open.pop()
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < 200:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


# Elements that end where the next of their kind begins, and elements whose text holds no elements.
CLOSES_ITSELF = frozenset("p li tr td th dt dd".split())
_CDATA, _RCDATA = frozenset(HTMLParser.CDATA_CONTENT_ELEMENTS), frozenset(getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()))
_RAW = _CDATA | _RCDATA
#: A tag that is written regularly, without its angle brackets, and an attribute of it.
_VALUE = r"""(?:"[^"<>&\0]*"|'[^'<>&\0]*'|[^\s"'=<>`&\0]+)"""
_TAG = re.compile(rf"(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z_][a-zA-Z0-9_:-]*(?:={_VALUE})?)*)[ \t\n]*(/?))")
_ATTRIBUTE = re.compile(rf"([a-zA-Z_][a-zA-Z0-9_:-]*)(?:=({_VALUE}))?")
_TAGS: dict[str, tuple[bool, str, dict[str, str] | None, frozenset[str]] | None] = {}
_TAGS_KEPT = 8192


def _tag(written: str) -> tuple[bool, str, dict[str, str] | None, frozenset[str]] | None:
    """A regular tag: whether it closes itself, its name, attributes (None for an end tag) and classes; None for any other text."""
    m = _TAG.fullmatch(written)
    if m is None:
        return None
    end, name, inside, alone = m.groups()
    if end:
        return False, end.lower(), None, _NO_CLASSES
    if not inside:
        return bool(alone), name.lower(), {}, _NO_CLASSES
    attrs = {k.lower(): v[1:-1] if v[:1] in ('"', "'") else v for k, v in _ATTRIBUTE.findall(inside)}
    css = attrs.get("class")
    return bool(alone), name.lower(), attrs, frozenset(css.split()) if css else _NO_CLASSES


def _raw_text(tag: str, data: str, parts: Iterator[str]) -> tuple[str, str] | None:
    """The text of an element that holds no elements, and what stands behind it; None if it doesn't end regularly."""
    end = "/" + tag
    for part in parts:
        if part[: len(end)].lower() == end and part[len(end) : len(end) + 1] in ("", *"\t\n\r\f />"):
            written, closed, behind = part.partition(">")
            return (data, behind) if closed and written[len(end) :].strip(" \t\n") == "" and "<!--" not in data else None
        if part[:1] == "/" and part[1:2].isspace():
            return None
        data += "<" + part
    return None


def _parse_regular(html: str) -> _Node | None:
    """The tree that _Builder gives, if every tag and comment of the page is regular; None if any isn't."""
    root = _Node("", {}, _NO_CLASSES)
    opened, last, children = [root], root, root.children
    parts = iter(html.split("<"))
    data = next(parts)
    if data:
        children.append(unescape(data) if "&" in data else data)
    for part in parts:
        written, closed, data = part.partition(">")
        told = _TAGS.get(written)
        if told is None:
            if part.startswith("!--"):
                while "-->" not in part:
                    more = next(parts, None)
                    if more is None:
                        return None
                    part += "<" + more
                inside, _, data = part[3:].partition("-->")
                if inside[:1] in (">", "-") or "--" in inside or inside[-1:] == "-" or (not inside and part[3:6] != "-->"):
                    return None
                if data:
                    children.append(unescape(data) if "&" in data else data)
                continue
            if not closed:
                return None
            if written[:8].lower() == "!doctype":
                if data:
                    children.append(unescape(data) if "&" in data else data)
                continue
            told = _tag(written)
            if told is None:
                return None
            if len(_TAGS) >= _TAGS_KEPT:
                _TAGS.clear()
            _TAGS[written] = told
        elif not closed:
            return None
        alone, tag, attrs, classes = told
        if attrs is None:
            if last.tag == tag and len(opened) > 1:
                opened.pop()
                last = opened[-1]
                children = last.children
            else:
                for i in range(len(opened) - 1, 0, -1):
                    if opened[i].tag == tag:
                        del opened[i:]
                        last = opened[-1]
                        children = last.children
                        break
        else:
            if tag in CLOSES_ITSELF and last.tag == tag and not alone:
                opened.pop()
                last = opened[-1]
                children = last.children
            node = _Node(tag, attrs, classes)
            children.append(node)
            if tag in _RAW:
                if alone or tag == "plaintext" or len(opened) >= 200:
                    return None
                told_raw = _raw_text(tag, data, parts)
                if told_raw is None:
                    return None
                raw, data = told_raw
                if raw:
                    node.children.append(raw if tag in _CDATA else unescape(raw))
            elif not alone and tag not in VOID and len(opened) < 200:
                opened.append(node)
                last = node
                children = node.children
        if data:
            children.append(unescape(data) if "&" in data else data)
    return root


def parse(html: str) -> _Node:
    """The tree of a page; pages that are written regularly need no general parser."""
    root = _parse_regular(html)
    if root is not None:
        return root
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_SCRIPT, _MAIL, _WEB = re.compile(r"(?i)javascript:"), re.compile(r"(?i)(mailto|tel):"), re.compile(r"(?i)https?://")


def _link(node: _Node, base: str) -> dict[str, str] | None:
    """Attributes of a link that may stay, or None to keep only what it holds."""
    href = node.attrs.get("href", "").strip()
    kept = {k: node.attrs[k] for k in ("title",) if k in node.attrs}
    if not href or href.startswith("#") or _SCRIPT.match(href):
        return None
    if _MAIL.match(href):
        return {"href": href} | kept
    full = href if _WEB.match(href) else urljoin(base, href) if base else href
    if not _WEB.match(full):
        return None
    return {"href": full} | kept | {"target": "_blank", "rel": "noopener noreferrer"}


def _image(node: _Node, base: str) -> dict[str, str] | None:
    src, alt = node.attrs.get("src", "").strip(), " ".join(node.attrs.get("alt", "").split())
    pixel = any(node.attrs.get(k) in ("0", "1") for k in ("width", "height")) or (not alt and re.search(r"(?i)\.gif(\?|$)", src))
    full = src if _WEB.match(src) else urljoin(base, src) if base else src
    if not src or pixel or not _WEB.match(full):
        return None
    return {"src": full} | ({"alt": node.attrs["alt"]} if "alt" in node.attrs else {})


def _render(node: _Node, base: str, out: list[str]) -> bool:
    """Writes what a node holds; whether any of it is content."""
    some = False
    for child in node.children:
        if isinstance(child, str):
            out.append(escape(child, quote=False))
            some |= bool(child.strip())
            continue
        if child.tag in STRIPPED:
            continue
        tag = "h2" if child.tag == "h1" else child.tag
        if tag not in ALLOWED:
            some |= _render(child, base, out)
            continue
        attrs: dict[str, str] | None = {k: child.attrs[k] for k in KEPT_ATTRIBUTES.get(tag, ()) if k in child.attrs} if child.attrs else {}
        if tag == "a":
            attrs = _link(child, base)
            if attrs is None:
                some |= _render(child, base, out)
                continue
        elif tag == "img":
            attrs = _image(child, base)
            if attrs is None:
                continue
        begin = len(out)
        out.append("<" + tag + "".join([f' {k}="{escape(v)}"' for k, v in attrs.items()]) + ">" if attrs else f"<{tag}>")
        inside = _render(child, base, out) if tag not in VOID else False
        if tag in DROPPED_IF_EMPTY and not inside and not any(n.tag in HOLDS_CONTENT for n in child.walk()):
            del out[begin:]
            continue
        if tag not in VOID:
            out.append(f"</{tag}>")
        some |= inside
    return some


def clean_html(html: str | None, base: str = "") -> str | None:
    """Markup of a posting's body that is safe and plain: allowed elements with allowed attributes, h1 as h2, links
    and images resolved, tracking pixels, comments and empty blocks removed; other elements leave what they hold."""
    if html is None:
        return None
    out: list[str] = []
    _render(parse(html), base or "", out)
    return "".join(out).strip()


# Elements that a posting's display keeps, elements that it drops with all they hold, and addresses of links.
SHOWN = frozenset("p br b strong i em u ul ol li h2 h3 h4 a blockquote span div".split())
HIDDEN = frozenset("annotation-xml audio colgroup desc foreignobject head iframe math mi mn mo ms mtext noembed noframes noscript plaintext script style svg template thead title video xmp".split())
SHOWN_LINK = re.compile(r"(?i)^(?:(?:(?:f|ht)tps?|mailto|tel|callto|sms|cid|xmpp|matrix):|[^a-z]|[a-z+.\-]+(?:[^a-z+.\-:]|$))")


def _shown(node: _Node, out: list[str]) -> None:
    for c in node.children:
        if isinstance(c, str):
            out.append(escape(c, quote=False))
        elif c.tag in SHOWN:
            href = c.attrs.get("href")
            kept = f' href="{escape(href)}"' if href is not None and SHOWN_LINK.match(re.sub(r"[\x00-\x20]", "", href)) else ""
            out.append(f"<{c.tag}{kept}" + (' target="_blank" rel="noopener noreferrer nofollow"' if c.tag == "a" else "") + ">")
            if c.tag not in VOID:
                _shown(c, out)
                out.append(f"</{c.tag}>")
        elif c.tag not in HIDDEN:
            _shown(c, out)


def display_html(html: str | None) -> str | None:
    """Markup as a reader sees it: few elements, no attributes but web and mail addresses of links, which open apart; what
    other elements hold stays, scripts and the like go."""
    if html is None:
        return None
    out: list[str] = []
    _shown(parse(html), out)
    return "".join(out).strip()


def _chrome(node: _Node) -> bool:
    css, own = node.attrs.get("class", ""), node.attrs.get("id", "")
    return (
        node.tag in CHROME or node.attrs.get("role") in CHROME_ROLES or not CHROME_CLASSES.isdisjoint(css.split()) or any(w in css for w in CHROME_CLASS_PARTS)
        or own == "breadcrumb" or "cookie" in own or (node.tag == "a" and node.attrs.get("href") in SKIP_LINKS)
    )


def _is(node: _Node, by: str, value: str) -> bool:
    return node.tag == value if by == "tag" else value in node.attrs.get("class", "").split() if by == "class" else node.attrs.get(by) == value


def _strip_chrome(node: _Node) -> None:
    node.children = [c for c in node.children if isinstance(c, str) or not _chrome(c)]
    for c in node.children:
        if not isinstance(c, str):
            _strip_chrome(c)


def _inner(node: _Node) -> str:
    parts = []
    for c in node.children:
        if isinstance(c, str):
            parts.append(escape(c, quote=False))
        else:
            attrs = "".join([f' {k}="{escape(v)}"' for k, v in c.attrs.items()]) if c.attrs else ""
            parts.append(f"<{c.tag}{attrs}>" + ("" if c.tag in VOID else _inner(c) + f"</{c.tag}>"))
    return "".join(parts)


def content(root: _Node) -> tuple[str, str | None]:
    """Title and markup of a page's content, from a tree that loses its chrome: the first heading, else the announced title;
    the container with most text, the first of each kind counted, or the body if none is dense; no markup without text."""
    _strip_chrome(root)
    size = lambda n: len(" ".join(n.text().split()))
    nodes = list(root.walk())
    heading = next((n for n in nodes if n.tag == "h1"), None)
    said = next((n.attrs.get("content", "") for n in nodes if n.tag == "meta" and n.attrs.get("property") == "og:title"), "")
    title = (" ".join(heading.text().split()) if heading else "") or " ".join(said.split())
    first = [next((n for n in nodes if _is(n, by, value)), None) for by, value in CONTENT]
    best = max((n for n in first if n is not None), key=size, default=None)
    if best is None or size(best) < DENSE:
        best = next((n for n in nodes if n.tag == "body"), root)
    return title, _inner(best) if size(best) else None


def densest(html: str | None) -> str | None:
    """Markup of a page's content, see content()."""
    return None if html is None else content(parse(html))[1]


def clean(pages: DataFrame) -> DataFrame:
    """page_id and html of pages (page_id, url, html), cleaned."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "html": [clean_html(h, u or "") for h, u in zip(b["html"], b["url"], strict=True)]})

    schema = T.StructType([pages.schema["page_id"], T.StructField("html", T.StringType())])
    return pages.select("page_id", "url", "html").mapInPandas(run, schema)


def display(rows: DataFrame, html: str = "html") -> DataFrame:
    """The rows with the column ``html`` as a reader sees it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{html: [display_html(h) for h in b[html]]})

    return rows.mapInPandas(run, rows.schema)


def main_content(pages: DataFrame) -> DataFrame:
    """page_id and html of the main container of pages (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "html": [densest(h) for h in b["html"]]})

    schema = T.StructType([pages.schema["page_id"], T.StructField("html", T.StringType())])
    return pages.select("page_id", "html").mapInPandas(run, schema)
