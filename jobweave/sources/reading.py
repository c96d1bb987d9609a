"""Pages read as trees, once each: content, cards of boards, rows of vacancy tables, posts, and the bodies of what they lead to."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from jobweave.sources.html import _inner, _Node, clean_html, content, parse

#: A step of a path to an element: its tag ("" for any) and classes that it has.
Step = tuple[str, tuple[str, ...]]


def _fits(node: _Node, step: Step) -> bool:
    return (not step[0] or step[0] == node.tag) and (not step[1] or node.classes.issuperset(step[1]))


def found(root: _Node, *paths: Sequence[Step]) -> Iterator[_Node]:
    """Elements in the page's order whose own and outer elements match one of the paths, outermost step first."""
    if all(len(path) == 1 for path in paths):
        plain = [root]
        steps = [path[0] for path in paths]
        while plain:
            node = plain.pop()
            for own, css in steps:
                if (not own or own == node.tag) and (not css or node.classes.issuperset(css)):
                    yield node
                    break
            if node.children:
                plain += [c for c in reversed(node.children) if not isinstance(c, str)]
        return
    stack: list[tuple] = [(root, None)]  # each element with the chain of those around it
    while stack:
        inner = stack.pop()
        node, outer = inner
        tag, classes = node.tag, node.classes
        for path in paths:
            own, css = path[-1]
            if (own and own != tag) or (css and not classes.issuperset(css)):
                continue
            left, up = len(path) - 1, outer
            while left and up is not None:
                if _fits(up[0], path[left - 1]):
                    left -= 1
                up = up[1]
            if not left:
                yield node
                break
        if node.children:
            stack += [(c, inner) for c in reversed(node.children) if not isinstance(c, str)]


def _text(node: _Node | None) -> str:
    return " ".join(node.text().split()) if node else ""


def _without(node: _Node, gone: Callable[[_Node], bool]) -> None:
    node.children = [c for c in node.children if isinstance(c, str) or not gone(c)]
    for c in node.children:
        if not isinstance(c, str):
            _without(c, gone)


def _gone(tags: str, classes: str, parts: Sequence[str] = (), ids: Sequence[str] = ()) -> Callable[[_Node], bool]:
    names, own = set(tags.split()), set(classes.split())

    def test(node: _Node) -> bool:
        if node.tag in names:
            return True
        attrs = node.attrs
        if not attrs:
            return False
        css, number = attrs.get("class"), attrs.get("id") if ids else None
        return bool(css and (not own.isdisjoint(node.classes) or any(p in css for p in parts))) or bool(number and any(p in number for p in ids)) or (node.tag == "iframe" and "ads" in attrs.get("src", ""))

    return test


# Where boards keep what is read, and what is taken out of it.
CARD = ([("li", ("post-item",))], [("article", ("post-item",))])
CARD_LINK = ([("", ("post-title",)), ("a", ())],)
CARD_BODY = ([("", ("entry-content", "entry"))],)
CARD_NOISE = _gone(
    "script style ins", "stream-item related-posts post-bottom-meta post-tags-share-box jannah-recent-posts tie-related-posts tie-popup mag-box sharing-buttons",
    ("related-post", "inline-related"), ("related",),
)
POST_LINK = ([("article", ()), ("", ("entry-title",)), ("a", ())], [("article", ()), ("h2", ()), ("a", ())], [("article", ()), ("h1", ()), ("a", ())], [("", ("post",)), ("h2", ()), ("a", ())], [("h2", ("post-title",)), ("a", ())])
POST_BODY = ([("", ("elementor-widget-theme-post-content",)), ("", ("elementor-widget-container",))], [("", ("entry-content",))], [("", ("post-content",))])
POST_NOISE = _gone("script style", "related-posts post-navigation comments-area sharedaddy wp-block-social-links")


def _links(root: _Node, url: str) -> list[dict]:
    return [{"href": a.attrs["href"].strip(), "text": _text(a)} for a in found(root, [("a", ())]) if "href" in a.attrs]


def _cards(root: _Node, url: str) -> list[dict]:
    out = []
    for card in found(root, *CARD):
        link = next(found(card, *CARD_LINK), None)
        href = link.attrs.get("href", "").strip() if link else ""
        if href:
            classes = card.attrs.get("class", "").split()
            number = next((c[5:] for c in classes if re.fullmatch(r"post-\d+", c)), None)
            excerpt = " ".join("".join(n.text() for n in found(card, [("", ("post-excerpt",))])).split())
            out.append({"href": href, "title": _text(link), "source_id": number, "excerpt": excerpt, "classes": classes})
    return out


def _vacancies(root: _Node, url: str) -> list[dict]:
    out = []
    for row in found(root, [("a", ("vacanciesTable__row",))]):
        href = row.attrs.get("href", "").strip()
        number = re.search(r"/job/(\d+)", href)
        if not number:
            continue
        fields = {}
        for cell in found(row, [("", ("vacanciesTable__cell",))]):
            label = " ".join("".join(n.text() for n in found(cell, [("", ("vacanciesTable__cell__label",))])).split())
            if label:
                fields[label.lower()] = _text(next(found(cell, [("span", ())]), None))
        home = "country_ETH" in row.attrs.get("class", "").split()
        out.append({"href": href, "source_id": number[1], "home": home, "fields": list(fields.items())})
    return out


def _posts(root: _Node, url: str) -> list[dict]:
    first: dict[str, dict] = {}
    for a in found(root, *POST_LINK):
        href, title = a.attrs.get("href", "").strip(), _text(a)
        if href and title:
            first.setdefault(href, {"href": href, "title": title})
    return list(first.values())


def _body(heading: Sequence[Sequence[Step]], where: Sequence[Sequence[Step]], noise: Callable[[_Node], bool]) -> Callable[[_Node, str], dict]:
    def read(root: _Node, url: str) -> dict:
        title = _text(next(found(root, *heading), None))
        body = next(found(root, *where), None)
        if body is not None:
            _without(body, noise)
        markup = _inner(body) if body is not None else ""
        return {"title": title, "html": markup, "cleaned": clean_html(markup, url), "text": _text(body)}

    return read


BLOG_NOISE = _gone("script style ins iframe", "", ("related", "share", "widget"))


def _blog(root: _Node, url: str) -> dict:
    _without(root, BLOG_NOISE)
    markup = _inner(root)
    cleaned = clean_html(markup, url) or ""
    return {"title": None, "html": markup, "cleaned": cleaned, "text": _text(parse(cleaned))}


def _content(root: _Node, url: str) -> dict:
    title, markup = content(root)
    return {"title": title, "html": markup, "cleaned": clean_html(markup, url), "text": None}


_BODY = "struct<title string, html string, cleaned string, text string>"
#: What can be read of a page, and its type.  Readers of bodies take their noise out of the tree, so they come last.
READERS: dict[str, tuple[Callable[[_Node, str], object], str]] = {
    "links": (_links, "array<struct<href string, text string>>"),
    "cards": (_cards, "array<struct<href string, title string, source_id string, excerpt string, classes array<string>>>"),
    "vacancies": (_vacancies, "array<struct<href string, source_id string, home boolean, fields map<string, string>>>"),
    "posts": (_posts, "array<struct<href string, title string>>"),
    "board_body": (_body([[("h1", ("post-title", "entry-title"))]], CARD_BODY, CARD_NOISE), _BODY),
    "post_body": (_body([[("h1", ())]], POST_BODY, POST_NOISE), _BODY),
    "blog": (_blog, _BODY),
    "content": (_content, _BODY),
}


def read_pages(pages: DataFrame, *what: str) -> DataFrame:
    """The pages (url, html and others) with a column for each of ``what`` in place of html, each page parsed once.  A null page gives nulls."""
    rows = pages.drop(*what)
    names = [n for n in READERS if n in what]
    kept = [f for f in rows.schema.fields if f.name != "html"]
    schema = T.StructType([*kept, *[T.StructField(n, T.DataType.fromDDL(READERS[n][1])) for n in names]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told: dict[str, list] = {n: [] for n in names}
            for html, url in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), strict=True):
                root = None if html is None else parse(html)
                for n in names:
                    told[n].append(None if root is None else READERS[n][0](root, url or ""))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(told[n], arrow.field(n).type) for n in names], schema=arrow)

    return rows.mapInArrow(run, schema)
