"""Pages as trees: the quick way for regular pages gives the general parser's tree, and pages are read once."""

from __future__ import annotations

import random

import pyarrow.parquet as pq

import __spark_entry__ as entry
from jobweave.sources import html

PIECES = (
    "<!DOCTYPE html>", "<p>", "</p>", '<li class="a b">', "</li>", "<div id=x class='q'>", "</div>", "<br>", "<br/>", "<img src=/a.gif alt=\"\">", "<a href=/x/>", '<a href="/x?a=1&amp;b">', "</a>", "a &amp b", "&amp;", "&lt",
    "<!-- c <p> -->", "<!---->", "<!-->", "<!--->x-->", "<!-- a -- b -->", "<!-- a", "<?x?>", "<![CDATA[x]]>", "<script>", "</script>", "</ script>", '<script src="a"/>', 'var a="<b></b>";', "<title>", "</title>", "</TEXTAREA>", "<textarea>",
    "<", ">", "< p", '"', "'", "<p a=1 a=2>", "<P CLASS>", "</p x>", "</>", "<my-tag a>", "\x00", "<p\x0ca=b>", "<p a = b>", "<p a=b/ c>", "<p a/b=c>", "<plaintext>", "<iframe src=ads>", "</iframe>", "<td>", "<tr>", "é", "<p é=1>",
)


def _general(page: str) -> html._Node:
    builder = html._Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def _told(node: html._Node) -> tuple:
    out: list = []
    for c in node.children:
        if not isinstance(c, str):
            out.append((c.tag, tuple(c.attrs.items()), c.classes, _told(c)))
        elif c and out and isinstance(out[-1], str):
            out[-1] += c
        elif c:
            out.append(c)
    return tuple(out)


def test_regular_pages_need_no_general_parser(sf_dir):
    pages = [h for h in pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist() if h is not None]
    quick = [html._parse_regular(h) for h in pages]
    assert pages and all(q is not None for q in quick)
    assert [_told(q) for q in quick] == [_told(_general(h)) for h in pages]


def test_any_page_gives_the_general_parsers_tree():
    draw, regular = random.Random(11), 0
    for _ in range(8000):
        page = "".join(draw.choice(PIECES) for _ in range(draw.randint(1, 7)))
        assert _told(html.parse(page)) == _told(_general(page)), page
        regular += html._parse_regular(page) is not None
    assert regular > 800
    deep = "<div>" * 300 + "x<script>y</script>" + "</div>" * 300
    assert _told(html.parse(deep)) == _told(_general(deep))


def test_board_pages_are_read_once(spark, sf_dir):
    plan = entry.queries()["board_pages"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 3
