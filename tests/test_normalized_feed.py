"""The feed of pages and documents holds whole titles and texts, and every field that a source fills."""

from __future__ import annotations

import hashlib

import duckdb

import __spark_entry__ as entry

FIELDS = ["source", "source_url", "title", "org_name", "location", "is_remote", "is_paid", "stipend_text", "deadline", "text_sha256", "n"]
BODY = "The team works on water and health with partners and hosts interns each year. " * 3


def test_titles_and_texts_of_the_feed_are_whole(spark, tmp_path):
    head = "word " * 60
    texts = [head + "a\nrest", head + "b\nrest", head + "b\nother", " Title　\nrest", "\nrest", "  ", None]
    docs = [(1, t, "s") for t in texts] + [(1, texts[0], "s"), (None, "no key", None)]
    page = "<html><body><h1>Water Intern</h1><p>Location: Remote</p><p>Organization: Green Fund</p><p>Deadline: May 29, 2026</p><p>" + BODY + "A stipend of USD 1,500 per month.</p></body></html>"
    plain = page.replace("Organization", "Host")
    pages = [(1, "https://www.example.org/a", page), (2, "https://www.example.org/a", page), (3, "https://u:p@x.example.org/b", plain), (4, "mailto:a", page), (5, None, page)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")

    found = [tuple(r) for r in entry.queries()["normalize_listings"](spark, str(tmp_path)).select(*FIELDS).collect()]
    of_docs = {(r[0], r[1], r[2], r[9], r[10]) for r in found if r[0].startswith("documents:")}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    titles = [(head + "a", texts[0], 2), (head + "b", texts[1], 1), (head + "b", texts[2], 1), ("Title", texts[3], 1), ("", texts[4], 1)]
    expected = {("documents:s", "https://docs.example.org/1", title, digest(text), n) for title, text, n in titles}
    assert of_docs == expected | {("documents:", "https://docs.example.org/", "no key", digest("no key"), 1)}
    of_pages = {r[:9] + r[10:] for r in found if r[0].startswith("generic:")}
    told = ("Water Intern", "Green Fund", "Remote", True, True, "USD 1,500 per month", "2026-05-29")
    assert of_pages == {
        ("generic:example.org", "https://www.example.org/a", *told, 2), ("generic:x.example.org", "https://u:p@x.example.org/b", told[0], "x.example.org", *told[2:], 1),
        ("generic:", "mailto:a", *told, 1), ("generic:", None, *told, 1),
    }

    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = duck.execute(f"SELECT {', '.join(FIELDS)} FROM ({entry.oracle_sql()['normalize_listings']})").fetchall()
    assert sorted(map(str, found)) == sorted(map(str, want))
