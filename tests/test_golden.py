"""Cases of the text rules."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobweave.functions import text, urls
from jobweave.operators import board, classify, gates, lifecycle, merge, resolve
from jobweave.sources import html, pages, report


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_internship_titles(spark):
    yes = ["Water Policy Intern", "Child Protection Internship", "Internship Scheme 2031", "Parliament Traineeship", "Press Assistant (Internship)", "Intern, Soil Research"]
    no = ["Internship Coordinator", "Internship Programme Manager", "Intern Supervisor", "Library Fellowship", "Graduate Trainee", "Internal Controller", "Field Officer", None, "international"]
    assert column(spark, yes + no, gates.is_internship) == [True] * len(yes) + [False] * len(no)


def test_ascii_word_edges(spark):
    assert column(spark, ["éintern", "intern_x", "x intern."], gates.is_internship) == [True, False, True]


def test_roundups(spark):
    assert column(spark, ["10 Jobs at X", "Job vacancies at X", "5 Interns Required", "Vacancies with Y", "Policy Intern"], gates.is_roundup) == [True, True, False, True, False]


@pytest.mark.parametrize(
    ("location", "body", "accessible", "category"),
    [
        ("Bahir Dar, Ethiopia", "", True, "ethiopia"),
        ("Remote", "", True, "remote"),
        (None, "You will hold a fully remote position with us.", True, "remote"),
        ("Vienna, Austria", "We offer visa sponsorship to the person chosen.", True, "sponsored"),
        ("Boston, USA", "Daily presence at the desk.", False, "elsewhere"),
        ("Kampala, Uganda", "The team visits remote villages.", False, "elsewhere"),
        ("Dublin, Ireland", "Please note: not a remote position.", False, "elsewhere"),
        (None, "You must be authorized to work in the United States.", False, "restricted"),
        (None, "Come and learn with us.", False, "unclear"),
        (None, "We do not cover travel or visas, though a visa support letter can be written.", False, "unclear"),
        ("Lagos, Nigeria", "This hybrid remote post has two office days.", False, "elsewhere"),
    ],
)
def test_access(spark, location, body, accessible, category):
    df = spark.createDataFrame([(location, "", body)], "location string, title string, body string")
    got = df.select(gates.access_decision(F.col("location"), F.col("title"), F.col("body")).alias("a")).first()["a"]
    assert (got["accessible"], got["category"]) == (accessible, category)


def test_titles_and_places(spark):
    titles = ["Internship: Water Quality Intern", "(Radio and Press Intern)", "Archive Internship (3 Required)", "Internal Control Intern"]
    assert column(spark, titles, text.normalize_title) == ["water quality", "radio and press", "archive", "internal control"]
    assert column(spark, ["Bahir Dar, Ethiopia", None, "BAHIR  DAR"], text.normalize_location) == ["bahir dar", "", "bahir dar"]


def test_dates(spark):
    raw = ["August 29, 2031", "29 August 2031", "29/08/2031", "2031-08-29", "March 3rd, 2027", "soon", "31/31/2027", None]
    got = column(spark, raw, lambda c: F.date_format(text.parse_deadline(c), "yyyy-MM-dd"))
    assert got == ["2031-08-29"] * 4 + ["2027-03-03", None, None, None]


def test_deadlines_in_prose(spark):
    prose = [
        "Deadline Date: Monday, February 3, 2031", "no later than 22nd July 2029", "apply by 7 October 2030", "the works will end by March 9, 2029",
        "Deadline: Smarch 3, 2024 but apply by 4 May 2024", "Deadline soon. Please apply before 4 May 2024", "",
    ]
    got = column(spark, prose, lambda c: F.date_format(text.find_deadline(c), "yyyy-MM-dd"))
    assert got == ["2031-02-03", "2029-07-22", "2030-10-07", None, None, "2024-05-04", None]


def test_labels(spark):
    got = column(spark, ["Location: Bahir Dar Deadline Date: July 8, 2030", "Organization: River Trust; \nx", "none"], text.top_meta)
    assert (got[0]["location"], got[0]["deadline"], got[1]["organization"], got[2]["location"]) == ("Bahir Dar", "July 8, 2030", "River Trust", None)


def test_pay(spark):
    assert column(spark, ["Interns get a stipend of USD 820 per month.", "costs $70", "ETB 4,100 - 6,300 monthly", "a stipend"], text.extract_stipend) == ["USD 820 per month", None, "ETB 4,100 - 6,300 monthly", None]
    df = spark.createDataFrame([("x", "unpaid but paid"), ("x", "paid"), ("x", "y")], "t string, b string")
    assert [r[0] for r in df.select(text.detect_paid(F.col("t"), F.col("b"))).collect()] == [False, True, None]


def test_text_of_markup(spark):
    got = column(spark, ["<div>Place: Here</div><div>Day: x</div>", "<table><tr><td>Sum</td><td>$7</td></tr></table><script>x()</script><p>This&amp;that</p>", None], text.html_to_text)
    assert got == ["Place: Here\nDay: x", "Sum $7 \nThis&that".replace(" \n", "\n"), None]


def test_clean_markup():
    base = "https://jobs.example.net/board/7"
    assert html.clean_html("<section><h1>Field office</h1><h3> </h3><p>Two seats.</p></section>") == "<h2>Field office</h2><p>Two seats.</p>"
    assert html.clean_html("<ul><li>Maps</li></ul><noscript>n</noscript><svg><path/></svg><ins>i</ins><!--c--><template>t</template>") == "<ul><li>Maps</li></ul>"
    assert html.clean_html('<p>See <a href=" JavaScript:void 0">terms</a></p>') == "<p>See terms</p>"
    assert html.clean_html("<p><a class=k href=../forms/a?b=1&amp;c=2 title='Form'>Form</a></p>", base) == '<p><a href="https://jobs.example.net/forms/a?b=1&amp;c=2" title="Form" target="_blank" rel="noopener noreferrer">Form</a></p>'
    assert html.clean_html('<p><a href="tel:+251 11">Call</a></p>') == '<p><a href="tel:+251 11">Call</a></p>'
    assert html.clean_html("<figure><img src=//cdn.example.net/map.jpg alt=Map loading=lazy></figure>", base) == '<figure><img src="https://cdn.example.net/map.jpg" alt="Map"></figure>'
    assert "<img" not in html.clean_html('<img src="https://s.example.net/hit.GIF" alt=" "><img src="https://s.example.net/q.webp" height="0" alt="q"><img alt="none">')
    assert html.clean_html("<main><font>Two</font> <em>words</em></main>") == "Two <em>words</em>"
    assert html.clean_html("<table><tr><td colspan=2 style=x>1</td></tr></table><br>") == '<table><tr><td colspan="2">1</td></tr></table><br>'
    assert html.clean_html(None) is None


def test_display_of_markup():
    assert html.display_html('<table><tr><td>1</td><td><a href="/x?a=1" id="i">two</a></td></tr></table>') == '1<a href="/x?a=1" target="_blank" rel="noopener noreferrer nofollow">two</a>'
    assert html.display_html("<p onclick=x>a<style>b</style><custom>c</custom></p> <video>d</video>") == "<p>ac</p>"
    assert html.display_html('<a href="java\nscript:1">x</a><a href="data:1">y</a><a href="#z">z</a>').count("href") == 1
    assert html.display_html(None) is None and html.display_html("1 < 2 & 3") == "1 &lt; 2 &amp; 3"


def test_title_and_host_of_a_page(spark):
    from jobweave.sources import pages

    body = "word " * 60
    rows = [
        (1, "http://www.x.example.org/a", f"<title>T</title><header><h1>Logo</h1></header><article><h1>Water <b>Intern</b></h1>{body}</article><article>second {body}</article>"),
        (2, "http://y.example.org/b", f"<head><title>Only a title</title></head><main>{body}</main>"),
        (3, "http://z.example.org/c", f'<meta property="og:title" content=" Said  here "><main>Location: Jimma<p>{body}</p></main>'),
        (4, "http://z.example.org/d", "<h1>Short</h1><main>few words</main>"), (5, "http://z.example.org/e", None),
    ]
    got = pages.pages_to_listings(spark.createDataFrame(rows, "page_id int, url string, html string"), gate=False).orderBy("page_id").collect()
    assert [(r["page_id"], r["title"], r["org_name"], r["source"], r["location"]) for r in got] == [(1, "Water Intern", "www.x.example.org", "generic:x.example.org", None), (3, "Said here", "z.example.org", "generic:z.example.org", "Jimma")]
    assert "second" not in got[0]["description_text"] and got[0]["description_html"].startswith("<h2>Water <b>Intern</b></h2>")


def test_references_without_a_semicolon_are_text(spark):
    rows = [(1, "http://x.example.org/a?b=1&c", f"<article><h1>Water &amp;&amp; Intern&amp</h1>Tea &lt; R&amp D {'word ' * 60}</article>")]
    got = pages.pages_to_listings(spark.createDataFrame(rows, "page_id int, url string, html string"), gate=False).first()
    assert got["title"] == "Water && Intern&amp" and "Tea < R&amp D" in got["description_text"]


def test_programs_and_evidence(spark):
    agents = {"WhatsApp/2.23": True, "axios/1.6": True, "Chrome-Lighthouse": True, "Mozilla python fan": False, " ": False, "": True, None: True, "python-requests/2": True}
    assert column(spark, list(agents), gates.is_bot) == list(agents.values())
    from jobweave.operators import classify

    urls_ = ["https://A.org/Form", "https://a.org/form/", "https://a.org/form//", "https://b.org/?x=1&y=2", "/", None, "https://c.org"]
    assert column(spark, urls_, lambda c: classify.url_guard(c, F.lit('<a href="https://b.org/?x=1&amp;y=2">'), F.lit("see https://a.org/form now"))) == ["https://A.org/Form", "https://a.org/form/", None, "https://b.org/?x=1&y=2", None, None, None]


def test_main_container():
    body = "word " * 60
    page = f"<html><body><nav>menu</nav><article><p>{body}</p></article><div class='sidebar'>{body * 3}</div></body></html>"
    assert "menu" not in html.densest(page) and html.densest(page).startswith("<p>")
    assert html.densest("<html><body></body></html>") is None


def test_guards(spark):
    df = spark.createDataFrame([("v", "a  Quote here", "x a quote HERE y"), ("v", "short", "short"), ("v", None, "t")], "v string, q string, t string")
    assert [r[0] for r in df.select(classify.evidence_guard(F.col("v"), F.col("q"), F.col("t"))).collect()] == ["v", None, None]


def test_classify_with_a_model(spark):
    rows = spark.createDataFrame([("Policy Intern", "governance"), ("Driver", ""), ("Helper", "nothing"), ("Helper", "policy and health")], "title string, text string")

    def predict(batch):
        import pandas as pd

        return pd.DataFrame({"fits": [None if "policy" in t else True for t in batch["text"]], "fields": [["policy"]] * len(batch), "fit_score": [88] * len(batch), "reason": ["model"] * len(batch)})

    with_answers = classify.with_model(rows, predict, ("title", "text"))
    got = classify.classify(with_answers, model=F.col("model")).orderBy("title", "text").collect()
    assert [(r["decision"], r["fits"], r["fit_score"]) for r in got] == [("exclude", False, 0), ("ambiguous", True, 88), ("ambiguous", True, 60), ("include", True, 91)]

    failing = classify.with_model(rows, lambda b: 1 / 0, ("title",))
    assert failing.where("model IS NOT NULL").count() == 0


def test_duplicates_do_not_depend_on_order(spark):
    words = "sort the letters of the water office and keep its map shelves in order"
    items = [
        (1, "Internship: Water Quality Intern", "Addis Ababa", words + " daily", "https://a/1", "active", "{}"), (2, "Water Quality Intern", "ADDIS ABABA", words, "https://b/2", "active", '{"n":1,"deep":{"f":true,"z":[1,"x"]},"q":null}'),
        (3, "Water Quality Intern", None, "write notes about harvest prices rainfall village markets", "https://c/3", "active", "{}"), (4, "Water Quality Intern", "Nairobi", words, "https://d/4", "active", "{}"),
        (5, "(intern)", "x", words, "https://e/5", "active", "{}"), (6, "Water Quality Intern", "", "", "https://f/6", "active", "{}"),
    ]
    schema = "id long, title string, location string, text string, source_url string, status string, raw string"
    for order in (items, items[::-1]):
        found = resolve.dup_clusters(spark.createDataFrame(order, schema)).orderBy("id").collect()
        assert [(r["id"], r["canonical_id"], r["size"]) for r in found] == [(1, 1, 2), (2, 1, 2)]
    hidden = resolve.hide_duplicates(spark.createDataFrame(items, schema), apply=True).where("status = 'hidden'").collect()
    assert [(r["id"], r["raw"]) for r in hidden] == [(2, '{"deep":{"f":true,"z":[1,"x"]},"duplicateOf":"https://a/1","n":1,"q":null}')]


def test_organisations_inside_words(spark):
    orgs = spark.createDataFrame([("a", "African Union Commission"), ("b", "Amnesty"), ("c", "Interaction"), ("d", "Green Light"), ("e", "The Fund")], "slug string, name string")
    names = ["african union commission", "Office of the African Union Commission, HQ", "Myinteractions Ltd", "xgreen lighthouse", "amnesty international", "Fund", "unknown", "", None]
    got = {r["org_name"]: r["org_slug"] for r in resolve.org_match(spark.createDataFrame([(n,) for n in names], "org_name string"), orgs).collect()}
    assert got == {"african union commission": "a", "Office of the African Union Commission, HQ": "a", "Myinteractions Ltd": "c", "xgreen lighthouse": "d", "amnesty international": None, "Fund": "e", "unknown": None, "": None, None: None}


def test_upsert(spark):
    table = spark.createDataFrame([("a", 1, '{"x":1,"k":2}'), ("b", 2, None)], "key string, n int, raw string")
    batch = spark.createDataFrame([("a", 5, '{"x":9}', 1), ("c", 6, "{}", 2), ("c", 7, "{}", 3)], "key string, n int, raw string, seq int")
    once = merge.upsert(table, batch, "key", "seq")
    rows = lambda df: sorted((r["key"], r["n"], r["raw"]) for r in df.collect())
    assert rows(once) == [("a", 5, '{"x":9}'), ("b", 2, None), ("c", 7, "{}")]
    assert rows(merge.upsert(once, batch, "key", "seq")) == rows(once)
    merged = rows(merge.upsert(table, batch, "key", "seq", keep=("n",), merge_raw=True))
    assert merged[0] == ("a", 1, '{"k":2,"x":9}')
    # Null keys never match, not even each other.
    lost = spark.createDataFrame([(None, 8, "{}", 1), (None, 9, "{}", 1), ("a", 5, '{"x":9}', 1)], "key string, n int, raw string, seq int")
    again = merge.upsert(merge.upsert(table, lost, "key", "seq"), lost, "key", "seq").collect()
    assert sorted(r["n"] for r in again if r["key"] is None) == [8, 8, 9, 9] and len(again) == 6
    assert tuple(merge.upsert_counts(table, batch, "key").first()) == (2, 1, 1)


def test_reconcile_is_idempotent_and_bounds_hold(spark):
    day = lambda d: dt.datetime(2024, 6, d)
    rows = [
        (1, "Policy Intern", "active", day(10), day(9), "x"), (2, "Policy Intern", "active", day(8), day(9), "x"), (3, "10 jobs at X", "active", None, day(9), "x"),
        (4, "Policy Intern", "hidden", None, day(9), "Deadline: 1 July 2024"), (5, "Policy Intern", "active", None, dt.datetime(2024, 5, 1), "x"), (6, "Policy Intern", "expired", dt.datetime(2024, 1, 1), day(1), "x"),
    ]
    df = spark.createDataFrame(rows, "id int, title string, status string, deadline timestamp, scraped_at timestamp, description string")
    as_of = "2024-06-10 00:00:00"
    decided = lifecycle.reconcile(df, as_of)
    assert {r["id"]: r["action"] for r in decided.collect()} == {1: None, 2: "expire", 3: "delete", 4: "backfill", 5: "stale", 6: "purge"}
    after = lifecycle.apply_reconcile(decided)
    assert {r["id"]: r["status"] for r in after.collect()} == {1: "active", 2: "expired", 4: "active", 5: "expired"}
    assert lifecycle.reconcile(after, as_of).where("action IS NOT NULL").count() == 0
    kept = lifecycle.apply_reconcile(decided, preserve_hidden=True)
    assert {r["id"]: r["status"] for r in kept.collect()}[4] == "hidden"
    late = {r["id"] for r in lifecycle.expire_now(df, as_of).where("status = 'expired'").collect()} - {6}
    assert late <= {r["id"] for r in decided.where("action IN ('expire', 'stale', 'purge', 'delete')").collect()}


def test_links(spark):
    page = "<a href='/x'>Policy Intern</a><a href='https://www.site.org/x'>Intern again</a><a href='#t'>Intern</a><a href='mailto:a@b'>Intern</a><a href='https://other.org/y'>Intern</a><a href='sub/z?q=1'>Legal <b>Internship</b></a>"
    df = spark.createDataFrame([(1, "https://site.org/jobs/list?p=1", page)], "page_id long, url string, html string")
    got = [r["href"] for r in pages.page_links(df).orderBy("pos").collect()]
    assert got == ["https://site.org/x", "https://www.site.org/x", "https://site.org/jobs/sub/z?q=1"]


def test_application_links(spark):
    a = lambda href, text: f'<a href="{href}">{text}</a>'
    cases = [
        # A call outweighs a known host; of two equal ones the later stands nearer to the end.
        (a("https://org.example.net/form", "How to apply") + a("https://jobs.lever.co/x", "Details"), "https://org.example.net/form"),
        (a("https://o.example.net/a", "Apply") + a("https://o.example.net/b", "Apply"), "https://o.example.net/b"),
        (a("https://o.example.net/info", "More") + a("https://o.example.net/vacancies/7", "More"), "https://o.example.net/vacancies/7"),
        (a("https://site.org/apply", "Apply") + a("/apply", "Apply now"), None),  # the page's own host, and no absolute link
        (a("https://o.example.net/x", "here"), None),  # 3 points are too few
    ]
    df = spark.createDataFrame([(i, "https://www.site.org/p", h) for i, (h, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r["url"] for r in pages.apply_links(df).collect()}
    assert [got.get(i) for i in range(len(cases))] == [want for _, want in cases]


def test_addresses_of_a_page_state(spark):
    cases = [
        (r'x"applyUrl","https://f.example.org/a?utm_source=z&amp;k=1"y https://jobs.lever.co/a/123', "https://f.example.org/a?k=1"),
        (r'{\\"applyUrl\\",\\"https://f.example.org/b\\"}', "https://f.example.org/b"),
        ("see https://example.org and https://bit.ly/q1 then https://Forms.GLE/Ab?ref=x#", "https://forms.gle/Ab"),
        ("https://docs.google.com/forms/d/1?q=a%20b https://x.workable.com/", "https://docs.google.com/forms/d/1?q=a+b"),
        ("https://www.facebook.com/jobs/123 https://example.org/", None),
        (r'"https://org.example.net/careers/view/88\\" "https://other.example.net/jobs/"', "https://org.example.net/careers/view/88"),
    ]
    df = spark.createDataFrame([(i, "https://www.site.org/p", h) for i, (h, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r["url"] for r in pages.external_urls(df).collect()}
    assert [got.get(i) for i in range(len(cases))] == [want for _, want in cases]


def test_kinds_and_canonical_addresses(spark):
    kinds = {"https://jobs.au.int/x": "successfactors", "https://career5.successfactors.eu/": "successfactors", "https://a.sapsf.com/": "successfactors", "https://successfactors.example.org/": "generic-html",
             "https://www.harmeejobs.com/a": "wordpress", "https://opportunitydesk.org": "wordpress", "https://blog.example.org/wp-json/": "generic-html", "https://opportunitydesk.org.example.net/": "generic-html"}
    assert column(spark, list(kinds), urls.kind_of) == list(kinds.values())
    clean = {"HTTPS://X.Org": "https://x.org/", "https://x.org/A?gh_src=1&amp=1&UTM_x=2&b=&c=d#": "https://x.org/A?c=d", "https://x.org/?fbclid=1&reference=2#t": "https://x.org/?fbclid=1&reference=2#t"}
    assert column(spark, list(clean), urls.canonical) == list(clean.values())


def test_labels_of_the_board(spark):
    row = ("1", "undp", "UNDP", "A & B", None, None, None, True, None, 80, ["x"], "https://s/1", "ftp://x", dt.datetime(2024, 9, 3), '{"structured":{"data":{"application_email":"a@b.org","sections":[{"title":"H","paragraphs":["i",3,null],"bullets":[" "]},{"title":""}],"how_to_apply":"mail"}}}')
    df = spark.createDataFrame([row], "id string, source string, org_name string, title string, deadline timestamp, location string, stipend_text string, is_paid boolean, posted string, fit_score int, field_tags array<string>, source_url string, apply_url string, scraped_at timestamp, raw string")
    v = board.listing_view(df, "2024-09-01 00:00:00").first()
    assert (v["pay_label"], v["deadline_label"], v["location_label"], v["scraped_label"], v["apply_email"], v["how_to_apply"]) == ("Pay unclear", "Rolling", "—", "Sep 3", "a@b.org", "mail")
    assert [tuple(s) for s in v["sections"]] == [("H", ["i"], [" "])]
    t = board.apply_target(df.withColumn("apply_email", F.lit("a@b.org"))).first()
    assert tuple(t)[1:] == ("mailto:a@b.org?subject=Application%20%E2%80%94%20A%20%26%20B", "Apply by email")
    days = [dt.datetime(2024, 9, d) for d in (1, 3, 10, 20)] + [dt.datetime(2024, 8, 2), None]
    assert column(spark, days, lambda c: board.urgency(c, "2024-09-01 00:00:00"), "timestamp") == ["🔴 closes today", "🔴 2d left", "⏳ 9d left", "20 Sept 2024 · 19d left", "closed", "rolling deadline"]
    assert column(spark, ["One.  Two! Three.", "no end " * 60, None], board.first_sentences) == ["One.  Two!", ("no end " * 60)[:200], ""]


def test_content_and_chrome_of_pages():
    body = "word " * 60
    page = lambda inner: f"<html><body>{inner}</body></html>"
    assert html.densest(page(f'<div id="content"><p class="sr-only">Skip</p><a href="#main">Skip</a><p>{body}</p></div><div class="x">{body * 3}</div>')) == f"<p>{body}</p>"
    # Only the first of a kind counts.
    assert "second" not in html.densest(page(f"<article>{body}</article><article>second {body * 2}</article>"))
    assert html.densest(page(f'<div class="field-name-body">{body}</div><div class="my-sidebar-box">x</div><ul class="pager"><li>2</li></ul>')) == body
    assert "tabs" in html.densest(page(f'<div class="tabs-like">tabs {body}</div>'))


def test_every_kind_is_registered():
    import jobweave.sources.payloads  # noqa: F401
    from jobweave.sources.normalize import REGISTRY

    assert {name for name, _ in urls.KINDS} <= set(REGISTRY)


def test_report(spark):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    assert report.markdown("T", df.orderBy("n")).splitlines() == ["## T", "", "| name | n |", "| --- | --- |", "| a\\|b | 1 |", "| - | 2 |"]
    assert column(spark, [5, 75, 90, 4000, None], report.duration, "int") == ["5s", "75s", "1m 30s", "66m 40s", "unfinished"]


def test_requests_and_logs(spark):
    reqs = spark.createDataFrame([("GET", "/x", "text/html"), ("POST", "/x", "text/html"), ("GET", "/api/y", "text/html"), ("GET", None, "text/html"), ("GET", "/z", "image/png")], "method string, route string, accept string")
    assert gates.pageviews(reqs).count() == 1
    logs = spark.createDataFrame([("all fine",), ("ERROR: x",), (None,)], "value string")
    assert [r["is_error"] for r in gates.log_errors(logs).collect()] == [False, True, False]
