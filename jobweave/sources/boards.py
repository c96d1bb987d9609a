"""Boards whose list pages lead to pages of their own: cards, vacancy rows and posts, joined with what they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.text import collapse, detect_paid, extract_stipend, filled, find_deadline, html_to_text, matches, org_from_title, parse_deadline, top_meta
from jobweave.operators.gates import is_internship, is_roundup
from jobweave.operators.kept import kept
from jobweave.sources.normalize import listing
from jobweave.sources.pages import apply_links
from jobweave.sources.payloads import instant, vacancy_rows
from jobweave.sources.reading import read_pages


def _address(href: Column, base: str) -> Column:
    """A link of a board as an address."""
    return (
        F.when(href.startswith("http"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(F.concat(F.lit(f"{base}/"), href))
    )


def _first(rows: DataFrame) -> DataFrame:
    """The first row of each address, by list page and place on it."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("page_id", "pos"))).where("_n = 1").drop("_n")


def _published(html: Column) -> Column:
    return instant(filled(F.regexp_extract(html, r'"datePublished"\s*:\s*"([^"]+)"', 1)))


def _listed(lists: DataFrame, what: str, base: str, *fields: str) -> DataFrame:
    each = read_pages(lists.select("page_id", "url", "html"), what).select("page_id", F.posexplode(what).alias("pos", "c"))
    return _first(each.select("page_id", "pos", _address(F.col("c.href"), base).alias("url"), *[F.col(f"c.{f}").alias(f) for f in fields]))


def _read(asked: DataFrame, details: DataFrame, body: str) -> DataFrame:
    """The rows (url, title and others) with posted_at and the body (b) of the pages (url, html) that they lead to, internships by the
    page's title or else their own.  Pages that no row leads to are not parsed."""
    joined = asked.join(details.select("url", "html"), "url").withColumn("posted_at", _published(F.col("html")))
    rows = read_pages(joined, body).withColumnRenamed(body, "b")
    return rows.withColumn("title", F.coalesce(filled(F.col("b.title")), "title")).where(is_internship(F.col("title")))


def card_listings(lists: DataFrame, details: DataFrame, source: str = "ethiongojobs", base: str = "https://www.ethiongojobs.com") -> DataFrame:
    """Cards on list pages (page_id, url, html) with the pages they lead to (url, html): internships that are no roundups, each
    address once.  The page's title counts, else the card's; a local board, so reach isn't asked."""
    cards = _listed(lists, "cards", base, "title", "source_id", "excerpt", "classes")
    asked = cards.where((F.col("title") == "") | (is_internship(F.col("title")) & ~is_roundup(F.col("title"))))
    rows = _read(asked, details, "board_body")
    # The rows go two ways, to their links and to their fields; without this step every page would be read for each.
    rows = kept(rows.withColumn("text", html_to_text(F.col("b.html"))).withColumn("b", F.struct("b.cleaned"))).withColumn("m", top_meta(F.col("text")))
    best = apply_links(rows.select(F.col("url").alias("page_id"), "url", F.col("b.cleaned").alias("html"))).select(F.col("page_id").alias("url"), F.col("url").alias("apply_url"))
    place = F.coalesce("m.location", "m.duty_station", "m.work_location")
    remote = matches(F.lower("text"), r"\bremote\b|home-?based") | F.array_contains("classes", "category-remote-jobs") | matches(place, r"(?i)\bremote\b")
    return listing(rows.join(best, "url", "left").select(
        F.lit(source).alias("source"), F.col("url").alias("source_url"), "source_id", "apply_url", F.coalesce("m.organization", "m.department", org_from_title(F.col("title")), F.lit("Unknown")).alias("org_name"),
        "title", place.alias("location"), remote.alias("is_remote"), detect_paid(F.col("title"), F.col("text")).alias("is_paid"), extract_stipend(F.col("text")).alias("stipend_text"),
        F.coalesce(parse_deadline(F.col("m.deadline")), parse_deadline(F.col("m.closing_date")), find_deadline(F.col("text"))).alias("deadline"), "posted_at",
        F.col("b.cleaned").alias("description_html"), F.col("text").alias("description_text"), F.to_json(F.struct("excerpt", F.col("classes").alias("classList"), F.col("m").alias("meta"))).alias("raw"),
    ))


def vacancy_listings(lists: DataFrame, details: DataFrame) -> DataFrame:
    """Rows of the vacancy tables on list pages (page_id, url, html), joined with their details (items) as vacancy_rows() does."""
    rows = _listed(lists, "vacancies", "", "source_id", "home", "fields")
    field = lambda name: F.try_element_at("fields", F.lit(name))
    table = rows.select(
        "source_id", "url", field("job title").alias("title"), field("location").alias("location"), field("post level").alias("post_level"), field("apply by").alias("apply_by"),
        F.when(F.col("home"), "ETH").alias("country"),
    )
    return vacancy_rows(table.where("title <> ''"), details)


# Labels of an archive's pages.
ARCHIVE_DEADLINE = r"(?i)(?:Deadline|Closing Date|Apply by|Applications? due)[^A-Za-z0-9]+([A-Za-z]+ \d{1,2},?\s*\d{4}|\d{1,2}\s+[A-Za-z]+\s+\d{4})"
ARCHIVE_PLACE = r"(?i)\bLocation\s*:\s*([^\n.;]{2,80})"


def archive_listings(lists: DataFrame, details: DataFrame, base: str = "https://ethdefenders.org", org_name: str = "Ethiopian Human Rights Defenders Center", org_slug: str = "ehrdc") -> DataFrame:
    """Posts that an archive's pages (page_id, url, html) link, with the pages (url, html): those whose title names an internship."""
    links = _listed(lists, "posts", base, "title").where(is_internship(F.col("title")))
    rows = _read(links, details, "post_body").withColumn("text", F.col("b.text"))
    low, number = F.lower("text"), F.regexp_extract("url", r"[?&]p=(\d+)", 1)
    place = filled(F.regexp_replace(collapse(F.regexp_extract(F.substring("text", 1, 600), ARCHIVE_PLACE, 1)), r"[.;]+$", ""))
    return listing(rows.select(
        F.lit(org_slug).alias("source"), F.col("url").alias("source_url"), F.coalesce(filled(number), filled(F.regexp_extract("url", r"/(\d+)/?$", 1))).alias("source_id"), F.lit(org_name).alias("org_name"),
        F.lit(org_slug).alias("org_slug"), "title", F.coalesce(place, F.lit("Addis Ababa, Ethiopia")).alias("location"), matches(low, r"\bremote\b|home-?based").alias("is_remote"),
        F.when(matches(low, r"\bunpaid\b"), False).when(matches(low, r"\bpaid\b|\bstipend\b|\bmonthly\s+allowance\b"), True).alias("is_paid"),
        filled(collapse(F.regexp_extract("text", r"(?i)(?:stipend|allowance|salary)[^.\n]{0,120}", 0))).alias("stipend_text"), parse_deadline(filled(F.regexp_extract("text", ARCHIVE_DEADLINE, 1))).alias("deadline"),
        "posted_at", F.col("b.cleaned").alias("description_html"), F.col("text").alias("description_text"), F.lit("{}").alias("raw"),
    ))
