"""Landed payload files of each kind of source as listings.

Every normaliser takes DataFrames with the schema given beside it (read() loads one file per
organisation and never infers) and the organisation's columns org_slug and org_name, which
may be null, and returns the common record.  Rows that no student in the home country can
take, and titles that are no internship, are left out; what can be told from a search row is
filtered before its detail document is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobweave.functions import urls
from jobweave.functions.text import (
    collapse, decode_entities, detect_paid, extract_stipend, filled, find_deadline, html_to_text, matches, org_from_title, parse_deadline, top_meta,
)
from jobweave.operators.gates import access_decision, is_internship, is_roundup
from jobweave.sources.normalize import listing, register
from jobweave.sources.reading import read_pages


#: Fields of each payload that are read; others are not loaded.
SCHEMAS: dict[str, str] = {
    "greenhouse": ("jobs array<struct<id bigint, title string, absolute_url string, content string, updated_at string, location struct<name string>>>"),
    "lever": (
        "id string, text string, hostedUrl string, applyUrl string, createdAt bigint, description string, categories struct<location string, commitment string, team string>, lists array<struct<text string, content string>>"
    ),
    "workday_search": ("jobPostings array<struct<title string, externalPath string, locationsText string, postedOn string>>"),
    "workday_detail": ("jobPostingInfo struct<id string, jobReqId string, externalUrl string, externalPath string, jobDescription string, location string, additionalLocations array<string>>"),
    "smartrecruiters_search": ("content array<struct<id string, name string, releasedDate string, location struct<city string, country string, remote boolean>>>"),
    "smartrecruiters_detail": (
        "id string, postingUrl string, applyUrl string, releasedDate string, location struct<city string, country string, remote boolean>, jobAd struct<sections map<string, struct<title string, text string>>>"
    ),
    "reliefweb": (
        "data array<struct<id string, fields struct<title string, url string, body string, `body-html` string, source array<struct<name string>>, city array<struct<name string>>, country array<struct<name string>>, date struct<closing string, created string>>>>"
    ),
    "idealist": (
        "hits array<struct<objectID string, type string, name string, orgName string, url struct<en string>, description string, remoteOk boolean, remoteCountry string, country string, city string, detailsStipendProvided boolean>>"
    ),
    "inspira": (
        "data array<struct<jobId bigint, postingTitle string, jobTitle string, categoryCode string, dept string, dutyStation array<struct<description string>>, jobDescription string, startDate string, endDate string>>"
    ),
    "oracle_search": ("items array<struct<requisitionList array<struct<Id string, Title string>>>>"),
    "oracle_detail": ("items array<struct<Id string, Title string, ExternalDescriptionStr string, PrimaryLocation string, ExternalPostedStartDate string, ExternalPostedEndDate string>>"),
    "successfactors": ("title string, link string, description string, pubDate string"),
    "wordpress": ("id bigint, link string, date string, title struct<rendered string>, content struct<rendered string>"),
}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Payload files of a kind, one JSON document (or array) a file; items of an RSS feed for successfactors."""
    if kind == "successfactors":
        return spark.read.format("xml").option("rowTag", "item").schema(SCHEMAS[kind]).load(path)
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(SCHEMAS[kind]).json(path)


# Words about pay in the payloads of one kind each.
NO_PAY = r"\bunpaid\b|not remunerated"
PAY_RULES = {
    "greenhouse": (NO_PAY, r"\bstipend\b|\bpaid internship\b|\bhourly rate\b|\$\d"),
    "reliefweb": (r"\bunpaid\b|not remunerated|no remuneration|voluntary basis", r"\bstipend\b|\bpaid internship\b|\bmonthly allowance\b"),
    "oracle": (r"\bunpaid\b|gratis personnel|not remunerated", r"\bstipend\b|\bpaid\b|\bmonthly allowance\b"),
    "default": (NO_PAY, r"\bstipend\b|\bpaid\b|\bmonthly allowance\b"),
}


def paid_by_rule(kind: str, text: Column) -> Column:
    no, yes = PAY_RULES.get(kind, PAY_RULES["default"])
    low = F.lower(text)
    return F.when(matches(low, no), False).when(matches(low, yes), True)


def pay_phrase(text: Column) -> Column:
    """What a text says about pay, up to 160 characters."""
    return filled(collapse(F.regexp_extract(text, r"(?i)((?:stipend|allowance|compensation|hourly rate)[^.\n]{0,160})", 1)))


def instant(c: Column) -> Column:
    """An ISO date or time, or the date of a feed, as an instant; null for anything else."""
    feed = filled(F.regexp_extract(c, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})", 1))
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(feed, F.lit("d MMM yyyy HH:mm:ss Z")))


def _remote(*parts: Column) -> Column:
    return matches(F.lower(F.concat_ws("\n", *parts)), r"\bremote\b|home-?based")


def _with_org(df: DataFrame) -> DataFrame:
    for c in ("org_slug", "org_name"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row: a filter on them is not put in front of what makes them, where it would work them out again."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_once")).select(*[F.col(c) for c in df.columns], "_once.*")


def _reachable(df: DataFrame) -> DataFrame:
    return df.where(access_decision(F.col("location"), F.col("title"), F.col("description_text"))["accessible"])


def _record(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """Adds columns, then what follows from title, text and place, and keeps reachable rows."""
    out = df.select("*", *[c.alias(k) for k, c in columns.items()])
    derived = {
        "is_remote": _remote(F.col("title"), F.col("location"), F.col("description_text")), "is_paid": paid_by_rule(kind, F.concat_ws("\n", "title", "description_text")),
        "stipend_text": pay_phrase(F.col("description_text")),
    }
    for name, c in derived.items():
        if name not in columns:
            out = out.withColumn(name, c)
    return listing(_reachable(out))


@register("greenhouse", lambda url: urls.kind_of(url) == "greenhouse")
def greenhouse(boards: DataFrame) -> DataFrame:
    jobs = _with_org(boards).select("org_slug", F.col("org_name").alias("_org"), F.explode("jobs").alias("j")).where(is_internship(F.col("j.title")))
    html = decode_entities(F.col("j.content"))
    return _record(
        jobs, "greenhouse", source=F.concat(F.lit("greenhouse:"), F.coalesce("org_slug", F.lower(F.regexp_extract("j.absolute_url", r"greenhouse\.io/([^/]+)", 1)))), source_url=F.col("j.absolute_url"),
        source_id=F.col("j.id").cast("string"), org_name=F.col("_org"), title=collapse(F.col("j.title")), location=filled(collapse(F.col("j.location.name"))), description_html=html,
        description_text=html_to_text(html), posted_at=instant(F.col("j.updated_at")),
    )


@register("lever", lambda url: urls.kind_of(url) == "lever")
def lever(postings: DataFrame) -> DataFrame:
    rows = _with_org(postings).withColumnRenamed("org_name", "_org").where(is_internship(F.col("text")) | matches(F.col("categories.commitment"), "(?i)intern"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    lists = F.array_join(F.transform("lists", lambda x: F.concat(F.lit("<h3>"), blank(x["text"]), F.lit("</h3><ul>"), blank(x["content"]), F.lit("</ul>"))), "")
    html = F.concat(blank(F.col("description")), blank(lists))
    slug = F.lower(F.regexp_extract("hostedUrl", r"lever\.co/([A-Za-z0-9_-]+)", 1))
    return _record(
        rows, "lever", source=F.concat(F.lit("lever:"), F.coalesce("org_slug", slug)), source_url=F.col("hostedUrl"), source_id=F.col("id"),
        org_name=F.coalesce("_org", slug), title=collapse(F.col("text")), location=filled(collapse(F.col("categories.location"))), description_html=html,
        description_text=html_to_text(html), posted_at=F.timestamp_millis("createdAt"),
    )


@register("workday", lambda url: urls.kind_of(url) == "workday")
def workday(search: DataFrame, details: DataFrame, origin: str, site: str) -> DataFrame:
    """Search rows joined with their detail documents on the external path."""
    rows = _with_org(search).select("org_slug", F.col("org_name").alias("_org"), F.explode("jobPostings").alias("p"))
    place = filled(collapse(F.col("p.locationsText")))
    cheap = place.isNull() | access_decision(place, F.col("p.title"), F.lit(""))["accessible"]
    rows = rows.where(is_internship(F.col("p.title")) & F.col("p.externalPath").isNotNull() & cheap).withColumn("row_place", place).withColumn("path", F.col("p.externalPath"))
    joined = rows.join(details.select(F.col("jobPostingInfo.externalPath").alias("path"), F.col("jobPostingInfo").alias("d")), "path")
    every = F.concat_ws(", ", filled(F.col("d.location")), F.filter(F.coalesce("d.additionalLocations", F.array().cast("array<string>")), lambda x: x != ""))
    return _record(
        joined, "workday", source=F.concat(F.lit("workday:"), F.coalesce("org_slug", F.lit(site))), source_url=F.coalesce("d.externalUrl", F.concat(F.lit(f"{origin}/{site}"), F.col("path"))),
        source_id=F.coalesce("d.jobReqId", "d.id", "path"), org_name=F.col("_org"), title=collapse(F.col("p.title")), location=F.coalesce(filled(collapse(every)), F.col("row_place")),
        description_html=F.col("d.jobDescription"), description_text=html_to_text(F.coalesce("d.jobDescription", F.lit(""))),
    )


def _place(location: str) -> Column:
    parts = F.array(filled(collapse(F.col(f"{location}.city"))), filled(collapse(F.col(f"{location}.country"))), F.when(F.col(f"{location}.remote"), F.lit("Remote")))
    return filled(F.array_join(F.array_compact(parts), ", "))


@register("smartrecruiters", lambda url: urls.kind_of(url) == "smartrecruiters")
def smartrecruiters(search: DataFrame, details: DataFrame, company: str) -> DataFrame:
    rows = _with_org(search).select("org_slug", F.col("org_name").alias("_org"), F.explode("content").alias("p")).withColumn("row_place", _place("p.location"))
    cheap = F.col("row_place").isNull() | F.coalesce("p.location.remote", F.lit(False)) | access_decision(F.col("row_place"), F.col("p.name"), F.lit(""))["accessible"]
    joined = rows.where(is_internship(F.col("p.name")) & cheap).withColumn("id", F.col("p.id")).join(details.select("id", F.struct(*[c for c in details.columns if c != "id"]).alias("d")), "id")
    parts = F.transform(F.map_values("d.jobAd.sections"), lambda s: F.concat(F.coalesce(F.concat(F.lit("<h3>"), s["title"], F.lit("</h3>")), F.lit("")), F.coalesce(s["text"], F.lit(""))))
    html = F.coalesce(F.array_join(parts, ""), F.lit(""))
    place = F.coalesce(_place("d.location"), F.col("row_place"))
    return _record(
        joined, "smartrecruiters", source=F.concat(F.lit("smartrecruiters:"), F.coalesce("org_slug", F.lit(company.lower()))), source_id=F.col("id"), apply_url=F.col("d.applyUrl"),
        source_url=F.coalesce("d.postingUrl", F.concat(F.lit(f"https://jobs.smartrecruiters.com/{company}/"), F.col("id"))), org_name=F.coalesce("_org", F.lit(company)), title=collapse(F.col("p.name")),
        location=place, description_html=html, description_text=html_to_text(html), posted_at=instant(F.coalesce("d.releasedDate", "p.releasedDate")),
    )


@register("reliefweb", lambda url: urls.kind_of(url) == "reliefweb")
def reliefweb(feed: DataFrame) -> DataFrame:
    rows = feed.select(F.explode("data").alias("r")).select("r.id", "r.fields.*")
    names = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<name string>>")), lambda x: collapse(x["name"])), lambda x: x != "")
    html = F.coalesce("body-html", F.concat(F.lit("<p>"), F.col("body"), F.lit("</p>")), F.lit(""))
    kept = rows.where(is_internship(F.col("title")))
    return _record(
        kept.withColumnRenamed("source", "_source").withColumnRenamed("title", "_title"), "reliefweb", source=F.lit("reliefweb"), source_url=F.coalesce("url", F.concat(F.lit("https://reliefweb.int/job/"), F.col("id"))), source_id=F.col("id"),
        org_name=F.coalesce(filled(collapse(F.get(F.col("_source"), 0)["name"])), F.lit("Unknown")), title=collapse(F.col("_title")),
        location=filled(F.array_join(F.concat(names(F.col("city")), names(F.col("country"))), ", ")), description_html=html, description_text=html_to_text(html),
        deadline=instant(F.col("date.closing")), posted_at=instant(F.col("date.created")),
    )


@register("idealist", lambda url: urls.kind_of(url) == "idealist")
def idealist(search: DataFrame) -> DataFrame:
    """Hits that are internships, remote for the whole world or in the home country, with some text."""
    hits = search.select(F.explode("hits").alias("h")).select("h.*").where("type = 'INTERNSHIP'")
    world = F.coalesce("remoteOk", F.lit(False)) & (F.col("remoteCountry").isNull() | (F.col("remoteCountry") == "ET"))
    text = html_to_text(F.coalesce("description", F.lit("")))
    rows = _once(hits.where(world | (F.col("country") == "ET")), _text=text).where(F.length("_text") >= 80)
    place = F.when(world, "Remote").otherwise(F.concat_ws(", ", filled(F.col("city")), F.lit("Ethiopia")))
    name = collapse(F.col("name"))
    return listing(rows.select(
        F.lit("idealist").alias("source"), F.when(F.col("url.en").startswith("/"), F.concat(F.lit("https://www.idealist.org"), F.col("url.en"))).otherwise(F.col("url.en")).alias("source_url"),
        F.col("objectID").alias("source_id"), F.coalesce(filled(collapse(F.col("orgName"))), F.lit("Idealist")).alias("org_name"), name.alias("title"), place.alias("location"), world.alias("is_remote"),
        F.when(F.col("detailsStipendProvided"), True).otherwise(detect_paid(name, F.col("_text"))).alias("is_paid"), extract_stipend(F.col("_text")).alias("stipend_text"),
        find_deadline(F.col("_text")).alias("deadline"), F.col("description").alias("description_html"), F.col("_text").alias("description_text"),
    ))


@register("inspira", lambda url: urls.kind_of(url) == "inspira")
def inspira(rows: DataFrame, departments: Sequence[tuple[str | None, str | None, str | None]]) -> DataFrame:
    """Openings of the internship category for each organisation whose department rule they meet; only the duty
    station decides who can take them.  ``departments``: slug, name and pattern (None for all) of each organisation;
    one scan serves them all."""
    openings = rows.select(F.explode("data").alias("r")).select("r.*").where("categoryCode = 'INT'")
    text_type = "string"
    met = [
        F.when(F.lit(True) if regex is None else matches(F.col("dept"), regex), F.struct(F.lit(slug).cast(text_type).alias("org_slug"), F.lit(name).cast(text_type).alias("org_name")))
        for slug, name, regex in departments
    ]
    ruled = openings.withColumn("_rule", F.explode(F.array_compact(F.array(*met)))).select("*", "_rule.*")
    place = F.array_join(F.filter(F.transform("dutyStation", lambda s: collapse(s["description"])), lambda x: x != ""), ", ")
    title = collapse(F.coalesce(filled(F.col("postingTitle")), F.col("jobTitle")))
    near = access_decision(place, title, F.lit(""))["accessible"] | matches(place, r"(?i)\bremote\b|home[-\s]?based|virtual|telecommut")
    text = html_to_text(F.coalesce("jobDescription", F.lit("")))
    return listing(ruled.where(near).select(
        F.lit("un-careers").alias("source"), F.concat(F.lit("https://careers.un.org/jobSearchDescription/"), F.col("jobId").cast("string")).alias("source_url"), F.col("jobId").cast("string").alias("source_id"),
        F.coalesce("org_name", F.lit("United Nations Careers")).alias("org_name"), F.coalesce("org_slug", F.lit("un-careers")).alias("org_slug"), title.alias("title"), filled(place).alias("location"),
        _remote(title, text).alias("is_remote"), paid_by_rule("inspira", F.concat_ws("\n", title, text)).alias("is_paid"), pay_phrase(text).alias("stipend_text"), instant(F.col("endDate")).alias("deadline"),
        instant(F.col("startDate")).alias("posted_at"), F.col("jobDescription").alias("description_html"), text.alias("description_text"),
    ))


@register("oracle-hcm", lambda url: urls.kind_of(url) == "oracle-hcm")
def oracle_hcm(search: DataFrame, details: DataFrame, origin: str, site: str) -> DataFrame:
    rows = _with_org(search).select("org_slug", F.col("org_name").alias("_org"), F.explode("items").alias("i")).select("org_slug", "_org", F.explode("i.requisitionList").alias("q")).where(is_internship(F.col("q.Title")))
    docs = details.select(F.explode("items").alias("d")).withColumn("id", F.col("d.Id"))
    joined = rows.withColumn("id", F.col("q.Id")).join(docs, "id")
    html = F.coalesce("d.ExternalDescriptionStr", F.lit(""))
    host = urls.host(F.lit(origin))
    return _record(
        joined, "oracle", source=F.concat(F.lit("oracle-hcm:"), F.coalesce("org_slug", host)), source_url=F.concat(F.lit(f"{origin}/hcmUI/CandidateExperience/en/sites/{site}/job/"), F.col("id")), source_id=F.col("id"),
        org_name=F.coalesce("_org", F.lit("Unknown")), title=collapse(F.col("d.Title")), location=F.col("d.PrimaryLocation"), description_html=html, description_text=html_to_text(html),
        deadline=instant(F.col("d.ExternalPostedEndDate")), posted_at=instant(F.col("d.ExternalPostedStartDate")),
    )


@register("successfactors", lambda url: urls.kind_of(url) == "successfactors")
def successfactors(items: DataFrame, origin: str) -> DataFrame:
    """Items of a feed: the title ends with the duty station in brackets."""
    text = html_to_text(F.coalesce("description", F.lit("")))
    told = _once(_with_org(items).withColumnRenamed("org_name", "_org"), _raw=collapse(F.col("title"))).drop("title").where(is_internship(F.col("_raw")))
    rows = _once(told, _text=text).where(F.length("_text") >= 80)
    title = F.coalesce(filled(collapse(F.regexp_replace("_raw", r"\s*\([^)]*\)\s*$", ""))), F.col("_raw"))
    url = F.regexp_replace("link", r"[?#].*$", "")
    return _record(
        rows, "successfactors", source=F.concat(F.lit("successfactors:"), urls.host(F.lit(origin))), source_url=url, source_id=filled(F.regexp_extract(url, r"/job/[^/]*/(\d+)", 1)),
        org_name=F.coalesce("_org", urls.host(F.lit(origin))), title=title, location=filled(F.trim(F.regexp_extract("_raw", r"\(([^)]+)\)\s*$", 1))), description_html=F.col("description"),
        description_text=F.col("_text"), deadline=find_deadline(F.col("_text")), posted_at=instant(F.col("pubDate")), is_paid=detect_paid(title, F.col("_text")), stipend_text=extract_stipend(F.col("_text")),
    )


@register("wordpress", lambda url: urls.kind_of(url) == "wordpress")
def wordpress(posts: DataFrame) -> DataFrame:
    """Posts whose title names an internship, without numbered roundups; blocks that link or share other posts are no part of the text."""
    title = collapse(decode_entities(F.col("title.rendered")))
    rows = _with_org(posts).withColumnRenamed("org_name", "_org").withColumn("_title", title).drop("title").where(is_internship(F.col("_title")) & ~matches(F.col("_title"), r"^\d+\+?\s") & F.col("link").isNotNull())
    read = read_pages(rows.select("id", "date", "_org", "_title", F.col("link").alias("url"), F.coalesce("content.rendered", F.lit("")).alias("html")), "blog")
    rows = _once(read.withColumn("_text", F.col("blog.text")).where("_text <> ''"), m=top_meta(F.col("_text")))
    place = F.coalesce("m.location", "m.duty_station", "m.work_location")
    return _record(
        rows, "wordpress", source=F.concat(F.lit("wordpress:"), urls.host(F.col("url"))), source_url=F.col("url"), source_id=F.col("id").cast("string"),
        org_name=F.coalesce("m.organization", org_from_title(F.col("_title")), "_org", F.lit("Unknown")), title=F.col("_title"), location=place,
        is_remote=matches(F.lower("_text"), r"\bremote\b|home-?based") | matches(place, r"(?i)remote"),
        description_html=F.col("blog.cleaned"), description_text=F.col("_text"), deadline=F.coalesce(parse_deadline(F.col("m.deadline")), parse_deadline(F.col("m.closing_date")), find_deadline(F.col("_text"))),
        posted_at=instant(F.col("date")), is_paid=detect_paid(F.col("_title"), F.col("_text")), stipend_text=extract_stipend(F.col("_text")),
    )


@register("ethiongojobs", lambda url: urls.host(url).rlike(r"(^|\.)ethiongojobs\.com$"))
def board_cards(cards: DataFrame, details: DataFrame, source: str) -> DataFrame:
    """Cards of a board (url, title, source_id, pos) joined with their pages (url, html): the first card of an address, no roundups; a local board, so reach isn't asked."""
    first = F.row_number().over(Window.partitionBy("url").orderBy("pos"))
    kept = cards.withColumn("_n", first).where((F.col("_n") == 1) & (is_internship(F.col("title")) & ~is_roundup(F.col("title")))).join(details.select("url", "html"), "url")
    text = html_to_text(F.col("html"))
    rows = kept.withColumn("_text", text).withColumn("m", top_meta(F.col("_text")))
    place = F.coalesce("m.location", "m.duty_station", "m.work_location")
    return listing(rows.select(
        F.lit(source).alias("source"), F.col("url").alias("source_url"), "source_id", F.coalesce("m.organization", "m.department", org_from_title(F.col("title")), F.lit("Unknown")).alias("org_name"), "title",
        place.alias("location"), (_remote(F.col("_text")) | matches(place, r"(?i)\bremote\b")).alias("is_remote"), detect_paid(F.col("title"), F.col("_text")).alias("is_paid"), extract_stipend(F.col("_text")).alias("stipend_text"),
        F.coalesce(parse_deadline(F.col("m.deadline")), parse_deadline(F.col("m.closing_date")), find_deadline(F.col("_text"))).alias("deadline"), F.col("html").alias("description_html"), F.col("_text").alias("description_text"),
    ))


def vacancy_rows(rows: DataFrame, details: DataFrame, source: str = "undp") -> DataFrame:
    """Rows of a vacancy table (source_id, url, title, location, post_level, apply_by, country) joined with details (items):
    in the home country, and an internship by title or by grade ``IN``; apply-by dates come as Mon-DD-YY."""
    home = (F.col("country") == "ETH") | matches(F.col("location"), r"(?i)\bethiopia\b")
    kept = rows.where(home & (is_internship(F.col("title")) | (F.col("post_level") == "IN"))).join(details.select(F.explode("items").alias("d")).withColumn("source_id", F.col("d.Id")), "source_id")
    part = lambda i: F.regexp_extract("apply_by", r"^\s*([A-Za-z]{3})-(\d{1,2})-(\d{2})\s*$", i)
    by = parse_deadline(F.concat(part(1), F.lit(" "), part(2), F.lit(", 20"), part(3)))
    text = html_to_text(F.coalesce("d.ExternalDescriptionStr", F.lit("")))
    named = kept.select(
        "source_id", F.lit(source).alias("source"), F.col("url").alias("source_url"), F.coalesce(filled(collapse(F.col("d.Title"))), F.col("title")).alias("title"), F.coalesce("d.PrimaryLocation", "location").alias("location"),
        F.coalesce(instant(F.col("d.ExternalPostedEndDate")), by).alias("deadline"), instant(F.col("d.ExternalPostedStartDate")).alias("posted_at"), F.col("d.ExternalDescriptionStr").alias("description_html"), text.alias("description_text"),
    )
    return listing(named.select(
        "*", F.lit("United Nations Development Programme (UNDP)").alias("org_name"), F.lit(source).alias("org_slug"), _remote(F.col("title"), F.col("description_text")).alias("is_remote"),
        paid_by_rule("oracle", F.concat_ws("\n", "title", "description_text")).alias("is_paid"), pay_phrase(F.col("description_text")).alias("stipend_text"),
    ))

