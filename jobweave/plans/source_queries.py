"""Payload sources, request logs and messages, over payloads that Spark builds from the postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions import patterns as P
from jobweave.operators import board, gates
from jobweave.plans.board_queries import AS_OF, LIVE, NOW, SAVES, URGENCY, _saves
from jobweave.plans.registry import query
from jobweave.plans.tables import base, load, oracle
from jobweave.plans.text_queries import ACCESS, collapsed, hits
from jobweave.sources import boards, payloads
from jobweave.streaming import jobs

GATE = f"({hits(collapsed('title'), P.INTERN)} AND NOT {hits(collapsed('title'), P.STAFF)})"


def _batched(rows: DataFrame, name: str, item) -> DataFrame:
    """Rows as documents of up to 40 items each, as a search endpoint gives them: neighbours by id, whose table is seven times as long."""
    return rows.groupBy(F.floor(F.col("id") / 280).alias("batch")).agg(F.collect_list(item).alias(name)).drop("batch")


def _postings(spark, sf_dir, k: int) -> DataFrame:
    return load(spark, sf_dir, "postings").where(F.col("id") % 7 == k).withColumn("sid", F.col("id").cast("string"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("source", "source_id", "title", "location")


@query("payload_feeds", oracle(f"""
WITH {ACCESS}, s AS (SELECT id, CAST(id AS VARCHAR) AS sid, {collapsed('title')} AS title, nullif(loc, '') AS loc, accessible, {GATE} AS gate, text,
  {hits(collapsed('location'), P.HOME_COUNTRY)} OR {hits('title', P.HOME_COUNTRY)} OR ({hits(collapsed('location'), P.REMOTE_WORD)} AND NOT {hits(collapsed('location'), P.REMOTE_GEOGRAPHY)}) AS row_ok FROM a)
SELECT 'greenhouse:acme' AS source, sid AS source_id, title, loc AS location FROM s WHERE id % 7 = 0 AND gate AND accessible
UNION ALL SELECT 'lever:acme', sid, title, loc FROM s WHERE id % 7 = 1 AND (gate OR id % 3 = 0) AND accessible
UNION ALL SELECT 'reliefweb', sid, title, concat_ws(', ', loc, 'Kenya') FROM s WHERE id % 7 = 2 AND gate AND accessible
UNION ALL SELECT 'workday:Ext', sid, title, loc FROM s WHERE id % 7 = 3 AND gate AND (loc IS NULL OR row_ok) AND id % 5 <> 0 AND accessible
UNION ALL SELECT 'smartrecruiters:acme', sid, title, loc FROM s WHERE id % 7 = 4 AND gate AND (loc IS NULL OR row_ok) AND accessible
UNION ALL SELECT 'oracle-hcm:x.oraclecloud.com', sid, title, loc FROM s WHERE id % 7 = 5 AND gate AND accessible
UNION ALL SELECT 'un-careers', sid, title, loc FROM s WHERE id % 7 = 6 AND id % 2 = 0 AND (row_ok OR regexp_matches(coalesce(loc, ''), '(?i)\\bremote\\b|home[-\\s]?based|virtual|telecommut'))""", "postings"))  # fmt: skip
def payload_feeds(spark, sf_dir):
    p = [_postings(spark, sf_dir, k) for k in range(7)]
    text, place = F.col("text"), F.col("location")
    greenhouse = payloads.greenhouse(_batched(p[0], "jobs", F.struct("id", "title", F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"), "sid").alias("absolute_url"), text.alias("content"), F.lit(None).cast("string").alias("updated_at"), F.struct(place.alias("name")).alias("location"))))
    commitment = F.when(F.col("id") % 3 == 0, "Internship").otherwise("Full time")
    lever = payloads.lever(p[1].select(
        F.col("sid").alias("id"), F.col("title").alias("text"), F.concat(F.lit("https://jobs.lever.co/acme/"), "sid").alias("hostedUrl"), F.lit(0).cast("bigint").alias("createdAt"), text.alias("description"),
        F.struct(place.alias("location"), commitment.alias("commitment")).alias("categories"), F.array().cast("array<struct<text string, content string>>").alias("lists"),
    ))
    named = lambda c: F.array(F.struct(c.alias("name")))
    fields = F.struct(
        "title", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("body"), text.alias("body-html"), named(F.lit("NRC")).alias("source"), named(place).alias("city"), named(F.lit("Kenya")).alias("country"),
        F.struct(F.lit(None).cast("string").alias("closing"), F.lit(None).cast("string").alias("created")).alias("date"),
    )
    reliefweb = payloads.reliefweb(_batched(p[2], "data", F.struct(F.col("sid").alias("id"), fields.alias("fields"))))
    path = F.concat(F.lit("/j/"), "sid")
    search = _batched(p[3], "jobPostings", F.struct("title", path.alias("externalPath"), place.alias("locationsText"), F.lit(None).cast("string").alias("postedOn")))
    none = F.lit(None).cast("string")
    detail = p[3].where("id % 5 <> 0").select(F.struct(F.col("sid").alias("id"), none.alias("jobReqId"), none.alias("externalUrl"), path.alias("externalPath"), text.alias("jobDescription"), place.alias("location"), F.array().cast("array<string>").alias("additionalLocations")).alias("jobPostingInfo"))
    workday = payloads.workday(search, detail, "https://acme.wd1.myworkdayjobs.com", "Ext")
    where = F.struct(place.alias("city"), none.alias("country"), F.lit(False).alias("remote"))
    offers = _batched(p[4], "content", F.struct(F.col("sid").alias("id"), F.col("title").alias("name"), none.alias("releasedDate"), where.alias("location")))
    section = F.create_map(F.lit("jobDescription"), F.struct(F.lit("About").alias("title"), text.alias("text")))
    detail = p[4].select(F.col("sid").alias("id"), none.alias("applyUrl"), none.alias("postingUrl"), none.alias("releasedDate"), where.alias("location"), F.struct(section.alias("sections")).alias("jobAd"))
    smartrecruiters = payloads.smartrecruiters(offers, detail, "acme")
    found = _batched(p[5], "requisitionList", F.struct(F.col("sid").alias("Id"), F.col("title").alias("Title"))).select(F.array(F.struct("requisitionList")).alias("items"))
    item = F.struct(F.col("sid").alias("Id"), F.col("title").alias("Title"), text.alias("ExternalDescriptionStr"), F.when(place != "", place).alias("PrimaryLocation"), none.alias("ExternalPostedStartDate"), none.alias("ExternalPostedEndDate"))
    oracle_hcm = payloads.oracle_hcm(found, p[5].select(F.array(item).alias("items")), "https://x.oraclecloud.com", "CX_1")
    opening = F.struct(
        F.col("id").alias("jobId"), F.col("title").alias("postingTitle"), none.alias("jobTitle"), F.when(F.col("id") % 2 == 0, "INT").otherwise("P").alias("categoryCode"), F.lit("ECA").alias("dept"),
        F.array(F.struct(place.alias("description"))).alias("dutyStation"), text.alias("jobDescription"), none.alias("startDate"), none.alias("endDate"),
    )
    inspira = payloads.inspira(_batched(p[6], "data", opening), [(None, None, None)])
    return reduce(DataFrame.unionByName, map(_shown, (greenhouse, lever, reliefweb, workday, smartrecruiters, oracle_hcm, inspira)))


_INTERN = lambda title: f"({hits(title, P.INTERN)} AND NOT {hits(title, P.STAFF)})"


@query("payload_feeds_more", oracle(f"""
WITH s AS (SELECT id, CAST(id AS VARCHAR) AS sid, {collapsed('title')} AS title, concat({collapsed('title')}, CASE WHEN id % 2 = 0 THEN ' (Addis Ababa, Ethiopia)' ELSE ' (Rome, Italy)' END) AS told FROM postings)
SELECT 'idealist' AS source, sid AS source_id, title, CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN 'Remote' ELSE 'Adama, Ethiopia' END AS location, CASE WHEN id % 13 = 0 THEN 'Idealist' ELSE 'Org' END AS org_name
  FROM s WHERE id % 3 = 0 AND id % 5 <> 0 AND id % 11 <> 0 AND ((id % 2 = 0 AND id % 4 <> 0) OR id % 7 = 0)
UNION ALL SELECT 'successfactors:jobs.au.int', sid, title, 'Addis Ababa, Ethiopia', 'jobs.au.int' FROM s WHERE id % 3 = 1 AND id % 2 = 0 AND id % 11 <> 0 AND {_INTERN('told')}
UNION ALL SELECT 'wordpress:blog.example.org', sid, title, 'Addis Ababa', 'Org ' || id % 9 FROM s WHERE id % 3 = 2 AND id % 2 = 0 AND {_INTERN('title')} AND NOT regexp_matches(title, '^[0-9]+\\+?\\s')""", "postings"))  # fmt: skip
def payload_feeds_more(spark, sf_dir):
    """Hits of a search index, items of a feed and posts of a blog."""
    k, sid, none = F.col("id"), F.col("sid"), F.lit(None).cast("string")
    rows = load(spark, sf_dir, "postings").withColumn("sid", k.cast("string"))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    body = F.when(k % 11 == 0, "<p>Too short</p>").otherwise("<p>" + "The team works on water and health with partners. " * 3 + "</p>")
    world = (k % 2 == 0) & (k % 4 != 0)
    hit = F.struct(
        sid.alias("objectID"), F.when(k % 5 == 0, "JOB").otherwise("INTERNSHIP").alias("type"), F.col("title").alias("name"), F.when(k % 13 == 0, " ").otherwise("Org").alias("orgName"),
        F.struct(say("/en/", sid).alias("en")).alias("url"), body.alias("description"), (k % 2 == 0).alias("remoteOk"), F.when((k % 2 == 0) & ~world, "US").alias("remoteCountry"),
        F.when(k % 7 == 0, "ET").otherwise("IT").alias("country"), F.lit("Adama").alias("city"), F.lit(False).alias("detailsStipendProvided"),
    )
    search = payloads.idealist(_batched(rows.where(k % 3 == 0), "hits", hit))
    told = F.concat("title", F.when(k % 2 == 0, " (Addis Ababa, Ethiopia)").otherwise(" (Rome, Italy)"))
    feed = payloads.successfactors(rows.where(k % 3 == 1).select(told.alias("title"), say("https://jobs.au.int/job/x/", sid, "/?feed=1").alias("link"), body.alias("description"), none.alias("pubDate")), "https://www.jobs.au.int")
    content = say("<p>Location: ", F.when(k % 2 == 0, "Addis Ababa").otherwise("Rome"), "</p>\n<p>Organization: Org ", (k % 9).cast("string"), "</p>\n<div class='widget'>Location: Jimma</div><p>Deadline: May 4, 2026</p>")
    posts = rows.where(k % 3 == 2).select("id", say("https://blog.example.org/?p=", sid).alias("link"), none.alias("date"), F.struct(F.replace("title", F.lit("&"), F.lit("&amp;")).alias("rendered")).alias("title"), F.struct(content.alias("rendered")).alias("content"))
    blog = payloads.wordpress(posts)
    return reduce(DataFrame.unionByName, [df.select("source", "source_id", "title", "location", "org_name") for df in (search, feed, blog)])


BOARD, ARCHIVE = "https://www.ethiongojobs.com", "https://ethdefenders.org"


@query("board_pages", oracle(f"""
WITH s AS (SELECT id, CAST(id AS VARCHAR) AS sid, {collapsed('title')} AS title, {GATE} AS gate, {hits(collapsed('title'), P.ROUNDUP)} AS many FROM postings)
SELECT 'ethiongojobs' AS source, '{BOARD}/post/' || sid AS source_url, sid AS source_id, title, 'Org ' || id % 9 AS org_name, CASE WHEN id % 4 = 0 THEN 'Addis Ababa' END AS location,
  id % 5 = 0 AS is_remote, CASE WHEN id % 2 = 0 THEN 'https://forms.gle/' || sid END AS apply_url, '2025-03-01' AS posted FROM s WHERE id % 3 = 0 AND gate AND NOT many
UNION ALL SELECT 'undp', 'https://jobs.example.org/job/' || sid, sid, title, 'United Nations Development Programme (UNDP)', CASE WHEN id % 2 = 0 THEN 'Addis Ababa, Ethiopia' ELSE 'Home office' END, false, NULL, NULL
  FROM s WHERE id % 3 = 1 AND (gate OR id % 5 = 0) AND (id % 2 = 0 OR id % 7 = 0)
UNION ALL SELECT 'ehrdc', '{ARCHIVE}/?p=' || sid, sid, title, 'Ethiopian Human Rights Defenders Center', CASE WHEN id % 4 = 0 THEN 'Mekelle' ELSE 'Addis Ababa, Ethiopia' END, false, NULL, NULL FROM s WHERE id % 3 = 2 AND gate""", "postings"))  # fmt: skip
def board_pages(spark, sf_dir):
    """List pages of twenty entries each, and the pages that these lead to, as three boards write them: with attributes without quotes,
    entries in comments, entries told twice, and texts of other posts inside."""
    rows = load(spark, sf_dir, "postings").select("id", F.col("id").cast("string").alias("sid"), F.replace("title", F.lit("&"), F.lit("&amp;")).alias("t"))
    k, t, sid = F.col("id"), F.col("t"), F.col("sid")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def lists(part: DataFrame, entry: Column) -> DataFrame:
        pages = part.groupBy(F.floor(k / 60).alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("items"))
        return pages.select("page_id", F.lit("https://list.example.org/").alias("url"), say("<html><body><ul>", F.col("items"), "</ul></body></html>").alias("html"))

    mine = [rows.where(k % 3 == i) for i in range(3)]
    card = say("<li class='post-item tie post-", sid, "'><!-- <h2 class=post-title><a href=/no>No</a></h2> --><h2 class=post-title><a href=/post/", sid, " title='Intern'>", t, "</a></h2><p class=post-excerpt>Read</p></li>")
    body = say(
        '<script>{"datePublished":"2025-03-01T00:00:00Z"}</script><h1>Menu</h1><h1 class="entry-title post-title">', t, '</h1><div class="entry entry-content"><p>Organization: Org ', (k % 9).cast("string"), "</p>",
        F.when(k % 4 == 0, "<p>Location: Addis Ababa</p>").otherwise(""), '<div class="x related-posts-box"><p>Location: Nowhere</p><p>Remote</p></div><p>We host interns', F.when(k % 5 == 0, ", home-based").otherwise(""), ".</p>",
        F.when(k % 2 == 0, say('<div><a href="https://forms.gle/', sid, '"><b>Click here</b> to apply</a></div>')).otherwise(""), "</div>",
    )
    cards = boards.card_listings(lists(mine[0], say(card, card)), mine[0].select(say(BOARD, "/post/", sid).alias("url"), body.alias("html")))
    cell = lambda name, value: say(
        '<div class=vacanciesTable__cell><div class="vacanciesTable__cell__label">', name, "</div><span>", value, "</span></div>")
    row = say(
        "<a class='vacanciesTable__row", F.when(k % 7 == 0, " country_ETH").otherwise(""), "' href='https://jobs.example.org/job/", sid, "'>", cell("Job Title", t), cell("Post level", F.when(k % 5 == 0, "IN").otherwise("NPSA-7")),
        cell("Location", F.when(k % 2 == 0, "Addis Ababa, Ethiopia").otherwise("Home office")), cell("Apply by", F.lit("Mar-09-25")), "</a>",
    )
    none = F.lit(None).cast("string")
    item = F.struct(sid.alias("Id"), none.alias("Title"), F.lit("Tasks").alias("ExternalDescriptionStr"), none.alias("PrimaryLocation"), none.alias("ExternalPostedStartDate"), none.alias("ExternalPostedEndDate"))
    vacancies = boards.vacancy_listings(lists(mine[1], row), mine[1].select(F.array(item).alias("items")))
    post = say("<article><header><h2 class='entry-title'><a href='/?p=", sid, "'> ", t, "\n</a></h2></header><a href='/?p=0'>More</a></article>")
    told = say("<h1>", t, "</h1><div class=entry-content><nav class='post-navigation'>Location: Adama.</nav>", F.when(k % 4 == 0, "Location: Mekelle; now. ").otherwise("At the office. "), "Apply.</div>")
    posts = boards.archive_listings(lists(mine[2], post), mine[2].select(say(ARCHIVE, "/?p=", sid).alias("url"), told.alias("html")))
    every = reduce(DataFrame.unionByName, (cards, vacancies, posts))
    return every.select("source", "source_url", "source_id", "title", "org_name", "location", "is_remote", "apply_url", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"))


@query("log_errors", "SELECT event_id, regexp_matches(concat(event_type, ' of ', user_id, CASE WHEN event_id % 3 = 0 THEN ' failed' ELSE '' END), '(?i)error|failed|exception|fatal') AS is_error FROM events")
def log_errors(spark, sf_dir):
    line = F.concat("event_type", F.lit(" of "), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, " failed").otherwise(""))
    return gates.log_errors(base(spark, sf_dir, "events").select("event_id", line.alias("value"))).select("event_id", "is_error")


@query("pageviews", """
WITH r AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE event_id % 5 WHEN 0 THEN '/api/x' WHEN 1 THEN '/analytics' WHEN 2 THEN NULL ELSE '/board' END AS route,
  CASE WHEN event_id % 3 = 0 THEN 'image/png' ELSE 'text/html,*/*' END AS accept FROM events)
SELECT event_id FROM r WHERE method = 'GET' AND route IS NOT NULL AND route NOT LIKE '/api%' AND route NOT LIKE '/analytics%' AND contains(accept, 'text/html')""")  # fmt: skip
def pageviews(spark, sf_dir):
    k = F.col("event_id")
    requests = base(spark, sf_dir, "events").select(
        "event_id", F.when(k % 4 == 0, "POST").otherwise("GET").alias("method"), F.when(k % 5 == 0, "/api/x").when(k % 5 == 1, "/analytics").when(k % 5 > 2, "/board").alias("route"),
        F.when(k % 3 == 0, "image/png").otherwise("text/html,*/*").alias("accept"),
    )
    return gates.pageviews(requests).select("event_id")


@query("saved_lines", oracle(f"""
WITH {SAVES}, o AS (SELECT DISTINCT chat_id, l.* FROM saves s JOIN listings l ON l.id = s.id WHERE {LIVE}),
n AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY deadline NULLS LAST, id) AS n FROM o)
SELECT chat_id, n, concat(n, '. <a href="https://board.example.org/?listing=', id, '&amp;ref=tg-saved"><b>', title[1:80], '</b></a>', chr(10), '    ', org_name[1:60], ' · ',
  CASE WHEN is_remote THEN 'Remote' ELSE coalesce(trim(split_part(location, ',', 1)), '—') END, ' · ', {URGENCY}) AS line FROM n""", "listings"))  # fmt: skip
def saved_lines(spark, sf_dir):
    listings = load(spark, sf_dir, "listings")
    return jobs.saved_lines(board.saved_open(_saves(spark, sf_dir), listings, AS_OF), listings, AS_OF).select("chat_id", "n", "line")


@query("save_confirmations", oracle(f"""
WITH {SAVES} SELECT chat_id, l.id, concat('✅ Saved — <b>', title, '</b>', chr(10), CASE WHEN deadline IS NULL THEN 'Rolling deadline — no reminders needed, apply when ready.'
  ELSE concat({URGENCY}, ' · I''ll remind you 24h &amp; 72h before it closes.') END) AS message FROM saves s JOIN listings l ON l.id = s.id""", "listings"))  # fmt: skip
def save_confirmations(spark, sf_dir):
    requests = _saves(spark, sf_dir).select("chat_id", F.explode("saved_listing_ids").alias("id"))
    return jobs.save_confirmations(requests, load(spark, sf_dir, "listings"), AS_OF)


@query("drain_channel", oracle(f"""
SELECT id, deadline IS NULL OR deadline >= {NOW} AS send FROM listings WHERE NOT posted_to_channel AND status = 'active' AND fit_score >= 70 AND id % 3 <> 0
ORDER BY fit_score DESC, listings.deadline NULLS LAST, id LIMIT 10"""))  # fmt: skip
def drain_channel(spark, sf_dir):
    listings = load(spark, sf_dir, "listings")
    return jobs.drain_channel(listings, listings.where("id % 3 = 0").select("id"), AS_OF).select("id", "send")
