"""Board, directory and messenger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave.operators import board, directory
from jobweave.plans.registry import query
from jobweave.plans.tables import base, load, oracle

AS_OF = "1997-06-01 00:00:00"
NOW = f"TIMESTAMP '{AS_OF}'"
LIVE = f"status = 'active' AND (deadline IS NULL OR deadline >= {NOW})"
ORDER = "ORDER BY fit_score DESC NULLS LAST, deadline ASC NULLS LAST, id"
SHOWN = "id, title, org_name, fit_score, strftime(deadline, '%Y-%m-%d') AS deadline"


def _listings(spark, sf_dir):
    return load(spark, sf_dir, "listings")


def _shown(df, *more):
    return df.select("id", "title", "org_name", "fit_score", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"), *more)


@query("live_board", oracle(f"SELECT {SHOWN} FROM listings WHERE {LIVE} {ORDER} LIMIT 50"))
def live_board(spark, sf_dir):
    return _shown(board.live_board(_listings(spark, sf_dir), AS_OF))


@query("board_with_focus", oracle(f"""
WITH b AS (SELECT * FROM listings WHERE {LIVE} {ORDER} LIMIT 50)
SELECT 0 AS rank_group, {SHOWN} FROM listings WHERE id = 8 AND status <> 'hidden' AND id NOT IN (SELECT id FROM b) UNION ALL SELECT 1, {SHOWN} FROM b"""))  # fmt: skip
def board_with_focus(spark, sf_dir):
    return _shown(board.board_with_focus(_listings(spark, sf_dir), AS_OF, 8), "rank_group")


@query("board_search", oracle(f"""
SELECT {SHOWN} FROM listings WHERE {LIVE} AND lower(source) = 'ethiongojobs' AND title LIKE '%Intern%' AND (is_paid IS NULL OR is_paid)
AND contains(lower(concat_ws(chr(10), title, org_name, location)), 'addis')"""))  # fmt: skip
def board_search(spark, sf_dir):
    found = board.search(board.live(_listings(spark, sf_dir), AS_OF), "EthioNGOJobs", F.col("title").contains("Intern"), True, "Addis ")
    return _shown(found)


@query("listings_query", oracle(f"""
SELECT {SHOWN} FROM listings WHERE status = 'active' AND is_paid AND is_remote AND list_contains(field_tags, 'policy') AND deadline >= {NOW} AND deadline <= {NOW} + INTERVAL 60 DAY {ORDER} LIMIT 20 OFFSET 5"""))  # fmt: skip
def listings_query(spark, sf_dir):
    return _shown(board.listings_query(_listings(spark, sf_dir), AS_OF, paid=True, remote=True, deadline_within=60, limit=20, offset=5, field="policy"))


LEFT = f"CAST(ceil((epoch_us(deadline) - epoch_us({NOW})) / 86400000000) AS INT)"


@query("listing_view", oracle(f"""
WITH r AS (SELECT *, json_extract(raw, '$.structured.data') AS data FROM listings)
SELECT id, upper(source) AS source_label, org_name AS org, title, coalesce(strftime(deadline, '%b %-d'), 'Rolling') AS deadline_label, coalesce(location, '—') AS location_label,
  CASE WHEN is_paid = false THEN 'Unpaid' ELSE coalesce(stipend_text, 'Pay unclear') END AS pay_label, fit_score AS fit,
  CASE WHEN deadline IS NULL THEN 'open' WHEN {LEFT} < 0 THEN 'expired' ELSE concat({LEFT}, 'd') END AS days_label, array_to_string(field_tags, ',') AS tags, source_url,
  CASE WHEN regexp_matches(apply_url, '(?i)^https?://') THEN apply_url END AS apply_url, json_extract_string(data, '$.application_email') AS apply_email, strftime(scraped_at, '%b %-d') AS scraped_label,
  CASE WHEN data IS NOT NULL THEN concat('About: Line ', id % 5, ' | a') END AS sections, json_extract_string(data, '$.how_to_apply') AS how_to_apply FROM r"""))  # fmt: skip
def listing_view(spark, sf_dir):
    view = board.listing_view(_listings(spark, sf_dir), AS_OF)
    told = F.transform("sections", lambda s: F.concat(s["title"], F.lit(": "), F.array_join(s["paragraphs"], "/"), F.lit(" | "), F.array_join(s["bullets"], "/")))
    return view.withColumn("tags", F.array_join("tags", ",")).withColumn("sections", F.array_join(told, ";"))


GB_DATE = "replace(strftime(deadline, '%-d %b %Y'), ' Sep ', ' Sept ')"
URGENCY = f"""CASE WHEN deadline IS NULL THEN 'rolling deadline' WHEN {LEFT} < 0 THEN 'closed' WHEN {LEFT} = 0 THEN '🔴 closes today' WHEN {LEFT} <= 3 THEN concat('🔴 ', {LEFT}, 'd left')
  WHEN {LEFT} <= 14 THEN concat('⏳ ', {LEFT}, 'd left') ELSE concat({GB_DATE}, ' · ', {LEFT}, 'd left') END"""


@query("deadline_urgency", oracle(f"SELECT id, {URGENCY} AS urgency, {LEFT} AS days_left FROM listings"))
def deadline_urgency(spark, sf_dir):
    return _listings(spark, sf_dir).select("id", board.urgency(F.col("deadline"), AS_OF).alias("urgency"), board.days_left(F.col("deadline"), AS_OF).alias("days_left"))


@query("apply_target", oracle("""
WITH a AS (SELECT *, CASE WHEN regexp_matches(apply_url, '(?i)^https?://') THEN apply_url END AS web FROM listings)
SELECT id, coalesce(web, 'mailto:' || apply_email || '?subject=Application%20%E2%80%94%20' || replace(title, ' ', '%20'), source_url) AS target,
  CASE WHEN web IS NOT NULL THEN 'Apply at source' WHEN apply_email IS NOT NULL THEN 'Apply by email' ELSE 'Open source' END AS label FROM a"""))  # fmt: skip
def apply_target(spark, sf_dir):
    return board.apply_target(_listings(spark, sf_dir))


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("caption_fields", oracle(f"""
WITH c AS (SELECT *, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS clean, nullif(trim(json_extract_string(raw, '$.structured.data.summary')), '') AS told,
  coalesce(nullif(trim(apply_url), ''), json_extract_string(raw, '$.structured.data.application_url')) AS form FROM listings),
s AS (SELECT *, trim(array_to_string(regexp_extract_all(clean, '[^.!?]+[.!?]+')[1:2], ' '))[1:280] AS two, CASE WHEN regexp_matches(form, '(?i)^https?://') THEN form END AS apply_link FROM c),
f AS (SELECT id, {_escaped('org_name[1:120]')} AS org, {_escaped('title[1:200]')} AS title, {_escaped('coalesce(told, two)[1:300]')} AS summary, apply_link, source_url,
  'Deadline ' || {GB_DATE} || CASE WHEN {LEFT} < 0 THEN '' WHEN {LEFT} = 0 THEN ' (today)' ELSE concat(' (', {LEFT}, 'd left)') END AS deadline_text FROM s)
SELECT *, concat_ws(chr(10), concat('<b>', org, '</b>'), title, '', summary, '', deadline_text, concat_ws(' · ', concat('<a href="https://board.example.org/?listing=', id, '&amp;ref=tg">Read</a>'),
  '<a href="' || {_escaped('apply_link')} || '">Apply</a>', '<a href="' || {_escaped('source_url')} || '">Source</a>')) AS post FROM f"""))  # fmt: skip
def caption_fields(spark, sf_dir):
    return board.caption_fields(_listings(spark, sf_dir), AS_OF)


@query("channel_queue", oracle(f"""
SELECT {SHOWN}, deadline IS NULL OR deadline >= {NOW} AS send FROM listings WHERE NOT posted_to_channel AND status = 'active' AND fit_score >= 70 {ORDER.replace('deadline', 'listings.deadline')} LIMIT 10"""))  # fmt: skip
def channel_queue(spark, sf_dir):
    return _shown(board.channel_queue(_listings(spark, sf_dir), AS_OF), "send")


@query("repost_candidates", oracle(f"""
SELECT {SHOWN} FROM listings WHERE {LIVE} AND fit_score >= 70 AND coalesce(json_extract_string(raw, '$.repostedToChannel'), 'false') <> 'true'
AND source = 'undp' {ORDER.replace('deadline', 'listings.deadline')} LIMIT 10"""))  # fmt: skip
def repost_candidates(spark, sf_dir):
    return _shown(board.repost_candidates(_listings(spark, sf_dir), AS_OF, source="undp"))


@query("reposts_ready", oracle(f"""
SELECT id, CASE WHEN id % 3 = 0 THEN 'x' END AS payload FROM (SELECT *, CASE WHEN id % 7 = 0 THEN TIMESTAMP '1990-01-01 00:00:00' ELSE listings.deadline END AS later FROM listings
  WHERE {LIVE} AND fit_score >= 70 AND coalesce(json_extract_string(raw, '$.repostedToChannel'), 'false') <> 'true' {ORDER.replace('deadline', 'listings.deadline')} LIMIT 1000)
WHERE id % 3 = 0 AND id % 7 <> 0"""))  # fmt: skip
def reposts_ready(spark, sf_dir):
    """Of a thousand candidates those that stay once their payloads are read: a third has one, a seventh turns out to be closed."""
    found = board.repost_candidates(_listings(spark, sf_dir), AS_OF, n=1000)
    repaired = found.withColumn("deadline", F.when(F.col("id") % 7 == 0, F.lit("1990-01-01").cast("timestamp")).otherwise(F.col("deadline"))).withColumn("structured", F.col("id") % 3 == 0)
    return board.ready_to_repost(repaired, AS_OF).select("id", F.when(F.col("structured"), "x").alias("payload"))


SAVES = "saves AS (SELECT c_custkey AS chat_id, unnest([c_custkey, c_custkey * 2, c_custkey * 3]) AS id FROM customer)"


def _saves(spark, sf_dir):
    return base(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chat_id"), F.array("c_custkey", F.col("c_custkey") * 2, F.col("c_custkey") * 3).alias("saved_listing_ids"))


@query("saved_open", oracle(f"""
WITH {SAVES}, o AS (SELECT DISTINCT chat_id, l.id, title, deadline FROM saves s JOIN listings l ON l.id = s.id WHERE {LIVE})
SELECT chat_id, id, title, row_number() OVER w AS n, CAST(floor((row_number() OVER w - 1) / 15) AS INT) AS page FROM o WINDOW w AS (PARTITION BY chat_id ORDER BY deadline NULLS LAST, id)""", "listings"))  # fmt: skip
def saved_open(spark, sf_dir):
    return board.saved_open(_saves(spark, sf_dir), _listings(spark, sf_dir), AS_OF).select("chat_id", "id", "title", "n", "page")


@query("due_reminders", oracle(f"""
WITH {SAVES}, h AS (SELECT id, CAST(id % 100 AS DOUBLE) AS hours FROM listings)
SELECT DISTINCT chat_id, s.id, CASE WHEN hours <= 24 THEN '24h' ELSE '72h' END AS band FROM saves s JOIN h ON h.id = s.id
WHERE ((hours > 21 AND hours <= 24 AND chat_id % 3 <> 0) OR (hours > 69 AND hours <= 72 AND chat_id % 4 <> 0)) AND chat_id % 11 <> 0""", "listings"))  # fmt: skip
def due_reminders(spark, sf_dir):
    """Deadlines are set 0 to 99 hours ahead, so that both bands are met."""
    saves = _saves(spark, sf_dir).withColumn("notify_24h", F.col("chat_id") % 3 != 0).withColumn("notify_72h", F.col("chat_id") % 4 != 0)
    ahead = F.timestamp_add("HOUR", (F.col("id") % 100).cast("int"), F.lit(AS_OF).cast("timestamp"))
    done = saves.where("chat_id % 11 = 0").select("chat_id", F.explode("saved_listing_ids").alias("id"))
    sent = done.select("*", F.explode(F.array(F.lit("24h"), F.lit("72h"))).alias("band"))
    return board.due_reminders(saves, _listings(spark, sf_dir).withColumn("deadline", ahead), AS_OF, sent)


@query("saved_board", oracle("""
WITH b AS (SELECT listing_id, max(created_at) AS bookmarked_at FROM bookmarks WHERE user_id = 7 GROUP BY 1)
SELECT strftime(bookmarked_at, '%Y-%m-%d %H:%M:%S') AS bookmarked_at, id, title FROM b JOIN listings ON id = listing_id"""))  # fmt: skip
def saved_board(spark, sf_dir):
    rows = board.saved_board(load(spark, sf_dir, "bookmarks"), _listings(spark, sf_dir), 7)
    return rows.select(F.date_format("bookmarked_at", "yyyy-MM-dd HH:mm:ss").alias("bookmarked_at"), "id", "title")


@query("apply_saves", oracle("""
WITH r AS (SELECT user_id AS chat_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS id, min(event_id) AS seq FROM events WHERE event_type = 'click' GROUP BY 1, 2),
w AS (SELECT r.*, row_number() OVER (PARTITION BY chat_id ORDER BY seq, r.id) AS rank FROM r JOIN customer ON c_custkey = chat_id JOIN listings l ON l.id = r.id AND status = 'active'
  WHERE NOT list_contains([c_custkey, c_custkey * 2, c_custkey * 3], r.id)),
n AS (SELECT chat_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY seq, id) AS new FROM w WHERE rank <= 2 GROUP BY 1)
SELECT c_custkey AS chat_id, concat_ws(',', c_custkey, c_custkey * 2, c_custkey * 3, new) AS saved FROM customer LEFT JOIN n ON chat_id = c_custkey""", "listings"))  # fmt: skip
def apply_saves(spark, sf_dir):
    clicks = base(spark, sf_dir, "events").where("event_type = 'click'")
    requests = clicks.select(F.col("user_id").alias("chat_id"), F.get_json_object("props", "$.k").cast("bigint").alias("id"), F.col("event_id").alias("seq"))
    saved = board.apply_saves(_saves(spark, sf_dir), requests, _listings(spark, sf_dir), most=5)
    return saved.select("chat_id", F.array_join(F.col("saved_listing_ids").cast("array<string>"), ",").alias("saved"))


@query("bookmark_state", oracle("""
WITH t AS (SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS listing_id FROM events WHERE event_type = 'view' GROUP BY ALL HAVING count(*) % 2 = 1),
h AS (SELECT DISTINCT user_id, listing_id FROM bookmarks),
x AS ((SELECT * FROM h EXCEPT SELECT * FROM t) UNION ALL (SELECT * FROM t EXCEPT SELECT * FROM h))
SELECT * FROM x WHERE listing_id IN (SELECT id FROM listings)"""))  # fmt: skip
def bookmark_state(spark, sf_dir):
    toggles = base(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("listing_id"))
    return board.bookmark_state(load(spark, sf_dir, "bookmarks"), toggles, _listings(spark, sf_dir))


@query("backfill_batch", oracle("SELECT id, strftime(scraped_at, '%Y-%m-%d') AS scraped FROM listings WHERE json_extract(raw, '$.structured') IS NULL ORDER BY scraped_at DESC, id LIMIT 500"))
def backfill_batch(spark, sf_dir):
    return board.backfill_batch(_listings(spark, sf_dir)).select("id", F.date_format("scraped_at", "yyyy-MM-dd").alias("scraped"))


# Organisations.

REACH = """(CASE WHEN hiring THEN 100 ELSE 0 END + CASE WHEN contact_email IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN internship_url IS NOT NULL THEN 30 ELSE 0 END
  + CASE WHEN addis_office THEN 15 ELSE 0 END + CASE WHEN careers_url IS NOT NULL THEN 10 ELSE 0 END
  + CASE scrape_priority WHEN 'critical' THEN 8 WHEN 'high' THEN 4 WHEN 'medium' THEN 2 ELSE 0 END + CASE WHEN notes IS NOT NULL THEN 2 ELSE 0 END)"""
RANKED = f"""a AS (SELECT org_slug AS slug, count(*) AS openings FROM listings WHERE status = 'active' AND org_slug IS NOT NULL GROUP BY 1),
o AS (SELECT orgs.*, coalesce(openings, 0) AS openings, coalesce(openings, 0) > 0 AS hiring FROM orgs LEFT JOIN a ON a.slug = orgs.slug),
r AS (SELECT *, {REACH} AS reach FROM o WHERE category <> 'aggregator')"""


def _ranked(spark, sf_dir):
    return directory.reach(directory.with_openings(load(spark, sf_dir, "orgs"), _listings(spark, sf_dir)).where("category <> 'aggregator'"))


@query("org_reach", oracle(f"WITH {RANKED} SELECT slug, name, openings, reach FROM r"))
def org_reach(spark, sf_dir):
    return directory.best_first(_ranked(spark, sf_dir)).select("slug", "name", "openings", "reach")


@query("org_badges", oracle(f"""WITH {RANKED}, b AS (SELECT *, list_filter([CASE WHEN hiring THEN 'hiring now' END, CASE WHEN contact_email IS NOT NULL THEN 'email' END,
  CASE WHEN internship_url IS NOT NULL THEN 'internships' END, CASE WHEN addis_office THEN 'addis' END], lambda x: x IS NOT NULL) AS named FROM r)
SELECT slug, CASE WHEN len(named) > 0 THEN array_to_string(named[1:3], ', ') WHEN careers_url IS NOT NULL THEN 'careers page' ELSE '' END AS badges, coalesce('mailto:' || contact_email, internship_url, careers_url, website) AS contact,
  CASE WHEN contact_email IS NOT NULL THEN 'Email introduction' WHEN internship_url IS NOT NULL THEN 'Open internship page' WHEN careers_url IS NOT NULL THEN 'Open careers page' WHEN website IS NOT NULL THEN 'Open website' END AS contact_label FROM b"""))  # fmt: skip
def org_badges(spark, sf_dir):
    return directory.badges(_ranked(spark, sf_dir)).select("slug", F.array_join("badges", ", ").alias("badges"), "contact", "contact_label")


@query("org_summary", oracle(f"""WITH {RANKED}
SELECT 'all' AS category, count(*) AS orgs, count(*) FILTER (hiring) AS hiring, count(contact_email) AS with_email, count(*) FILTER (addis_office) AS local_office FROM r
UNION ALL SELECT category, count(*), count(*) FILTER (hiring), count(contact_email), count(*) FILTER (addis_office) FROM r GROUP BY category"""))  # fmt: skip
def org_summary(spark, sf_dir):
    return directory.summary(_ranked(spark, sf_dir))


@query("org_search", oracle(f"""WITH {RANKED} SELECT slug, name, reach FROM r WHERE category = 'un' AND contains(lower(concat_ws(chr(10), name, category, region)), 'supp')"""))
def org_search(spark, sf_dir):
    return directory.search(_ranked(spark, sf_dir), category="un", text="Supp").select("slug", "name", "reach")


@query("org_directory", oracle(f"""
WITH l AS (SELECT org_slug, id, title, row_number() OVER (PARTITION BY org_slug ORDER BY fit_score DESC NULLS LAST, deadline NULLS LAST, id) AS n FROM listings WHERE status = 'active')
SELECT slug, n, id, title FROM orgs LEFT JOIN l ON l.org_slug = slug AND n <= 25"""))  # fmt: skip
def org_directory(spark, sf_dir):
    return directory.with_listings(load(spark, sf_dir, "orgs"), _listings(spark, sf_dir)).select("slug", "n", "id", "title")


@query("org_history", oracle("""
WITH p AS (SELECT org_slug, title, coalesce(deadline, scraped_at) AS happened, row_number() OVER (PARTITION BY org_slug ORDER BY scraped_at DESC, id) AS n FROM listings WHERE status <> 'active' AND org_slug IS NOT NULL)
SELECT org_slug AS slug, string_agg(title || '@' || strftime(happened, '%Y-%m-%d'), ';' ORDER BY n) AS past FROM p WHERE n <= 4 GROUP BY 1"""))  # fmt: skip
def org_history(spark, sf_dir):
    past = directory.history(_listings(spark, sf_dir))
    line = F.transform("past", lambda x: F.concat(x["title"], F.lit("@"), F.date_format(x["at"], "yyyy-MM-dd")))
    return past.select("slug", F.array_join(line, ";").alias("past"))


@query("similar_orgs", oracle(f"""WITH {RANKED}, k AS (SELECT a.slug, b.slug AS "similar", row_number() OVER (PARTITION BY a.slug ORDER BY b.reach DESC, b.name, b.slug) AS n
  FROM r a JOIN r b ON a.category = b.category AND a.slug <> b.slug) SELECT slug, "similar", n FROM k WHERE n <= 3"""))  # fmt: skip
def similar_orgs(spark, sf_dir):
    return directory.similar(_ranked(spark, sf_dir))


@query("outreach_orgs", oracle("SELECT slug, name FROM orgs WHERE posts_publicly IN ('no', 'sometimes') AND category <> 'aggregator' ORDER BY name, slug LIMIT 12"))
def outreach_orgs(spark, sf_dir):
    return directory.outreach(load(spark, sf_dir, "orgs")).select("slug", "name")


@query("work_queue", oracle("""
SELECT slug, coalesce(internship_url, careers_url) AS url, CASE slug WHEN 'org-1' THEN 'undp' WHEN 'org-21' THEN 'board' END AS source,
  row_number() OVER (ORDER BY CASE scrape_priority WHEN 'critical' THEN 1 ELSE 2 END, slug) AS n FROM orgs
WHERE posts_publicly IN ('yes', 'sometimes') AND scrape_priority IN ('critical', 'high') AND (coalesce(internship_url, careers_url) IS NOT NULL OR slug IN ('org-1', 'org-21'))"""))  # fmt: skip
def work_queue(spark, sf_dir):
    return directory.work_queue(load(spark, sf_dir, "orgs"), ("critical", "high"), overrides={"org-1": "undp", "org-21": "board"})


@query("org_playbook", oracle("SELECT slug, CASE category WHEN 'un' THEN 'institutional' WHEN 'ingo' THEN 'ingo' WHEN 'think-tank' THEN 'thinktank' WHEN 'media' THEN 'advocacy' ELSE 'default' END AS playbook FROM orgs"))
def org_playbook(spark, sf_dir):
    return directory.playbook(load(spark, sf_dir, "orgs")).select("slug", "playbook")


@query("social_links", oracle("""
SELECT slug, CASE WHEN twitter IS NULL OR trim(twitter) = '' THEN NULL WHEN regexp_matches(trim(twitter), '(?i)^https?://') THEN trim(twitter)
  ELSE 'https://x.com/' || regexp_replace(trim(twitter), '^@', '') END AS url FROM orgs"""))  # fmt: skip
def social_links(spark, sf_dir):
    return load(spark, sf_dir, "orgs").select("slug", directory.social_url(F.col("twitter"), "https://x.com/").alias("url"))


@query("normalize_orgs", oracle("""
WITH c AS (SELECT slug, nullif(trim(name), '') AS name, CASE lower(category) WHEN 'media' THEN '' ELSE category END AS category, CASE CAST(slug[5:] AS BIGINT) % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' ELSE 'maybe' END AS office,
  upper(posts_publicly) AS posts, CASE WHEN scrape_priority = 'low' THEN 'urgent' ELSE scrape_priority END AS priority FROM orgs WHERE CAST(slug[5:] AS BIGINT) % 10 <> 0)
SELECT slug, name, coalesce(nullif(category, ''), 'other') AS category, CASE lower(trim(office)) WHEN 'yes' THEN true WHEN 'no' THEN false END AS addis_office,
  CASE WHEN lower(posts) IN ('yes', 'no', 'sometimes') THEN lower(posts) ELSE 'unknown' END AS posts_publicly, CASE WHEN priority IN ('critical', 'high', 'medium', 'low') THEN priority END AS scrape_priority FROM c"""))  # fmt: skip
def normalize_orgs(spark, sf_dir):
    n = F.substring_index("slug", "-", -1).cast("bigint")
    raw = load(spark, sf_dir, "orgs").select(
        F.when(n % 10 == 0, "  ").otherwise(F.col("slug")).alias("slug"), "name", F.when(F.col("category") == "media", "").otherwise(F.col("category")).alias("category"),
        F.when(n % 3 == 0, "Yes").when(n % 3 == 1, " no ").otherwise("maybe").alias("addis_office"), F.upper("posts_publicly").alias("posts_publicly"),
        F.when(F.col("scrape_priority") == "low", "urgent").otherwise(F.col("scrape_priority")).alias("scrape_priority"),
    )
    return directory.normalize(raw)
