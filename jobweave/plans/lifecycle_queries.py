"""Upserts, caches, lifecycle, event rules and payload queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobweave.functions import patterns as P
from jobweave.operators import events, lifecycle, merge, snapshots
from jobweave.operators.kept import shared_folder
from jobweave.operators.memo import recall
from jobweave.plans.registry import query
from jobweave.plans.tables import base, dealt, load, oracle
from jobweave.plans.text_queries import hits, sql_deadline

AS_OF = "1997-06-01 00:00:00"
NOW = f"TIMESTAMP '{AS_OF}'"


def _listings(spark, sf_dir):
    return load(spark, sf_dir, "listings")


def _batch(spark, sf_dir):
    """A batch for the listings table: changed rows, new rows and repeated keys."""
    rows = _listings(spark, sf_dir).where("id % 4 = 0").withColumn("title", F.concat("title", F.lit(" v2"))).withColumn("raw", F.lit('{"scraped":1,"structured":null}'))
    added = rows.where("id % 8 = 0").withColumn("id", F.col("id") + 10_000_000).withColumn("source_url", F.concat("source_url", F.lit("/new")))
    again = rows.where("id % 12 = 0").withColumn("title", F.concat("title", F.lit("b")))
    return rows.withColumn("seq", F.lit(1)).unionByName(added.withColumn("seq", F.lit(2))).unionByName(again.withColumn("seq", F.lit(3)))


BATCH = """r AS (SELECT * REPLACE (title || ' v2' AS title) FROM listings WHERE id % 4 = 0),
batch AS (SELECT id, source_url, title, status, 1 AS seq FROM r UNION ALL SELECT id + 10000000, source_url || '/new', title, status, 2 FROM r WHERE id % 8 = 0
  UNION ALL SELECT id, source_url, title || 'b', status, 3 FROM r WHERE id % 12 = 0),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY seq DESC) AS n FROM batch) WHERE n = 1)"""


@query("upsert_listings", oracle(f"""WITH {BATCH}
SELECT coalesce(t.id, b.id) AS id, coalesce(t.source_url, b.source_url) AS source_url, coalesce(b.title, t.title) AS title, coalesce(t.posted_to_channel, b.id % 4 = 0) AS posted,
  CASE WHEN t.id IS NOT NULL AND b.id IS NOT NULL THEN 'updated' WHEN t.id IS NULL THEN 'new' ELSE 'kept' END AS outcome
FROM listings t FULL JOIN last b ON b.source_url = t.source_url""", "listings"))  # fmt: skip
def upsert_listings(spark, sf_dir):
    table, batch = _listings(spark, sf_dir), _batch(spark, sf_dir)
    merged = merge.upsert(table, batch, "source_url", "seq", keep=("id", "source", "posted_to_channel"))
    outcome = F.when(F.col("id") >= 10_000_000, "new").when(F.contains("title", F.lit(" v2")), "updated").otherwise("kept")
    return merged.select("id", "source_url", "title", F.col("posted_to_channel").alias("posted"), outcome.alias("outcome"))


@query("upsert_committed", oracle(f"""WITH {BATCH}
SELECT coalesce(t.id, b.id) AS id, coalesce(t.source_url, b.source_url) AS source_url, coalesce(b.title, t.title) AS title, coalesce(b.status, t.status) AS status, 3 AS snapshots
FROM listings t FULL JOIN last b ON b.source_url = t.source_url""", "listings"))  # fmt: skip
def upsert_committed(spark, sf_dir):
    """The upsert in two batches into a table of snapshots; the first one is played again after the second and changes nothing."""
    store = snapshots.SnapshotStore(spark, f"{shared_folder(spark)}/listings-{uuid.uuid4().hex}")
    columns = ["id", "source_url", "title", "status"]
    batch = _batch(spark, sf_dir).select(*columns, "seq")
    store.update(lambda _: _listings(spark, sf_dir).select(*columns))
    merged = lambda part: lambda table: merge.upsert(table, part, "source_url", "seq", keep=("id",))
    first, second = batch.where("seq < 3"), batch.where("seq = 3")
    for n, part in ((0, first), (1, second), (0, first)):
        store.update(merged(part), "scrape", n)
    return store.read().withColumn("snapshots", F.lit(len(store.versions())))


@query("upsert_counts", oracle(f"""WITH {BATCH}
SELECT count(*) FILTER (t.source_url IS NULL) AS new_count, count(*) FILTER (t.source_url IS NOT NULL) AS updated_count, count(DISTINCT b.source_url) FILTER (t.source_url IS NULL) AS new_keys
FROM batch b LEFT JOIN listings t ON t.source_url = b.source_url""", "listings"))  # fmt: skip
def upsert_counts(spark, sf_dir):
    return merge.upsert_counts(_listings(spark, sf_dir), _batch(spark, sf_dir), "source_url")


@query("cache_misses", """
WITH c AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, sha256(text || 'old') FROM documents WHERE doc_id % 3 = 1)
SELECT d.doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = d.doc_id AND c.h = sha256(coalesce(text, '')))""")  # fmt: skip
def cache_misses(spark, sf_dir):
    docs = base(spark, sf_dir, "documents")
    fresh = docs.where("doc_id % 3 = 0").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    old = docs.where("doc_id % 3 = 1").select("doc_id", F.sha2(F.concat("text", F.lit("old")), 256).alias("content_hash"))
    return merge.cache_misses(docs, fresh.unionByName(old), key="doc_id").select("doc_id", "content_hash")


@query("memo_answers", """
WITH b AS (SELECT doc_id, source AS source_url, text FROM documents), k AS (SELECT DISTINCT source_url, coalesce(text, '') AS t FROM b WHERE doc_id % 3 = 0)
SELECT doc_id, length(coalesce(text, '')) AS n_chars, EXISTS (SELECT 1 FROM k WHERE k.source_url = b.source_url AND k.t = coalesce(b.text, '')) AS known FROM b""")  # fmt: skip
def memo_answers(spark, sf_dir):
    """A third of the documents is asked about first; of all of them, later, only contents that the memo doesn't hold."""
    docs = dealt(base(spark, sf_dir, "documents")).select("doc_id", F.col("source").alias("source_url"), "text")
    measured = lambda first: lambda rows: rows.select("*", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.lit(first).alias("known"))
    _, memo = recall(docs.where("doc_id % 3 = 0"), None, measured(True), ("n_chars", "known"))
    found, _ = recall(docs, memo, measured(False), ("n_chars", "known"))
    return found.select("doc_id", "n_chars", "known")


#: Top-level merge of the JSON objects x and y as text with sorted keys.
MERGED = """'{' || coalesce((SELECT string_agg(to_json(key)::VARCHAR || ':' || value::VARCHAR, ',' ORDER BY key) FROM
  (SELECT key, value FROM json_each(y) UNION ALL SELECT key, value FROM json_each(x) WHERE key NOT IN (SELECT key FROM json_each(y)))), '') || '}'"""


@query("raw_merge", oracle(f"""
WITH m AS (SELECT id, raw::JSON AS x, (CASE WHEN id % 3 = 0 THEN concat('{{"structured":"n', id, '","n":', id, ',"f":false,"q":null}}') ELSE '{{}}' END)::JSON AS y FROM listings)
SELECT id, {MERGED} AS merged FROM m"""))  # fmt: skip
def raw_merge(spark, sf_dir):
    n = F.col("id").cast("string")
    new = F.when(F.col("id") % 3 == 0, F.concat(F.lit('{"structured":"n'), n, F.lit('","n":'), n, F.lit(',"f":false,"q":null}'))).otherwise("{}")
    return _listings(spark, sf_dir).select("id", merge.raw_merge(F.col("raw"), new).alias("merged"))


@query("upsert_merged", oracle(f"""WITH {BATCH},
u AS (SELECT t.id, t.raw::JSON AS x, '{{"scraped":1,"structured":null}}'::JSON AS y, b.source_url IS NOT NULL AS hit FROM listings t LEFT JOIN last b ON b.source_url = t.source_url)
SELECT id, CASE WHEN hit THEN {MERGED} ELSE x::VARCHAR END AS raw FROM u
UNION ALL SELECT b.id, '{{"scraped":1,"structured":null}}' FROM last b LEFT JOIN listings t ON b.source_url = t.source_url WHERE t.id IS NULL
UNION ALL SELECT id + 20000000, '{{"scraped":1,"structured":null}}' FROM listings WHERE id % 16 = 0""", "listings"))  # fmt: skip
def upsert_merged(spark, sf_dir):
    """An upsert that merges payloads; rows without an address are added, each."""
    batch = _batch(spark, sf_dir)
    lost = batch.where("seq = 1 AND id % 16 = 0").withColumn("id", F.col("id") + 20_000_000).withColumn("source_url", F.lit(None).cast("string"))
    return merge.upsert(_listings(spark, sf_dir), batch.unionByName(lost), "source_url", "seq", keep=("id",), merge_raw=True).select("id", "raw")


@query("purge_cascade", oracle("SELECT user_id, listing_id, count(*) AS n FROM bookmarks WHERE listing_id NOT IN (SELECT id FROM listings WHERE status = 'expired') GROUP BY ALL"))
def purge_cascade(spark, sf_dir):
    kept = merge.purge_cascade(load(spark, sf_dir, "bookmarks"), _listings(spark, sf_dir).where("status = 'expired'").select("id"))
    return kept.groupBy("user_id", "listing_id").agg(F.count(F.lit(1)).alias("n"))


@query("new_urls", """
WITH c AS (SELECT page_id AS pos, regexp_replace(url, '[?#].*$', '') AS url FROM pages), f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS n FROM c
  WHERE url NOT IN (SELECT regexp_replace(url, '[?#].*$', '') FROM pages WHERE page_id % 5 = 0)) SELECT pos, url FROM f WHERE n = 1""")  # fmt: skip
def new_urls(spark, sf_dir):
    cards = base(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.regexp_replace("url", r"[?#].*$", "").alias("url"))
    return merge.new_urls(cards, cards.where("pos % 5 = 0").select("url"))


@query("expire_now", oracle(f"SELECT id, CASE WHEN status = 'active' AND deadline < {NOW} THEN 'expired' ELSE status END AS status FROM listings"))
def expire_now(spark, sf_dir):
    return lifecycle.expire_now(_listings(spark, sf_dir), AS_OF).select("id", "status")


DECIDED = f"""e AS (SELECT *, coalesce(deadline, CAST({sql_deadline('description')} AS TIMESTAMP)) AS effective FROM source),
x AS (SELECT *, CASE WHEN {hits('title', P.ROUNDUP)} THEN 'delete' WHEN status = 'expired' AND coalesce(effective, scraped_at) < {NOW} - INTERVAL 90 DAY THEN 'purge'
  WHEN status = 'active' AND effective < {NOW} - INTERVAL 1 DAY THEN 'expire' WHEN status = 'active' AND scraped_at < {NOW} - INTERVAL 21 DAY THEN 'stale'
  WHEN effective IS NOT NULL AND deadline IS NULL THEN 'backfill' END AS action FROM e)"""
SOURCE = "source AS (SELECT * REPLACE (concat(description, CASE WHEN id % 7 = 0 THEN ' Apply by 3 September 1997.' ELSE '' END) AS description) FROM listings)"


def _decided(spark, sf_dir):
    more = F.when(F.col("id") % 7 == 0, " Apply by 3 September 1997.").otherwise("")
    return lifecycle.reconcile(_listings(spark, sf_dir).withColumn("description", F.concat("description", more)), AS_OF)


@query("reconcile", oracle(f"WITH {SOURCE}, {DECIDED} SELECT id, action, strftime(effective, '%Y-%m-%d') AS effective FROM x", "listings"))
def reconcile(spark, sf_dir):
    return _decided(spark, sf_dir).select("id", "action", F.date_format("effective", "yyyy-MM-dd").alias("effective"))


@query("reconciled", oracle(f"""WITH {SOURCE}, {DECIDED} SELECT id, CASE WHEN action IN ('expire', 'stale') THEN 'expired' WHEN action = 'backfill' THEN 'active' ELSE status END AS status,
  strftime(CASE WHEN action = 'backfill' THEN effective ELSE deadline END, '%Y-%m-%d') AS deadline FROM x WHERE action IS NULL OR action NOT IN ('delete', 'purge')""", "listings"))  # fmt: skip
def reconciled(spark, sf_dir):
    return lifecycle.apply_reconcile(_decided(spark, sf_dir)).select("id", "status", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"))


@query("prune_counters", oracle(f"""WITH {SOURCE}, {DECIDED} SELECT count(*) AS scanned, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action = 'purge') AS purged,
  count(*) FILTER (action = 'expire') AS expired, count(*) FILTER (action = 'stale') AS stale, count(*) FILTER (action = 'backfill') AS backfilled FROM x""", "listings"))  # fmt: skip
def prune_counters(spark, sf_dir):
    return lifecycle.prune_counters(_decided(spark, sf_dir))


PAGE = """p AS (SELECT *, CASE WHEN id % 3 = 0 THEN concat('<a href="https://forms.example.org/', id, '?a=1&amp;b=2">Form</a>') END AS html FROM listings)"""


def _with_pages(spark, sf_dir):
    page = F.concat(F.lit('<a href="https://forms.example.org/'), F.col("id").cast("string"), F.lit('?a=1&amp;b=2">Form</a>'))
    return _listings(spark, sf_dir).withColumn("description_html", F.when(F.col("id") % 3 == 0, page))


@query("repair_columns", oracle(f"""
WITH s AS (SELECT *, id % 2 = 0 AS hit, CASE WHEN id % 4 = 0 THEN TIMESTAMP '1999-01-01 00:00:00' WHEN id % 12 = 6 THEN TIMESTAMP '1996-01-01 00:00:00' END AS said FROM listings)
SELECT id, CASE WHEN id % 4 = 0 THEN 'Structured place' ELSE location END AS location, CASE WHEN NOT hit THEN is_paid WHEN id % 6 = 0 THEN false END AS is_paid,
  CASE WHEN NOT hit THEN stipend_text WHEN id % 10 = 0 THEN 'ETB 900' END AS stipend_text,
  CASE WHEN apply_url IS NULL AND id % 6 = 0 THEN concat('https://Forms.example.org/', id, '?a=1&b=2/') ELSE apply_url END AS apply_url,
  strftime(CASE WHEN hit THEN coalesce(said, deadline) ELSE deadline END, '%Y-%m-%d') AS deadline,
  CASE WHEN NOT hit THEN status WHEN coalesce(said, deadline) < {NOW} THEN 'expired' WHEN id % 14 = 0 THEN 'hidden' ELSE 'active' END AS status,
  CASE WHEN hit AND org_name = 'Unknown' THEN concat('Named ', id) ELSE org_name END AS org_name FROM s"""))  # fmt: skip
def repair_columns(spark, sf_dir):
    rows, k = _with_pages(spark, sf_dir), F.col("id")
    n = k.cast("string")
    given = F.when(k % 6 == 0, F.concat(F.lit("https://Forms.example.org/"), n, F.lit("?a=1&b=2/"))).when(k % 4 == 0, "https://apply.example.org/x")
    structured = rows.where("id % 2 = 0").select(
        "id", F.when(k % 4 == 0, "Structured place").otherwise("").alias("location"), F.when(k % 6 == 0, False).alias("is_paid"), F.when(k % 10 == 0, "ETB 900").alias("stipend_text"), given.alias("apply_url"),
        F.when(k % 4 == 0, F.lit("1999-01-01").cast("timestamp")).when(k % 12 == 6, F.lit("1996-01-01").cast("timestamp")).alias("deadline"), (k % 14 != 0).alias("realistic"),
        F.concat(F.lit(" Named "), n).alias("org_name"),
    )
    fixed = lifecycle.repair_columns(rows, structured, AS_OF)
    return fixed.select("id", "location", "is_paid", "stipend_text", "apply_url", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"), "status", "org_name")


@query("reextract_diff", oracle(f"""
WITH n AS (SELECT id, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN description ELSE description || '!' END AS text, CASE WHEN id % 3 = 0 THEN NULL ELSE location END AS location,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN {NOW} + INTERVAL 1 DAY WHEN id % 5 = 2 THEN {NOW} - INTERVAL 1 DAY ELSE deadline END AS deadline FROM listings),
c AS (SELECT l.id, coalesce(nullif(n.text, ''), l.description) AS text, n.location, coalesce(n.deadline, l.deadline) AS deadline, l.status, l.deadline AS old, list_filter([
  CASE WHEN coalesce(nullif(n.text, ''), l.description) <> l.description THEN 'description_text' END, CASE WHEN n.location IS DISTINCT FROM l.location THEN 'location' END,
  CASE WHEN coalesce(n.deadline, l.deadline) IS DISTINCT FROM l.deadline THEN 'deadline' END], lambda x: x IS NOT NULL) AS changed FROM listings l JOIN n ON n.id = l.id WHERE source LIKE 'generic:%')
SELECT id, array_to_string(changed, ',') AS changed, text, location, CASE WHEN deadline IS NOT DISTINCT FROM old THEN status WHEN deadline < {NOW} THEN 'expired' ELSE 'active' END AS status,
  concat('{{"keep":1,"scraped":{{"a":', id, ',"b":2}}}}') AS raw FROM c WHERE len(changed) > 0"""))  # fmt: skip
def reextract_diff(spark, sf_dir):
    k, text, now = F.col("id"), F.col("description_text"), F.lit(AS_OF).cast("timestamp")
    old = _listings(spark, sf_dir).withColumnRenamed("description", "description_text").withColumn("raw", F.lit('{"keep":1,"scraped":{"a":0,"b":2}}'))
    new = old.select(
        "id", F.when(k % 4 == 0, "").when(k % 4 == 2, text).when(k % 4 == 3, F.concat(text, F.lit("!"))).alias("description_text"), F.when(k % 3 != 0, F.col("location")).alias("location"),
        F.when(k % 5 == 1, F.timestamp_add("DAY", F.lit(1), now)).when(k % 5 == 2, F.timestamp_add("DAY", F.lit(-1), now)).when(k % 5 > 2, F.col("deadline")).alias("deadline"),
        F.concat(F.lit('{"a":'), k.cast("string"), F.lit("}")).alias("raw"),
    )
    found = lifecycle.reextract_diff(old, new, ("description_text", "location", "deadline"), AS_OF)
    return found.select("id", F.array_join("changed", ",").alias("changed"), F.col("description_text").alias("text"), "location", "status", "raw")


@query("fix_apply_urls", oracle("""
SELECT id, CASE WHEN id % 2 = 0 THEN concat('https://found.example.org/', id) WHEN id % 9 = 1 THEN apply_url END AS apply_url FROM listings"""))
def fix_apply_urls(spark, sf_dir):
    """Half of the pages have an address; of the others, those stay that the text holds, in capitals."""
    n = F.col("id").cast("string")
    stands = F.when(F.col("id") % 9 == 1, F.concat(F.lit("Apply: HTTPS://APPLY.example.org/"), n, F.lit("/ now"))).otherwise(F.col("description"))
    rows = _with_pages(spark, sf_dir).withColumn("description", stands)
    found = rows.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://found.example.org/"), n)).alias("url"))
    return lifecycle.fix_apply_urls(rows, found).select("id", "apply_url")


@query("reader_sections", oracle("SELECT id, CASE id % 5 WHEN 0 THEN 'Duties=a+b|' WHEN 2 THEN '=|x;Terms=y+ |z' END AS sections FROM listings"))
def reader_sections(spark, sf_dir):
    """Sections as payloads hold them: with numbers and nulls among the strings, empty ones, and none."""
    k = F.col("id") % 5
    raw = (
        F.when(k == 0, '[{"title":"Duties","paragraphs":["a",1,"b"]},{"title":"","bullets":[]},7]').when(k == 1, '[{"title":5,"paragraphs":[1,null],"bullets":"x"},null]')
        .when(k == 2, '[{"bullets":["x"]},{"title":"Terms","paragraphs":["y"," "],"bullets":["z",{}]}]').when(k == 3, '{"title":"no list"}').otherwise("not json")
    )
    kept = _listings(spark, sf_dir).select("id", lifecycle.reader_sections(F.try_parse_json(raw)).alias("s"))
    told = lambda s: F.concat(s["title"], F.lit("="), F.array_join(s["paragraphs"], "+"), F.lit("|"), F.array_join(s["bullets"], "+"))
    return kept.select("id", F.array_join(F.transform("s", told), ";").alias("sections"))


# Event rules.


@query("rate_limited", """
WITH w AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, n <= 2 AS accepted FROM w""")
def rate_limited(spark, sf_dir):
    rows = base(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.rate_limited(rows, "user_id", "ts", "event_id", most=2, window="1 hour").select("event_id", "accepted")


@query("rate_windows", """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS tm FROM events), t AS (SELECT DISTINCT user_id, tm FROM e),
n AS (SELECT a.user_id, a.tm, min(b.tm) AS nxt FROM t a JOIN t b ON b.user_id = a.user_id AND b.tm >= a.tm + 86400000000 GROUP BY ALL),
o AS (SELECT user_id, min(tm) AS tm FROM t GROUP BY ALL UNION ALL SELECT n.user_id, n.nxt FROM o JOIN n ON n.user_id = o.user_id AND n.tm = o.tm),
w AS (SELECT e.event_id, row_number() OVER (PARTITION BY e.user_id, x.tm ORDER BY e.tm, event_id) AS n FROM e ASOF JOIN o x ON x.user_id = e.user_id AND x.tm <= e.tm)
SELECT event_id, n <= 1 AS accepted FROM w""")  # fmt: skip
def rate_windows(spark, sf_dir):
    """The limiter's own windows, which open with a user's first event: one event a day."""
    rows = base(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return events.first_event_windows(rows, "user_id", "ts", "event_id", most=1, window=86400.0).select("event_id", "accepted")


@query("ip_country", """
WITH r AS (SELECT n_nationkey * 1000 AS lo, n_nationkey * 1000 + CASE WHEN n_nationkey % 3 = 0 THEN 499 ELSE 999 END AS hi, n_name AS country FROM nation)
SELECT o_orderkey AS id, country FROM orders LEFT JOIN r ON (o_orderkey * 37) % 27000 BETWEEN lo AND hi""")
def ip_country(spark, sf_dir):
    hi = F.col("n_nationkey") * 1000 + F.when(F.col("n_nationkey") % 3 == 0, 499).otherwise(999)
    ranges = base(spark, sf_dir, "nation").select((F.col("n_nationkey") * 1000).cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), F.col("n_name").alias("country"))
    addresses = base(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 37) % 27000).alias("ip"))
    return events.ip_country(addresses, ranges).select("id", "country")
