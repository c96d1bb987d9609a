"""Analytics queries over the event log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.operators import sketches, traffic
from jobweave.plans.registry import query
from jobweave.plans.tables import EVENTS_AS_OF, load, oracle

NOW = f"TIMESTAMP '{EVENTS_AS_OF}'"
#: The 30-day window, and local time (UTC+3 all year).
IN30, LOCAL = f"ts > {NOW} - INTERVAL 30 DAY AND ts <= {NOW}", "(ts + INTERVAL 3 HOUR)"


def _events(spark, sf_dir):
    return load(spark, sf_dir, "page_events")


def _day(df):
    return df.withColumn("day", F.col("day").cast("string"))


@query("daily_traffic", oracle(f"""
WITH spine AS (SELECT CAST(unnest(generate_series(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
d AS (SELECT CAST({LOCAL} AS DATE) AS day, count(*) AS views, count(DISTINCT visitor_hash) AS visitors FROM page_events WHERE type = 'pageview' AND {IN30} GROUP BY 1)
SELECT CAST(spine.day AS VARCHAR) AS day, coalesce(views, 0) AS views, coalesce(visitors, 0) AS visitors FROM spine LEFT JOIN d ON d.day = spine.day"""))  # fmt: skip
def daily_traffic(spark, sf_dir):
    return _day(traffic.daily_traffic(_events(spark, sf_dir), EVENTS_AS_OF))


@query("sketched_visitors", oracle(f"""
WITH e AS (SELECT *, CAST({LOCAL} AS DATE) AS day FROM page_events), s AS (SELECT * FROM e WHERE day > DATE '2024-01-31' - 30 AND day <= DATE '2024-01-31'),
p AS (SELECT 'all' AS dimension, '' AS value, visitor_hash FROM s WHERE type = 'pageview' UNION ALL SELECT 'ref', coalesce(ref, 'direct'), visitor_hash FROM s WHERE type = 'pageview'
  UNION ALL SELECT 'device', coalesce(device, 'unknown'), visitor_hash FROM s WHERE type = 'pageview' UNION ALL SELECT 'country', country, visitor_hash FROM s WHERE type = 'pageview' AND country IS NOT NULL
  UNION ALL SELECT 'step', 'visited', visitor_hash FROM s WHERE type = 'pageview' UNION ALL SELECT 'step', 'opened', visitor_hash FROM s WHERE type = 'listing_view' OR (type = 'pageview' AND listing_id IS NOT NULL)
  UNION ALL SELECT 'step', 'applied', visitor_hash FROM s WHERE type = 'apply_click')
SELECT dimension, value, count(*) AS views, count(DISTINCT visitor_hash) AS visitors, true AS within_error FROM p GROUP BY ALL"""))  # fmt: skip
def sketched_visitors(spark, sf_dir):
    """Views of 30 days from daily sketches, with the exact visitors beside and whether the estimate keeps its error; sketches of
    even and odd events are stored apart and merged, as those of two days' batches would be."""
    events = _events(spark, sf_dir)
    stored = sketches.merge_days(sketches.daily_sketches(events.where("id % 2 = 0")), sketches.daily_sketches(events.where("id % 2 = 1")))
    told = sketches.visitors_of(stored, EVENTS_AS_OF, 30)
    last = F.to_date(F.from_utc_timestamp(traffic.moment(EVENTS_AS_OF), traffic.LOCAL_ZONE))
    day = F.to_date(traffic.local("ts"))
    view = F.col("type") == "pageview"
    seen = events.where((day > F.date_sub(last, 30)) & (day <= last))
    of = lambda rows, dimension, value: rows.groupBy(F.lit(dimension).alias("dimension"), value.cast("string").alias("value")).agg(F.count_distinct("visitor_hash").alias("exact"))
    exact = [of(seen.where(view), "all", F.lit("")), of(seen.where(view), "ref", F.coalesce("ref", F.lit("direct"))), of(seen.where(view), "device", F.coalesce("device", F.lit("unknown"))),
             of(seen.where(view & F.col("country").isNotNull()), "country", F.col("country")), of(seen.where(view), "step", F.lit("visited")), of(seen.where("type = 'apply_click'"), "step", F.lit("applied")),
             of(seen.where((F.col("type") == "listing_view") | (view & F.col("listing_id").isNotNull())), "step", F.lit("opened"))]
    both = told.join(reduce(DataFrame.unionByName, exact), ["dimension", "value"], "full_outer")
    return both.select("dimension", "value", "views", F.col("exact").alias("visitors"), sketches.within_error(F.col("visitors"), F.col("exact")).alias("within_error"))


@query("traffic_totals", oracle(f"""
SELECT count(*) FILTER (type = 'pageview') AS views30, count(DISTINCT visitor_hash) FILTER (type = 'pageview') AS visitors30,
  count(*) FILTER (type = 'pageview' AND ts > {NOW} - INTERVAL 7 DAY) AS views7,
  count(DISTINCT visitor_hash) FILTER (type = 'pageview' AND ts > {NOW} - INTERVAL 7 DAY) AS visitors7,
  count(DISTINCT visitor_hash) FILTER (type = 'pageview' AND ref = 'tg') AS tg30, count(*) FILTER (type = 'apply_click') AS applies30
FROM page_events WHERE {IN30}"""))  # fmt: skip
def traffic_totals(spark, sf_dir):
    return traffic.traffic_totals(_events(spark, sf_dir), EVENTS_AS_OF)


def _top(types: str, name: str) -> str:
    return oracle(f"""SELECT title, org_name AS org, count(*) AS {name} FROM page_events e JOIN listings l ON l.id = e.listing_id
WHERE e.type IN ({types}) AND {IN30} GROUP BY 1, 2 ORDER BY {name} DESC, title, org LIMIT 8""")


@query("top_viewed", _top("'listing_view', 'pageview'", "views"))
def top_viewed(spark, sf_dir):
    return traffic.top_listings(_events(spark, sf_dir), load(spark, sf_dir, "listings"), EVENTS_AS_OF, ("listing_view", "pageview"), "views")


@query("top_applied", _top("'apply_click'", "clicks"))
def top_applied(spark, sf_dir):
    return traffic.top_listings(_events(spark, sf_dir), load(spark, sf_dir, "listings"), EVENTS_AS_OF, ("apply_click",), "clicks")


def _by(key: str, name: str, more: str = "", limit: str = "") -> str:
    return oracle(f"SELECT {key} AS {name}, count(DISTINCT visitor_hash) AS visitors FROM page_events WHERE type = 'pageview' AND {IN30} {more} GROUP BY 1 ORDER BY 2 DESC, 1 {limit}")


@query("referrers", _by("coalesce(ref, 'direct')", "ref", limit="LIMIT 8"))
def referrers(spark, sf_dir):
    return traffic.visitors_by(_events(spark, sf_dir), EVENTS_AS_OF, "ref", "direct", 8)


@query("devices", _by("coalesce(device, 'unknown')", "device"))
def devices(spark, sf_dir):
    return traffic.visitors_by(_events(spark, sf_dir), EVENTS_AS_OF, "device", "unknown")


@query("countries", _by("country", "country", "AND country IS NOT NULL"))
def countries(spark, sf_dir):
    return traffic.visitors_by(_events(spark, sf_dir), EVENTS_AS_OF, "country", None)


@query("country_intensity", oracle(f"""
WITH c AS (SELECT country, count(DISTINCT visitor_hash) AS visitors FROM page_events WHERE type = 'pageview' AND country IS NOT NULL AND {IN30} GROUP BY 1)
SELECT country, visitors, 0.25::DOUBLE + 0.75::DOUBLE * visitors / greatest((SELECT max(visitors) FROM c), 1) AS intensity FROM c"""))  # fmt: skip
def country_intensity(spark, sf_dir):
    return traffic.country_intensity(countries(spark, sf_dir))


@query("activity_heatmap", oracle(f"""
WITH g AS (SELECT CAST(i // 24 + 1 AS INT) AS dow, CAST(i % 24 AS INT) AS hr FROM range(168) t(i)),
c AS (SELECT isodow({LOCAL}) AS dow, hour({LOCAL}) AS hr, count(*) AS n FROM page_events WHERE type IN ('pageview', 'listing_view', 'apply_click') AND {IN30} GROUP BY 1, 2)
SELECT g.dow, g.hr, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.dow = g.dow AND c.hr = g.hr"""))  # fmt: skip
def activity_heatmap(spark, sf_dir):
    return traffic.activity_heatmap(_events(spark, sf_dir), EVENTS_AS_OF)


@query("funnel", oracle(f"""
WITH f AS (SELECT count(DISTINCT visitor_hash) FILTER (type = 'pageview') AS visited,
  count(DISTINCT visitor_hash) FILTER (type = 'listing_view' OR (type = 'pageview' AND listing_id IS NOT NULL)) AS opened,
  count(DISTINCT visitor_hash) FILTER (type = 'apply_click') AS applied FROM page_events WHERE {IN30})
SELECT *, CASE WHEN visited > 0 THEN opened / visited ELSE 0.0 END AS open_rate, CASE WHEN opened > 0 THEN applied / opened ELSE 0.0 END AS apply_rate FROM f"""))  # fmt: skip
def funnel(spark, sf_dir):
    return traffic.funnel(_events(spark, sf_dir), EVENTS_AS_OF)


@query("channel_counters", oracle(f"""
SELECT count(*) FILTER (type = 'tg_subscribe') AS subs30, count(*) FILTER (type = 'tg_save') AS saves30,
  count(*) FILTER (type = 'tg_save' AND ref = 'deeplink') AS saves_deeplink FROM page_events WHERE {IN30}"""))  # fmt: skip
def channel_counters(spark, sf_dir):
    return traffic.channel_counters(_events(spark, sf_dir), EVENTS_AS_OF)


@query("channel_performance", oracle(f"""
SELECT title, org_name AS org, count(*) FILTER (type = 'pageview' AND ref = 'tg') AS reads, count(*) FILTER (type = 'tg_save') AS saves
FROM page_events e JOIN listings l ON l.id = e.listing_id WHERE {IN30} AND (type = 'tg_save' OR (type = 'pageview' AND ref = 'tg'))
GROUP BY 1, 2 ORDER BY count(*) DESC, title, org LIMIT 8"""))  # fmt: skip
def channel_performance(spark, sf_dir):
    return traffic.channel_performance(_events(spark, sf_dir), load(spark, sf_dir, "listings"), EVENTS_AS_OF)


@query("subscriber_growth", oracle(f"""
WITH spine AS (SELECT CAST(unnest(generate_series(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
d AS (SELECT CAST(joined_at + INTERVAL 3 HOUR AS DATE) AS day, count(*) AS n FROM subscribers WHERE joined_at > {NOW} - INTERVAL 30 DAY AND joined_at <= {NOW} GROUP BY 1)
SELECT CAST(spine.day AS VARCHAR) AS day,
  CAST((SELECT count(*) FROM subscribers WHERE joined_at <= {NOW} - INTERVAL 30 DAY) + sum(coalesce(n, 0)) OVER (ORDER BY spine.day) AS BIGINT) AS total
FROM spine LEFT JOIN d ON d.day = spine.day"""))  # fmt: skip
def subscriber_growth(spark, sf_dir):
    return _day(traffic.subscriber_growth(load(spark, sf_dir, "subscribers"), EVENTS_AS_OF))


LIVE = "2024-01-15 12:00:00"


@query("live_now", oracle(f"""
SELECT count(DISTINCT visitor_hash) AS visitors FROM page_events WHERE ts > TIMESTAMP '{LIVE}' - INTERVAL 5 MINUTE AND ts <= TIMESTAMP '{LIVE}'
AND type IN ('pageview', 'listing_view', 'apply_click')"""))  # fmt: skip
def live_now(spark, sf_dir):
    return traffic.live_now(_events(spark, sf_dir), LIVE)
