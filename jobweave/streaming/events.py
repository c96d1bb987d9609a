"""Streams of page events: ingest, daily visitors, and who is here now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.operators.events import ip_country, visitor_hash
from jobweave.operators.gates import device_class, is_bot
from jobweave.streaming.limiter import MOST, limit, replay

TYPES = ("pageview", "listing_view", "apply_click")
# Lengths of the fields, form of a listing's id, and how far the board's day is ahead of UTC.
PATH, REF = 200, 80
LISTING_ID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
AHEAD_HOURS = 3


def clean_events(requests: DataFrame, ranges: DataFrame | None = None, most: int | None = MOST, late: str | None = "1 minute") -> DataFrame:
    """Requests (id, ts, type, path, listing_id, ref, ip, agent) as event rows: programs and unknown types go, views and
    clicks of a listing go whose listing id is none, and so do those beyond ``most`` of an address in a minute (None: no
    limit); fields are cut to their lengths, broken listing ids of page views become null, and the address leaves only a daily hash.

    ``ranges`` (lo, hi, country over the number of the address in ip_number) adds the country; on a stream it
    is joined as a static table.  ``late`` is how late an event of a limited stream may come; None: the stream has its own
    watermark.  The limiter hands its event time on, so daily_traffic() and live_now() can follow in the same query.
    """
    is_id = F.coalesce(F.col("listing_id").rlike(LISTING_ID), F.lit(False))
    kept = requests.where(~is_bot(F.col("agent")) & F.col("type").isin(*TYPES) & ((F.col("type") == "pageview") | is_id))
    if most is not None:
        limited = limit(kept, key="ip", most=most, late=late) if kept.isStreaming else replay(kept, key="ip", most=most)
        kept = limited.where("accepted").drop("accepted")
    day = F.to_date("ts")
    out = kept.select(
        "id", "ts", "type", F.substring("path", 1, PATH).alias("path"), F.when(F.col("listing_id").rlike(LISTING_ID), F.col("listing_id")).alias("listing_id"), F.substring("ref", 1, REF).alias("ref"),
        device_class(F.col("agent")).alias("device"), visitor_hash(day, F.col("ip"), F.col("agent")).alias("visitor_hash"), *(["ip_number"] if ranges is not None else []),
    )
    if ranges is None:
        return out.withColumn("country", F.lit(None).cast("string"))
    if out.isStreaming:
        within = (F.col("ip_number") >= F.col("lo")) & (F.col("ip_number") <= F.col("hi")) & (F.shiftright("ip_number", 16) == F.col("b"))
        spread = ranges.select("lo", "hi", "country", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))).alias("b"))
        return out.join(spread, within, "left").drop("lo", "hi", "b", "ip_number")
    return ip_country(out.withColumnRenamed("ip_number", "ip"), ranges).drop("ip")


def _marked(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late else events


def limited_traffic(requests: DataFrame, most: int | None = MOST, late: str = "1 day") -> DataFrame:
    """Daily views and visitors straight from requests, in one query: the limiter's keyed state, then the windows, under one watermark."""
    return daily_traffic(clean_events(requests.withWatermark("ts", late), most=most, late=None), late=None)


def daily_traffic(events: DataFrame, late: str | None = "1 day") -> DataFrame:
    """day (of the board's time zone), views and visitors of page views.  A day's visitors are counted once each, so
    state holds a row for each visitor of the days within the watermark (``late`` None: that of the stream)."""
    views = _marked(events.where("type = 'pageview'"), late)
    start = f"{24 - AHEAD_HOURS} hours"
    each = views.groupBy(F.window("ts", "1 day", startTime=start).alias("w"), "visitor_hash").agg(F.count(F.lit(1)).alias("n"))
    days = each.groupBy(F.window(F.window_time("w"), "1 day", startTime=start).alias("w")).agg(F.sum("n").alias("views"), F.count("visitor_hash").alias("visitors"))
    return days.select(F.to_date(F.col("w.end") - F.expr("INTERVAL 1 HOUR")).alias("day"), "views", "visitors")


def live_now(events: DataFrame, late: str | None = "10 minutes") -> DataFrame:
    """Visitors (approximately) of the trailing five minutes, for every minute; ``late`` as in daily_traffic()."""
    seen = _marked(events.where(F.col("type").isin(*TYPES)), late)
    counts = seen.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(F.approx_count_distinct("visitor_hash").alias("visitors"))
    return counts.select(F.col("w.end").alias("at"), "visitors")
