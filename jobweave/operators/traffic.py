"""Web-analytics aggregates over the event log.

Every function takes the instant ``as_of`` in place of the clock and reads the window
``(as_of - days, as_of]``.  Several distinct counts in one row are taken from per-visitor
flags: one shuffle by visitor, then sums, with no row multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.config import LOCAL_ZONE


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def within(as_of: str, days: int, ts: str = "ts") -> Column:
    return (F.col(ts) > moment(as_of) - F.expr(f"INTERVAL '{days}' DAY")) & (F.col(ts) <= moment(as_of))


def local(ts: str, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(F.col(ts), zone)


def day_spine(events: DataFrame, as_of: str, days: int, zone: str) -> DataFrame:
    """The last ``days`` local dates up to that of ``as_of``, in the time zone of the buckets."""
    last = F.to_date(F.from_utc_timestamp(moment(as_of), zone))
    return events.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))


def daily_traffic(events: DataFrame, as_of: str, days: int = 30, zone: str = LOCAL_ZONE) -> DataFrame:
    """day, views and visitors of page views for each local date, zero where there were none."""
    seen = events.where(within(as_of, days) & (F.col("type") == "pageview"))
    counts = seen.groupBy(F.to_date(local("ts", zone)).alias("day")).agg(F.count(F.lit(1)).alias("views"), F.count_distinct("visitor_hash").alias("visitors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return day_spine(events, as_of, days, zone).join(counts, "day", "left").select("day", zero("views"), zero("visitors"))


def _flags(events: DataFrame, flags: dict[str, Column], counts: dict[str, Column]) -> DataFrame:
    """One row: how many visitors have each flag on any event, and how many events meet each count."""
    per_visitor = events.groupBy("visitor_hash").agg(
        *[F.max(F.when(c, 1).otherwise(0)).alias(k) for k, c in flags.items()], *[F.count_if(c).alias(k) for k, c in counts.items()]
    )
    known = F.col("visitor_hash").isNotNull()
    return per_visitor.agg(
        *[F.coalesce(F.sum(F.when(known, F.col(k)).otherwise(0)), F.lit(0)).cast("bigint").alias(k) for k in flags],
        *[F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(k) for k in counts],
    )


def traffic_totals(events: DataFrame, as_of: str) -> DataFrame:
    """Views and visitors of 30 and 7 days, visitors by channel link, and apply clicks, in one row."""
    view, week = F.col("type") == "pageview", within(as_of, 7)
    return _flags(
        events.where(within(as_of, 30) & F.col("type").isin("pageview", "apply_click")),
        {"visitors30": view, "visitors7": view & week, "tg30": view & (F.col("ref") == "tg")},
        {"views30": view, "views7": view & week, "applies30": F.col("type") == "apply_click"},
    )


def top_listings(events: DataFrame, listings: DataFrame, as_of: str, types: tuple[str, ...], name: str, n: int = 8) -> DataFrame:
    """The listings with most events of these types, by title and organisation."""
    seen = events.where(within(as_of, 30) & F.col("type").isin(*types) & F.col("listing_id").isNotNull()).select("listing_id")
    # Counted by listing before the join, so that the join sees one row a listing.
    counts = seen.groupBy("listing_id").count()
    named = counts.join(listings.select(F.col("id").alias("listing_id"), "title", F.col("org_name").alias("org")), "listing_id")
    return named.groupBy("title", "org").agg(F.sum("count").alias(name)).orderBy(F.col(name).desc(), "title", "org").limit(n)


def visitors_by(events: DataFrame, as_of: str, column: str, default: str | None, n: int | None = None) -> DataFrame:
    """Distinct visitors of page views by a dimension; without a default its nulls are left out."""
    seen = events.where(within(as_of, 30) & (F.col("type") == "pageview"))
    key = F.col(column) if default is None else F.coalesce(column, F.lit(default))
    counts = (seen.where(F.col(column).isNotNull()) if default is None else seen).groupBy(key.alias(column)).agg(F.count_distinct("visitor_hash").alias("visitors"))
    ordered = counts.orderBy(F.col("visitors").desc(), column)
    return ordered.limit(n) if n else ordered


def activity_heatmap(events: DataFrame, as_of: str, zone: str = LOCAL_ZONE) -> DataFrame:
    """Events by ISO weekday and hour of local time, all 168 cells."""
    seen = events.where(within(as_of, 30) & F.col("type").isin("pageview", "listing_view", "apply_click"))
    at = local("ts", zone)
    counts = seen.groupBy((F.weekday(at) + 1).alias("dow"), F.hour(at).alias("hr")).agg(F.count(F.lit(1)).alias("n"))
    grid = events.sparkSession.range(168).select((F.floor(F.col("id") / 24) + 1).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hr"))
    return grid.join(counts, ["dow", "hr"], "left").select("dow", "hr", F.coalesce("n", F.lit(0)).alias("n"))


def funnel(events: DataFrame, as_of: str) -> DataFrame:
    """Visitors who arrived, opened a listing and clicked apply, with the rate of each step."""
    view = F.col("type") == "pageview"
    steps = _flags(
        events.where(within(as_of, 30)),
        {"visited": view, "opened": (F.col("type") == "listing_view") | (view & F.col("listing_id").isNotNull()), "applied": F.col("type") == "apply_click"},
        {},
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return steps.withColumn("open_rate", rate("opened", "visited")).withColumn("apply_rate", rate("applied", "opened"))


def channel_counters(events: DataFrame, as_of: str) -> DataFrame:
    save = F.col("type") == "tg_save"
    return events.where(within(as_of, 30)).agg(
        F.count_if(F.col("type") == "tg_subscribe").alias("subs30"), F.count_if(save).alias("saves30"),
        F.count_if(save & (F.col("ref") == "deeplink")).alias("saves_deeplink"),
    )


def channel_performance(events: DataFrame, listings: DataFrame, as_of: str, n: int = 8) -> DataFrame:
    """Reads through channel links and saves of each listing, by their total."""
    read, save = (F.col("type") == "pageview") & (F.col("ref") == "tg"), F.col("type") == "tg_save"
    seen = events.where(within(as_of, 30) & (read | save) & F.col("listing_id").isNotNull())
    counts = seen.groupBy("listing_id").agg(F.count_if(read).alias("r"), F.count_if(save).alias("s"))
    named = counts.join(listings.select(F.col("id").alias("listing_id"), "title", F.col("org_name").alias("org")), "listing_id")
    totals = named.groupBy("title", "org").agg(F.sum("r").alias("reads"), F.sum("s").alias("saves"))
    return totals.orderBy((F.col("reads") + F.col("saves")).desc(), "title", "org").limit(n)


def subscriber_growth(subscribers: DataFrame, as_of: str, days: int = 30, zone: str = LOCAL_ZONE) -> DataFrame:
    """Subscribers in total at the end of each local date of the window."""
    spine = day_spine(subscribers, as_of, days, zone)
    recent = within(as_of, days, "joined_at")
    before = subscribers.where(F.col("joined_at") <= moment(as_of) - F.expr(f"INTERVAL '{days}' DAY")).agg(F.count(F.lit(1)).alias("base"))
    daily = subscribers.where(recent).groupBy(F.to_date(local("joined_at", zone)).alias("day")).count()
    running = F.sum(F.coalesce("count", F.lit(0))).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    # The spine has a fixed number of rows, so an unpartitioned window over it is no bottleneck.
    return spine.join(daily, "day", "left").crossJoin(F.broadcast(before)).select("day", (F.col("base") + running).alias("total"))


def live_now(events: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    recent = (F.col("ts") > moment(as_of) - F.expr(f"INTERVAL '{minutes}' MINUTE")) & (F.col("ts") <= moment(as_of))
    return events.where(recent & F.col("type").isin("pageview", "listing_view", "apply_click")).agg(F.count_distinct("visitor_hash").alias("visitors"))


def country_intensity(countries: DataFrame) -> DataFrame:
    """Shade of each country: a quarter, and the rest by its share of the largest."""
    top = countries.agg(F.max("visitors").alias("top"))
    return countries.crossJoin(F.broadcast(top)).select("country", "visitors", (0.25 + 0.75 * F.col("visitors") / F.greatest("top", F.lit(1))).alias("intensity"))
