"""Visitors of any span of days from sketches stored by day: mergeable, of fixed size, with a known error.

A row holds a day's views and a HyperLogLog sketch of its visitors for one value of one
dimension.  Thirty days are thirty rows a value, however many events they had.  With 2^12
registers the standard error is 1.04 / 64 = 1.6 %; ERROR is three of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.config import LOCAL_ZONE
from jobweave.operators.traffic import local, moment

REGISTERS_LOG2, ERROR = 12, 0.049
#: Dimensions of page views, with what stands for their nulls (None: nulls are left out).
DIMENSIONS: dict[str, str | None] = {"ref": "direct", "device": "unknown", "country": None}


def daily_sketches(events: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """day (local), dimension, value, views and visitors (sketch), in one pass.

    The dimensions of page views are ref, device, country and all (value ''), and the funnel's steps visited, opened and
    applied are values of the dimension step.  Sketches are merged where the events are before any row moves.
    """
    view = F.col("type") == "pageview"
    one = lambda dimension, value, when: F.when(when, F.struct(F.lit(dimension).alias("dimension"), value.cast("string").alias("value")))
    parts = [one("all", F.lit(""), view)]
    for name, default in DIMENSIONS.items():
        value = F.col(name) if default is None else F.coalesce(name, F.lit(default))
        parts.append(one(name, value, view & value.isNotNull()))
    opened = (F.col("type") == "listing_view") | (view & F.col("listing_id").isNotNull())
    parts += [one("step", F.lit(s), when) for s, when in (("visited", view), ("opened", opened), ("applied", F.col("type") == "apply_click"))]
    rows = events.select(F.to_date(local("ts", zone)).alias("day"), F.col("visitor_hash").cast("string").alias("v"), F.explode(F.array_compact(F.array(*parts))).alias("p"))
    return rows.groupBy("day", "p.dimension", "p.value").agg(F.count(F.lit(1)).alias("views"), F.hll_sketch_agg("v", F.lit(REGISTERS_LOG2)).alias("visitors"))


def merge_days(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored sketches with those of further events, late ones of known days among them."""
    both = stored.unionByName(fresh)
    return both.groupBy("day", "dimension", "value").agg(F.sum("views").alias("views"), F.hll_union_agg("visitors").alias("visitors"))


def visitors_of(sketches: DataFrame, as_of: str, days: int, zone: str = LOCAL_ZONE) -> DataFrame:
    """dimension, value, views and visitors (estimated) of the last ``days`` local days up to that of ``as_of``."""
    last = F.to_date(F.from_utc_timestamp(moment(as_of), zone))
    seen = sketches.where((F.col("day") > F.date_sub(last, days)) & (F.col("day") <= last))
    return seen.groupBy("dimension", "value").agg(F.sum("views").alias("views"), F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("visitors"))


def funnel_of(sketches: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """visited, opened and applied (estimated) with the rates of the steps, in one row."""
    steps = visitors_of(sketches, as_of, days).where("dimension = 'step'")
    n = lambda s: F.coalesce(F.max(F.when(F.col("value") == s, F.col("visitors"))), F.lit(0)).alias(s)
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return steps.agg(n("visited"), n("opened"), n("applied")).withColumn("open_rate", rate("opened", "visited")).withColumn("apply_rate", rate("applied", "opened"))


def within_error(estimate: Column, exact: Column) -> Column:
    """Whether an estimate keeps the stated error; small counts may be off by one."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * ERROR)
