"""Sketches of visitors against exact counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobweave.operators import sketches, traffic

AS_OF = "2024-03-31 00:00:00"


def _events(spark, n=200_000):
    kinds = F.when(F.col("id") % 5 == 0, "apply_click").when(F.col("id") % 3 == 0, "listing_view").otherwise("pageview")
    return spark.range(n).select(
        "id", F.timestamp_add("SECOND", -(F.col("id") * 13 % 2_500_000).cast("int"), F.lit(AS_OF).cast("timestamp")).alias("ts"), kinds.alias("type"), (F.col("id") * 7919 % 60_000).alias("visitor_hash"),
        F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("r"), (F.col("id") % 3).cast("string"))).alias("ref"), F.lit("mobile").alias("device"), F.lit(None).cast("string").alias("country"),
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("listing_id"),
    )


def test_error_and_size(spark):
    events = _events(spark)
    stored = sketches.daily_sketches(events).cache()
    # A row a day and value, whatever the number of events.
    assert stored.where("dimension = 'all'").count() <= 31 and stored.where("dimension = 'country'").count() == 0
    assert stored.select(F.max(F.length("visitors"))).first()[0] <= (1 << sketches.REGISTERS_LOG2) + 64
    seen = events.where((F.col("ts") > dt.datetime(2024, 3, 1, 21)) & (F.col("type") == "pageview"))
    exact = seen.agg(F.count(F.lit(1)), F.count_distinct("visitor_hash")).first()
    told = sketches.visitors_of(stored, AS_OF, 30).where("dimension = 'all'").first()
    assert told["views"] == exact[0] and abs(told["visitors"] - exact[1]) <= sketches.ERROR * exact[1] and exact[1] > 20_000
    refs = {r["value"]: r["visitors"] for r in sketches.visitors_of(stored, AS_OF, 30).where("dimension = 'ref'").collect()}
    assert set(refs) == {"direct", "r1", "r2"}
    funnel, true = sketches.funnel_of(stored, AS_OF).first(), traffic.funnel(events, AS_OF).first()
    assert all(abs(funnel[c] - true[c]) <= 0.06 * true[c] for c in ("visited", "opened", "applied")) and 0 < funnel["apply_rate"] < 1.2


def test_late_events_and_nothing(spark):
    events = _events(spark, 3000)
    whole = sketches.daily_sketches(events)
    merged = sketches.merge_days(sketches.daily_sketches(events.where("id < 2000")), sketches.daily_sketches(events.where("id >= 2000")))
    key = lambda df: {(str(r["day"]), r["dimension"], r["value"], r["views"]): r["n"] for r in df.withColumn("n", F.hll_sketch_estimate("visitors")).drop("visitors").collect()}
    one, other = key(merged), key(whole)  # the estimate of a union is another one, within the same error
    assert one.keys() == other.keys() and all(abs(n - other[k]) <= max(1, sketches.ERROR * n) for k, n in one.items())
    none = sketches.daily_sketches(events.limit(0))
    assert none.count() == 0 and tuple(sketches.funnel_of(none, AS_OF).first()) == (0, 0, 0, 0.0, 0.0)
