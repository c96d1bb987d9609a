"""Rules over single events: limits and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.operators.kept import kept


def rate_limited(events: DataFrame, key: str, ts: str, order: str, most: int = 60, window: str = "60 seconds") -> DataFrame:
    """Events with accepted: the first ``most`` of a key in each window, windows aligned to the epoch.

    first_event_windows() opens windows at a key's first event instead, as the streaming limiter does.
    """
    n = F.row_number().over(Window.partitionBy(key, F.window(ts, window)).orderBy(ts, order))
    return events.withColumn("accepted", n <= most)


#: The state of a bucket in which no window opens.
_NONE = -(1 << 62)


def window_starts(times: DataFrame, length: int) -> DataFrame:
    """Rows (k, b, at: microseconds, b of the bucket of ``length`` that holds them; distinct) to (k, b, opened): where windows
    open, each at the first time of its key that the window before it does not reach.

    A bucket is as long as a window, so at most one opens in it, and what opens in the next bucket follows from that one
    alone: the first time a window's length later, or the bucket's first time where no window reaches into it.  These steps
    are pointers, which double their reach each round, so a key that is busy for n buckets takes log n rounds of equal
    joins on key, bucket and time.  No key and no stretch of time is in one task.
    """
    # Who asks for the first time from x on: all in descending order, times before those that ask for them.
    asked = times.select("k", (F.col("b") + 1).alias("b"), (F.col("at") + length).alias("x"), F.col("at").alias("s"), F.lit(0).alias("side"))
    there = times.select("k", "b", F.col("at").alias("x"), F.lit(None).cast("bigint").alias("s"), F.lit(1).alias("side"))
    bucket = Window.partitionBy("k", "b")
    from_here = F.last(F.when(F.col("side") == 1, F.col("x")), ignorenulls=True).over(bucket.orderBy(F.col("x").desc(), F.col("side").desc()).rowsBetween(Window.unboundedPreceding, 0))
    met = asked.unionByName(there).withColumn("to", from_here).withColumn("busy", F.max("side").over(bucket)).where("side = 0 AND busy = 1")
    first = kept(times.groupBy("k", "b").agg(F.min("at").alias("first")))
    following = first.select("k", (F.col("b") - 1).alias("b"), F.lit(_NONE).alias("s"), F.col("b").alias("tb"), F.col("first").alias("to"))
    steps = kept(met.select("k", (F.col("b") - 1).alias("b"), "s", F.col("b").alias("tb"), F.coalesce("to", F.lit(_NONE)).alias("to")).unionByName(following))
    reached = first.join(first.select("k", (F.col("b") + 1).alias("b")), ["k", "b"], "left_anti").select("k", "b", F.col("first").alias("s"))
    # Only where a chain begins and where a step leads to can a window open.
    ends = steps.select("k", F.col("tb").alias("b"), F.col("to").alias("s")).unionByName(reached).distinct()
    steps = kept(steps.join(ends, ["k", "b", "s"], "left_semi"))
    reached = kept(reached)
    while not steps.isEmpty():
        reached = kept(reached.unionByName(reached.join(steps, ["k", "b", "s"]).select("k", F.col("tb").alias("b"), F.col("to").alias("s"))))
        on = steps.select("k", F.col("b").alias("tb"), F.col("s").alias("to"), F.col("tb").alias("_tb"), F.col("to").alias("_to"))
        steps = kept(steps.join(on, ["k", "tb", "to"]).select("k", "b", "s", F.col("_tb").alias("tb"), F.col("_to").alias("to")))
    return reached.where(F.col("s") != _NONE).select("k", "b", F.col("s").alias("opened"))


def first_event_windows(events: DataFrame, key: str, ts: str, order: str, most: int = 60, window: float = 60.0) -> DataFrame:
    """Events with accepted: the first ``most`` by time and ``order`` of each window of ``window`` seconds.  A key's window opens with
    its first event, the next one with the first event after it has passed.

    ``order`` tells apart events of equal time; events that tie in both count as one.  Events without a key or a time get null.
    An accepted column of the input is replaced.
    """
    length = round(window * 1_000_000)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.drop("accepted").withColumn("_k", F.col(key)).withColumn("_at", at).withColumn("_b", ((at - F.pmod(at, F.lit(length))) / length).cast("bigint"))
    times = rows.where("_k IS NOT NULL AND _at IS NOT NULL").select(F.col("_k").alias("k"), F.col("_b").alias("b"), F.col("_at").alias("at")).distinct()
    opened = window_starts(kept(times), length)
    none = F.lit(None).cast("bigint")
    own = opened.select("k", "b", F.col("opened").alias("own"), none.alias("before"))
    after = opened.select("k", (F.col("b") + 1).alias("b"), none.alias("own"), F.col("opened").alias("before"))
    spans = kept(own.unionByName(after).groupBy("k", "b").agg(F.max("own").alias("_own"), F.max("before").alias("_before")).withColumnsRenamed({"k": "_k", "b": "_b"}))
    placed = rows.join(spans, ["_k", "_b"], "left").withColumn("_opened", F.when(F.col("_at") >= F.col("_own"), F.col("_own")).otherwise(F.col("_before")))
    # The last event that a window takes; only so many of each window leave a task.
    place = F.row_number().over(Window.partitionBy("_k", "_opened").orderBy("_at", order))
    narrow = placed.where("_opened IS NOT NULL").select("_k", "_opened", "_at", F.col(order)).distinct()
    last = narrow.withColumn("_n", place).where(F.col("_n") == most).select("_k", "_opened", F.struct("_at", F.col(order).alias("_order")).alias("_last"))
    told = placed.join(last, ["_k", "_opened"], "left") if most > 0 else placed.withColumn("_last", F.lit(None))
    within = F.col("_last").isNull() | (F.struct("_at", F.col(order).alias("_order")) <= F.col("_last")) if most > 0 else F.lit(False)
    return told.select(*[c for c in events.columns if c != "accepted"], F.when(F.col("_opened").isNotNull(), within).alias("accepted"))


def ip_country(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """Addresses (ip as a number) with the country of the range (lo, hi, country; disjoint) that holds them, or null.

    Each different number is looked up once: range starts and numbers are merged in order within buckets of 2^16 numbers,
    and each number takes the last start at or before it if that range reaches so far.  A range that spans buckets is
    entered in each, so a bucket holds at most 2^16 numbers and as many starts, however many addresses it has; the
    addresses then meet their numbers in an equal join, which splits what is asked very often.
    """
    bucket = lambda c: F.shiftright(c.cast("bigint"), 16)
    spread = ranges.select("lo", "hi", "country", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))).alias("b"))
    starts = spread.select("b", F.greatest("lo", F.shiftleft("b", 16)).alias("at"), F.struct("hi", "country").alias("r"), F.lit(0).alias("side"))
    numbers = addresses.select(F.col("ip").cast("bigint").alias("at")).where("at IS NOT NULL").distinct()
    asked = numbers.select(bucket(F.col("at")).alias("b"), "at", F.lit(None).cast(starts.schema["r"].dataType).alias("r"), F.lit(1).alias("side"))
    latest = F.last("r", ignorenulls=True).over(Window.partitionBy("b").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    found = starts.unionByName(asked).withColumn("r", latest).where("side = 1").select(F.col("at").alias("_at"), F.when(F.col("at") <= F.col("r.hi"), F.col("r.country")).alias("_country"))
    return addresses.drop("country").join(found, F.col("ip").cast("bigint") == F.col("_at"), "left").drop("_at").withColumnRenamed("_country", "country")


def visitor_hash(day: Column, ip: Column, agent: Column) -> Column:
    """A visitor's identity for one day; nulls count as empty."""
    return F.sha2(F.concat_ws(":", day.cast("string"), F.coalesce(ip, F.lit("")), F.coalesce(agent, F.lit(""))), 256)
