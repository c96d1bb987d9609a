"""How the large tables lie: events in a folder a day, listings in buckets of their identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the listings table: a power of two, so that another number of tasks divides it evenly.
BUCKETS = 256


def write_events(events: DataFrame, path: str) -> None:
    """Events partitioned by their UTC day; each day's rows are spread over tasks before they are written, so no day is one task's."""
    day = events.withColumn("day", F.to_date("ts"))
    day.repartition("day", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("day", "ts").write.partitionBy("day").mode("append").parquet(path)


def read_events(spark, path: str, as_of: str, days: int) -> DataFrame:
    """The events of the last ``days`` days up to ``as_of``: only the folders of these days are listed and read."""
    last = F.lit(as_of).cast("timestamp")
    first = last - F.expr(f"INTERVAL '{days}' DAY")
    return spark.read.parquet(path).where(F.col("day").between(F.to_date(first), F.to_date(last)) & (F.col("ts") > first) & (F.col("ts") <= last))


def write_listings(listings: DataFrame, table: str, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Listings as a table bucketed and sorted by id: a join or count by id deals only the other side."""
    listings.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").mode(mode).saveAsTable(table)


def by_listing(events: DataFrame, listings: DataFrame) -> DataFrame:
    """Events counted by listing and joined with a bucketed table of listings, which stays where it lies."""
    counts = events.where(F.col("listing_id").isNotNull()).groupBy(F.col("listing_id").alias("id")).agg(F.count(F.lit(1)).alias("events"))
    return listings.join(counts, "id")
