"""Keyed upserts, caches and purges: decisions first, then one merge into a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_object(c: Column) -> Column:
    """Top-level keys of a JSON object with their values in their types; none for what is no object."""
    values = F.try_parse_json(F.coalesce(c, F.lit("{}"))).try_cast("map<string,variant>")
    return F.coalesce(values, F.create_map().cast("map<string,variant>"))


def raw_merge(old: Column, new: Column) -> Column:
    """Top-level merge of two JSON objects as JSON text with sorted keys: the second one's keys win, nested values,
    numbers, booleans and nulls stay what they are."""
    left, right = json_object(old), json_object(new)
    merged = F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged), by_key)))


def last_of_batch(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last to arrive, of equal ones that of the largest content hash.  Rows with a null key all stay."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), F.xxhash64(*batch.columns).desc()))
    keyed = batch.where(F.col(key).isNotNull()).withColumn("_n", newest).where("_n = 1").drop("_n")
    return keyed.unionByName(batch.where(F.col(key).isNull()))


def upsert(table: DataFrame, batch: DataFrame, key: str, order: str, keep: tuple[str, ...] = (), merge_raw: bool = False) -> DataFrame:
    """A new snapshot of ``table``: rows of the batch replace those with their key, but for the columns in ``keep``; others are added.

    A key that occurs more than once in the batch takes its last row by ``order``.  With ``merge_raw`` the
    payload is merged instead of replaced.  Null keys never match and are added.
    """
    new = last_of_batch(batch, key, order).select(*[F.col(c).alias(f"_new_{c}") for c in table.columns], F.lit(True).alias("_hit"))
    both = table.withColumn("_old", F.lit(True)).join(new, F.col(key) == F.col(f"_new_{key}"), "full_outer")

    def value(c: str) -> Column:
        if c in keep:
            return F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_new_{c}"))
        if c == "raw" and merge_raw:
            return F.when(F.col("_old") & F.col("_hit"), raw_merge(F.col(c), F.col("_new_raw"))).when(F.col("_hit"), F.col("_new_raw")).otherwise(F.col(c))
        return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))

    return both.select(*[value(c).alias(c) for c in table.columns])


def upsert_counts(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """new_count and updated_count of the batch's rows by the table before it, and new_keys."""
    known = table.select(key).distinct().withColumn("_known", F.lit(True))
    marked = batch.select(key).join(known, key, "left")
    fresh = F.col("_known").isNull()
    return marked.agg(F.count_if(fresh).alias("new_count"), F.count_if(~fresh).alias("updated_count"), F.count_distinct(F.when(fresh, F.col(key))).alias("new_keys"))


def cache_misses(batch: DataFrame, cache: DataFrame, key: str = "source_url", text: str = "text") -> DataFrame:
    """Batch rows whose content isn't cached under their key (key, content_hash), with the hash: the only rows for an expensive step."""
    hashed = batch.withColumn("content_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    return hashed.join(cache.select(key, "content_hash"), [key, "content_hash"], "left_anti")


def purge_cascade(children: DataFrame, purged_ids: DataFrame, ref: str = "listing_id") -> DataFrame:
    """Child rows whose listing stays."""
    return children.join(purged_ids.select(F.col("id").alias(ref)), ref, "left_anti")


def new_urls(cards: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """Cards that are not known yet, the first of each address by position."""
    first = F.row_number().over(Window.partitionBy(url).orderBy("pos"))
    return cards.join(known.select(url), url, "left_anti").withColumn("_n", first).where("_n = 1").drop("_n")
