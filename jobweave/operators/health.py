"""State of the catalogue, of the pipeline's runs and of the boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.config import CHANNEL_FIT
from jobweave.operators.traffic import moment


def has_key(raw: Column, key: str) -> Column:
    """Whether a JSON object has a key at the top; not for a null or broken object."""
    return F.coalesce(F.array_contains(F.json_object_keys(raw), key), F.lit(False))


def active_by_source(listings: DataFrame) -> DataFrame:
    return listings.where("status = 'active'").groupBy("source").agg(F.count(F.lit(1)).alias("active")).orderBy(F.col("active").desc(), "source")


def product_counts(listings: DataFrame, subscribers: DataFrame, bookmarks: DataFrame, reminders: DataFrame) -> DataFrame:
    """Five independent counts in one row."""
    one = lambda df, name: F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))
    both = listings.agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if("posted_to_channel").alias("posted"))
    return both.crossJoin(one(subscribers, "subscribers")).crossJoin(one(bookmarks, "bookmarks")).crossJoin(one(reminders, "reminders"))


def catalog_health(listings: DataFrame, events: DataFrame) -> DataFrame:
    """Listings by status, how many active ones are structured or can be applied to, and the channel's backlog."""
    active = F.col("status") == "active"
    row = listings.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("active", "expired", "hidden")],
        F.count_if(active & has_key(F.col("raw"), "structured")).alias("structured"),
        F.count_if(active & F.col("apply_url").isNotNull()).alias("with_apply"),
        F.count_if(active & (F.col("fit_score") >= CHANNEL_FIT) & ~F.col("posted_to_channel")).alias("backlog"),
    ).crossJoin(F.broadcast(events.agg(F.count(F.lit(1)).alias("events"))))
    share = lambda c: F.when(F.col("active") > 0, F.floor(100.0 * F.col(c) / F.col("active") + 0.5)).otherwise(0).cast("bigint")
    return row.withColumn("structured_pct", share("structured")).withColumn("apply_pct", share("with_apply"))


def board_summary(listings: DataFrame, as_of: str) -> DataFrame:
    """Size of a board, its mean fit, unpaid listings, and those that close within a week."""
    soon = (F.col("deadline") >= moment(as_of)) & (F.col("deadline") <= moment(as_of) + F.expr("INTERVAL '7' DAY"))
    return listings.agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.floor(F.avg("fit_score") + 0.5), F.lit(0)).cast("bigint").alias("mean_fit"),
        F.count_if(F.col("is_paid") == False).alias("unpaid"), F.count_if(soon).alias("closing_soon"),  # noqa: E712
    )


def run_log(org_stats: DataFrame, source: str = "orgs") -> DataFrame:
    """One row per run from the statistics of its organisations: totals, and the organisations as an array.

    ``org_stats``: run_id, slug, adapter, scraped, kept, new_rows, errors, duration_ms, error, started_at, finished_at.
    An organisation that could not be read at all (error) counts one error, besides those of its rows.
    """
    one = F.struct("slug", "adapter", "scraped", "kept", "new_rows", "errors", "duration_ms", "error")
    return org_stats.groupBy("run_id").agg(
        F.lit(source).alias("source"), F.min("started_at").alias("started_at"),
        F.when(F.count("finished_at") == F.count(F.lit(1)), F.max("finished_at")).alias("finished_at"),
        F.sum("scraped").alias("scraped_count"), F.sum("kept").alias("kept_count"), F.sum("new_rows").alias("new_count"), F.sum(F.col("kept") - F.col("new_rows")).alias("updated_count"),
        (F.sum("errors") + F.count("error")).alias("error_count"), F.array_sort(F.collect_list(one)).alias("orgs"),
    )


def run_org_stats(runs: DataFrame, n: int = 10) -> DataFrame:
    """The organisations of the latest run over organisations that logged them, even if none: most errors first, then slowest."""
    latest = runs.where((F.col("source") == "orgs") & F.col("orgs").isNotNull()).orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(1)
    each = latest.select(F.explode("orgs").alias("o")).select("o.slug", "o.adapter", "o.errors", "o.kept", F.col("o.duration_ms").alias("ms"))
    return each.orderBy(F.col("errors").desc(), F.col("ms").desc(), "slug").limit(n)


def recent_runs(runs: DataFrame, n: int = 15) -> DataFrame:
    """The latest runs with their duration in seconds, null while a run is under way."""
    seconds = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(n).select(
        "run_id", "source", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started"), seconds.alias("secs"), "new_count", "updated_count", "error_count"
    )
