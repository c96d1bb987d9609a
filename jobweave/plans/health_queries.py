"""Catalogue, run log and report queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobweave.operators import health
from jobweave.operators.kept import shared_folder
from jobweave.operators.snapshots import append_run
from jobweave.plans.registry import query
from jobweave.plans.tables import load, oracle



def _listings(spark, sf_dir):
    return load(spark, sf_dir, "listings")


@query("active_by_source", oracle("SELECT source, count(*) AS active FROM listings WHERE status = 'active' GROUP BY 1"))
def active_by_source(spark, sf_dir):
    return health.active_by_source(_listings(spark, sf_dir))


@query("product_counts", oracle("""
SELECT (SELECT count(*) FROM listings WHERE status = 'active') AS active, (SELECT count(*) FROM listings WHERE posted_to_channel) AS posted,
  (SELECT count(*) FROM subscribers) AS subscribers, (SELECT count(*) FROM bookmarks) AS bookmarks,
  (SELECT count(*) FROM bookmarks WHERE listing_id % 2 = 0) AS reminders"""))  # fmt: skip
def product_counts(spark, sf_dir):
    bookmarks = load(spark, sf_dir, "bookmarks")
    return health.product_counts(_listings(spark, sf_dir), load(spark, sf_dir, "subscribers"), bookmarks, bookmarks.where("listing_id % 2 = 0"))


@query("catalog_health", oracle("""
WITH h AS (SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'expired') AS expired, count(*) FILTER (status = 'hidden') AS hidden,
  count(*) FILTER (status = 'active' AND list_contains(json_keys(raw), 'structured')) AS structured,
  count(*) FILTER (status = 'active' AND apply_url IS NOT NULL) AS with_apply,
  count(*) FILTER (status = 'active' AND fit_score >= 70 AND NOT posted_to_channel) AS backlog, (SELECT count(*) FROM page_events) AS events FROM listings)
SELECT *, CAST(CASE WHEN active > 0 THEN floor(100.0 * structured / active + 0.5) ELSE 0 END AS BIGINT) AS structured_pct,
  CAST(CASE WHEN active > 0 THEN floor(100.0 * with_apply / active + 0.5) ELSE 0 END AS BIGINT) AS apply_pct FROM h"""))  # fmt: skip
def catalog_health(spark, sf_dir):
    return health.catalog_health(_listings(spark, sf_dir), load(spark, sf_dir, "page_events"))


BOARD = "1997-01-01 00:00:00"


@query("board_summary", oracle(f"""
SELECT count(*) AS total, CAST(floor(avg(fit_score) + 0.5) AS BIGINT) AS mean_fit, count(*) FILTER (is_paid = false) AS unpaid,
  count(*) FILTER (deadline >= TIMESTAMP '{BOARD}' AND deadline <= TIMESTAMP '{BOARD}' + INTERVAL 7 DAY) AS closing_soon
FROM listings WHERE status = 'active' AND (deadline IS NULL OR deadline >= TIMESTAMP '{BOARD}')"""))  # fmt: skip
def board_summary(spark, sf_dir):
    from jobweave.operators import board

    return health.board_summary(board.live(_listings(spark, sf_dir), BOARD), BOARD)


RUNS = """
runs AS (SELECT run_id, 'orgs' AS source, min(started_at) AS started_at, CASE WHEN count(finished_at) = count(*) THEN max(finished_at) END AS finished_at,
  CAST(sum(scraped) AS BIGINT) AS scraped_count, CAST(sum(new_rows) AS BIGINT) AS new_count, CAST(sum(kept - new_rows) AS BIGINT) AS updated_count,
  CAST(sum(kept) AS BIGINT) AS kept_count, CAST(sum(errors) + count(error) AS BIGINT) AS error_count, count(*) AS n_orgs FROM org_stats GROUP BY run_id)"""


@query("run_log", oracle(f"WITH {RUNS} SELECT run_id, source, scraped_count, kept_count, new_count, updated_count, error_count, n_orgs FROM runs", "org_stats"))
def run_log(spark, sf_dir):
    runs = health.run_log(load(spark, sf_dir, "org_stats"))
    return runs.select("run_id", "source", "scraped_count", "kept_count", "new_count", "updated_count", "error_count", F.size("orgs").cast("bigint").alias("n_orgs"))


@query("run_log_appended", oracle(f"WITH {RUNS} SELECT CAST(run_id AS BIGINT) AS run_id, new_count, error_count, n_orgs FROM runs", "org_stats"))
def run_log_appended(spark, sf_dir):
    """The log as two appends leave it, the first of them run twice."""
    runs = health.run_log(load(spark, sf_dir, "org_stats")).select("run_id", "new_count", "error_count", F.size("orgs").cast("bigint").alias("n_orgs"))
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    for part in ("run_id % 2 = 0", "run_id % 2 = 1", "run_id % 2 = 0"):
        append_run(runs.where(part), path)
    return spark.read.parquet(path).select(F.col("run_id").cast("bigint").alias("run_id"), "new_count", "error_count", "n_orgs")


@query("run_org_stats", oracle(f"""WITH {RUNS}
SELECT slug, adapter, errors, kept, duration_ms AS ms FROM org_stats WHERE run_id = (SELECT run_id FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1)
ORDER BY errors DESC, ms DESC, slug LIMIT 10""", "org_stats"))  # fmt: skip
def run_org_stats(spark, sf_dir):
    return health.run_org_stats(health.run_log(load(spark, sf_dir, "org_stats")))


@query("recent_runs", oracle(f"""WITH {RUNS}
SELECT run_id, source, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started, CAST(epoch(finished_at) - epoch(started_at) AS BIGINT) AS secs, new_count, updated_count, error_count
FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 15""", "org_stats"))  # fmt: skip
def recent_runs(spark, sf_dir):
    return health.recent_runs(health.run_log(load(spark, sf_dir, "org_stats")))


@query("report_cells", oracle("""
WITH h AS (SELECT source, count(*) AS of_n, count(*) FILTER (apply_url IS NOT NULL) AS n, sum(CAST(id AS BIGINT) % 7200)::BIGINT AS secs FROM listings GROUP BY source)
SELECT source, CASE WHEN of_n > 0 THEN concat(CAST(floor(100.0 * n / of_n + 0.5) AS BIGINT), '%') ELSE '—' END AS share,
  CASE WHEN source = 'undp' THEN 'unfinished' WHEN secs < 90 THEN concat(secs, 's') ELSE concat(secs // 60, 'm ', secs % 60, 's') END AS duration FROM h"""))  # fmt: skip
def report_cells(spark, sf_dir):
    from jobweave.sources import report

    counts = _listings(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("of_n"), F.count("apply_url").alias("n"), F.sum(F.col("id") % 7200).alias("secs"))
    return counts.select("source", report.percent(F.col("n"), F.col("of_n")).alias("share"), report.duration(F.when(F.col("source") != "undp", F.col("secs"))).alias("duration"))


