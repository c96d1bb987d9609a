"""Connected components of a link table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a session on one machine may lack that setting, and gets a folder of its own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None and not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-")


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, with their lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a few numbers that a task of a small table holds.
ROWS = 100_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """The same rows in as many tasks as ``rows`` narrow rows need: what follows a shuffle of few rows has few files to write."""
    return df.coalesce(max(1, -(-rows // ROWS)))


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, in no certain order: unlike a checkpoint, its plan knows nothing of what it came
    from, so loops over such tables plan as quickly in the last round as in the first."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to one row per linked node: id and component, the smallest id reachable.

    Alternating large-star and small-star rounds: each node hands its neighbours
    the smallest of them, until every node hangs on the smallest of its component.
    The smallest neighbour is a map-side-combined minimum, so a node with very many
    links is no hot group; rows are only joined back on it.  Rows with a null end and
    self-links are ignored.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n, before = edges.count(), None
    few = lambda df: packed(df, 2 * n)
    edges = few(edges)
    while n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = few(few(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        # Every edge now points from the larger end to the smaller one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = few(large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")))
        edges = durable(few(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
