"""Answers of an expensive step, kept by address and content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.operators.kept import kept


def recall(batch: DataFrame, memo: DataFrame | None, ask: Callable[[DataFrame], DataFrame], answers: tuple[str, ...], key: str = "source_url", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The batch with the columns ``answers``, and the memo's new rows (``key``, content_hash, ``answers``).

    Rows whose content is known under their key take what the memo says; ``ask`` adds the answers to all others, each
    content once, whatever the number of its rows.  It runs once: both results read what it wrote.  A memo with
    several answers for one content gives the smallest.  Null keys match one another, a null text counts as empty.
    ``ask`` may leave an answer null; it is kept as such.
    """
    hashed = batch.drop(*answers).withColumn("content_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    named = lambda df, what: df.select(F.col(key).alias("_key"), F.col("content_hash").alias("_hash"), what.alias("_a"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("content_hash") == F.col("_hash"))
    wanted = hashed.dropDuplicates([key, "content_hash"])
    known = None
    if memo is not None:
        known = named(memo, F.struct(*answers)).groupBy("_key", "_hash").agg(F.min("_a").alias("_a"))
        wanted = wanted.join(known, same, "left_anti")
    fresh = kept(ask(wanted).select(key, "content_hash", *answers))
    told = named(fresh, F.struct(*answers))
    both = told if known is None else known.unionByName(told)
    found = hashed.join(both, same, "left")
    return found.select(*hashed.columns, *[F.col("_a")[a].alias(a) for a in answers]), fresh
