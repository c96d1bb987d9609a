"""Exact de-duplication by a content sort.

Texts are equal when they are identical after each run of ASCII white space
is replaced by one space.  Sampled splitters range-partition the rows by the
leading characters of the normalised text and its 64-bit fingerprint (the
fingerprint lets the splitters cut through texts that share a long opening),
an external sort inside each range places equal texts next to each other, and
the window operator compares neighbours in full and keeps the smallest
identifier of each run.

Only the leading characters go into the splitter sample, so what the driver
gathers to choose the splitters does not grow with the length of the texts.

A text that holds more than ``1 / (8 * partitions)`` of all rows would fill a
range by itself.  Such texts are found by an exact count of fingerprints; their
rows are written to the checkpoint folder, grouped by their full text with map-side
combining, and meet their groups in a broadcast join, whose size is bounded by
``8 * partitions`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from jobweave.llm.components import durable

SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Characters of the normalised text that the splitters see.
SPLITTER_CHARS = 48
#: A text with fewer copies than this is never treated as hot.
MIN_HOT_ROWS = 256
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: list[str] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, the columns in ``payload`` (all others by
    default), then keep_id, group_size, kept and text_sha256.

    - A null text counts as empty; all empty texts are equal.  Texts of any
      length are compared whole.
    - Of rows that repeat both identifier and text one is kept, so the kept rows
      never hold a text twice.  A null identifier sorts after all others.
    - Input columns named like a result column are replaced by the result.
    - An empty table gives an empty table.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if payload is None else payload) if c != id_col and c not in RESULT]
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row") if keep else F.lit(0).alias("_row"),
        normalised(F.col(text_col)).alias("_norm"),
    ).withColumn("_print", F.xxhash64("_norm"))

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Fewer than 8 * partitions texts can be hot, so the most frequent ones and the number of rows tell which are.
    seen = Observation()
    prints = rows.groupBy("_print").count().observe(seen, F.sum("count").alias("n"))
    top = prints.orderBy(F.col("count").desc(), "_print").limit(8 * partitions).collect()
    threshold = max(MIN_HOT_ROWS, (seen.get["n"] or 0) // (8 * partitions))
    hot = [r["_print"] for r in top if r["count"] > threshold]

    sorted_rows = rows.where(~F.col("_print").isin(hot)) if hot else rows
    by_text = Window.partitionBy("_lead", "_print", "_norm").orderBy(F.col("_id").asc_nulls_last())
    whole = by_text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    result = (
        sorted_rows.withColumn("_lead", F.substring("_norm", 1, SPLITTER_CHARS))
        .repartitionByRange("_lead", "_print")
        .select(
            "_id", "_row",
            F.first("_id").over(whole).alias("keep_id"),
            F.count(F.lit(1)).over(whole).alias("group_size"),
            (F.row_number().over(by_text) == 1).alias("kept"),
            F.sha2("_norm", 256).alias("text_sha256"),
        )
    )
    if hot:
        result = result.unionByName(_mark_hot(rows.where(F.col("_print").isin(hot))))
    out = [F.col("_id").alias(id_col), *[F.col("_row")[c].alias(c) for c in keep]]
    return result.select(*out, *RESULT)


def _mark_hot(rows: DataFrame) -> DataFrame:
    """Rows of the few texts with very many copies, without dealing them by text."""
    # One row of the smallest identifier stays; the mark tells rows with the same identifier apart.
    # It is written once, so that both sides of the join see the same marks.
    marked = durable(rows.withColumn("_sha", F.sha2("_norm", 256)).withColumn("_mark", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col("_mark").alias("mark")))
    groups = marked.groupBy("_print", "_norm", "_sha").agg(first.alias("_first"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("_print", "_sha", "_first", "group_size")
    return marked.join(F.broadcast(groups), ["_print", "_sha"]).select(
        "_id", "_row", F.col("_first.id").alias("keep_id"), "group_size",
        (F.col("_mark") == F.col("_first.mark")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns as they were."""
    clash = [c for c in docs.columns if c in RESULT]
    safe = docs.select(*[F.col(f"`{c}`").alias(f"_in_{c}" if c in clash else c) for c in docs.columns])
    kept = mark_duplicates(safe, id_col, text_col).where("kept")
    return kept.select(*[F.col(f"_in_{c}" if c in clash else c).alias(c) for c in docs.columns])
