"""A training corpus from raw documents, in five stages.

Each stage takes the documents that the stage before it kept, decides, and hands on
what stays; every result is written as Parquet and read again, so a lost executor
costs one stage at most.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import exact_dedup, minhash_dedup, packing, queries, secret_scan, toxicity
from jobweave.llm.components import durable, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"), queries.fold() != 1)
    return toxicity.score(docs, model, score_col="_toxicity").where(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one with the smallest identifier stays."""
    return exact_dedup.deduplicate(docs)


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a _key of their own: the identifier; where it is null or an earlier row has it, a number above all identifiers in use."""
    odd = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if odd.isEmpty():
        return docs.withColumn("_key", F.col("doc_id"))
    marked = durable(docs.withColumn("_mark", F.monotonically_increasing_id()))
    first = marked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("_mark").alias("_mark"), F.lit(True).alias("_first"))
    keyed = marked.join(first, ["doc_id", "_mark"], "left")
    return keyed.select(*docs.columns, F.when(F.col("_first"), F.col("doc_id")).otherwise(F.col("_mark") + F.lit(1 << 62)).alias("_key"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share four fifths of their five-word shingles, the one with the smallest identifier stays;
    rows without an identifier come last, and rows that repeat one are documents of their own."""
    keyed = _keyed(docs)
    found = minhash_dedup.near_duplicates(keyed, id_col="_key", width=5, similarity=0.8)
    return keyed.join(found.where(~F.col("kept")).select("_key"), "_key", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and n_chars follows."""
    masked = secret_scan.redact(secret_scan.find_secrets(docs, spans_col="_secrets"), spans_col="_secrets")
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row per piece with its ids and its place."""
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the learned toxicity model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the results between stages go to the shared checkpoint folder."""
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}_{name}")
            docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs
