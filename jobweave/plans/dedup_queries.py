"""Duplicate and organisation matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave.operators import resolve
from jobweave.plans.registry import query
from jobweave.plans.tables import base, dealt, load, oracle
from jobweave.plans.text_queries import sql_norm_location, sql_norm_title, sql_tokens


def _items(spark, sf_dir):
    """Documents as listings: the first three words are the title, so that many share one."""
    words = F.split("text", r"[ \n]")
    return dealt(base(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("id"), F.array_join(F.slice(words, 1, 2), " ").alias("title"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat("lang", F.lit(", x"))).alias("location"),
        "text", F.concat(F.lit("https://d.example.org/"), F.col("doc_id").cast("string")).alias("source_url"), F.lit("active").alias("status"), F.lit("{}").alias("raw"),
    )


ITEMS = f"""i AS (SELECT doc_id AS id, array_to_string(regexp_split_to_array(text, '[ \\n]')[1:2], ' ') AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(lang, ', x') END AS location, text,
  concat('https://d.example.org/', doc_id) AS source_url FROM documents),
n AS (SELECT *, {sql_norm_title('title')} AS block, {sql_norm_location('location')} AS place, {sql_tokens('text')} AS tokens FROM i),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.tokens, b.tokens)) AS common, len(a.tokens) AS na, len(b.tokens) AS nb FROM n a JOIN n b ON a.block = b.block AND a.id < b.id
  WHERE a.block <> '' AND (a.place = b.place OR a.place = '' OR b.place = '')),
d AS (SELECT a, b, common / (na + nb - common) AS similarity FROM p WHERE na > 0 AND nb > 0 AND common / (na + nb - common) >= 0.5)"""
CLUSTERS = f"""{ITEMS}, u AS (SELECT a, b FROM d UNION ALL SELECT b, a FROM d),
r AS (SELECT a AS id, a AS seen FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.seen),
c AS (SELECT id, min(seen) AS cluster FROM r GROUP BY id),
k AS (SELECT c.id, cluster, count(*) OVER (PARTITION BY cluster) AS size, row_number() OVER w AS rank, first_value(c.id) OVER w AS canonical_id, first_value(source_url) OVER w AS canonical_url
  FROM c JOIN i ON i.id = c.id WINDOW w AS (PARTITION BY cluster ORDER BY length(text) DESC, source_url, c.id))"""


@query("dup_pairs", f"WITH {ITEMS} SELECT a, b, similarity FROM d")
def dup_pairs(spark, sf_dir):
    return resolve.dup_pairs(_items(spark, sf_dir))


@query("dup_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT id, cluster, size, rank, canonical_id FROM k")
def dup_clusters(spark, sf_dir):
    return resolve.dup_clusters(_items(spark, sf_dir)).select("id", "cluster", "size", "rank", "canonical_id")


@query("dup_decisions", f"""WITH RECURSIVE {CLUSTERS} SELECT id, 'hidden' AS status, canonical_url AS duplicate_of,
  concat('{{"deep":{{"n":1,"t":true}},"duplicateOf":"', canonical_url, '","n":', id, '}}') AS raw FROM k WHERE rank > 1""")  # fmt: skip
def dup_decisions(spark, sf_dir):
    raw = F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit(',"duplicateOf":"x","deep":{"t":true,"n":1}}'))
    hidden = resolve.hide_duplicates(_items(spark, sf_dir).withColumn("raw", raw), apply=True).where("status = 'hidden'")
    return hidden.select("id", "status", F.get_json_object("raw", "$.duplicateOf").alias("duplicate_of"), "raw")


def sql_norm_org(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower({c}), '&', 'and'), '\\b(the|inc|ltd|plc|ngo|organization|organisation)\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("org_match", oracle(f"""
WITH w AS (SELECT DISTINCT org_name, {sql_norm_org('org_name')} AS norm FROM postings), k AS (SELECT slug, {sql_norm_org('name')} AS candidate FROM orgs),
e AS (SELECT org_name, min(slug) AS slug FROM w JOIN k ON norm = candidate WHERE norm NOT IN ('', 'unknown') GROUP BY 1),
h AS (SELECT org_name, min(slug) AS slug FROM w JOIN k ON length(candidate) > 8 AND contains(norm, candidate) WHERE norm NOT IN ('', 'unknown') GROUP BY 1)
SELECT p.id, coalesce(e.slug, h.slug) AS org_slug FROM postings p LEFT JOIN e ON e.org_name = p.org_name LEFT JOIN h ON h.org_name = p.org_name"""))  # fmt: skip
def org_match(spark, sf_dir):
    return resolve.org_match(load(spark, sf_dir, "postings").select("id", "org_name"), load(spark, sf_dir, "orgs")).select("id", "org_slug")
