"""Plans over partitioned events and bucketed listings; names in a reader's order; large lexicons; ranges with hot buckets."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from jobweave.functions import keywords, lexicon
from jobweave.operators import directory, events, layout


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_are_pruned_and_listings_are_not_dealt(spark, tmp_path):
    rows = spark.range(2000).select("id", F.timestamp_add("HOUR", -(F.col("id") % 1200).cast("int"), F.lit("2024-03-31 12:00:00").cast("timestamp")).alias("ts"), (F.col("id") % 50).alias("listing_id"))
    layout.write_events(rows, str(tmp_path / "events"))
    seen = layout.read_events(spark, str(tmp_path / "events"), "2024-03-31 12:00:00", 7)
    assert re.search(r"PartitionFilters: \[[^\]]*day", _plan(seen)) and len(seen.inputFiles()) and seen.select("day").distinct().count() == 8
    assert seen.count() == rows.where("ts > '2024-03-24 12:00:00' AND ts <= '2024-03-31 12:00:00'").count()
    spark.sql("DROP TABLE IF EXISTS laid_listings")
    layout.write_listings(spark.range(50).withColumn("title", F.concat(F.lit("t"), F.col("id").cast("string"))), "laid_listings", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = layout.by_listing(seen, spark.table("laid_listings"))
        plan = _plan(joined)
        # One exchange: that of the events' counts.
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
        assert joined.agg(F.sum("events")).first()[0] == seen.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE laid_listings")


def test_names_in_a_reader_s_order(spark):
    names = ["Zeta", "alpha", "Émile", "Echo", "Alpha", "emile", "éclair", "Zürich", "zulu", "Ärzte", "arzt"]
    orgs = spark.createDataFrame([(n, f"s{i}", 1, "x", "y") for i, n in enumerate(names)], "name string, slug string, reach int, category string, region string")
    want = ["alpha", "Alpha", "arzt", "Ärzte", "Echo", "éclair", "emile", "Émile", "Zeta", "zulu", "Zürich"]
    assert [r["name"] for r in directory.search(orgs, alphabetic=True).collect()] == want
    assert [r["name"] for r in directory.best_first(orgs).collect()] == want


def test_a_large_lexicon_finds_what_keywords_find(spark):
    rng = random.Random(2)
    words = [f"{rng.choice(['net', 'gov', 'aid', 'c++', '.net', 'co-op', 'health care'])}{i if i % 3 else ''}" for i in range(300)]
    terms = tuple(dict.fromkeys(w.lower() for w in words))[:120]
    texts = [" ".join(rng.choice([*words, "X", "-", "(", "é", "x.net", "NET1", "co-operation"]) + rng.choice(["", ",", "s", "1", "\n"]) for _ in range(40)) for _ in range(80)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(t.upper() if i % 2 else t,) for i, t in enumerate(terms)] + [(None,), ("",)], "term string")
    got = {r["id"]: r["terms"] for r in lexicon.matched(df, table).collect()}
    want = {r["id"]: sorted(r["m"] or []) for r in df.select("id", keywords.matched(F.col("text"), terms).alias("m")).collect()}
    assert got == want and any(want.values())


def test_a_hundred_thousand_terms(spark, monkeypatch):
    table = spark.range(100_000).select(F.concat(F.lit("term "), F.col("id").cast("string")).alias("term"))
    df = spark.createDataFrame([(1, "a TERM 77777, term 5x and term 99999")], "id int, text string")
    found = lexicon.matched(df, table)
    assert found.first()["terms"] == ["term 77777", "term 99999"] and len(_plan(found)) < 3000
    assert lexicon.matched(df, table.limit(0)).first()["terms"] == []
    monkeypatch.setattr(lexicon, "MOST_CHARACTERS", 1000)
    with pytest.raises(ValueError):
        lexicon.matched(df, table)


def test_ranges_of_a_hot_bucket(spark):
    # A third of all addresses is one number, another third lies in one bucket.
    ips = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 70000).when(F.col("id") % 3 == 1, 65536 + F.col("id") % 3000).otherwise(F.col("id") * 997 % 400_000).cast("long").alias("ip"), F.lit("old").alias("country"))
    ips = ips.withColumn("ip", F.when(F.col("id") % 500 != 7, F.col("ip")))
    spans = [(0, 99, "A"), (60_000, 66_000, "B"), (66_001, 66_001, "C"), (69_999, 300_000, "D")]
    got = events.ip_country(ips, spark.createDataFrame(spans, "lo long, hi long, country string"))
    assert sorted(got.columns) == ["country", "id", "ip"]
    rows = got.collect()
    assert len(rows) == 9000 and all(r["country"] == next((c for lo, hi, c in spans if r["ip"] is not None and lo <= r["ip"] <= hi), None) for r in rows)
