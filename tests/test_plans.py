"""What the plans of the main operators must and must not hold."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

QUERIES = {k: f for k, f in entry.queries().items() if not re.match(r"op\d+_|pipeline", k)}
#: Tree rewriting is the one thing here that needs Python.
PYTHON = {"pages_clean", "pages_main", "pages_to_listings", "normalize_listings", "board_pages", "source_shown", "lexicon_hits", "payload_feeds_more"}
#: Queries that join totals of one row.
ONE_ROW_SIDES = {"product_counts", "catalog_health", "country_intensity", "subscriber_growth"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cartesian_product(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    # Nested loops only join a row or two of totals to each row.
    assert name in ONE_ROW_SIDES or "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow|FlatMapGroups", plan)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["bookmark_state"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,", plan)
    plan = plan_of(QUERIES["active_by_source"](spark, sf_dir))
    assert "o_orderstatus" in plan and not re.search(r"ReadSchema: struct<[^>]*o_totalprice", plan)


def test_top_n_is_one_operator(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["live_board"](spark, sf_dir))


def test_equal_listings_are_not_compared_with_each_other(spark):
    from jobweave.operators import resolve

    items = spark.range(3000).selectExpr("id", "'Water Intern' AS title", "'' AS location", "'sort the letters of the water office' AS text", "concat('u', id) AS source_url")
    classes, members = resolve._classes(items, "id")
    assert (classes.count(), members.count(), resolve.class_pairs(classes).count()) == (1, 3000, 0)
    found = resolve.dup_clusters(items).agg(F.count("id"), F.min("size"), F.max("canonical_id")).first()
    assert tuple(found) == (3000, 3000, 0)


def test_large_blocks_meet_in_cells_that_hold_no_table_of_words(spark, monkeypatch):
    """Blocks above the bounds give the pairs that all comparisons give; words of classes are in no table that is kept."""
    import random

    from jobweave.operators import resolve

    draw = random.Random(5)
    words = [f"word{i:02d}" for i in range(40)]
    rows = [(i, "Water Office", ("", "Jimma", "Adama")[i % 3], " ".join(draw.sample(words, draw.choice((3, 6, 12, 24, 36)))), f"u{i}") for i in range(120)]
    items = spark.createDataFrame(rows, "id long, title string, location string, text string, source_url string")
    sets = {r[0]: (r[2], set(r[3].split())) for r in rows}
    share = lambda a, b: len(a & b) / len(a | b)
    expected = {(a, b) for a in sets for b in sets if a < b and "" in (sets[a][0], sets[b][0], "" if sets[a][0] == sets[b][0] else None) and share(sets[a][1], sets[b][1]) >= 0.5}
    held, keep = [], resolve.kept
    monkeypatch.setattr(resolve, "kept", lambda df: held.append(df.columns) or keep(df))
    monkeypatch.setattr(resolve, "MEMBERS", 7)
    monkeypatch.setattr(resolve, "PAIRS", 50)
    monkeypatch.setattr(resolve, "DENSE", 0.3)
    found = resolve.dup_pairs(items).collect()
    assert expected and {(r["a"], r["b"]) for r in found} == expected and len(found) == len(expected)
    assert all(r["similarity"] == share(sets[r["a"]][1], sets[r["b"]][1]) for r in found)
    root = {i: i for pair in expected for i in pair}
    for _ in root:
        for a, b in expected:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["id"]: r["cluster"] for r in resolve.dup_clusters(items).collect()} == root
    assert held and not any("tokens" in c for c in held)
