"""Texts and labels of payloads are worked out once a row, not again in each filter on what follows from them."""

from __future__ import annotations

from jobweave.sources import payloads


def _plan(df) -> str:
    return df.select("source_id", "title", "location", "org_name")._jdf.queryExecution().optimizedPlan().toString()


def test_the_text_of_a_feed_is_worked_out_once(spark):
    items = spark.range(3).selectExpr("concat('Intern ', id, ' (Addis Ababa)') AS title", "concat('https://x.org/job/x/', id) AS link", "concat('<p>', repeat('Text ', 30 * CAST(id AS int)), '</p>') AS description", "CAST(null AS string) AS pubDate")
    df = payloads.successfactors(items, "https://x.org")
    assert _plan(df).count("<style") == 1
    assert sorted((r["source_id"], r["title"], r["location"]) for r in df.collect()) == [("1", "Intern 1", "Addis Ababa"), ("2", "Intern 2", "Addis Ababa")]


def test_the_labels_of_a_post_are_worked_out_once(spark):
    posts = spark.range(2).selectExpr("id", "concat('https://b.org/?p=', id) AS link", "CAST(null AS string) AS date", "struct('Intern' AS rendered) AS title", "struct(concat('<p>Work Location: ', IF(id = 0, 'Adama', 'Rome'), '</p>') AS rendered) AS content")
    df = payloads.wordpress(posts)
    assert _plan(df).count("struct(location, ") == 1
    assert [(r["source_id"], r["location"]) for r in df.collect()] == [("0", "Adama")]
