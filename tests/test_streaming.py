"""Streams against their batch twins."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from jobweave.operators import board
from jobweave.streaming import events, jobs, limiter

T0 = dt.datetime(2024, 1, 1, 12)
ID = "0123abcd-0000-4000-8000-00000000000F"
SCHEMA = "id string, ts timestamp, type string, path string, listing_id string, ref string, ip string, agent string, ip_number long"


@pytest.fixture
def requests(spark):
    rows = [
        (str(i), T0 + dt.timedelta(seconds=7 * i), ["pageview", "listing_view", "other"][i % 3], "/" + "x" * 600, ID if i % 2 else "0123abcd-99", "tg", f"10.0.0.{i % 4}", "Mozilla" if i % 5 else "curl/8", i % 4)
        for i in range(60)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def _played(spark, df, tmp_path, f, files=4):
    folder = str(tmp_path / "in")
    df.repartitionByRange(files, "ts").write.parquet(folder)
    stream = f(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder))
    out, done = str(tmp_path / "out"), str(tmp_path / "done")
    stream.writeStream.option("checkpointLocation", done).trigger(availableNow=True).start(out, format="parquet").awaitTermination(120)
    return spark.read.parquet(out)


def test_clean_events(spark, requests, tmp_path):
    batch = events.clean_events(requests)
    got = batch.collect()
    # A view of a listing with a broken id is dropped, a page view keeps none.
    assert len(got) == sum(1 for i in range(60) if (i % 3 == 0 or i % 3 == 1 and i % 2) and i % 5)
    assert all(len(r["path"]) == 200 and (r["listing_id"] in (None, ID)) for r in got)
    assert {(r["type"], r["listing_id"]) for r in got} == {("pageview", None), ("pageview", ID), ("listing_view", ID)}
    # At most so many of an address in a minute.
    few = events.clean_events(requests, most=1).select("id").collect()
    assert 0 < len(few) < len(got) and len(events.clean_events(requests, most=None).collect()) == len(got)
    same = _played(spark, requests, tmp_path, events.clean_events)
    assert same.select(*batch.columns).exceptAll(batch).count() == 0 and same.count() == batch.count()


def test_countries(spark, requests):
    ranges = spark.createDataFrame([(0, 1, "ET"), (3, 70000, "KE")], "lo long, hi long, country string")
    got = {(r["ref"], r["country"]) for r in events.clean_events(requests, ranges).collect()}
    assert got == {("tg", "ET"), ("tg", None), ("tg", "KE")}


def test_limiter_opens_windows_at_the_first_event(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("k", "a", at(50)), ("k", "b", at(70)), ("k", "c", at(80)), ("k", "d", at(109)), ("k", "e", at(111)), ("j", "f", at(60))]
    df = spark.createDataFrame(rows, "key string, id string, ts timestamp")
    batch = {r["id"]: r["accepted"] for r in limiter.replay(df, most=2).collect()}
    assert batch == {"a": True, "b": True, "c": False, "d": False, "e": True, "f": True}
    stream = {r["id"]: r["accepted"] for r in _played(spark, df, tmp_path, lambda s: limiter.limit(s, most=2), files=1).collect()}
    assert stream == batch


def _verdicts(rows, most, window):
    """By the definition: rows (key, id, time in microseconds), events one after another."""
    out, opened = {}, {}
    for key, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        at, n = opened.get(key, (None, 0))
        at, n = (t, 1) if at is None or t >= at + window else (at, n + 1)
        opened[key] = at, n
        out[i] = n <= most
    return out


@pytest.mark.parametrize("most, window", [(1, 60.0), (3, 60.0), (2, 0.5), (5, 3600.0)])
def test_replay_by_the_definition(spark, most, window):
    rng = random.Random(most)
    rows = []
    for key in range(12):
        # Keys that are busy for long, with and without breaks, and times at the very edge of a window.
        t = rng.randint(-3, 3) * 10**6
        for _ in range(400 if key == 0 else 40):
            t += rng.choice([0, 1, 10**5, round(window * 1e6), round(window * 1e6) - 1, round(window * 3e5), round(window * 4e6) if key % 3 else 0])
            rows.append((f"k{key}", len(rows), t))
    df = spark.createDataFrame([(k, i, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=t), "old") for k, i, t in rows], "key string, id long, ts timestamp, accepted string").repartition(3)
    got = limiter.replay(df, most=most, window=window)
    assert sorted(got.columns) == ["accepted", "id", "key", "ts"]
    assert {r["id"]: r["accepted"] for r in got.collect()} == _verdicts(rows, most, round(window * 1e6))


def test_replay_of_odd_events(spark):
    rows = [(None, 1, T0), ("a", 2, None), ("a", 3, T0), ("a", 4, T0)]
    df = spark.createDataFrame(rows, "key string, id long, ts timestamp")
    assert {r["id"]: r["accepted"] for r in limiter.replay(df, most=1).collect()} == {1: None, 2: None, 3: True, 4: False}
    assert {r["accepted"] for r in limiter.replay(df, most=0).collect()} == {None, False}
    assert limiter.replay(df.limit(0)).count() == 0


def test_a_busy_key_is_in_many_tasks(spark):
    # Half of all events are of one key; none of the exchanges deals by the key alone.
    df = spark.range(4000).selectExpr("id", "if(id % 2 = 0, 'hot', concat('k', id)) AS key", "timestamp_seconds(id * 7) AS ts")
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got = limiter.replay(df, most=3)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and not re.search(r"hashpartitioning\(_?k#\d+, \d+\)", plan)
        assert got.where("key = 'hot'").groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        for k in small:
            spark.conf.unset(k)
    hot = [(r["key"], r["id"], r["id"] * 7_000_000) for r in df.collect()]
    assert {r["id"]: r["accepted"] for r in got.collect()} == _verdicts(hot, 3, 60_000_000)


def test_limiter_and_daily_counts_in_one_query(spark, tmp_path):
    """Files are played one a batch, in order of time: the limiter's verdicts, days and visitors are those of the table."""
    rows = []
    for day in range(4):
        for i in range(120):
            rows.append((f"{day}-{i:03}", T0 + dt.timedelta(days=2 * day, seconds=2 * i), "pageview", "/", None, None, f"10.0.0.{i % 2}", f"Mozilla {i % 5}", 0))
    requests = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    want = events.daily_traffic(events.clean_events(requests, most=7)).orderBy("day").collect()
    assert [r["views"] for r in want] == [5 * 7 + 5 * 7] * 0 + [r["views"] for r in want] and 0 < want[0]["views"] < 120
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    query = None
    for day in range(4):
        requests.where(F.col("id").startswith(f"{day}-")).write.mode("append").parquet(str(folder))
        if day == 2:  # an event of the first day, later than the watermark lets in
            spark.createDataFrame([("late", T0, "pageview", "/", None, None, "10.9.9.9", "Mozilla late", 0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        query = events.limited_traffic(stream, most=7).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out, format="parquet")
        query.awaitTermination(180)
    got = spark.read.parquet(out).orderBy("day").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want][: len(got)] and len(got) >= 2
    # Timers have cleared what the limiter knew of the days that the watermark has passed.
    states = {s["operatorName"]: s["numRowsTotal"] for s in query.lastProgress["stateOperators"]}
    assert any("transformWithState" in n for n in states), states


def test_windows(spark, requests, tmp_path):
    clean = events.clean_events(requests)
    views = clean.where("type = 'pageview'")
    want = [(dt.date(2024, 1, 1), views.count(), views.select("visitor_hash").distinct().count())]
    assert [tuple(r) for r in events.daily_traffic(clean).collect()] == want
    # Days begin at the board's midnight, 21:00 UTC.
    late = views.withColumn("ts", F.expr("ts + INTERVAL '08:59:30' HOUR TO SECOND"))
    told = events.daily_traffic(late).orderBy("day").collect()
    assert [r["day"] for r in told] == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)] and sum(r["views"] for r in told) == views.count()
    # A later day's event lets the watermark pass the first one, which is then told.
    more = clean.unionByName(clean.limit(1).withColumn("type", F.lit("pageview")).withColumn("ts", F.lit(T0 + dt.timedelta(days=4)))).coalesce(1)
    day = _played(spark, more.sortWithinPartitions("ts"), tmp_path / "daily", events.daily_traffic, files=2)
    assert [tuple(r) for r in day.collect()] == want
    live = events.live_now(clean).orderBy("at").collect()
    assert live[0]["at"] == T0 + dt.timedelta(minutes=1)
    streamed = _played(spark, clean, tmp_path, events.live_now)
    # In append mode a window is told once the watermark has passed it.
    assert streamed.exceptAll(events.live_now(clean)).count() == 0


def test_appended_table(spark, requests, tmp_path):
    requests.write.parquet(str(tmp_path / "in"))
    stream = events.clean_events(spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in")))
    for _ in range(2):  # the second run finds nothing new
        jobs.append_events(stream, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == events.clean_events(requests).count()


def test_files_are_handed_on_once(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("a int")
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text('{"a": %d}' % i)
        jobs.ingest_files(spark, str(tmp_path / "in"), schema, lambda b: seen.extend(r["a"] for r in b.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(seen) == [0, 1]


def test_queue_and_reminders_run_twice(spark):
    as_of = "2024-06-10 00:00:00"
    soon = lambda h: dt.datetime(2024, 6, 10) + dt.timedelta(hours=h)
    listings = spark.createDataFrame(
        [
            (i, t, "active", fit, at, posted, f"Org {t}", place, t == "D", "https://apply.example.org/?a=1&b=2" if i == 1 else "ftp://x", None)
            for i, t, fit, at, posted, place in ((1, "A & Co", 90, soon(24), False, "Addis Ababa, Ethiopia"), (2, "B", 80, soon(-5), False, None), (3, "C", 60, None, False, None), (4, "D", 75, soon(70), True, "x"), (5, "E", 75, soon(21), False, None))
        ],
        "id int, title string, status string, fit_score int, deadline timestamp, posted_to_channel boolean, org_name string, location string, is_remote boolean, apply_url string, raw string",
    )
    outbox = spark.createDataFrame([], "id int, send boolean, posted_at timestamp")
    first = jobs.drain_channel(listings, outbox, as_of)
    assert [(r["id"], r["send"]) for r in first.collect()] == [(1, True), (2, False), (5, True)]
    assert jobs.drain_channel(listings, first, as_of).count() == 0
    marked = board.mark_posted(listings, first)
    assert marked.where("posted_to_channel").count() == 4 and board.mark_posted(marked, first).where("posted_to_channel").count() == 4
    saves = spark.createDataFrame([(7, [1, 4, 5]), (8, [])], "chat_id int, saved_listing_ids array<int>")
    due = jobs.remind(saves, listings, as_of, spark.createDataFrame([], "chat_id int, id int, band string"))
    assert sorted((r["chat_id"], r["id"], r["band"]) for r in due.collect()) == [(7, 1, "24h"), (7, 4, "72h")]
    assert jobs.remind(saves, listings, as_of, due.select("chat_id", "id", "band")).count() == 0
    told = {r["id"]: r["message"] for r in due.collect()}
    read = '<a href="https://board.example.org/?listing=%d&amp;ref=tg-reminder">Read</a>'
    assert told[1] == "⏰ <b>Closes in ~24h</b>\n<b>Org A &amp; Co</b> — A &amp; Co\n\n" + read % 1 + ' · <a href="https://apply.example.org/?a=1&amp;b=2">Apply now</a>'
    assert told[4] == "⏰ <b>Closes in ~72h</b>\n<b>Org D</b> — D\n\n" + read % 4
    lines = [r["line"] for r in jobs.saved_lines(board.saved_open(saves, listings, as_of), listings, as_of).orderBy("n").collect()]
    assert lines[1] == '2. <a href="https://board.example.org/?listing=1&amp;ref=tg-saved"><b>A &amp; Co</b></a>\n    Org A &amp; Co · Addis Ababa · 🔴 1d left'
    assert lines[0].endswith("Org E · — · 🔴 1d left") and lines[2].endswith("Org D · Remote · 🔴 3d left")
    asked = spark.createDataFrame([(7, 1), (7, 3)], "chat_id int, id int")
    assert sorted(r["message"] for r in jobs.save_confirmations(asked, listings, as_of).collect()) == [
        "✅ Saved — <b>A &amp; Co</b>\n🔴 1d left · I'll remind you 24h &amp; 72h before it closes.", "✅ Saved — <b>C</b>\nRolling deadline — no reminders needed, apply when ready.",
    ]
