"""Snapshots, ledgers and memos: lost runs, repeated batches, writers at the same time."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.operators import merge, snapshots
from jobweave.operators.memo import recall
from jobweave.streaming import jobs


@pytest.fixture
def store(spark, tmp_path):
    return snapshots.SnapshotStore(spark, str(tmp_path / "table"))


def _rows(spark, *rows):
    return spark.createDataFrame(rows, "k int, v string, seq int")


def _told(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


def _upsert(batch):
    return lambda table: batch if table is None else merge.upsert(table, batch, "k", "seq")


def test_batches_count_once(spark, store):
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.update(_upsert(_rows(spark, (1, "a", 0), (2, "b", 0))), "s", 0) == 1
    old = store.read()
    assert store.update(_upsert(_rows(spark, (2, "c", 1), (3, "d", 1))), "s", 1) == 2
    # Again, and late: nothing changes.  Another stream has numbers of its own.
    assert store.update(_upsert(_rows(spark, (2, "x", 9))), "s", 1) == 2 and store.update(_upsert(_rows(spark, (2, "x", 9))), "s", 0) == 2
    assert _told(store.read()) == [(1, "a"), (2, "c"), (3, "d")]
    assert store.update(_upsert(_rows(spark, (4, "e", 1))), "other", 0) == 3 and store.latest().ledger == {"s": 1, "other": 0}
    assert _told(old) == [(1, "a"), (2, "b")] == _told(store.read(1))


def test_a_run_that_is_lost_before_its_commit(spark, store, monkeypatch):
    store.update(_upsert(_rows(spark, (1, "a", 0))), "s", 0)

    def lost(version, body):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lost)
        with pytest.raises(OSError):
            store.update(_upsert(_rows(spark, (1, "b", 1))), "s", 1)
    assert store.versions() == [1] and _told(store.read()) == [(1, "a")] and len(store._listed("data")) == 2
    assert store.update(_upsert(_rows(spark, (1, "b", 1))), "s", 1) == 2
    assert _told(store.read()) == [(1, "b")]
    # What the lost run wrote goes with the old snapshots.
    assert len(store.sweep(keep=1)) == 2 and store.versions() == [2] and _told(store.read()) == [(1, "b")]


def test_two_writers(spark, store):
    store.update(_upsert(_rows(spark, (1, "a", 0))))
    done = []

    def slow(table):
        if not done:  # another writer commits while this one works
            done.append(store.commit(_upsert(_rows(spark, (2, "b", 0)))(table), after=store.latest()))
        return _upsert(_rows(spark, (3, "c", 0)))(table)

    assert store.update(slow) == 3 and done == [2]
    assert _told(store.read()) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(snapshots.Conflict):
        store.commit(_rows(spark, (9, "z", 0)), after=store._load(1))
    assert _told(store.read()) == [(1, "a"), (2, "b"), (3, "c")] and not store._listed("drafts")


def test_files_are_merged_into_a_table_once(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    schema = T.StructType.fromDDL("k int, v string, seq int")
    for i, v in enumerate("ab"):
        (tmp_path / "in" / f"{i}.json").write_text('{"k": %d, "v": "%s", "seq": 0}' % (i, v))
        jobs.ingest_into(spark, str(tmp_path / "in"), schema, store, _upsert, str(tmp_path / "c")).awaitTermination(120)
    assert _told(store.read()) == [(0, "a"), (1, "b")] and store.versions() == [1, 2]
    # The stream forgets its last commit and plays the batch again, as after a lost driver.
    newest = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    newest.with_name(f".{newest.name}.crc").unlink(missing_ok=True)
    jobs.ingest_into(spark, str(tmp_path / "in"), schema, store, _upsert, str(tmp_path / "c")).awaitTermination(120)
    assert store.versions() == [1, 2] and _told(store.read()) == [(0, "a"), (1, "b")]


def test_run_log_keeps_every_run_once(spark, tmp_path):
    log = str(tmp_path / "log")
    row = lambda run, n: spark.createDataFrame([(run, n)], "run_id int, kept int")
    for run, n in ((1, 5), (2, 6), (1, 7)):
        snapshots.append_run(row(run, n), log)
    assert sorted((r["run_id"], r["kept"]) for r in spark.read.parquet(log).collect()) == [(1, 7), (2, 6)]


def test_memo_asks_for_new_contents_only(spark):
    batch = spark.createDataFrame([("u1", "t1"), ("u1", "t1"), ("u2", "t1"), ("u3", None), (None, "t4"), (None, "t4")], "source_url string, text string")
    asked = spark.sparkContext.accumulator(0)

    def count(x):
        asked.add(1)
        return len(x or "")

    size = F.udf(count, "int")
    ask = lambda df: df.withColumn("size", size("text")).withColumn("note", F.lit(None).cast("string"))
    first, fresh = recall(batch, None, ask, ("size", "note"))
    want = sorted((r["source_url"] or "", r["text"] or "", len(r["text"] or "")) for r in batch.collect())
    told = lambda df: sorted((r["source_url"] or "", r["text"] or "", r["size"]) for r in df.collect())
    assert told(first) == want and fresh.count() == 4 and asked.value == 4
    changed = batch.withColumn("text", F.when(F.col("source_url") == "u2", "longer").otherwise(F.col("text")))
    memo = fresh.unionByName(fresh)  # rows that a run wrote twice
    second, more = recall(changed, memo, ask, ("size", "note"))
    without, _ = recall(changed, None, ask, ("size", "note"))
    asked_before = asked.value
    assert told(second) == told(without) and [r["source_url"] for r in more.collect()] == ["u2"] and asked.value == asked_before
    third, none = recall(changed, memo.unionByName(more), ask, ("size", "note"))
    assert told(third) == told(second) and none.count() == 0 and asked.value == asked_before
