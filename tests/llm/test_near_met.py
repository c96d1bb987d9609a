"""Pairs that an earlier wave of trees compared on full sets are not compared again."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from jobweave.llm import minhash_dedup


def _level(comps: np.ndarray, sigs: np.ndarray, seen: list[list[int]]) -> list[int]:
    n = len(comps)
    columns = [pa.array(np.full(n, 7)), pa.array(np.arange(n)), pa.array(comps), pa.array([s.tobytes() for s in sigs], pa.binary()), pa.array(seen, pa.list_(pa.int64()))]
    rows = pa.RecordBatch.from_arrays(columns, ["key", "id", "comp", "sig", "seen"])
    return [r["id"] for b in minhash_dedup._level(0.8, False, 8, False)(iter([rows])) for r in b.to_pylist()]


@pytest.mark.parametrize("n", [20, 300])
def test_only_pairs_that_have_not_met_meet(n):
    sigs = np.random.default_rng(5).integers(0, 256, (n, minhash_dedup.COORDINATES), dtype=np.uint8)
    sigs[:6], sigs[6:9] = sigs[0], sigs[6]
    seen = [[3], [3, 9], [3], [4, 3], [5], [5], [9], [9], [1, 9], *[[9]] * (n - 9)]
    # Of six that resemble each other four were in meeting 3 and two in 5: these have met one another, not the others; the next three were in 9.
    assert _level(np.arange(n), sigs, seen) == list(range(6))
    assert _level(np.arange(n), sigs, [[3], *seen[1:4], [3, 5], [5, 3], *seen[6:]]) == []
    assert _level(np.arange(n), sigs, [None if i == 7 else s for i, s in enumerate([[3]] * 6 + seen[6:])]) == [6, 7, 8]


def test_no_pair_meets_in_two_waves(spark, monkeypatch):
    draw = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    # About seven tenths of the shingles of any two are common: each may resemble each, none is linked.
    texts = {k: " ".join(w if draw.random() > 0.16 else f"x{k}-{i}" for i, w in enumerate(base)) for k in range(60)}
    waves, tried = [], minhash_dedup.meetings

    def kept(*a):
        met = tried(*a)
        groups: dict[int, set[int]] = {}
        for r in met.collect():
            groups.setdefault(r["key"], set()).add(r["id"])
        waves.append(list(groups.values()))
        return met

    monkeypatch.setattr(minhash_dedup, "meetings", kept)
    minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=1).count()
    assert sum(map(len, waves[0])) > 0
    met = {(i, j) for groups in waves[:1] for g in groups for i in g for j in g if i < j}
    again = [g for groups in waves[1:] for g in groups if all((i, j) in met for i in g for j in g if i < j)]
    assert not again
