"""Only members of a node that may resemble one of another component go on, and a large component does not meet itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from jobweave.llm import minhash_dedup


def _level(comps: np.ndarray, sigs: np.ndarray) -> list[dict]:
    n = len(comps)
    rows = pa.RecordBatch.from_arrays([pa.array(np.full(n, 7)), pa.array(np.arange(n)), pa.array(comps), pa.array([s.tobytes() for s in sigs], pa.binary())], ["key", "id", "comp", "sig"])
    return [r for b in minhash_dedup._level(0.8, False, 8, False)(iter([rows])) for r in b.to_pylist()]


def test_members_that_resemble_nobody_do_not_branch():
    draw = np.random.default_rng(5)
    sigs = draw.integers(0, 256, (300, minhash_dedup.COORDINATES), dtype=np.uint8)
    sigs[200:230] = sigs[200]  # of one component
    sigs[11] = sigs[290]
    comps = np.arange(300)
    comps[200:230] = 200
    assert [(r["id"], r["meets"]) for r in _level(comps, sigs)] == [(11, True), (290, True)]


def test_few_others_meet_a_large_component_in_parts():
    n, others = 1500, 120
    comps = np.where(np.arange(n) < others, np.arange(n), n)
    draw = np.random.default_rng(6)
    order = draw.permutation(n)
    comps = comps[order]
    rows = _level(comps, np.zeros((n, minhash_dedup.COORDINATES), np.uint8))
    assert all(r["meets"] for r in rows) and len(rows) < 1.5 * n
    met = np.zeros((n, n), bool)
    for k in {r["key"] for r in rows}:
        some = [r["id"] for r in rows if r["key"] == k]
        assert len(some) <= minhash_dedup.MEETING
        met[np.ix_(some, some)] = True
    assert met[comps[:, None] != comps].all()
