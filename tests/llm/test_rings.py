"""A wider search for near-duplicate embeddings looks in further shards only, and counts no link twice."""

from __future__ import annotations

import numpy as np

from jobweave.llm import embedding_dedup


def test_rings_add_up(spark, monkeypatch):
    draw = np.random.default_rng(3)
    x = np.repeat(draw.normal(size=(60, 8)), 12, axis=0) + 0.25 * draw.normal(size=(720, 8))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    asked, links = [], embedding_dedup._Index.links
    monkeypatch.setattr(embedding_dedup._Index, "links", lambda self, *a: asked.append((a[1], a[3])) or links(self, *a))
    monkeypatch.setattr(embedding_dedup, "SHARD", 90)
    monkeypatch.setattr(embedding_dedup, "PROBES", (1, 3, 8))
    monkeypatch.setattr(embedding_dedup, "RECALL", 2.0)
    monkeypatch.setattr(embedding_dedup, "LEAST_RECALL", 0.0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(rows).collect()}
    got = np.array([found[i] for i in range(len(x))])
    assert asked == [(1, 0), (3, 1), (8, 3)]
    assert (got <= truth).all() and got.sum() >= 0.98 * truth.sum() > 0


def test_a_group_that_no_edge_leads_into_is_found_from_its_own_nodes():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(200, 16))
    x[100:] = x[100] + 0.02 * draw.normal(size=(100, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    # Two graphs that are not connected, entered in the first one.
    adjacency = np.concatenate([embedding_dedup.build_graph(x[:100]), embedding_dedup.build_graph(x[100:]) + 100])
    adjacency[100:][adjacency[100:] == 99] = -1
    a, b = embedding_dedup.search(x, embedding_dedup.linked(adjacency), np.array([0]), x[100:], 0.9, own=np.arange(100, 200))
    assert len(a) == len(set(zip(a.tolist(), b.tolist(), strict=True))) == 100 * 100
