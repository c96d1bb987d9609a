"""Properties of the small helpers, over generated inputs."""

from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("jobweave.llm.queries")
from jobweave.llm import embedding_dedup, packing, pii, secret_scan  # noqa: E402


@given(st.lists(st.integers(1, 40), max_size=200), st.integers(1, 6))
def test_pieces_never_overlap(sizes, open_bins):
    bins, ends = packing.BestFit(40, open_bins), {}
    for n in sizes:
        which, at = bins.place(n)
        assert at == ends.get(which, 0) and at + n <= 40 and bins.open <= open_bins
        ends[which] = at + n
    assert bins.made == len(ends) and sum(ends.values()) == sum(sizes)


@settings(max_examples=300)
@given(st.text(st.sampled_from("aA1.@-+_ ():='\"é\n") | st.characters(codec="utf-8"), max_size=40))
def test_pattern_spans_are_whole_matches_in_order(text):
    for found in (pii.base_spans(text), [s[:3] for s in secret_scan.base_spans(text)]):
        for kind in {k for k, _, _ in found}:
            own = [(a, b) for k, a, b in found if k == kind]
            assert all(b <= c for (_, b), (c, _) in zip(own, own[1:], strict=False))
        assert [a for _, a, _ in found] == sorted(a for _, a, _ in found)
    emails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [(a, b) for k, a, b in pii.base_spans(text) if k == "email"] == emails


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_forest_keeps_components(links):
    a, b = (np.array(x) for x in zip(*links, strict=True))
    node, root = embedding_dedup._forest(a, b)
    label = {n: n for n in node.tolist()}
    for _ in label:
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == label


@given(st.integers(2, 60), st.integers(0, 10_000))
@settings(max_examples=25, deadline=None)
def test_searches_find_no_false_link(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 6))
    x[n // 2 :] = x[: n - n // 2] + 0.05 * x[n // 2 :]
    x /= np.linalg.norm(x, axis=1)[:, None]
    adjacency = embedding_dedup.linked(embedding_dedup.build_graph(x))
    q, m = embedding_dedup.search(x.astype(np.float32), adjacency, np.array([0]), x.astype(np.float32), 0.9)
    pairs = list(zip(q.tolist(), m.tolist(), strict=True))
    assert len(set(pairs)) == len(pairs)
    near = x @ x.T
    assert all(near[i, j] >= 0.9 - 1e-5 for i, j in pairs)
    assert len(pairs) >= 0.9 * (near >= 0.9).sum()
