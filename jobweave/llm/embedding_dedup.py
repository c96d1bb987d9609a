"""Near-duplicate embeddings by robust-pruned graphs over overlapping shards.

Identical vectors are folded into one class with its number of copies.  Centres
fitted on a bounded sample split the classes into shards; each class is owned by
the shard of its nearest centre and also stands in that of the second.  Each
shard builds a flat graph: a node's nearest candidates, pruned so that no kept
neighbour is much closer to another kept one than to the node.  The adjacency
lists that a node got in its shards are united.  Each class is then looked for in
the shards of its nearest centres: a greedy beam search from the shard's medoid
finds the neighbourhood, and range expansion follows all edges from nodes within
the threshold, and from the query's own node where it stands in the shard, until no new one is found.  Pairs are verified in double precision.

A pair counts in the shard that owns its target, so no pair is met twice and no
table of pairs is needed: a task returns each query's number of links and a
spanning forest of its links.  A shard above ``SHARD`` owned classes is split by
hash, and its queries go to all its parts; the queries of a shard are split into
blocks too, so the memory of a task is bounded whatever the data.

Recall is audited: the links of a bounded number of classes are counted by brute
force over all rows, in blocks, and the search is widened by further shards until enough are found.
Where the widest search still finds too few, every query is compared with every
node, in the same blocks.  Vectors of each length have an index of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.components import connected_components, durable

THRESHOLD = 0.9
#: Centres at most, vectors that they are fitted on (SAMPLE, or PER_CENTRE for each centre if that is more), and bytes of these at most.
CENTRES, SAMPLE, PER_CENTRE, SAMPLE_BYTES = 1 << 14, 20_000, 4, 128 << 20
#: Owned classes of a shard (split beyond four times that, the members of neighbouring shards included), and queries of a block.
SHARD, QUERIES = 2048, 4096
#: Neighbours of a node, candidates that they are pruned from, width of the beam, how much closer a kept neighbour must be to drop a candidate.
DEGREE, CANDIDATES, BEAM, ALPHA = 24, 96, 16, 1.6
#: Nodes of a beam that are expanded at a time, and queries that are searched at a time.
WIDTH, TOGETHER = 2, 1024
#: How much farther than the threshold range expansion goes, to reach links whose path leads through such nodes.
SLACK = 0.05
#: Classes whose links are audited, the share of links to be found, and how many nearest centres are probed, in turn.
AUDITED, RECALL, PROBES = 1000, 0.99, (3, 6, 12, 24)
#: Share of links below which the widest search gives way to comparing all.
LEAST_RECALL = 0.95


def folded(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, print, d (number of components) and vec (their float64 bytes); the last three are null if the vector links with nothing."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    marked = rows.withColumn("v", F.when(usable, F.col("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_pylist()
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0
            vec: list = [None] * batch.num_rows
            prints: list = [None] * batch.num_rows
            at = 0
            for i, n in enumerate(sizes):
                if n is not None:
                    vec[i] = flat[at : at + n].tobytes()
                    prints[i] = xxhash.xxh3_128_digest(vec[i])
                    at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(vec, pa.binary())], ["id", "print", "d", "vec"])

    return marked.mapInArrow(run, "id bigint, print binary, d int, vec binary")


def _unit(blobs: list[bytes], dimension: int) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(-1, dimension)
    # Scaled first, so that very large or small components keep their norm finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Directions of k clusters of the rows, by a few rounds of spherical k-means (fewer where there are very many)."""
    rounds = rounds if k <= 1024 else 2
    centres = x[np.random.default_rng(11).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + 1024] @ centres.T).argmax(axis=1) for a in range(0, len(x), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-30), centres)
    return centres


def build_graph(x: np.ndarray) -> np.ndarray:
    """Pruned neighbours (rows of x, -1 for none) of each row."""
    n = len(x)
    c = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE), -1, np.int64)
    if c <= 0:
        return out
    x = x.astype(np.float32)
    for a in range(0, n, 512):
        rows = np.arange(a, min(n, a + 512))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -2
        near_ids = np.argpartition(-near, c - 1, axis=1)[:, :c]
        sims = np.take_along_axis(near, near_ids, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(near_ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        # Squared distances of unit vectors: 2 - 2 * similarity.
        among = np.matmul(x[ids], x[ids].transpose(0, 2, 1))
        alive = np.ones(ids.shape, bool)
        for r in range(DEGREE):
            pick = alive.argmax(axis=1)
            has = alive[np.arange(len(rows)), pick]
            if not has.any():
                break
            q = np.flatnonzero(has)
            p = pick[q]
            out[rows[q], r] = ids[q, p]
            alive[q] &= ALPHA * ALPHA * (1 - among[q, p]) > 1 - sims[q]
            alive[q, p] = False
    return out


def linked(adjacency: np.ndarray, extra: int = 16) -> np.ndarray:
    """The lists with the reverse edges added, as far as they fit in ``extra`` more places."""
    n, r = adjacency.shape
    out = np.concatenate([adjacency, np.full((n, extra), -1, adjacency.dtype)], axis=1)
    source, target = np.repeat(np.arange(n), r), adjacency.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    fits = rank < extra
    out[target[fits], r + rank[fits]] = source[fits]
    return out


def search(x: np.ndarray, adjacency: np.ndarray, entry: np.ndarray, queries: np.ndarray, radius: float, beam: int = BEAM, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within the radius that greedy search and range expansion reach, each once.  ``own`` is the node that a
    query is itself, or -1: expansion begins there too, as no edge may lead into its group from elsewhere."""
    own = np.full(len(queries), -1) if own is None else own
    found = [_search(x, adjacency, np.unique(entry), queries[a : a + TOGETHER], own[a : a + TOGETHER], radius, beam) for a in range(0, len(queries), TOGETHER)]
    pairs = [np.empty(0, np.int64), *(pair + k * TOGETHER * len(x) for k, pair in enumerate(found))]
    pair = np.concatenate(pairs)
    return pair // len(x), pair % len(x)


def _search(x: np.ndarray, adjacency: np.ndarray, start: np.ndarray, queries: np.ndarray, own: np.ndarray, radius: float, beam: int) -> np.ndarray:
    """Numbers query * nodes + node of the pairs within the radius."""
    m, q, degree = len(x), len(queries), adjacency.shape[1]
    # met holds which place of a round's candidates met a node last, so that a round counts it once; -1 is not met.
    met, expanded = np.full((q, m), -1, np.int16), np.zeros((q, m), bool)
    sims0 = queries @ x[start].T
    met[:, start] = 0
    ids, sims, closed = np.full((q, beam), -1, np.int64), np.full((q, beam), -2.0, np.float32), np.ones((q, beam), bool)
    w = min(beam, len(start))
    first = np.argsort(-sims0, axis=1)[:, :w]
    ids[:, :w], sims[:, :w], closed[:, :w] = start[first], np.take_along_axis(sims0, first, axis=1), False
    who, what = np.nonzero(sims0 >= radius)
    hits = [who * m + start[what]]
    active, place = np.arange(q), np.arange(WIDTH * degree, dtype=np.int16)
    while True:
        active = active[~closed[active].all(axis=1)]
        if not len(active):
            break
        # The best WIDTH of a beam that are not expanded yet; beams are sorted.
        row, col = np.nonzero(~closed[active])
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, rank = (z[rank < WIDTH] for z in (row, col, rank))
        node = np.full((len(active), WIDTH), -1, np.int64)
        node[row, rank] = ids[active[row], col]
        closed[active[row], col] = True
        expanded[active[row], node[row, rank]] = True
        near = np.where(node[:, :, None] >= 0, adjacency[node], -1).reshape(len(active), -1)
        row, col = np.nonzero(near >= 0)
        to = near[row, col]
        fresh = met[active[row], to] < 0
        row, col, to = row[fresh], col[fresh], to[fresh]
        met[active[row], to] = place[col]
        once = met[active[row], to] == place[col]
        row, col, to = row[once], col[once], to[once]
        s = np.einsum("ij,ij->i", queries[active[row]], x[to])
        hit = s >= radius
        hits.append(active[row[hit]] * m + to[hit])
        # What is no better than the last of a full beam can't enter it.
        enters = s > sims[active[row], -1]
        row, to, s = row[enters], to[enters], s[enters]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        more = int(rank.max()) + 1 if len(rank) else 0
        if not more:
            continue
        new_ids, new_sims = np.full((len(active), more), -1, np.int64), np.full((len(active), more), -2.0, np.float32)
        new_ids[row, rank], new_sims[row, rank] = to, s
        changed = np.unique(row)
        at = active[changed]
        all_ids = np.concatenate([ids[at], new_ids[changed]], axis=1)
        all_sims = np.concatenate([sims[at], new_sims[changed]], axis=1)
        all_closed = np.concatenate([closed[at], new_ids[changed] < 0], axis=1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[at], sims[at], closed[at] = (np.take_along_axis(z, top, axis=1) for z in (all_ids, all_sims, all_closed))
    # Range expansion: every node within the radius opens its neighbours, and so does the query's own.
    who = np.flatnonzero(own >= 0)
    who = who[met[who, own[who]] < 0]
    met[who, own[who]] = 0
    hits.append(who * m + own[who])
    todo = np.concatenate(hits)
    while len(todo):
        todo_q, todo_n = todo // m, todo % m
        still = ~expanded[todo_q, todo_n]
        todo_q, todo_n = todo_q[still], todo_n[still]
        expanded[todo_q, todo_n] = True
        found = [todo[:0]]
        for a in range(0, len(todo_q), 65536):
            near = adjacency[todo_n[a : a + 65536]]
            who = np.repeat(todo_q[a : a + 65536], near.shape[1])
            to = near.ravel()
            ok = (to >= 0) & (met[who, np.maximum(to, 0)] < 0)
            pair = np.unique(who[ok] * m + to[ok])
            who, to = pair // m, pair % m
            met[who, to] = 0
            found.append(pair[np.einsum("ij,ij->i", queries[who], x[to]) >= radius])
        todo = np.concatenate(found)
        hits.append(todo)
    return np.concatenate(hits)


def compared(x: np.ndarray, queries: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within the radius, by comparing all."""
    found = [np.nonzero(queries[a : a + 512] @ x.T >= radius) for a in range(0, len(queries), 512)]
    return np.concatenate([q + 512 * k for k, (q, _) in enumerate(found)]), np.concatenate([n for _, n in found])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links (a, b): every node with the smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if (low == label).all():
            return nodes, nodes[label]
        label = low


class _Index:
    """Classes (id, n, vec), the centres and the shards."""

    def __init__(self, classes: DataFrame, dimension: int, total: int):
        self.classes, self.dimension = classes, dimension
        self.spark = classes.sparkSession
        held = SAMPLE_BYTES // (8 * dimension)  # vectors that the driver may hold
        k = max(1, min(CENTRES, total // SHARD, held // PER_CENTRE))
        sample = min(max(SAMPLE, PER_CENTRE * k), held)
        every = max(1, total // sample)
        some = classes.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("vec").limit(2 * sample).collect() if k > 1 else []
        x = _unit([r["vec"] for r in some], dimension) if some else np.empty((0, dimension))
        self.centres = fit_centres(x, min(k, len(x))) if len(x) else np.zeros((1, dimension))
        counts = self._dealt(2).groupBy("shard").count().collect()
        self.parts = self._by_shard({r["shard"]: max(1, -(-r["count"] // (4 * SHARD))) for r in counts}, "parts")
        members = self._dealt(2).join(self.parts, "shard")
        self.members = members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        self.graph = durable(self._graph())

    def _by_shard(self, values: dict[int, int], name: str) -> DataFrame:
        """A number for each shard, 1 where none is given; a table of at most CENTRES rows."""
        rows = [(s, values.get(s, 1)) for s in range(len(self.centres))]
        return F.broadcast(self.spark.createDataFrame(rows, f"shard int, {name} int"))

    def _dealt(self, nearest: int, beyond: int = 0) -> DataFrame:
        """A row for each class and each of its nearest centres but the first ``beyond``: shard, own (the nearest), id, n, vec."""
        centres, dimension = self.spark.sparkContext.broadcast(self.centres), self.dimension
        nearest = min(nearest, len(self.centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    sims = _unit(part.column(2).to_pylist(), dimension) @ centres.value.T
                    top = np.argsort(-sims, axis=1, kind="stable")[:, beyond:nearest]
                    row = pa.array(np.repeat(np.arange(part.num_rows), nearest - beyond))
                    own = np.tile(np.arange(beyond, nearest) == 0, part.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(top.ravel().astype(np.int32)), pa.array(own), *(c.take(row) for c in part.columns)], ["shard", "own", "id", "n", "vec"])

        return self.classes.select("id", "n", "vec").mapInArrow(run, "shard int, own boolean, id bigint, n bigint, vec binary")

    def _graph(self) -> DataFrame:
        """id and near: each class's pruned neighbours, united over its shards."""
        dimension = self.dimension

        def build(table: pa.Table) -> pa.Table:
            ids = table["id"].to_numpy()
            near = linked(build_graph(_unit(table["vec"].to_pylist(), dimension)))
            lists = [ids[r[r >= 0]].tolist() for r in near]
            return pa.table({"id": ids, "near": pa.array(lists, pa.list_(pa.int64()))})

        built = self.members.select("shard", "part", "id", "vec").groupBy("shard", "part").applyInArrow(build, "id bigint, near array<bigint>")
        return built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def links(self, threshold: float, probes: int, beam: int | None, beyond: int = 0) -> DataFrame:
        """Rows of two kinds: links (id, the number of links found in one part), and forest edges (id, root).
        A query looks in the shards of its ``probes`` nearest centres but the first ``beyond``; as a link counts in the one
        shard that owns its target, the links of such rings add up.

        Without a beam every query is compared with every node of the parts that it is dealt to.
        """
        dimension = self.dimension
        wanted = self._dealt(probes, beyond)
        blocks = self._by_shard({r["shard"]: max(1, -(-r["count"] // QUERIES)) for r in wanted.groupBy("shard").count().collect()}, "blocks")
        block = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("blocks")).cast("int").alias("block")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        queries = wanted.join(self.parts, "shard").join(blocks, "shard").select("shard", each("parts").alias("part"), block, "id", "n", "vec")
        nodes = self.members.join(self.graph, "id").join(blocks, "shard").select("shard", "part", each("blocks").alias("block"), "id", "n", "own", "vec", "near")
        keys = ["shard", "part", "block"]

        def look(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, n, own = (left[c].to_numpy() for c in ("id", "n", "own"))
            q_ids = right["id"].to_numpy()
            if not len(ids) or not len(q_ids):
                return pa.table({"kind": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "value": pa.array([], pa.int64())})
            x64, q64 = _unit(left["vec"].to_pylist(), dimension), _unit(right["vec"].to_pylist(), dimension)
            # Neighbours that stand in this part, as its rows.
            near = left["near"].combine_chunks()
            sizes, flat = near.value_lengths().to_numpy(), near.flatten().to_numpy()
            order = np.argsort(ids, kind="stable")
            spot = np.minimum(np.searchsorted(ids[order], flat), len(ids) - 1)
            here, row = ids[order][spot] == flat, np.repeat(np.arange(len(ids)), sizes)
            row, to = row[here], order[spot[here]]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            adjacency = np.full((len(ids), int(rank.max()) + 1 if len(rank) else 1), -1, np.int64)
            adjacency[row, rank] = to
            middle = x64.mean(axis=0)
            medoid = int((x64 @ middle).argmax())
            # A few evenly spread entries beside the medoid reach parts of the graph that its edges may not.
            entry = np.unique(np.concatenate([[medoid], np.linspace(0, len(ids) - 1, 8).astype(int)]))
            x32, q32 = x64.astype(np.float32), q64.astype(np.float32)
            as_node = order[np.minimum(np.searchsorted(ids[order], q_ids), len(ids) - 1)]
            itself = np.where(ids[as_node] == q_ids, as_node, -1)
            a, b = search(x32, adjacency, entry, q32, threshold - SLACK, beam, itself) if beam else compared(x32, q32, threshold - 1e-4)
            # Where both ends are queries and nodes here, what either finds counts for both.
            q_order = np.argsort(q_ids, kind="stable")
            as_query = q_order[np.minimum(np.searchsorted(q_ids[q_order], ids), len(q_ids) - 1)]
            both = (q_ids[as_query[b]] == ids[b]) & (ids[as_node[a]] == q_ids[a])
            pair = np.unique(np.concatenate([a * len(ids) + b, as_query[b[both]] * len(ids) + as_node[a[both]]]))
            a, b = pair // len(ids), pair % len(ids)
            live = own[b] & (q_ids[a] != ids[b])
            a, b = a[live], b[live]
            sure = np.concatenate([np.einsum("ij,ij->i", q64[a[i : i + 65536]], x64[b[i : i + 65536]]) >= threshold for i in range(0, len(a), 65536)] or [np.empty(0, bool)])
            a, b = a[sure], b[sure]
            total = np.bincount(a, weights=n[b], minlength=len(q_ids)).astype(np.int64)
            some = np.flatnonzero(total)
            node, root = _forest(q_ids[a], ids[b]) if len(a) else (q_ids[:0], q_ids[:0])
            tree = node != root
            return pa.table({
                "kind": np.concatenate([np.zeros(len(some), np.int32), np.ones(int(tree.sum()), np.int32)]),
                "id": np.concatenate([q_ids[some], node[tree]]), "value": np.concatenate([total[some], root[tree]]),
            })

        return nodes.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(look, "kind int, id bigint, value bigint")


def audit(classes: DataFrame, dimension: int, threshold: float, audited: int = AUDITED) -> dict[int, int]:
    """True numbers of links, beside those to copies, of up to ``audited`` classes, by brute force over all classes."""
    picked = classes.orderBy(F.xxhash64("id"), "id").limit(audited).select("id", "vec").collect()
    if not picked:
        return {}
    ids, x = np.array([r["id"] for r in picked]), _unit([r["vec"] for r in picked], dimension)
    shared = classes.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                same = own[:, None] == part.column(0).to_numpy()[None, :]
                near = (q @ _unit(part.column(2).to_pylist(), dimension).T >= threshold) & ~same
                total += near @ part.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total)], ["id", "n"])

    counts = classes.select("id", "n", "vec").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counts.collect()}


def _linked(classes: DataFrame, dimension: int, total: int, threshold: float) -> tuple[DataFrame, float]:
    """links() of the classes of one length, and the audited share of links that it found."""
    index, truth = _Index(classes, dimension, total), audit(classes, dimension, threshold)
    asked = classes.sparkSession.createDataFrame(list(truth.items()), "id bigint, n_true bigint").where("n_true > 0")

    def share(found: DataFrame) -> float:
        counts = found.where("kind = 0").groupBy("id").agg(F.sum("value").alias("found"))
        each = asked.join(counts, "id", "left").select("n_true", F.least(F.coalesce("found", F.lit(0)), "n_true").alias("got"))
        # Of all links, and of a class on average, so that large groups don't hide what small ones lose.
        got = each.agg((F.sum("got") / F.sum("n_true")).alias("links"), F.avg(F.col("got") / F.col("n_true")).alias("classes")).first()
        return 1.0 if got["links"] is None else min(got["links"], got["classes"])

    found, recall, seen = None, 0.0, 0
    for step, probes in enumerate(PROBES):
        # Only shards that no query has been to; what was found before stays.
        ring = durable(index.links(threshold, probes, BEAM << step, seen))
        found = ring if found is None else found.unionByName(ring)
        recall, seen = share(found), probes
        if recall >= RECALL or probes >= len(index.centres):
            break
    if recall < LEAST_RECALL:
        found = durable(index.links(threshold, len(index.centres), None))
        recall = share(found)
    return found, recall


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col``, n_links (other rows linked directly), component_id
    (the smallest identifier that links reach), kept and audited_recall (the least of all lengths).

    - Vectors that are null, empty, zero, or hold null or non-finite components link with
      nothing, nor does a row with a null identifier.  Vectors link with those of their own length only.
    - Copies of a vector link with each other.  Rows that share an identifier share their links.
    - Other columns are left out, whatever their names.  An empty table gives no rows.
    """
    rows = durable(folded(vectors, id_col, vector_col))
    live = rows.where("vec IS NOT NULL AND id IS NOT NULL")
    classes = durable(live.groupBy("print").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("d").alias("d"), F.first("vec").alias("vec")))
    # One index for each length that vectors have; there are few.
    lengths = classes.groupBy("d").count().where("count > 1").orderBy("d").collect()
    parts = [_linked(classes.where(F.col("d") == r["d"]), r["d"], r["count"], threshold) for r in lengths]
    recall = min((r for _, r in parts), default=1.0)
    found = classes.sparkSession.createDataFrame([], "kind int, id bigint, value bigint")
    for part, _ in parts:
        found = found.unionByName(part)
    counts = found.where("kind = 0").groupBy("id").agg(F.sum("value").alias("found"))
    forest = found.where("kind = 1").select(F.col("id").alias("a"), F.col("value").alias("b"))
    reps = classes.select("print", F.col("id").alias("rep"), F.col("n").alias("copies"))
    same = live.join(reps, "print").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    components = durable(connected_components(forest.unionByName(same)))
    summed = reps.join(counts.withColumnRenamed("id", "rep"), "rep", "left").select("print", "rep", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("links"))
    joined = rows.join(summed, "print", "left").join(components, "id", "left")
    linked_row = F.col("links").isNotNull() & F.col("id").isNotNull()
    return joined.select(
        F.col("id").alias(id_col), F.when(linked_row, F.col("links")).otherwise(0).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"), F.lit(float(recall)).alias("audited_recall"),
    )
