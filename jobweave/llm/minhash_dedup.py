"""Near-duplicate texts by a chosen-path set similarity join.

A document's set holds its distinct word shingles.  Identical sets are folded
into one class first.  Each class carries ``COORDINATES`` minwise values, cut to
eight bits.  In each of ``TREES`` independent trees, a node chooses one or two
coordinates by a hash of its path, 1 / similarity of them on average, and a class
moves on to one child for each, named by its minwise value there.  A pair at the
threshold so keeps one shared child on average at every level, while unrelated
sets part.  In a node with at most ``SCREENED`` classes those that may resemble one of
another component there, by their minwise values, go on, and no others do.  They meet if they are
``FULL`` at most, or if few are outside their largest component.  In larger nodes they
move on to the children; where all resemble the first, they meet the node's leaders
before, and one that surely resembles a leader is settled there.

A meeting has a bounded number of members and holds their full sets, so all its pairs
are compared exactly in one task, and only links that join it leave that task: neither
a group's pairs nor its candidates ever make a table.  Links make components.

The nodes of the first levels cannot be small, so the paths down to the level
where an average node would be small are computed where the rows are.  Branching
needs no other row, so a node of any size is streamed through its task.

The trees come in waves.  The first one joins most of a large group; in later ones its
members carry the component and the meetings that they are in: nodes of one component
end there, only members that may resemble another component's member whom they have not met
yet meet, and no leader settles a member that is not in its component already, however
much it resembles it.

Recall is audited: partners of a bounded number of classes are looked for among all
classes by their minwise values, and trees are added until they join enough of the
links that the full sets confirm.  Where even the most trees don't, all classes that are
apart are compared by their minwise values, in cells of bounded size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.blocks import Words, filled, text_blocks
from jobweave.llm.components import connected_components, durable, packed, written

COORDINATES = 64
TREES = 16
SMALL = 32
#: Members of a node up to which each is compared with all others by minwise values, and only those that may resemble one of another
#: component go on; and how many of these meet at once: each level less saves members a fourth of the copies.
SCREENED, FULL = 2048, 1024
#: Rows of a larger node that decide whether it branches at once or gets leaders, and leaders of a node whose other members branch.
PROBE, LEADERS = 1024, 8
#: The level from which on leaders settle what is left, as many as it takes.
MAX_DEPTH = 12
#: Shares of equal minwise values: below WEAK a pair is no candidate at a similarity of 0.8 (four deviations), from STRONG on it joins.
WEAK_BELOW = 0.2
STRONG = 0.93
#: A member is settled by one leader from STRONG on, or by so many from a similarity and LIKELY_ABOVE on.
LIKELY_ABOVE, LIKELY_LEADERS = 0.05, 2
#: Trees of the first waves, and leaders of a node in the first one, which only joins what is large; all other trees follow in one wave.
WAVES, FIRST_LEADERS = (2, 6), 2
#: Members of a meeting at most, and shared shingles of a meeting that are counted at a time.
MEETING, COLUMNS = 512, 1 << 14
#: Classes whose links are audited, links of each at most, how many equal minwise values make a partner (six deviations below
#: the threshold), the share of the links to be joined, trees added at a time and at most, and the share below which all are compared.
AUDITED, PARTNERS, ALIKE, RECALL, MORE_TREES, MOST_TREES, LEAST_RECALL = 1000, 8, 32, 0.99, 8, 64, 0.9
#: Classes of a block where all are compared.
BLOCK = 2048
#: Bits of the fixed-size filter that tells which documents have candidates.
FILTER_BITS = 1 << 26

_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_rng = np.random.default_rng(20240817)
_FACTORS = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


class _WordHashes:
    """64-bit hashes of distinct words, each computed once while the table holds it."""

    def __init__(self, limit: int = 400_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) + len(words) > self.limit:
            self.known.clear()
        known, digest = self.known, xxhash.xxh3_64_intdigest
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out[i] = h
        return out


def shingle_sets(texts: pa.Array, width: int, hashes: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text one after another, and the bounds of each."""
    lowered = pc.ascii_trim_whitespace(pc.ascii_lower(filled(texts)))
    words = Words(lowered, pc.ascii_split_whitespace)
    h = hashes.of(words.values)[words.codes]
    starts, ends = words.bounds[:-1], words.bounds[1:]
    blank = np.asarray(pc.equal(lowered, "").to_numpy(zero_copy_only=False), bool)
    n_words = np.where(blank, 0, ends - starts)
    # A shingle begins at every word but the last width - 1; a text with fewer words is one shingle.
    joined = h.copy() * _MIX1
    for k in range(1, min(width, len(h))):  # a block may hold fewer words than a shingle
        joined[: len(h) - k] = _mixed(joined[: len(h) - k]) + h[k:] * _MIX2
    joined = _mixed(joined)
    sets = []
    for s, n in zip(starts.tolist(), n_words.tolist(), strict=True):
        if n >= width:
            sets.append(np.unique(joined[s : s + n - width + 1]))
        elif n:
            one = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in h[s : s + n]:
                    one = _mixed(np.array([one * _MIX2 + x * _MIX1], np.uint64))[0]
            sets.append(np.array([one], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), bounds


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minwise values of each set, cut to eight bits; zeros for an empty set."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), COORDINATES), np.uint8)
    if len(full):
        at = bounds[:-1][full]
        for i in range(COORDINATES):
            low = np.minimum.reduceat(flat * _FACTORS[i] + _SHIFTS[i], at)
            out[full, i] = (_mixed(low) & np.uint64(255)).astype(np.uint8)
    return out


def features(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (shingles), print (of the whole set) and sig of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for block in text_blocks(batches, "text"):
            flat, bounds = shingle_sets(block.column(1), width, hashes)
            sig = signatures(flat, bounds)
            ends = bounds.tolist()
            prints = [xxhash.xxh3_128_digest(flat[a:b].tobytes()) if b > a else None for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(prints, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())],
                ["id", "n", "print", "sig"],
            )

    rows = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, "id bigint, n bigint, print binary, sig binary")


def _chosen(keys: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates of each node: one, and with what is left of 1 / similarity a second (or -1)."""
    h = _mixed(keys ^ np.uint64(0x5851F42D4C957F2D))
    first = (h % np.uint64(COORDINATES)).astype(np.int64)
    g = _mixed(h + _MIX1)
    step = (g % np.uint64(COORDINATES - 1)).astype(np.int64) + 1
    more = (_mixed(g) >> np.uint64(11)).astype(np.float64) / 2.0**53 < 1 / similarity - 1
    return first, np.where(more, (first + step) % COORDINATES, -1)


def _children(keys: np.ndarray, sigs: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The child nodes of rows, and the row that each belongs to."""
    first, second = _chosen(keys, similarity)
    rows = np.arange(len(keys))
    two = np.flatnonzero(second >= 0)
    row, coordinate = np.concatenate([rows, two]), np.concatenate([first, second[two]])
    value = sigs[row, coordinate].astype(np.uint64)
    return _mixed(keys[row] * _MIX1 + (coordinate.astype(np.uint64) << np.uint64(8)) + value), row


#: Rows of nodes, one array for each column: key of the node, id, component that the class is in, minwise values, and (where told) the
#: keys of the meetings that the class was in.
Members = tuple[np.ndarray, ...]

#: A node's row, or that of a meeting (meets), whose key is the meeting's.
_NODE = "key bigint, id bigint, comp bigint, meets boolean, sig binary, seen array<bigint>"
_NODE_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def _of(members: Members, at) -> Members:
    return tuple(x[at] for x in members)


def _node_batch(members: Members, meets: bool = False) -> pa.RecordBatch:
    keys, ids, comps, sigs, *seen = members
    sig = pa.nulls(len(ids), pa.binary()) if meets else pa.array([r.tobytes() for r in sigs], pa.binary())
    seen = pa.nulls(len(ids), pa.list_(pa.int64())) if meets or not seen else pa.array(seen[0], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(ids), pa.array(comps), pa.array(np.full(len(ids), meets)), sig, seen], _NODE_NAMES)


def _seen(lists: pa.Array) -> np.ndarray:
    """The meetings of each row as an array of its own; those of null are none."""
    none, out = np.empty(0, np.int64), np.empty(len(lists), object)
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    for i, (a, b) in enumerate(itertools.pairwise(ends.tolist())):
        out[i] = flat[a:b] if b > a else none
    return out


def _forget_met(apart: np.ndarray, seen: np.ndarray) -> None:
    """Takes the pairs that share a meeting out of a node's pairs (a square of flags): they were compared on full sets, and what is apart
    since then is not similar enough."""
    some = np.flatnonzero(apart.any(axis=1))
    place = np.repeat(some, [len(x) for x in seen[some]])
    if not len(place):
        return
    keys = np.concatenate(seen[some])
    order = np.argsort(keys, kind="stable")
    keys, place = keys[order], place[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(starts[1:], len(keys))
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        apart[place[a:b, None], place[a:b]] = False


def _meeting_in(members: Members, starts: np.ndarray, size: int, weak: float) -> np.ndarray:
    """Places of the members that may resemble one of another component that they have not met, in all nodes with ``size`` members
    that begin at ``starts``."""
    _, _, comps, sigs, *seen = members
    out = []
    step = max(1, (1 << 21) // (size * size * COORDINATES))
    for s in range(0, len(starts), step):
        at = starts[s : s + step, None] + np.arange(size)
        sig, comp = sigs[at], comps[at]
        alike = (sig[:, :, None, :] == sig[:, None, :, :]).mean(axis=3, dtype=np.float32)
        apart = (alike >= weak) & (comp[:, :, None] != comp[:, None, :])
        if seen:
            for i in np.flatnonzero(apart.any(axis=(1, 2))).tolist():
                _forget_met(apart[i], seen[0][at[i]])
        out.append(at[apart.any(axis=2)])
    return np.concatenate(out)


def _resembling(members: Members, weak: float) -> np.ndarray:
    """Places of the members of one node that may resemble one of another component that they have not met."""
    _, _, comps, sigs, *seen = members
    columns, apart = np.ascontiguousarray(sigs.T), np.zeros((len(comps), len(comps)), bool)
    for s in range(0, len(comps), 256):
        alike = np.zeros((len(comps[s : s + 256]), len(comps)), np.uint8)
        for c in columns:
            alike += c[s : s + 256, None] == c
        apart[s : s + 256] = (alike >= weak * COORDINATES) & (comps[s : s + 256, None] != comps)
    if seen:
        _forget_met(apart, seen[0])
    return np.flatnonzero(apart.any(axis=1))


class _Leaders:
    """Members of one node, each compared with the leaders so far; one that they don't settle leads, up to ``most`` leaders.

    With ``trust`` a leader settles what surely resembles it, else only what is in its component as well."""

    def __init__(self, similarity: float, most: int | None, trust: bool):
        self.weak, self.likely, self.most, self.trust = similarity - WEAK_BELOW, similarity + LIKELY_ABOVE, most, trust
        self.ids, self.comps, self.sigs = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, COORDINATES), np.uint8)
        self.met: list[int] = []  # how many each leader has met

    def add(self, members: Members) -> tuple[list[Members], np.ndarray]:
        """Rows of meetings, and the places of the members that no leader settles, leaders among them."""
        keys, ids, comps, sigs = members[:4]
        out, led = [], []
        todo, likely = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        done = 0
        while True:
            for k in range(done, len(self.ids)):
                alike = (sigs[todo] == self.sigs[k]).mean(axis=1)
                same = comps[todo] == self.comps[k]
                # Members that branch meet the later leaders again, which branch as well.
                # Nor need they meet a leader that they may resemble: only one that may settle them.
                hit = todo[(alike >= (self.weak if self.most is None else self.likely)) & ~same]
                if len(hit):
                    out += self._meetings(k, keys[0], _of(members[:4], hit))
                settles = np.ones(len(todo), bool) if self.trust else same
                likely[todo] += (alike >= self.likely) & settles
                todo = todo[~((alike >= STRONG) & settles) & (likely[todo] < LIKELY_LEADERS)]
            done = len(self.ids)
            if not len(todo) or done == self.most:
                break
            self.ids, self.comps, self.sigs = np.append(self.ids, ids[todo[0]]), np.append(self.comps, comps[todo[0]]), np.vstack([self.sigs, sigs[todo[:1]]])
            self.met.append(0)
            led.append(int(todo[0]))
            todo = todo[1:]
        return out, np.concatenate([np.array(led, np.int64), todo])

    def _meetings(self, k: int, key: np.uint64, hit: Members) -> list[Members]:
        """The leader with those that it meets, so many at a time."""
        numbers = (self.met[k] + np.arange(len(hit[1]))) // (MEETING - 1)
        self.met[k] += len(hit[1])
        name = lambda n: _mixed(_mixed(n.astype(np.uint64) * _MIX1 + key) + self.ids[k : k + 1].astype(np.uint64) * _MIX2)
        each = np.unique(numbers)
        own = (name(each), np.full(len(each), self.ids[k]), np.full(len(each), self.comps[k]), hit[3][:0])
        return [(name(numbers), hit[1], hit[2], hit[3][:0]), own]


def _in_largest(comps: np.ndarray) -> np.ndarray:
    """Which members are in the component that most are in."""
    _, number, count = np.unique(comps, return_inverse=True, return_counts=True)
    return number == count.argmax()


def _block_meetings(members: Members) -> Members:
    """Meetings in which all pairs of a node's members meet that are in two components: all that are outside the largest component with
    a part of it in turn where they are few, else every two of the node's blocks."""
    keys, n = members[0], len(members[1])
    largest = _in_largest(members[2])
    others = np.flatnonzero(~largest)
    if MEETING < n and len(others) <= MEETING // 2:
        within = np.flatnonzero(largest)
        parts = -(-len(within) // (MEETING - len(others)))
        dealt = [np.concatenate([others, within[len(within) * i // parts : len(within) * (i + 1) // parts]]) for i in range(parts)]
    else:
        blocks = -(-2 * n // MEETING)
        at = [np.arange(n * i // blocks, n * (i + 1) // blocks) for i in range(blocks)]
        dealt = [np.concatenate([at[i], at[j]]) for i in range(blocks) for j in range(i + 1, blocks)] or at
    rows = np.concatenate(dealt)
    number = np.repeat(np.arange(1, len(dealt) + 1, dtype=np.uint64), [len(d) for d in dealt])
    return (_mixed(keys[rows] + number * _MIX2), *_of(members[1:], rows))


def _level(similarity: float, last: bool, most: int, trust: bool):
    """One level of all trees, over rows sorted by node: the rows of meetings and those of the next level."""
    weak = similarity - WEAK_BELOW

    def large(members, leaders):
        if leaders is not None:
            meetings, left = leaders.add(members)
            for m in meetings:
                yield _node_batch(m, True)
            if last:
                return
            members = _of(members, left)
        if len(members[1]):
            child, row = _children(members[0], members[3], similarity)
            yield _node_batch((child, *_of(members[1:], row)))

    def dense(sigs):
        return (sigs == sigs[0]).mean(axis=1).mean() >= similarity

    def verdict(sigs):
        return _Leaders(similarity, None if last else most, trust) if last or dense(sigs) else None

    def read(batch) -> Members:
        keys, ids, comps = (batch.column(i).to_numpy() for i in range(3))
        sigs = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        return keys.astype(np.uint64), ids, comps, sigs, *([_seen(batch.column(4))] if batch.num_columns > 4 else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Members | None = None
        streaming: tuple | None = None  # the node under way that is too large to hold, and its leaders
        for batch, more in _followed(batches):
            members = read(batch)
            if streaming is not None:
                keys = members[0]
                n = int(np.searchsorted(keys != streaming[0], True)) if keys[0] == streaming[0] else 0
                if n:
                    yield from large(_of(members, slice(0, n)), streaming[1])
                members = _of(members, slice(n, None))
                if not len(members[0]):
                    continue
                streaming = None
            if held is not None:
                members = tuple(np.concatenate(x) for x in zip(held, members, strict=True))
                held = None
            keys, sigs = members[0], members[3]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(keys)]]))
            if more:  # the last node may go on in the next batch
                s, n = int(starts[-1]), int(sizes[-1])
                if n < SCREENED:
                    held = _of(members, slice(s, None))
                else:
                    streaming = (keys[s], verdict(sigs[s : s + PROBE]))
                    yield from large(_of(members, slice(s, None)), streaming[1])
                starts, sizes = starts[:-1], sizes[:-1]
            small = sizes <= SMALL
            for size in range(2, SMALL + 1):
                at = starts[small & (sizes == size)]
                if len(at) and len(some := _meeting_in(members, at, size, weak)):
                    yield _node_batch(_of(members, some), True)
            branch = []
            for s, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
                # A member that resembles none of another component here, but whom it has met, does so in no child either.
                at = s + (_resembling(_of(members, slice(s, s + n)), weak) if n <= SCREENED else np.arange(n))
                if not len(at):
                    continue
                if len(at) <= FULL or len(at) <= SCREENED and (~_in_largest(members[2][at])).sum() <= min(MEETING, len(at)) // 2:
                    yield _node_batch(_block_meetings(_of(members, at)), True)
                elif (leaders := verdict(sigs[at[:PROBE]])) is None:
                    branch.append(at)
                else:
                    yield from large(_of(members, at), leaders)
            if branch:
                yield from large(_of(members, np.concatenate(branch)), None)

    return run


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Each batch with rows, and whether another one follows."""
    ahead = None
    for batch in batches:
        if batch.num_rows:
            if ahead is not None:
                yield ahead, True
            ahead = batch
    if ahead is not None:
        yield ahead, False


def meetings(classes: DataFrame, similarity: float, trees: range, first: bool = False) -> DataFrame:
    """Meetings (key, id, comp; at most MEETING members each, a few more where keys fall together) of classes (id, comp, sig, seen: keys
    of earlier meetings) that may resemble one of another component, by the trees of these numbers.  The first wave trusts its few leaders."""
    total = classes.count()
    first_depth = depth = max(1, math.ceil(math.log(max(total, 2) / SMALL, 256))) if total > SMALL else 1

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = _mixed((np.array(trees, np.uint64) + np.uint64(1)) * _MIX2)
        for batch in batches:
            ids, comps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sigs, seen = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, COORDINATES), _seen(batch.column(3))
            for root in roots:
                rows, keys = np.arange(len(ids)), np.full(len(ids), root)
                for _ in range(first_depth):
                    keys, row = _children(keys, sigs[rows], similarity)
                    rows = rows[row]
                yield _node_batch((keys, ids[rows], comps[rows], sigs[rows], seen[rows]))

    level = classes.select("id", "comp", "sig", "seen").mapInArrow(seed, _NODE)
    met, rows = None, 2 * total * len(trees)
    node = Window.partitionBy("key")
    while True:
        last = depth >= MAX_DEPTH
        # Nodes of one component, those of one class among them, have nothing to join.
        nodes = level.where("NOT meets").select("key", "id", "comp", "sig", "seen").repartition("key")
        open_ = nodes.withColumn("lo", F.min("comp").over(node)).withColumn("hi", F.max("comp").over(node)).where("lo < hi").drop("lo", "hi")
        # The order inside a node differs from node to node, so that leaders do.  Few rows need few tasks, which hold nodes whole.
        ordered = packed(open_, 8 * rows).sortWithinPartitions("key", F.xxhash64("key", "id"))
        level = durable(ordered.mapInArrow(_level(similarity, last, FIRST_LEADERS if first else LEADERS, first), _NODE))
        found = level.where("meets").select("key", "id", "comp")
        met = found if met is None else met.unionByName(found)
        rows = level.where("NOT meets").count()
        if last or not rows:
            break
        depth += 1
    return met


def _joins(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], part: int) -> list[tuple[int, int]]:
    """Pairs of a meeting's members that are similar enough, as many as join its components."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # Only shingles that several hold can be common ones.
    shared = np.bincount(place, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    owner, column = owner[keep], number[place[keep]]
    common = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        holds = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - low)), np.float32)
        holds[owner[a:b], column[a:b] - low] = 1
        common += np.rint(holds @ holds.T).astype(np.int64)
    near = (common > 0) & (100 * common >= part * (sizes[:, None] + sizes[None, :] - common)) & (comps[:, None] != comps[None, :]) & (ids[:, None] < ids[None, :])
    known, first = np.unique(comps, return_inverse=True)
    root = list(range(len(known)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
        x, y = find(int(first[i])), find(int(first[j]))
        if x != y:
            root[x] = y
            out.append((int(ids[i]), int(ids[j])))
    return out


def compared(docs: DataFrame, met: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that join the components in each meeting (key, id, comp), by the full sets of its members."""
    own = _sets_of(docs, met.select("id").distinct(), width, id_col, text_col)
    # A row is a whole set, so a task takes few of them; meetings stay whole.
    rows = packed(met.join(own, "id").select("key", "id", "comp", "shingles").repartition("key"), 50 * met.count()).sortWithinPartitions("key")
    part = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        key = None

        def ended() -> pa.RecordBatch:
            ids, comps = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
            links = _joins(ids, comps, [h[2] for h in held], part)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

        for batch in batches:
            keys, ids, comps = (batch.column(i).to_pylist() for i in range(3))
            lists = batch.column(3)
            ends, flat = lists.offsets.to_pylist(), lists.values.to_numpy()
            for i, k in enumerate(keys):
                if k != key:
                    if len(held) > 1:
                        yield ended()
                    held, key = [], k
                held.append((ids[i], comps[i], flat[ends[i] : ends[i + 1]].copy()))
        if len(held) > 1:
            yield ended()

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def all_apart(classes: DataFrame, similarity: float, block: int | None = None) -> DataFrame:
    """Candidate pairs (a < b) of all classes (id, comp, sig) in different components, compared in cells of two blocks."""
    weak = round((similarity - WEAK_BELOW) * COORDINATES)
    parts = max(1, math.ceil(classes.count() / (block or BLOCK)))

    def cell(table: pa.Table) -> pa.Table:
        ids, comps, side = (table.column(c).to_numpy() for c in ("id", "comp", "side"))
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        left = np.flatnonzero(side == 0)
        right = left if table.column("ga")[0] == table.column("gb")[0] else np.flatnonzero(side == 1)
        out = [np.empty((0, 2), np.int64)]
        for s in range(0, len(left), 64):
            rows = left[s : s + 64]
            alike = (sigs[rows][:, None, :] == sigs[right][None, :, :]).sum(axis=2)
            i, j = np.nonzero((alike >= weak) & (comps[rows][:, None] != comps[right][None, :]))
            a, b = ids[rows[i]], ids[right[j]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        found = np.concatenate(out)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    own = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts))
    dealt = classes.select("id", "comp", "sig", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("with"))
    cells = dealt.select("id", "comp", "sig", F.least("own", "with").alias("ga"), F.greatest("own", "with").alias("gb"), F.when(F.col("own") > F.col("with"), 1).otherwise(0).alias("side"))
    return cells.groupBy("ga", "gb").applyInArrow(cell, "a bigint, b bigint").distinct()


def audited_pairs(classes: DataFrame, audited: int = AUDITED) -> DataFrame:
    """Pairs a, b of up to ``audited`` classes (those that hash lowest) with PARTNERS classes each at most, those that hash
    lowest among all classes with ALIKE equal minwise values."""
    picked = classes.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(audited).select("id", "sig").collect()
    ids = np.array([r["id"] for r in picked], np.int64)
    shared = classes.sparkSession.sparkContext.broadcast((ids, np.frombuffer(b"".join(r["sig"] for r in picked), np.uint8).reshape(-1, COORDINATES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_sigs = shared.value
        best = np.empty((0, 3), np.uint64)  # hash, place of the class, partner
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, COORDINATES)
            for s in range(0, len(ids), 128):
                alike = (sigs[s : s + 128, None, :] == own_sigs[None, :, :]).sum(axis=2, dtype=np.uint8)
                row, place = np.nonzero(alike >= ALIKE)
                partner = ids[s : s + 128][row]
                row, place, partner = (z[own[place] != partner] for z in (row, place, partner))
                if len(place):
                    h = _mixed(partner.astype(np.uint64) * _MIX1 + place.astype(np.uint64) * _MIX2)
                    best = np.concatenate([best, np.stack([h, place.astype(np.uint64), partner.astype(np.uint64)], axis=1)])
                    order = np.lexsort((best[:, 0], best[:, 1]))
                    rank = np.arange(len(order)) - np.searchsorted(best[order, 1], best[order, 1])
                    best = best[order[rank < PARTNERS]]
        if len(best):
            yield pa.RecordBatch.from_arrays([pa.array((best[:, 0] >> np.uint64(1)).astype(np.int64)), pa.array(own[best[:, 1].astype(np.int64)]), pa.array(best[:, 2].astype(np.int64))], ["h", "a", "b"])

    met = classes.select("id", "sig").mapInArrow(run, "h bigint, a bigint, b bigint")
    rank = F.row_number().over(Window.partitionBy("a").orderBy("h", "b"))
    return met.withColumn("n", rank).where(F.col("n") <= PARTNERS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets_of(docs: DataFrame, ends: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id and shingles of the documents in ``ends`` (id) and of the few other rows that a fixed-size filter can't tell from them."""
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1
    words = ends.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, value in words.collect():  # FILTER_BITS in all, whatever the table; in one job, where an iterator takes one for each partition
        at = (bucket - 1) * len(value)
        bits[at : at + len(value)] = np.frombuffer(value, np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = _WordHashes(), shared.value
        for block in text_blocks(batches, "text"):
            slot = block.column(2).to_numpy()
            block = block.filter(pa.array((known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            if block.num_rows:
                flat, bounds = shingle_sets(block.column(1), width, hashes)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([block.column(0), lists], ["id", "shingles"])

    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("slot")
    rows = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS id", f"`{text_col}` AS text").where("id IS NOT NULL").select("id", "text", slot)
    return rows.mapInArrow(sets, "id bigint, shingles array<bigint>")


def confirmed(docs: DataFrame, pairs: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The candidate pairs whose full sets are similar enough."""
    own = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width, id_col, text_col)
    joined = (
        pairs.join(own.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
        .join(own.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
        .select("a", "b", "left", "right")
    )
    part = round(similarity * 100)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i) for i in (2, 3))
            (ax, af), (bx, bf) = ((x.offsets.to_pylist(), x.values.to_numpy()) for x in (a, b))
            keep = []
            for i in range(batch.num_rows):
                x, y = af[ax[i] : ax[i + 1]], bf[bx[i] : bx[i + 1]]
                if 100 * min(len(x), len(y)) < part * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= part * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return joined.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, trees: int = TREES) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id (the smallest identifier that links reach), kept and audited_recall
    (the share of the audited links that the trees joined, the same on every row; 1 where there were none).

    - Words are runs of anything but ASCII white space, with A-Z lower-cased; a text
      of fewer than ``width`` words is one shingle.
    - A null, empty or blank text has no shingle and links with nothing.
    - Texts of any length enter whole.  Rows that share an identifier are one node of
      the link graph, each with its own row; a null identifier is never kept and
      reaches the component of texts with the same set.
    - Other columns are left out, whatever their names.  An empty table gives no rows.
    """
    own = durable(features(docs, width, id_col, text_col))
    classes = durable(own.where("n > 0 AND id IS NOT NULL").groupBy("print").agg(F.min("id").alias("id"), F.first("sig").alias("sig")))
    links, components, recall = _links(docs, classes, width, similarity, id_col, text_col, trees)
    # A row's identifier is linked with that of its class, which its text makes it equal to.
    same = own.where("n > 0").join(classes.select("print", F.col("id").alias("rep")), "print")
    if _ids_repeat(own):
        repeated = same.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        components = written(connected_components(links.unionByName(repeated)))
    member = classes.join(components, "id", "left").select("print", F.coalesce("component", "id").alias("component"))
    found = own.join(member, "print", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"), F.lit(recall).alias("audited_recall"),
    )


def _waves(trees: int) -> list[range]:
    edges = sorted({0, trees, *[min(trees, sum(WAVES[: k + 1])) for k in range(len(WAVES))]})
    return [range(a, b) for a, b in itertools.pairwise(edges)]


def _links(docs: DataFrame, classes: DataFrame, width: int, similarity: float, id_col: str, text_col: str, trees: int) -> tuple[DataFrame, DataFrame, float]:
    """Links of classes (a, b) that join what is similar enough, the components that they make, and the share of the audited links
    that the trees joined."""
    few = classes.count()
    audited = audited_pairs(classes)
    true = written(packed(confirmed(docs, written(audited), width, similarity, id_col, text_col), AUDITED * PARTNERS))
    links = parts = tried = None

    def added(found: DataFrame) -> None:
        nonlocal links, parts
        links = written(packed(found if links is None else links.unionByName(found), few))
        parts = written(packed(connected_components(links), 2 * few))

    def labelled() -> DataFrame:
        """The classes with the component that they are in and the meetings that they were in."""
        if parts is None:
            return classes.select("id", "sig", F.col("id").alias("comp"), F.array().cast("array<bigint>").alias("seen"))
        seen = packed(tried.groupBy("id").agg(F.collect_list("key").alias("seen")), 2 * few)
        own = classes.select("id", "sig").join(parts, "id", "left").select("id", "sig", F.coalesce("component", "id").alias("comp"))
        return durable(own.join(seen, "id", "left"))

    def wave(some: range, first: bool = False) -> None:
        nonlocal tried
        met = written(packed(meetings(labelled(), similarity, some, first), 2 * few))
        tried = met if tried is None else tried.unionByName(met)
        added(compared(docs, met, width, similarity, id_col, text_col))

    def recall() -> float:
        """The mean over the classes that the audit found links of."""
        joined = _ends(true, parts, few).select(F.explode(F.array("a", "b")).alias("id"), (~_apart()).cast("double").alias("joined"))
        found = joined.groupBy("id").agg(F.avg("joined").alias("joined")).agg(F.avg("joined")).first()[0]
        return 1.0 if found is None else found

    for some in _waves(trees):
        wave(some, not some.start)
    while (share := recall()) < RECALL and trees < MOST_TREES:
        wave(range(trees, trees + MORE_TREES))
        trees += MORE_TREES
    if share < LEAST_RECALL:
        added(confirmed(docs, written(all_apart(labelled(), similarity)), width, similarity, id_col, text_col))
    # What the audit found counts too.
    if not _ends(true, parts, few).where(_apart()).isEmpty():
        added(true)
    return links, parts, share


def _apart():
    """Whether no link joins the ends of a pair with its components."""
    return ~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))


def _ends(pairs: DataFrame, parts: DataFrame, rows: int) -> DataFrame:
    """Pairs, about so many, with the components of their ends (ca, cb), null where nothing is linked."""
    of = lambda n: parts.select(F.col("id").alias(n), F.col("component").alias(f"c{n}"))
    return packed(pairs.join(of("a"), "a", "left"), rows).join(of("b"), "b", "left")


def _ids_repeat(own: DataFrame) -> bool:
    """Whether an identifier stands on rows with different sets."""
    return not own.where("id IS NOT NULL").groupBy("id").agg(F.count_distinct("print").alias("sets")).where("sets > 1").isEmpty()
