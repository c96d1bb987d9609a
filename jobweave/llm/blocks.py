"""Helpers for Arrow batches of texts inside tasks."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at a time, unless one text alone is longer.
BLOCK_BYTES = 4 << 20


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of text each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")


class Words:
    """The pieces of each text between single spaces, as codes into their distinct values."""

    def __init__(self, texts: pa.Array, split: Callable[[pa.Array], pa.Array] | None = None):
        lists = split(texts) if split else pc.split_pattern(texts, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        encoded = lists.flatten().dictionary_encode()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False)
        self.distinct: pa.Array = encoded.dictionary
        self.values: list[str] = self.distinct.to_pylist()

    def rows_with(self, marked: np.ndarray) -> np.ndarray:
        """Rows that hold a value marked in a boolean array over the distinct values."""
        hits = np.concatenate([[0], np.cumsum(marked[self.codes])])
        return hits[self.bounds[1:]] > hits[self.bounds[:-1]]


#: A space between two letters or digits: no token and no marked word runs across it into the next word.
_GAP = re.compile(r"(?<=\w) (?=\w)")


def gaps(text: str, size: int = BLOCK_BYTES) -> list[int]:
    """Places of single spaces, about ``size`` characters apart, where a long text can be cut between two words."""
    cuts: list[int] = []
    at = 0
    while len(text) - at > size and (m := _GAP.search(text, at + size)):
        at = m.start()
        cuts.append(at)
    return cuts


class ChunkTable:
    """Integer lists of distinct chunks: each chunk is encoded once while the table holds it.

    The table is emptied before it takes more than ``limit`` bytes (counted as the characters,
    the integers and ENTRY bytes a chunk), so its memory is bounded by that or by one block.
    """

    ENTRY = 160

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 32 << 20):
        self.encode, self.limit = encode, limit  # encode gives the ids of all chunks one after another, and how many each has
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0
        self.flat, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64)
        self.starts = self.lengths

    def rows(self, values: list[str]) -> np.ndarray:
        """The table's row of each of these distinct chunks."""
        missing = [v for v in values if v not in self.index]
        size = lambda some: sum(map(len, some)) + self.ENTRY * len(some)
        if self.index and self.held + size(missing) > self.limit:
            self.clear()
            missing = values
        if missing:
            flat, lengths = self.encode(missing)
            self.index.update(zip(missing, range(len(self.lengths), len(self.lengths) + len(missing)), strict=True))
            self.flat = np.concatenate([self.flat, flat], dtype=np.int32, casting="unsafe")
            self.lengths = np.concatenate([self.lengths, lengths])
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.held += size(missing) + flat.nbytes
        return np.fromiter(map(self.index.__getitem__, values), np.int64, len(values))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists in these rows one after another, and the bounds of each."""
        lengths = self.lengths[rows]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(bounds[-1], dtype=np.int64) + np.repeat(self.starts[rows] - bounds[:-1], lengths)
        return self.flat[at], bounds


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(lengths.sum())), lengths


def joined_by_row(table: ChunkTable, rows: np.ndarray, bounds: np.ndarray, other: dict[int, np.ndarray]) -> pa.ListArray:
    """One list a text: the table's lists in ``rows`` between the text's bounds, or ``other``'s list for that text."""
    flat, ends = table.gather(rows)
    offsets = ends[bounds]
    if other:
        parts, lengths = [], np.diff(offsets)
        for row, ids in other.items():
            lengths[row] = len(ids)
        last = 0
        for row in sorted(other):
            parts += [flat[offsets[last] : offsets[row]], other[row]]
            last = row + 1
        flat = np.concatenate([*parts, flat[offsets[last] :]])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
