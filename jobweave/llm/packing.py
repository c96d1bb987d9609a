"""Best-fit packing of token lists into sequences of bounded length.

Documents are tokenised where they are read, only those longer than a sequence
are cut (the short piece first, then whole sequences), and the pieces are dealt
by hash to packing tasks.  Each task packs a stream of pieces with a bounded
number of open sequences.  A bitset keyed by free space holds which amounts of
free space are open: the lowest set bit at or above a piece's length is the
best fit, and when too many sequences are open, the fullest closes first.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.llm.blocks import filled, gaps, text_blocks

SEQUENCE = 2048
#: Sequences that a packing task keeps open.
OPEN_BINS = 1 << 16
END_ID = 0
#: Characters of a long text that are encoded at a time, about.
LONG = 1 << 20


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: How byte-level BPE cuts a text before it merges bytes (fixed value of the vocabulary's family).
_CUTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable
    Latin-1 characters for themselves, characters from 256 on for the others in turn."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[str], np.ndarray]:
    """From a text to its ids.  Where the file's merges come in the order of their ids, which
    is how this vocabulary is built, merging by id gives the same ids as merging by the
    list, and the quicker library does it; else the file's own tokenizer.  The strings of
    the file's added tokens stand for those tokens, as that tokenizer has it."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, added = content["model"], content.get("added_tokens") or []
    vocabulary, byte = model["vocab"], _byte_of()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocabulary.get("".join(p), -1) for p in pairs]
    if made != list(range(256, 256 + len(made))) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        tokenizer = _tokenizer(path)
        return lambda text: np.asarray(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
    import tiktoken

    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(made)}
    special = {t["content"]: t["id"] for t in added}
    encoding = tiktoken.Encoding("by_id", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if any(t in text for t in special):
            return np.asarray(encoding.encode(text, allowed_special="all"), np.int32)
        # A long text is encoded in parts, so that only one part's ids are ever Python objects.
        ends = [0, *gaps(text, LONG), len(text)]
        parts = [np.asarray(encoding.encode_ordinary(text[a:b]), np.int32) for a, b in itertools.pairwise(ends)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    return encode


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each has."""
    encode = _encoder(path)
    ids = [encode(text.as_py()) for text in filled(texts)]
    return np.concatenate([np.empty(0, np.int32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))


def tokenise(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE) -> DataFrame:
    """Pieces of documents: id, piece, start, length and ids; see pack()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            flat, sizes = encode_texts(block.column(1), tokenizer_path)
            flat = np.insert(flat, np.cumsum(sizes), END_ID)
            sizes = sizes + 1
            begins = np.cumsum(sizes) - sizes
            pieces = -(-sizes // length)
            row = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = sizes - (pieces - 1) * length
            start = np.where(number == 0, 0, head[row] + (number - 1) * length)
            size = np.where(number == 0, head[row], length)
            bounds = np.concatenate([begins[row] + start, [len(flat)]])
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), ids],
                ["id", "piece", "start", "length", "ids"],
            )

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    return rows.mapInArrow(run, schema)


class BestFit:
    """Bounded-space online best fit."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.limit = length, open_bins
        self.free = 0  # bit f: a sequence with f free places is open
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """The sequence and the place in it for a piece of this size."""
        fits = self.free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            which = self._take(room)
        else:
            room, which = self.length, self.made
            self.made += 1
        left = room - size
        if left:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            self.bins[left].append(which)
            self.free |= 1 << left
            self.open += 1
        return which, self.length - room

    def _take(self, room: int) -> int:
        which = self.bins[room].pop()
        self.open -= 1
        if not self.bins[room]:
            self.free ^= 1 << room
        return which


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids, sequence_id, offset.

    - Every document ends with id 0, so a null or empty text is one piece of one id.
    - Texts of any length are tokenised whole; repeated rows are packed each;
      other columns are left out, whatever their names.
    - Pieces of a packing task come longest first, ties by identifier, so a lost
      task is packed again in the same way.  An empty table gives no pieces.
    """
    pieces = tokenise(docs, tokenizer_path, id_col, text_col, length)
    dealt = pieces.repartition(F.xxhash64("id", "piece", "length")).sortWithinPartitions(F.col("length").desc(), "id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            which = pa.array([base + s for s, _ in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, which, pa.array([o for _, o in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)
