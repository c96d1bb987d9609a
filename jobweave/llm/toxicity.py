"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the distinct hashes (62 bits) of its words, of the words'
openings of four, five and six letters (inflected forms share them), of pairs of
neighbouring words and of pairs one word apart.  Training follows the regularised
leader with a learning rate for each coordinate; the L1 term keeps the weights of
all but the telling features at exactly zero, so the weights that remain are a
short sorted table that is broadcast to the scoring tasks.

The classifier is fitted on at most ``SAMPLE`` labelled documents of either class,
those whose identifiers hash lowest, in one task; the intercept is then moved to
the share of toxic rows among all rows that may be used for training.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.blocks import ChunkTable, Words, filled, text_blocks

#: Labelled documents of either class that the classifier is fitted on, at most.
SAMPLE = 2000
EPOCHS = 5
ALPHA, BETA, L2 = 1.0, 1.0, 0.0
#: Of a full sample; a smaller one gets less in proportion, and FEWEST_L1 at least.
L1, FEWEST_L1 = 8.0, 2.0
THRESHOLD = 0.7
#: Hashes of a word: the whole and its openings.
OPENINGS = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")
_MASK = np.uint64((1 << 62) - 1)
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P1
    return (x ^ (x >> np.uint64(29))) & _MASK


def _word_hashes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each string the hashes of its words and of their openings, as pairs of 32-bit numbers."""
    digest, out, lengths = xxhash.xxh3_64_intdigest, [], []
    width = 2 * (1 + len(OPENINGS))
    for s in strings:
        words = _WORD.findall(s.lower())
        lengths.append(width * len(words))
        for w in words:
            out.append(digest(w))
            out.extend(digest(w[:k], k) if len(w) > k else 0 for k in OPENINGS)
    return np.asarray(out, np.uint64).view(np.int32), np.asarray(lengths, np.int64)


class Featurizer:
    """Feature hashes of a block of texts."""

    def __init__(self) -> None:
        self.table = ChunkTable(_word_hashes)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (one row for each kind of feature, 0 for none) and the bounds of each text."""
        words = Words(filled(texts))
        flat, ends = self.table.gather(self.table.rows(words.values)[words.codes])
        width = 1 + len(OPENINGS)
        h = np.ascontiguousarray(flat).view(np.uint64).reshape(-1, width)
        bounds = ends[words.bounds] // (2 * width)
        n = len(h)
        kinds = np.zeros((width + 2, n), np.uint64)
        kinds[:width] = h.T & _MASK
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for k, gap, salt in ((0, 1, _P2), (1, 2, _P3)):
            if n > gap:
                pair = _mixed(h[:-gap, 0] * salt + h[gap:, 0])
                kinds[width + k, : n - gap] = np.where(row[:-gap] == row[gap:], pair, np.uint64(0))
        return kinds, bounds


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes with their weights, and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    intercept: float

    def scorer(self):
        """A function from texts to scores."""
        features = Featurizer()
        screen = np.zeros(1 << 20, bool)  # which low bits any key has
        screen[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

        def score(texts: pa.Array) -> np.ndarray:
            kinds, bounds = features(texts)
            total = np.full(len(bounds) - 1, self.intercept)
            if len(self.keys):
                where, found = [], []
                for hashes in kinds:
                    at = np.flatnonzero(screen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    spot = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
                    hit = self.keys[spot] == hashes[at]
                    where.append(at[hit])
                    found.append(spot[hit])
                # Each feature counts once a text.
                row = np.searchsorted(bounds, np.concatenate(where), side="right") - 1
                seen = np.unique(row * len(self.keys) + np.concatenate(found))
                np.add.at(total, seen // len(self.keys), self.weights[seen % len(self.keys)])
            return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

        return score


def fit_rows(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Keys, weights and intercept of the non-zero coordinates after training in the order of the rows."""
    features = Featurizer()
    sets: list[np.ndarray] = []
    for block in text_blocks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text"):
        kinds, bounds = features(block.column(0))
        sets += [np.setdiff1d(kinds[:, a:b], [np.uint64(0)]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    # A feature of one training text alone can't be told from chance.
    values, counts = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
    keys = values[counts > 1]
    rows = [np.searchsorted(keys, x[np.isin(x, keys, assume_unique=True)]) for x in sets]
    z, n, b = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(2)
    l1 = max(FEWEST_L1, L1 * min(1.0, len(labels) / (2 * SAMPLE)))

    def weight(zi: np.ndarray, ni: np.ndarray, least: float) -> np.ndarray:
        w = -(zi - np.sign(zi) * least) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= least, 0.0, w)

    for _ in range(epochs):
        for at, y in zip(rows, labels.tolist(), strict=True):
            zi, ni = z[at], n[at]
            w, w0 = weight(zi, ni, l1), weight(b[:1], b[1:], 0.0)[0]
            g = 1 / (1 + math.exp(-max(-40.0, min(40.0, float(w.sum()) + w0)))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
            b = np.array([b[0] + g - (math.sqrt(b[1] + g * g) - math.sqrt(b[1])) / ALPHA * w0, b[1] + g * g])
    w = weight(z, n, l1)
    return keys[w != 0], w[w != 0], float(weight(b[:1], b[1:], 0.0)[0])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model learned from ``labels`` (``id_col``, ``label_col`` 0 or 1) on the documents where ``usable`` (over ``id_col``) holds.

    Rows with a null identifier or label are not used.  An identifier with several labels has
    the largest, one with several texts the smallest of them.  Without labels of both
    classes, as with empty tables, the model scores every text alike, by the share of toxic labels.
    """
    known = labels.where(usable).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    prior = math.log((toxic + 0.5) / (clean + 0.5))
    if not toxic or not clean:
        return Model(np.empty(0, np.uint64), np.empty(0), prior)
    order = F.xxhash64("id")
    picked = known.where("label = 1").orderBy(order, "id").limit(sample).unionByName(known.where("label = 0").orderBy(order, "id").limit(sample))
    # At most 2 * sample identifiers: a bounded broadcast, so no text is shuffled to find its label.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got).combine_chunks()
            keys, weights, intercept = fit_rows(table["text"].combine_chunks(), table["label"].to_numpy())
            keys = np.concatenate([[np.uint64(0)], keys])
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.concatenate([[intercept], weights]))], ["key", "weight"])

    few = rows.groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label", order.alias("h"), "id").repartition(1).sortWithinPartitions("h", "id").select("text", "label")
    learned = few.mapInArrow(train, "key bigint, weight double").toPandas()
    if learned.empty:
        return Model(np.empty(0, np.uint64), np.empty(0), prior)
    # The sample holds the classes in another proportion than the labels do.
    shift = prior - math.log(min(toxic, sample) / min(clean, sample))
    keys, weights = learned["key"].to_numpy().astype(np.uint64)[1:], learned["weight"].to_numpy()
    return Model(keys, weights[1:], float(weights[0]) + shift)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with ``score_col`` (0 to 1) added, or replaced where it exists.

    Null and empty texts get the score of no features; texts of any length are
    scored whole; repeated rows score alike; an empty table gives no rows; other columns are passed through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for block in text_blocks(batches, text_col):
            scores = scorer(block.column(block.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(scores)], [*block.schema.names, score_col])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(score_col, T.DoubleType())]))
