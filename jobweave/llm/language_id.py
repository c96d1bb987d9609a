"""Language identification by character language models.

Each language gets an interpolated Kneser-Ney model of the characters of words:
the probability of a character after up to ``ORDER`` - 1 characters of the same
word, discounted counts at the highest order and continuation counts below.  The
counts come from all training documents: words are counted where they are read,
their n-grams are counted once for each distinct word, and discounts, continuation
counts and shares are computed from all of them in Spark.  The models are a sorted
array of n-gram hashes with the shares in the languages that have the n-gram, and a
second one for contexts.

A text goes to the language with the lowest cross-entropy per character.  The
score is the softmax of the negated cross-entropies, at the temperature that makes
it most likely on all training documents; below a threshold that keeps a given share of
them, a text may be rejected.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.llm.blocks import Words, filled, gaps, text_blocks
from jobweave.llm.components import durable

ORDER = 5
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
#: Bins of one look at the scores, and looks: each one goes into the bin that holds the threshold.
BINS, LOOKS = 4096, 3
UNKNOWN = "und"
#: Words are letters (Unicode category L) with the marks on them; numbers and signs are none, whatever \w takes them for.
_LETTERS, _ASCII = regex.compile(r"\p{L}[\p{L}\p{M}]*"), re.compile(r"[a-z]+")
_OPEN, _SHUT = 2, 3  # mark the ends of a word; no letters
_P = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(32, dtype=np.uint64) * _P


def _words_of(value: str) -> list[str]:
    low = value.lower()
    return (_ASCII if low.isascii() else _LETTERS).findall(low)


def _marked(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words with their marks one after another, and where each word begins."""
    points = np.frombuffer(("".join(f"\x02{w}\x03" for w in words)).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return points, np.cumsum(sizes) - sizes


def _grams(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character but the opening marks its place, its n-grams' hashes by order, and how many characters each order has.

    Row k holds the hash of the last k + 1 characters; where the word has fewer, the hash of all it has.
    """
    n = len(points)
    index = np.arange(n)
    age = index - np.repeat(begins, np.diff(np.append(begins, n)))
    at = index[age > 0]
    hashes = np.empty((ORDER, len(at)), np.uint64)
    h = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        has = age[at] >= k
        c = points[np.maximum(at - k, 0)].astype(np.uint64)
        step = (h ^ (c + _SALTS[k + 1])) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = np.where(has, step ^ (step >> np.uint64(29)), h)
        hashes[k] = h
    return at, hashes, np.minimum(age[at] + 1, ORDER)


class Table:
    """Sorted hashes, each with values of some languages; a language without one has ``empty``."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, values: np.ndarray, empty: float):
        order = np.lexsort((langs, keys))
        self.keys, starts = np.unique(keys[order], return_index=True)
        self.starts = np.append(starts, len(keys))
        self.langs, self.values, self.empty = langs[order].astype(np.int16), values[order].astype(np.float32), empty

    def look_up(self, hashes: np.ndarray, languages: int) -> np.ndarray:
        """The values of these hashes, a row each, by language."""
        out = np.full((len(hashes), languages), self.empty)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = np.flatnonzero(self.keys[at] == hashes)
            begin = self.starts[at[known]]
            sizes = self.starts[at[known] + 1] - begin
            entry = np.arange(sizes.sum()) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
            out[np.repeat(known, sizes), self.langs[entry]] = self.values[entry]
        return out


@dataclass
class Models:
    """Models of several languages side by side; they take 12 to 20 bytes for each n-gram, or context, of each language."""

    languages: list[str]
    direct: Table  # discounted share of each gram
    rest: Table  # what a context leaves to the shorter one
    floor: float
    temperature: float = 1.0
    threshold: float = 0.0

    def log_probabilities(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each word in each language, and how many characters it has."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int64)
        points, begins = _marked(words)
        at, hashes, orders = _grams(points, begins)
        # Windows repeat; each distinct one is looked up once.
        _, first, back = np.unique(hashes[-1], return_index=True, return_inverse=True)
        hashes, orders, places = hashes[:, first], orders[first], at[first]
        p = np.full((len(first), len(self.languages)), self.floor)
        contexts = _contexts(points, places, orders)
        for k in range(ORDER):
            live = np.flatnonzero(orders > k)
            own = self.direct.look_up(hashes[k][live] ^ np.uint64(k), len(self.languages))
            p[live] = own + self.rest.look_up(contexts[k][live], len(self.languages)) * p[live]
        log = np.log(p)[back]
        # Characters of a word are neighbours: one fewer than its code points and marks.
        starts = begins - np.arange(len(begins))
        return np.add.reduceat(log, starts, axis=0).astype(np.float32), np.diff(np.append(starts, len(log)))


def _contexts(points: np.ndarray, places: np.ndarray, orders: np.ndarray) -> list[np.ndarray]:
    """Hash of the k characters before each place, for k below ORDER (of all there are, where there are fewer)."""
    out, h = [], np.zeros(len(places), np.uint64)
    for k in range(ORDER):
        if k:
            c = points[np.maximum(places - k, 0)].astype(np.uint64)
            step = (h ^ (c + _SALTS[k + 11])) * np.uint64(0x165667B19E3779F9)
            h = np.where(orders > k, step ^ (step >> np.uint64(31)), h)
        out.append(h ^ np.uint64(k << 8))
    return out


def _hash_grams(grams: list[str], order: int) -> np.ndarray:
    """Hashes of grams of one length, as the scorer makes them."""
    points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(len(grams), order)
    h = np.zeros(len(grams), np.uint64)
    for k in range(order):
        step = (h ^ (points[:, order - 1 - k].astype(np.uint64) + _SALTS[k + 1])) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = step ^ (step >> np.uint64(29))
    return h ^ np.uint64(order - 1)


def _hash_contexts(contexts: list[str], size: int) -> np.ndarray:
    h = np.zeros(len(contexts), np.uint64)
    if size:
        points = np.frombuffer("".join(contexts).encode("utf-32-le"), np.uint32).reshape(len(contexts), size)
        for k in range(1, size + 1):
            step = (h ^ (points[:, size - k].astype(np.uint64) + _SALTS[k + 11])) * np.uint64(0x165667B19E3779F9)
            h = step ^ (step >> np.uint64(31))
    return h ^ np.uint64(size << 8)


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, word, n: how often the documents of each language hold each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[str]] = {}
        for block in text_blocks(batches, "text"):
            words = Words(filled(block.column(0)))
            codes = block.column(1).dictionary_encode()
            names, width = codes.dictionary.to_pylist(), len(words.values)
            owner = np.repeat(codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(words.bounds))
            found = np.bincount(owner * width + words.codes, minlength=len(names) * width).reshape(len(names), width)
            counts: dict[tuple[int, str], int] = defaultdict(int)
            if len(cache) > 200_000:
                cache.clear()
            for y in range(len(names)):
                at = np.flatnonzero(found[y])
                for v, n in zip(at.tolist(), found[y, at].tolist(), strict=True):
                    value = words.values[v]
                    parts = cache.get(value)
                    if parts is None:
                        parts = cache[value] = _words_of(value)
                    for w in parts:
                        counts[y, w] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[y] for y, _ in counts], pa.string()), pa.array([w for _, w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    rows = docs.selectExpr(f"`{text_col}` AS text", f"`{lang_col}` AS lang").where("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, gram, n: the highest-order n-grams of all words, each word as often as it was counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 50_000):
                part = batch.slice(a, 50_000)
                words = part.column(1).to_pylist()
                if not words:
                    continue
                codes = part.column(0).dictionary_encode()
                points, begins = _marked(words)
                at, hashes, orders = _grams(points, begins)
                word = np.searchsorted(begins, at, side="right") - 1
                lang = codes.indices.to_numpy(zero_copy_only=False)[word].astype(np.uint64)
                _, first, back = np.unique((hashes[-1] ^ lang * _P) * np.uint64(0x27D4EB2F165667C5), return_index=True, return_inverse=True)
                n = np.bincount(back, weights=part.column(2).to_numpy()[word].astype(np.float64)).astype(np.int64)
                text, names = points.astype("<u4").tobytes().decode("utf-32-le"), codes.dictionary.to_pylist()
                grams = [text[e + 1 - k : e + 1] for e, k in zip(at[first].tolist(), orders[first].tolist(), strict=True)]
                langs = [names[y] for y in lang[first].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(n)], ["lang", "gram", "n"])

    return words.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounted(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kneser-Ney estimates of the highest-order n-grams of gram_counts(): the shares of grams
    (lang, gram, value) and what contexts leave to shorter ones (lang, gram, value).

    A gram of ORDER characters, or one that begins at the opening mark of a word and so has no
    longer form, has its own count.  Any other counts the different grams that are longer by
    one character before it.  Discounts come from the grams with counts of one and two.
    """
    size = F.length("gram")
    ends = grams.select("lang", "n", size.alias("top"), F.explode(F.sequence(F.lit(1), size)).alias("k"), "gram")
    ends = ends.select("lang", F.expr("right(gram, k)").alias("gram"), F.when(F.col("k") == F.col("top"), F.col("n")).alias("n"))
    forms = ends.groupBy("lang", "gram").agg(F.max("n").alias("n"))
    longer = forms.where(size > 1).groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("kinds"))
    counted = durable(forms.join(longer, ["lang", "gram"], "left").select("lang", "gram", F.coalesce("n", "kinds").alias("c"), size.alias("k")))
    # A row for each language and order.
    few = counted.groupBy("lang", "k").agg(F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos"))
    share = F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.col("ones") / (F.col("ones") + 2 * F.col("twos"))))
    discounts = F.broadcast(few.select("lang", "k", F.when(F.col("ones") > 0, share).otherwise(0.5).alias("d")))
    headed = counted.withColumn("head", F.expr("left(gram, k - 1)"))
    contexts = headed.groupBy("lang", "k", "head").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds")).join(discounts, ["lang", "k"])
    shares = headed.join(contexts, ["lang", "k", "head"]).select("lang", "gram", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("value"))
    return shares, contexts.select("lang", F.col("head").alias("gram"), (F.col("d") * F.col("kinds") / F.col("total")).alias("value"))


def _gathered(estimates: DataFrame, languages: list[str], hashed, empty: float) -> Table:
    """The table of estimates (lang, gram, value), hashed where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            grams, langs = batch.column(1).to_pylist(), batch.column(0).dictionary_encode()
            own = np.array([number[x] for x in langs.dictionary.to_pylist()], np.int32)[langs.indices.to_numpy()]
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            keys = np.empty(len(grams), np.uint64)
            for k in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == k)
                keys[at] = hashed([grams[i] for i in at.tolist()], k)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own), batch.column(2).cast(pa.float32())], ["key", "lang", "value"])

    got = estimates.mapInArrow(run, "key bigint, lang int, value float").toArrow()
    key, lang, value = (got[c].to_numpy() for c in ("key", "lang", "value"))
    return Table(key.view(np.uint64), lang, value, empty)


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models of the languages in ``lang_col`` of all documents where ``usable`` holds, not calibrated yet.

    Rows with a null text or language are not used.  All n-grams of a language are counted and
    estimated in Spark; the driver gathers the finished shares, so what it holds and every task
    gets grows with the different n-grams of the corpus.  An empty table gives models of no language.
    """
    rows = docs.where(usable).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    grams = durable(gram_counts(word_counts(rows, "text", "lang")))
    known = grams.select("lang").distinct().orderBy("lang").collect()
    languages = [r["lang"] for r in known]
    alphabet = grams.select(F.expr("right(gram, 1)")).distinct().count()
    shares, rests = discounted(grams)
    return Models(languages, _gathered(shares, languages, _hash_grams, 0.0), _gathered(rests, languages, _hash_contexts, 1.0), 1.0 / (alphabet + 1))


def calibrated(scored: DataFrame, models: Models, lang_col: str = "lang", keep: float = 0.995) -> Models:
    """The models with the temperature and threshold of rejection that all these rows of entropies() give: the threshold
    is the score that the share ``keep`` of them reaches.  Sums and counts of bins leave Spark, whatever the table."""
    if not models.languages:
        return models
    own = F.array_position(_names(models), F.col(lang_col).cast("string")).cast("int")
    rows = scored.where("letters > 0").select("entropy", own.alias("own")).where("own > 0")
    likely = lambda t: _weight(t) * F.exp((F.array_min("entropy") - F.get("entropy", F.col("own") - 1)) * t)
    losses = rows.agg(*[F.avg(-F.log(F.greatest(likely(t), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    if losses[0] is None:
        return models
    temperature = min(zip(losses, TEMPERATURES, strict=True))[1]
    threshold = _reached(rows.select(_weight(temperature).alias("score")), 1 - keep)
    return replace(models, temperature=temperature, threshold=threshold)


def _reached(scores: DataFrame, share: float) -> float:
    """The score (0 to 1) that stands at this share of all in their order."""
    low, width = 0.0, 1.0
    rank: int | None = None
    for _ in range(LOOKS):
        at = F.least(F.lit(BINS - 1), F.floor((F.col("score") - low) / width * BINS)).alias("bin")
        bins = sorted((r["bin"], r["count"]) for r in scores.where((F.col("score") >= low) & (F.col("score") <= low + width)).groupBy(at).count().collect())
        rank = int((sum(n for _, n in bins) - 1) * share) if rank is None else rank
        for k, n in bins:
            if rank < n or k == bins[-1][0]:
                break
            rank -= n
        low, width = low + k * width / BINS, width / BINS
    return scores.where(F.col("score") >= low).agg(F.min("score")).first()[0] or 0.0


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: float = 0.995) -> Models:
    """Models of train(), calibrated on all documents that they are trained on; ``id_col`` is not read."""
    models = train(docs, usable, text_col, lang_col)
    rows = docs.where(usable).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    return calibrated(durable(entropies(rows, models, "text").select("lang", "letters", "entropy")), models, "lang", keep) if models.languages else models


def _names(models: Models) -> Column:
    return F.array(*[F.lit(x) for x in models.languages])


def _weight(temperature: float) -> Column:
    """Softmax of the language with the lowest entropy."""
    low = F.array_min("entropy")
    return F.aggregate("entropy", F.lit(0.0), lambda acc, e: acc + F.exp((low - e) * temperature), lambda acc: 1 / acc)


class _WordScores:
    """Log-probabilities of distinct space-separated strings, each computed once while the table holds it.

    The table is emptied before it takes more than ``limit`` bytes, or what one block needs.
    """

    def __init__(self, models: Models, limit: int = 64 << 20):
        self.models, self.limit = models, limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0
        self.log = np.zeros((0, len(self.models.languages)), np.float32)
        self.size = np.zeros(0, np.int64)

    def rows(self, values: list[str]) -> np.ndarray:
        missing = [v for v in values if v not in self.index]
        size = lambda some: sum(map(len, some)) + (160 + 4 * len(self.models.languages)) * len(some)
        if self.index and self.held + size(missing) > self.limit:
            self._clear()
            missing = values
        if missing:
            self.held += size(missing)
            words = [_words_of(v) for v in missing]
            owner = np.repeat(np.arange(len(missing)), np.fromiter(map(len, words), np.int64, len(words)))
            log, size = self.models.log_probabilities([w for ws in words for w in ws])
            total, sizes = np.zeros((len(missing), log.shape[1]), np.float32), np.bincount(owner, weights=size, minlength=len(missing)).astype(np.int64)
            for y in range(log.shape[1]):
                total[:, y] = np.bincount(owner, weights=log[:, y], minlength=len(missing))
            self.index.update(zip(missing, range(len(self.size), len(self.size) + len(missing)), strict=True))
            self.log, self.size = np.concatenate([self.log, total]), np.concatenate([self.size, sizes])
        return np.fromiter(map(self.index.__getitem__, values), np.int64, len(values))


def entropies(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows with letters (characters scored) and entropy (array: per character, by language) added; columns of these names are
    replaced.  A null text, and one without letters, has none and an entropy of 0; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _WordScores(shared.value)

        def sums(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            if len(texts) == 1 and (cuts := gaps(texts[0].as_py())):  # a text longer than a block goes in parts
                text = texts[0].as_py()
                parts = [sums(pa.array([text[a:b]])) for a, b in itertools.pairwise([0, *cuts, len(text)])]
                return sum(n for n, _ in parts), sum(total for _, total in parts)
            words = Words(texts)
            codes = table.rows(words.values)[words.codes]
            owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
            totals = [np.bincount(owner, weights=table.log[codes, y], minlength=len(texts)) for y in range(table.log.shape[1])]
            return np.bincount(owner, weights=table.size[codes], minlength=len(texts)), np.stack(totals, axis=1)

        for block in text_blocks(batches, text_col):
            letters, total = sums(filled(block.column(block.schema.get_field_index(text_col))))
            entropy = -total / np.maximum(letters, 1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(block.num_rows + 1, dtype=np.int32) * entropy.shape[1]), pa.array(entropy.ravel()))
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(letters.astype(np.int64)), lists], [*block.schema.names, "letters", "entropy"])

    rows = docs.drop("letters", "entropy")
    schema = T.StructType([*rows.schema.fields, T.StructField("letters", T.LongType()), T.StructField("entropy", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, models: Models, text_col: str = "text", reject_below: float | None = None) -> DataFrame:
    """The rows with lang_pred and score (0 to 1) added, or replaced where they exist.

    A null text, a text without letters, any text where no language was learned, and with
    ``reject_below`` (models.threshold is the calibrated one) a text of a lower score get
    ``und``; the first three with score 0.  Ties go to the language first in the alphabet.  Texts
    of any length are scored whole; repeated rows score alike; an empty table gives no rows;
    other columns are passed through, whatever their names.
    """
    if not models.languages:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = entropies(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text_col).alias("text")), models, "text")
    known = (F.col("letters") > 0) & F.col("text").isNotNull()
    lang, score = labels(models, known, reject_below)
    return rows.select("row", lang.alias("lang_pred"), score.alias("score")).select("row.*", "lang_pred", "score")


def labels(models: Models, known: Column, reject_below: float | None = None) -> tuple[Column, Column]:
    """The language and score of a row of entropies(), as predict() gives them; ``known`` tells whether it has any."""
    score = F.when(known, _weight(models.temperature)).otherwise(0.0)
    lang = F.when(known, F.get(_names(models), F.array_position("entropy", F.array_min("entropy")).cast("int") - 1)).otherwise(UNKNOWN)
    return lang if reject_below is None else F.when(score < reject_below, UNKNOWN).otherwise(lang), score
