"""Exact token counts at every prefix of a text, by dynamic programming over the last token.

The tokens of a prefix are those of a shorter prefix and one more: its last token.
Byte pair encoding gives a sequence of tokens exactly when it gives every two
neighbours of it, so the last token of a prefix is the one token ending there that
agrees with the last token of the prefix before it.  One table over a word's bytes
so holds the count at each of them, and that of the word cut there, whose last token
ends the word.  White space is dropped and no token crosses it, so each distinct run
between white space is worked out once, and sums of whole runs do the rest.

Truncation and budgets are then read from the table; nothing is encoded again.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.llm.blocks import ChunkTable, Words, filled, flattened, text_blocks

#: Code points in a row of the prefix table, unless one run between white space is longer.
PART = 1 << 15
#: Characters of words, pairs of tokens, and bytes of runs that a worker keeps tables of.
_WORDS_HELD, _PAIRS_HELD, _RUNS_HELD = 8 << 20, 1 << 19, 96 << 20
#: Bytes as the characters that stand for them in the vocabulary: printable ones themselves, the others from 256 on in order.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_RUN = re.compile(r"[^\x20\x09-\x0D]+")


@functools.cache
def _joins_back() -> frozenset[str]:
    """Characters that composition may join with one before them."""
    pairs = (unicodedata.decomposition(chr(c)) for c in range(0x110000))
    seconds = {chr(int(p.split()[1], 16)) for p in pairs if p and p[0] != "<" and " " in p}
    return frozenset(seconds | {chr(c) for c in range(0x1161, 0x11C3)})


class PrefixCounter:
    """Counts at every prefix, for a tokenizer file of byte pair encoding that drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        if model["type"] != "BPE" or self._pieces(self._normal(" a  b")) != self._pieces(self._normal("a b ")):
            raise ValueError(f"{path} is no byte pair encoding that drops white space")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.found = ahocorasick.Automaton()
        bodies = {t.removesuffix(self.end) if self.end else t for t in self.vocab} - {""}
        for body in bodies:
            self.found.add_word(body, (len(body), body if body in self.vocab else "", body + self.end if body + self.end in self.vocab else ""))
        self.found.make_automaton()
        added = [t.content for t in whole.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._shortcut()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.held = 0

    def _normal(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def _pieces(self, text: str) -> list[str]:
        return [p for p, _ in self.splitter.pre_tokenize_str(text)]

    def _shortcut(self) -> None:
        """Patterns for text of printable ASCII and Latin letters that are their own normal form, and for its pieces, if the file's rules give these."""
        letters = [c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and self._normal(c) == c.lower() and len(c.lower()) == 1 and len(self._pieces(c.lower())) == 1]
        low = "".join(sorted({c.lower() for c in letters} & set(letters)))
        self.plain = re.compile(f"[\x21-\x7E{low}{''.join(c for c in letters if c.lower() in low)}]+")
        self.split = re.compile(f"'(?:[stmd]|re|ve|ll)|[a-z{low}]+|[0-9]|[^a-z0-9{low}]+")
        probes = ["".join(map(chr, range(0x21, 0x7F))), *"I'm it's won't we'll 'RE a1b22 'x '' 'lll ...'d!!'ve 3's été-à1".split(), low]
        if any([m[0] for m in self.split.finditer(w.lower())] != [self._normal(w)[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(self._normal(w))] for w in probes):
            self.plain = re.compile("(?!)")

    def _symbols(self, token: str, ends: bool) -> list[str]:
        """The smallest tokens of a token, whose last one carries the word's end."""
        if not ends:
            return list(token)
        body = token[: len(token) - len(self.end)]
        return [*body[:-1], body[-1] + self.end]

    def _merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: (self.ranks.get((symbols[i], symbols[i + 1]), 1 << 60), i))
            if (symbols[best], symbols[best + 1]) not in self.ranks:
                break
            symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2 :]]
        return symbols

    def _agree(self, left: str, right: str, ends: bool) -> bool:
        """Whether both tokens (left may be none) come out of their characters as they are."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= _PAIRS_HELD:
                self.pairs.clear()
            symbols = self._symbols(left, False) + self._symbols(right, ends)
            known = self.pairs[left, right] = self._merged(symbols) == ([left, right] if left else [right])
        return known

    def _cuts(self, letters: str) -> list[int]:
        """Tokens of the word (one character a byte) cut after each of its characters."""
        n, pairs = len(letters), self.pairs
        last, count, cut = [""] * (n + 1), [0] * (n + 1), [0] * n
        for at, (size, inner, closing) in self.found.iter(letters):  # the longest first of those that end at a place
            j = at + 1 - size
            before = last[j]
            if inner and not last[at + 1]:
                fits = pairs.get((before, inner))
                if self._agree(before, inner, False) if fits is None else fits:
                    last[at + 1], count[at + 1] = inner, count[j] + 1
            if closing and not cut[at]:
                fits = pairs.get((before, closing))
                if self._agree(before, closing, True) if fits is None else fits:
                    cut[at] = count[j] + 1
        return cut

    def word(self, piece: str) -> list[int]:
        """Tokens of a piece of text cut after each of its code points."""
        known = self.words.get(piece)
        if known is not None:
            return known
        if piece.isascii():
            counts = self._cuts(piece.translate(_LETTERS))
        else:
            counts = self._cuts(piece.encode().decode("latin-1").translate(_LETTERS))
            counts = [counts[e - 1] for e in itertools.accumulate(len(c.encode()) for c in piece)]
        if piece[0] == "'" and 1 < len(piece) < 4:  # a clitic that is cut short is other pieces
            shorter = [self.splitter.pre_tokenize_str(piece[:k]) for k in range(1, len(piece))]
            counts = [*[sum(self.word(piece[a:b])[-1] for _, (a, b) in found) for found in shorter], counts[-1]]
        if self.held > _WORDS_HELD:
            self.words.clear()
            self.held = 0
        self.words[piece] = counts
        self.held += len(piece) + 8
        return counts

    def _normalised(self, text: str, pieces: Iterable[tuple[str, int]]) -> list[int]:
        """Counts at each code point of normalised text, which has these pieces (and where they begin)."""
        out: list[int] = []
        total, words = 0, self.words
        for piece, start in pieces:
            if start > len(out):
                out += [total] * (start - len(out))
            counts = words.get(piece) or self.word(piece)
            out += [total + c for c in counts] if total else counts
            total += counts[-1]
        return out + [total] * (len(text) - len(out)) if len(out) < len(text) else out

    def _plain(self, text: str) -> list[int]:
        """Counts at each code point of text without special tokens; a place inside a combining sequence counts as that before it."""
        if self.plain.fullmatch(text):
            lowered = text.lower()
            if lowered.isalpha():
                return self.words.get(lowered) or self.word(lowered)
            return self._normalised(lowered, ((m[0], m.start()) for m in self.split.finditer(lowered)))
        normal = self._normal(text)
        counts = self._normalised(normal, ((normal[a:b], a) for _, (a, b) in self.splitter.pre_tokenize_str(normal)))
        if text.isascii():
            return counts
        joins = _joins_back()
        apart = lambda a, b: not (a.isspace() and b.isspace()) or self._normal(a + b) != " "
        cuts = [i for i, c in enumerate(text) if i and not unicodedata.combining(c) and c not in joins and apart(text[i - 1], c)] + [len(text)]
        out, done = [], 0
        for a, b in itertools.pairwise([0, *cuts]):
            out += [counts[done - 1] if done else 0] * (b - a - 1)
            done += len(self._normal(text[a:b]))
            out.append(counts[done - 1] if done else 0)
        return out

    def run(self, text: str) -> list[int]:
        """Counts at each code point of a run between white space: the tokens of the run cut behind it."""
        pieces = self.special.split(text) if self.special and self.special.search(text) else [text]
        if len(pieces) == 1:
            return self._plain(text)
        out: list[int] = []
        total = 0
        for k in range(0, len(pieces), 2):
            plain, special = pieces[k], pieces[k + 1] if k + 1 < len(pieces) else ""
            # A special token that is cut short is ordinary text, read together with what stands before it.
            counts = self._plain(plain + special[:-1]) if plain or special else []
            out += [total + c for c in counts]
            total += counts[len(plain) - 1] if plain else 0
            if special:
                total += 1
                out.append(total)
        return out



@functools.lru_cache(maxsize=1)
def _table(path: str) -> ChunkTable:
    """Counts of distinct runs, each worked out once while the table holds it; a worker's tasks share it."""
    counter = PrefixCounter(path)
    return ChunkTable(lambda runs: flattened([counter.run(r) for r in runs]), _RUNS_HELD)


def _words(block: pa.RecordBatch, place: int) -> Words:
    return Words(pc.ascii_trim_whitespace(filled(block.column(place))), pc.ascii_split_whitespace)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """The rows with the number of tokens of their whole text, special tokens' strings in it counted as the library does.

    - A null, empty or blank text has none.  Texts of any length are counted whole.
    - Rows that repeat, and rows without identifiers, each have their own count; an empty table stays empty.
    - A column named as ``count_col`` is replaced; all others stay as they are.
    """
    kept = docs.drop(count_col)
    names = kept.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for block in text_blocks(batches, text_col):
            words = _words(block, place)
            rows = table.rows(words.values)
            ends = table.starts[rows] + table.lengths[rows]
            last = np.where(table.lengths[rows] > 0, np.concatenate([[0], table.flat])[ends], 0) if len(rows) else np.empty(0, np.int64)
            sums = np.concatenate([[0], np.cumsum(last[words.codes], dtype=np.int64)])
            counts = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(counts, pa.int64())], [*names, count_col])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(count_col, T.LongType())]))


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """The tokens at every prefix: rows (``id_col``, part, begin, counts, last), where counts[i] are those of the first begin + i code points.

    Parts of a text follow one another from 0, cut between words, about ``part`` code points each; the first place of a part
    repeats the last of the part before it.  ``last`` marks the part that ends the text.  Null, empty and blank texts have one
    part.  Rows that share an identifier each have their parts.  An empty table gives no rows; other columns are left out.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL("part int, begin bigint, counts array<int>, last boolean").fields])

    def parts(text: str, counts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, bool]]:
        begin, done, total, held = 0, 0, 0, [np.zeros(1, np.int32)]
        for m, run in zip(_RUN.finditer(text), counts, strict=True):
            if m.start() - begin >= part:
                held.append(np.full(m.start() - done, total, np.int32))
                yield begin, np.concatenate(held), False
                begin, done, held = m.start(), m.start(), [np.array([total], np.int32)]
            held += [np.full(m.start() - done, total, np.int32), total + run]
            total, done = total + int(run[-1]), m.end()
        held.append(np.full(len(text) - done, total, np.int32))
        yield begin, np.concatenate(held), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for block in text_blocks(batches, "_text"):
            words = _words(block, 1)
            at = table.rows(words.values)
            for i, text in enumerate(filled(block.column(1)).to_pylist()):
                flat, bounds = table.gather(at[words.codes[words.bounds[i] : words.bounds[i + 1]]])
                runs = [flat[a:b] for a, b in itertools.pairwise(bounds.tolist())] if text.strip(" \t\n\v\f\r") else []
                for k, (begin, counts, last) in enumerate(parts(text, runs)):
                    arrays = [block.column(0).slice(i, 1), pa.array([k], pa.int32()), pa.array([begin], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int32())), pa.array([last])]
                    yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return rows.mapInArrow(run, schema)


def longest_within(table: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and n_chars: the longest prefix of each text, in code points, that has at most ``limit`` tokens.

    Read from the prefix table alone.  A count can fall where a word is completed, so the last place counts that
    keeps to the limit.  Rows that share an identifier give the longest of theirs."""
    kept = F.size("counts") - F.array_position(F.transform(F.reverse("counts"), lambda c: c <= limit), True)
    place = F.when(F.exists("counts", lambda c: c <= limit), F.col("begin") + kept)
    return table.groupBy(id_col).agg(F.max(place).alias("n_chars"))


def tokens_at(table: DataFrame, asked: DataFrame, id_col: str = "doc_id", at_col: str = "at", part: int = PART) -> DataFrame:
    """The rows of ``asked`` (``id_col``, ``at_col``: a number of code points) with n_tokens of that prefix; places beyond a text get none.

    Each place meets the one part that holds it: parts are looked up by the stretches of ``part`` code points that they touch."""
    ends = F.col("begin") + F.size("counts") - F.when(F.col("last"), 1).otherwise(2)
    spread = table.select(F.col(id_col), "begin", "counts", ends.alias("_end"), F.explode(F.sequence(F.floor(F.col("begin") / part), F.floor(ends / part))).alias("_stretch")).where("_end >= begin")
    asked = asked.withColumn("_stretch", F.floor(F.col(at_col) / part))
    met = asked.join(spread.withColumnRenamed(id_col, "_id"), (F.col(id_col) == F.col("_id")) & (asked["_stretch"] == spread["_stretch"]) & F.col(at_col).between(F.col("begin"), F.col("_end")), "left")
    return met.select(*[c for c in asked.columns if c != "_stretch"], F.get("counts", (F.col(at_col) - F.col("begin")).cast("int")).alias("n_tokens"))
