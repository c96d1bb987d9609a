"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field.

The patterns (e-mail addresses, IP addresses, card and phone numbers) always
report.  Beside them, regions with an @ or several digits are cut into atoms
(runs of letters and digits, or single characters), and a semi-Markov conditional
random field scores every segment of up to ``LONGEST`` atoms by features of the
whole span: its length, its digits, how digits group, what it begins with, which
separators it holds and what stands before it.  Dynamic programming over segments
of bounded length chooses boundaries and types together.  Entities that don't
touch a span of the patterns are added.

The field is trained by gradient steps on its conditional log-likelihood, on the
at most ``REGIONS`` regions whose pattern spans serve as labels.  In
half of the training regions the features that give the pattern away (a leading
plus sign, a valid check digit) are left out, so that the field does not lean on
them alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.llm.blocks import filled, text_blocks

KINDS = ("email", "ip", "card", "phone")
#: Regions that the field is fitted on, at most.
REGIONS = 1200
#: Atoms of an entity at most; atoms of a region whose entities are decoded at once, with twice LONGEST more on either side.
LONGEST, REGION_ATOMS = 24, 160
#: Characters of ordinary text kept on either side of a region, and digits that make one.
MARGIN, DIGITS = 24, 7
EPOCHS, RATE, DECAY = 6, 0.3, 1e-3
#: Probability that an added entity needs, over all segmentations, to be reported.
CONFIDENCE = 0.8
_REGION = re.compile(r"[^\s@]{1,64}@[^\s@]{1,64}|[+(]?[0-9](?:[^0-9\n]{0,3}[0-9]){6,}")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^\sA-Za-z0-9]")
# Fixed patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """An address begins where its run of local characters does, unless the address before it reaches in."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield "email", start, done
            at = text.find("@", done)
        else:
            # No other start in this run can match; the next address begins behind the sign at the earliest.
            done = max(done, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of each match of the fixed patterns that passes its test."""
    found = list(_emails(text)) if "@" in text else []
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def regions(text: str) -> list[tuple[int, int]]:
    """Where the field is decoded, with some ordinary text on either side."""
    out: list[tuple[int, int]] = []
    for m in _REGION.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


#: Features of a span, in this order.
FEATURES = (
    "bias", "has_at", "one_at", "dot_behind_at", "letters", "digits_only", "digits_7_9", "digits_10_11", "digits_12_13", "digits_14_19", "digits_20",
    "four_groups", "small_groups", "dots_between", "space_inside", "dash_inside", "bracket_inside", "other_inside", "plus_first", "bracket_first",
    "check_digit", "word_edge_left", "word_edge_right", "label_before", "atoms_1", "atoms_2_4", "atoms_5_9", "atoms_10",
)
_GIVEAWAYS = [FEATURES.index("plus_first"), FEATURES.index("check_digit")]
_LABELS = re.compile(r"(?i:e-?mail|mail|phone|tel|mobile|call|fax|ip|host|card|visa|account)\W*$", re.ASCII)


@lru_cache(maxsize=50_000)
def _features(span: str, before: str, after: str, atoms: int) -> tuple[float, ...]:
    digits = _digits(span)
    n, groups = len(digits), re.findall(r"[0-9]+", span)
    head, _, tail = span.partition("@")
    letters = any(c.isalpha() for c in span)
    inner = set(span) - set("0123456789")
    values = (
        True, "@" in span, span.count("@") == 1 and bool(head), "." in tail, letters, n == len(span), 7 <= n <= 9, 10 <= n <= 11, 12 <= n <= 13, 14 <= n <= 19, n >= 20,
        len(groups) == 4, bool(groups) and all(len(g) <= 3 for g in groups), bool(inner) and inner <= {"."}, " " in span, "-" in span, "(" in span, bool(inner - set(" .-()@+") ) and not letters,
        span[0] == "+", span[0] == "(", n >= 12 and luhn(digits), bool(before) and before[-1].isalnum(), bool(after) and after[0].isalnum(), bool(_LABELS.search(before)),
        atoms == 1, 2 <= atoms <= 4, 5 <= atoms <= 9, atoms >= 10,
    )
    return tuple(map(float, values))


@dataclass
class Field:
    """Weights of the features for each kind, and of a kind behind what came before it (ordinary text last)."""

    weights: np.ndarray
    moves: np.ndarray

    @staticmethod
    def lattice(text: str, drop: bool = False) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
        """Atoms, candidate segments (first atom, atom behind the last) by their end, and their features."""
        atoms = [(m.start(), m.end()) for m in _ATOM.finditer(text)]
        segments, rows = [], []
        opens = [text[a].isalnum() or text[a] in "+(" for a, _ in atoms]
        shuts = [text[b - 1].isalnum() for _, b in atoms]
        for j in range(1, len(atoms) + 1):
            if not shuts[j - 1]:
                continue
            for i in range(max(0, j - LONGEST), j):
                a, b = atoms[i][0], atoms[j - 1][1]
                if opens[i] and ("@" in text[a:b] or sum(c.isdigit() for c in text[a:b]) >= DIGITS or text.count(".", a, b) == 3):
                    segments.append((i, j))
                    rows.append(_features(text[a:b], text[max(0, a - 12) : a], text[b : b + 1], j - i))
        x = np.asarray(rows, float).reshape(len(rows), len(FEATURES))
        if drop and len(x):
            x[:, _GIVEAWAYS] = 0
        return atoms, segments, x

    def _run(self, n: int, segments: list[tuple[int, int]], scores: np.ndarray, best: bool):
        """Log-sums (or maxima, with where they came from) over segmentations up to each atom, by the last label."""
        labels = len(KINDS)
        table = np.full((n + 1, labels + 1), -np.inf)
        table[0, labels] = 0.0
        back: list[dict[int, tuple[int, int]]] = [{} for _ in range(n + 1)]
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(segments):
            by_end[j].append(k)
        fold = np.maximum if best else np.logaddexp
        for j in range(1, n + 1):
            prior = table[j - 1]
            table[j, labels] = prior.max() if best else np.logaddexp.reduce(prior)
            back[j][labels] = (j - 1, int(prior.argmax()))
            for k in by_end[j]:
                i = segments[k][0]
                incoming = table[i][:, None] + self.moves
                reach = incoming.max(axis=0) if best else np.logaddexp.reduce(incoming, axis=0)
                value = reach + scores[k]
                if best:
                    for y in np.flatnonzero(value > table[j, :labels]).tolist():
                        back[j][y] = (i, int(incoming[:, y].argmax()))
                table[j, :labels] = fold(table[j, :labels], value)
        return table, back

    def _behind(self, n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
        """Log-sums of what follows an atom, by the label before it."""
        labels = len(KINDS)
        behind = np.zeros((n + 1, labels + 1))
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, _) in enumerate(segments):
            by_start[i].append(k)
        for i in range(n - 1, -1, -1):
            value = np.full(labels + 1, behind[i + 1, labels])
            for k in by_start[i]:
                value = np.logaddexp(value, np.logaddexp.reduce(self.moves + scores[k] + behind[segments[k][1], :labels], axis=1))
            behind[i] = value
        return behind

    def decode(self, text: str) -> tuple[list[tuple[str, int, int]], list[float]]:
        """The entities of the likeliest segmentation, and the probability of each over all segmentations."""
        atoms, segments, x = self.lattice(text)
        if not segments:
            return [], []
        scores = x @ self.weights
        table, back = self._run(len(atoms), segments, scores, best=True)
        j, y, found, sure = len(atoms), int(table[-1].argmax()), [], []
        if y == len(KINDS) and all(z == (k, y) for k, z in enumerate(b[y] for b in back[1:])):
            return [], []
        ahead, behind = self._run(len(atoms), segments, scores, best=False)[0], self._behind(len(atoms), segments, scores)
        total, index = float(np.logaddexp.reduce(ahead[-1])), {s: k for k, s in enumerate(segments)}
        while j:
            i, z = back[j][y]
            if y < len(KINDS):
                found.append((KINDS[y], atoms[i][0], atoms[j - 1][1]))
                own = float(np.logaddexp.reduce(ahead[i] + self.moves[:, y])) + scores[index[i, j], y] + behind[j, y]
                sure.append(math.exp(min(0.0, own - total)))
            j, y = i, z
        return found[::-1], sure[::-1]

    def step(self, text: str, gold: list[tuple[str, int, int]], rate: float, drop: bool) -> None:
        """One gradient step on the log-likelihood of the gold entities."""
        atoms, segments, x = self.lattice(text, drop)
        if not segments:
            return
        scores, n, labels = x @ self.weights, len(atoms), len(KINDS)
        ahead, _ = self._run(n, segments, scores, best=False)
        total = np.logaddexp.reduce(ahead[-1])
        behind = self._behind(n, segments, scores)
        wanted, moves = np.zeros((len(segments), labels)), np.zeros_like(self.moves)
        index = {(atoms[i][0], atoms[j - 1][1]): k for k, (i, j) in enumerate(segments)}
        last_end, last = -1, labels
        for kind, a, b in gold:
            k = index.get((a, b))
            if k is None:
                continue
            y = KINDS.index(kind)
            wanted[k, y] = 1
            moves[last if last_end == a else labels, y] += 1
            last_end, last = b, y
        expected = np.zeros_like(wanted)
        for k, (i, j) in enumerate(segments):
            joint = ahead[i][:, None] + self.moves + scores[k] + behind[j, :labels] - total
            p = np.exp(np.minimum(joint, 0))
            moves -= p
            expected[k] = p.sum(axis=0)
        self.weights += rate * (x.T @ (wanted - expected) - DECAY * self.weights)
        self.moves += rate * (moves - DECAY * self.moves)


def fit_regions(examples: list[tuple[str, list[tuple[str, int, int]]]]) -> Field:
    """A field trained on regions with their entities, in an order fixed by a seed."""
    field = Field(np.zeros((len(FEATURES), len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS))))
    field.weights[0] = -2.0
    random = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        for k in random.permutation(len(examples)).tolist():
            field.step(*examples[k], RATE / (1 + epoch), bool(random.random() < 0.5))
    return field


def _labelled(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    base = base_spans(text)
    for a, b in regions(text):
        if b - a <= 2 * REGION_ATOMS:
            own, end = [], a
            for kind, s, e in base:
                if end <= s and e <= b:  # the first of overlapping spans
                    own.append((kind, s - a, e - a))
                    end = e
            yield text[a:b], own


def fit(docs: DataFrame, text_col: str = "text", most: int = REGIONS) -> Field:
    """The field fitted on the ``most`` different regions of all documents that hash lowest."""

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            some: dict[str, str] = {}
            for text in _screened(block.column(0))[1]:
                some |= {region: ",".join(f"{k}:{x}:{y}" for k, x, y in own) for region, own in _labelled(text)}
            keys = [xxhash.xxh3_64_intdigest(r) >> 1 for r in some]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(some), pa.string()), pa.array(list(some.values()), pa.string())], ["h", "region", "spans"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda s: [(k, int(x), int(y)) for k, x, y in (e.split(":") for e in s.split(",") if e)]
        rows = sorted((h, r, s) for b in batches for h, r, s in zip(*(c.to_pylist() for c in b.columns), strict=True))
        field = fit_regions([(r, read(s)) for _, r, s in rows])
        yield pa.RecordBatch.from_arrays([pa.array([field.weights.ravel().tolist()]), pa.array([field.moves.ravel().tolist()])], ["weights", "moves"])

    # Copies of a region count once, so that none takes the place of others.
    found = docs.selectExpr(f"`{text_col}` AS text").mapInArrow(examples, "h bigint, region string, spans string").distinct()
    few = found.orderBy("h", "region", "spans").limit(most).repartition(1)  # at most `most` short strings in the one training task
    got = few.mapInArrow(train, "weights array<double>, moves array<double>").collect()
    if not got:
        return fit_regions([])
    return Field(np.asarray(got[0]["weights"]).reshape(len(FEATURES), len(KINDS)), np.asarray(got[0]["moves"]).reshape(len(KINDS) + 1, len(KINDS)))


#: Texts that can hold a span of any kind: an @, a plus sign before a digit, three dots between digits, or seven digits close together.
_SCREEN = r"@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[^0-9]{0,3}[0-9]){6}"


def _screened(texts: pa.Array) -> tuple[list[int], list[str]]:
    """Rows whose texts can hold personal data, and those texts."""
    texts = filled(texts)
    rows = pc.indices_nonzero(pc.match_substring_regex(texts, _SCREEN))
    return rows.to_pylist(), texts.take(rows).to_pylist()


def added_spans(field: Field, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Entities of the field that don't touch a base span."""
    out = []
    for a, b in regions(text):
        # A long region is decoded in pieces that overlap; each gives the entities that begin in its inner part.
        cuts = [*(m.start() for m in _ATOM.finditer(text, a, b)), b]
        n, end = len(cuts) - 1, a
        for i in range(0, n, REGION_ATOMS):
            first, last = cuts[i], cuts[min(i + REGION_ATOMS, n)]
            s, e = cuts[max(0, i - 2 * LONGEST)], cuts[min(i + REGION_ATOMS + 2 * LONGEST, n)]
            for (k, x, y), p in zip(*_decoded(field, text[s:e]), strict=True):
                x, y = s + x, s + y
                if p >= CONFIDENCE and max(first, end) <= x < last and not any(u < y and x < v for _, u, v in base):
                    out.append((k, x, y))
                    end = y
    return out


def _decoded(field: Field, piece: str) -> tuple[list[tuple[str, int, int]], list[float]]:
    if "@" not in piece and sum(c.isdigit() for c in piece) < DIGITS:
        return [], []
    return field.decode(piece)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, field: Field, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """The rows with ``spans_col`` added (or replaced): spans of kind, start, end (code
    points, end exclusive) and base (whether a fixed pattern found it), by start, then kind.

    Null and empty texts have no spans; whole texts of any length are searched;
    repeated rows get the same spans; an empty table gives no rows; other columns are passed through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.drop(spans_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text_col):
            spans: list[list] = [[]] * block.num_rows
            for row, text in zip(*_screened(block.column(block.schema.get_field_index(text_col))), strict=True):
                base = base_spans(text)
                found = [(*s, True) for s in base] + [(*s, False) for s in added_spans(shared.value, text, base)]
                found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                spans[row] = [dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in found]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(spans, _SPANS_ARROW)], [*block.schema.names, spans_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(spans_col, SPANS)]))


def joined(spans, only_base: bool):
    some = F.filter(spans, lambda s: s["base"]) if only_base else spans
    return F.concat_ws(",", F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
