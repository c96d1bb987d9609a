"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new.

The patterns (assignments, access keys, long hexadecimal runs) always report.
Beside them, strings that stand close behind a sensitive word and mix kinds of
characters are candidates.  A zstandard compressor primed with identifiers, those
of common code and those that the corpus itself uses around sensitive words,
compresses the text around a candidate with and without it; the bytes that the
candidate adds are its novelty.  Placeholders, identifiers and words that the
surroundings repeat add few bytes; strings that add nearly as many as they have
are reported as kind ``novel``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.llm.blocks import filled, text_blocks

KINDS = ("assign", "access", "hex", "novel")
# Fixed patterns.
_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Texts that can hold a secret of any kind.
_SCREEN = r"(?i:passw|secret|token|api[_-]?key|credential|bearer|private|pwd|auth)|AKIA|[0-9a-f]{24}"
_SENSITIVE = re.compile(r"(?i:passw(?:or)?d|secret|token|api[_-]?key|credential|bearer|private|pwd|auth)", re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
_IDENTIFIER = re.compile(r"[A-Za-z_]{3,24}", re.ASCII)
#: Characters behind a sensitive word that a candidate may start in, and characters of surroundings that prime the compressor.
REACH, AROUND = 64, 256
#: Bytes that a candidate must add, and their share of its length.
MIN_BYTES, MIN_SHARE = 10, 0.5
#: Identifiers of the corpus in the dictionary.
IDENTIFIERS = 2000
#: Words of common code around secrets (fixed values).
_CODE = """
access account admin api auth authorization bearer begin bool bucket build byte cache cert char class client cloud
config const content cookie credential data database default delete deploy dev digest docker double else encoding
endpoint env environ error example export false file final float for from function get hash header host http https
id if import include int integer json key kubernetes lambda let local localhost login long main map master message
method model module name new none null number object oauth object password path placeholder port post print private
production profile project protected public put query random read region release request response return root salt
schema secret select self server service session set sha256 sign source ssh ssl staging static status storage string
struct sudo table test this token true type undefined update url user username utf value var version void webhook
while with write xxxxxxxx changeme your_api_key your_password_here 0123456789 abcdefghijklmnopqrstuvwxyz
""".split()


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """Kind, start, end and start of the secret itself, for each match of the fixed patterns."""
    found = [("assign", m.start(), m.end(), m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _mixes(s: str) -> bool:
    """Whether a string mixes digits and letters, or cases within the string."""
    digits = sum(c.isdigit() for c in s)
    upper, lower = sum(c.isupper() for c in s[1:]), sum(c.islower() for c in s)
    return (digits >= 2 and upper + lower >= 2) or (upper >= 3 and lower >= 3)


class Novelty:
    """Marginal compressed bytes of a string against its surroundings and a dictionary."""

    def __init__(self, identifiers: list[str]):
        import zstandard

        primed = " ".join([*_CODE, *identifiers]).encode()
        self._compressor = zstandard.ZstdCompressor(
            level=19, dict_data=zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False
        )

    def marginal(self, before: str, candidate: str, after: str) -> int:
        rest = len(self._compressor.compress((before + " " + after).encode()))
        return len(self._compressor.compress((before + candidate + " " + after).encode())) - rest

    def spans(self, text: str, base: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
        taken, out, seen = [(a, b) for _, a, b, _ in base], [], set()
        for word in _SENSITIVE.finditer(text):
            for m in _CANDIDATE.finditer(text, word.end(), min(len(text), word.end() + REACH)):
                a, b = m.start(), m.end()
                if b == word.end() + REACH:  # the window may cut it
                    b = _CANDIDATE.match(text, a).end()
                if a in seen or not _mixes(text[a:b]) or any(x < b and a < y for x, y in taken):
                    continue
                seen.add(a)
                added = self.marginal(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND])
                if added >= MIN_BYTES and added >= MIN_SHARE * (b - a):
                    out.append(("novel", a, b, a))
        return out


def identifiers_near(text: str) -> set[str]:
    """The identifiers close to a sensitive word, without what may be part of a secret."""
    spans = [(value, b) for _, _, b, value in base_spans(text)] + [m.span() for m in _CANDIDATE.finditer(text) if _mixes(m[0])]
    kept = list(text)
    for a, b in spans:
        kept[a:b] = " " * (b - a)
    rest, near = "".join(kept), set()
    for word in _SENSITIVE.finditer(text):
        near.update(_IDENTIFIER.findall(rest, max(0, word.start() - REACH), word.end() + REACH))
    return near


def corpus_identifiers(docs: DataFrame, text_col: str = "text", most: int = IDENTIFIERS) -> list[str]:
    """The identifiers that most distinct texts hold close to a sensitive word, rarest first.

    All texts are counted, copies once; the dictionary keeps a fixed number of identifiers.
    What lies inside a span of the patterns or inside a string that could be a secret is no identifier.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            texts = _screened(block.column(0))[1]
            prints = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array([sorted(identifiers_near(t)) for t in texts], pa.list_(pa.string()))], ["print", "words"])

    texts = docs.selectExpr(f"`{text_col}` AS text").mapInArrow(run, "print binary, words array<string>")
    distinct = texts.groupBy("print").agg(F.first("words").alias("words"))
    words = distinct.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = words.where("n > 1").orderBy(F.col("n").desc(), "word").limit(most).collect()
    return [r["word"] for r in reversed(top)]


def _screened(texts: pa.Array) -> tuple[list[int], list[str]]:
    """Rows whose texts can hold a secret, and those texts."""
    texts = filled(texts)
    hit = pc.match_substring_regex(texts, _SCREEN)
    rows = pc.indices_nonzero(hit)
    return rows.to_pylist(), texts.take(rows).to_pylist()


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("value_start", T.LongType()),
]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64())]))


def find_secrets(docs: DataFrame, text_col: str = "text", spans_col: str = "secrets") -> DataFrame:
    """The rows with ``spans_col`` added (or replaced): spans of kind, start, end and
    value_start (where the secret itself begins) in code points, by start, then kind.

    Null and empty texts have no spans; whole texts of any length are searched;
    repeated rows get the same spans; an empty table gives no rows; other columns are passed through.
    """
    identifiers = corpus_identifiers(docs, text_col)
    rows = docs.drop(spans_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for block in text_blocks(batches, text_col):
            spans: list[list] = [[]] * block.num_rows
            for row, text in zip(*_screened(block.column(block.schema.get_field_index(text_col))), strict=True):
                base = base_spans(text)
                found = sorted(base + novelty.spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))
                spans[row] = [dict(zip(("kind", "start", "end", "value_start"), s, strict=True)) for s in found]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(spans, _SPANS_ARROW)], [*block.schema.names, spans_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(spans_col, SPANS)]))


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "secrets", mask: str = "[SECRET]") -> DataFrame:
    """The rows of find_secrets() with every secret replaced by ``mask`` and the spans
    dropped.  Of spans that overlap, the part not yet masked is masked once."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    cut = lambda a, b: F.substring(F.col(text_col), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def step(acc, s):
        fresh = s["value_start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], cut(acc["at"], s["value_start"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    ordered = F.array_sort(F.transform(spans_col, lambda s: F.struct(s["value_start"].alias("value_start"), s["end"].alias("end"))))
    masked = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], cut(acc["at"], F.length(text_col).cast("long"))))
    changed = F.when(F.size(spans_col) > 0, masked).otherwise(F.col(text_col))
    return found.withColumn(text_col, changed).drop(spans_col)


def joined(spans, kinds: tuple[str, ...]):
    """kind:start:end of the spans whose kind is in ``kinds``, comma-joined, in their order."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
