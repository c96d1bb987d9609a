"""Large lexicons: terms from a table, found by one automaton a task, with the same boundaries as the rules' own keywords."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of all terms together, which every task holds; a larger lexicon is refused.
MOST_CHARACTERS = 64 << 20
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _terms(lexicon: DataFrame, column: str) -> list[str]:
    """The different terms in lower case, once their size is known to be bounded."""
    rows = lexicon.select(F.lower(column).alias("t")).where("t <> ''").distinct()
    size = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    if size > MOST_CHARACTERS:
        raise ValueError(f"a lexicon of {size} characters is beyond the {MOST_CHARACTERS} that a task may hold")
    return sorted(r["t"] for r in rows.collect())


def hits(text: str, found: ahocorasick.Automaton) -> list[str]:
    """Terms that occur with no ASCII letter or digit beside them, in order."""
    low = text.lower()
    seen, n = set(), len(low)
    for end, term in found.iter(low):
        begin = end - len(term)
        if (begin < 0 or low[begin] not in _INSIDE) and (end + 1 >= n or low[end + 1] not in _INSIDE):
            seen.add(term)
    return sorted(seen)


def matched(rows: DataFrame, lexicon: DataFrame, text_col: str = "text", term_col: str = "term", hits_col: str = "terms") -> DataFrame:
    """The rows with the terms of a lexicon table that occur in their text (array, sorted; empty for a null text).

    The plan has the same size whatever the lexicon's; the automaton is built once a task.  A column named ``hits_col`` is replaced."""
    terms = rows.sparkSession.sparkContext.broadcast(_terms(lexicon, term_col))
    kept = rows.drop(hits_col)
    names = kept.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for t in terms.value:
            found.add_word(t, t)
        found.make_automaton()
        for batch in batches:
            lists = [hits(t, found) if t and terms.value else [] for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.string()))], [*names, hits_col])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(hits_col, T.ArrayType(T.StringType()))]))
