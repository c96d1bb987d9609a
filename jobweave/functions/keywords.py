"""Keyword lexicons over lower-case text, with a boundary of anything but ASCII letters and digits."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.functions.text import once


def _quoted(term: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", term)


def present(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms of a lexicon that occur, in lower case: one scan of the text finds the longest term at each place where
    one begins, and a term that a longer one begins with occurs there too."""
    longest = sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t))
    pattern = "(?<![a-z0-9])(?=(" + "|".join(map(_quoted, longest)) + ")(?![a-z0-9]))"
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))
    shorter = {t: [s for s in longest if s != t and re.match(re.escape(s) + "(?![a-z0-9])", t)] for t in longest}
    for term, inside in shorter.items():
        if inside:
            found = _with(found, term, inside)
    return found


def _with(found: Column, term: str, inside: list[str]) -> Column:
    return once(found, lambda f: F.when(F.array_contains(f, term), F.array_union(f, F.array(*map(F.lit, inside)))).otherwise(f))


def those(found: Column, some: tuple[str, ...]) -> Column:
    """The terms of ``some`` that present() found, in their order."""
    return F.filter(F.array(*map(F.lit, some)), lambda t: F.array_contains(found, F.lower(t)))


def tagged(found: Column, tag_terms: dict[str, tuple[str, ...]]) -> Column:
    """The tags of which any term was found, in the table's order."""
    table = F.array(*[F.struct(F.lit(tag).alias("tag"), F.array(*[F.lit(t.lower()) for t in ts]).alias("terms")) for tag, ts in tag_terms.items()])
    return F.transform(F.filter(table, lambda x: F.arrays_overlap(x["terms"], found)), lambda x: x["tag"])


def matched(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that occur, in the lexicon's order."""
    return once(present(text, terms), lambda found: those(found, terms))


def tags(text: Column, tag_terms: dict[str, tuple[str, ...]]) -> Column:
    """The tags of which any term occurs, in the table's order."""
    terms = tuple(t for ts in tag_terms.values() for t in ts)
    return once(present(text, terms), lambda found: tagged(found, tag_terms))
