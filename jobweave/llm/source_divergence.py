"""How much the sources of a language differ from each other, and in which terms.

Shares of terms are compared between all pairs of sources of a language, by a cube of
cells: a cell owns a block of sources, another block of sources and a block of terms.
The counts of a block of sources and a block of terms (a slice) are sent to every cell
that needs them, each cell works out its part of the divergences of its pairs, and the
parts are summed along the axis of the terms.  Terms that neither source of a pair has
are never sent: there are so many of them, each with the same part.

A cell holds a bounded number of counts whatever a source's size: sources and terms are
dealt to blocks by their hashes, and the counts of a source with very many texts are
summed where the texts are before any row of them moves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.blocks import Words, filled, text_blocks
from jobweave.llm.components import durable

#: Documents of a language that a term must occur in, terms reported of a source, and what a share is counted in.
MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Sources and terms of a block, on average.
SOURCES, TERMS = 32, 8192
#: Everything in ASCII but letters parts terms.
_GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Counts that a task holds before it hands them on, and rows of a batch then.
_HELD, _EMITTED = 1 << 17, 1 << 14
#: Shares of a group's terms that meet what is known of the group.
_SHARES = 64


def _terms(texts: pa.Array) -> Words:
    spaced = pc.replace_substring_regex(pc.ascii_lower(filled(texts)), _GAPS, " ")
    return Words(spaced)


def term_counts(docs: DataFrame, group_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """g, s, term, n (occurrences) and docs (documents with it) of each group and source, and a row with a null term for each
    source that occurs.  Null groups, sources and texts count as empty.  Rows are dealt by group and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[str, list[int]]] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            flat = [(g, s, term, n, d) for (g, s), found in held.items() for term, (n, d) in itertools.chain([(None, (0, 0))], found.items())]
            held.clear()
            for k in range(0, len(flat), _EMITTED):
                g, s, term, n, d = zip(*flat[k : k + _EMITTED], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(s, pa.string()), pa.array(term, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["g", "s", "term", "n", "docs"])

        for block in text_blocks(batches, "text"):
            words = _terms(block.column(2))
            rows = np.repeat(np.arange(block.num_rows), np.diff(words.bounds))
            pairs = list(zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True))
            names = dict.fromkeys(pairs)
            group_of_row = np.array([k for k in map({p: i for i, p in enumerate(names)}.__getitem__, pairs)], np.int64)
            width = max(1, len(words.values))
            codes = words.codes.astype(np.int64)
            each, times = np.unique(rows * width + codes, return_counts=True)  # a document and a term
            of_group = group_of_row[each // width] * width + each % width
            order = np.argsort(of_group, kind="stable")
            of_group, times = of_group[order], times[order]
            starts = np.flatnonzero(np.concatenate([[True], of_group[1:] != of_group[:-1]])) if len(of_group) else np.empty(0, np.int64)
            sums = np.add.reduceat(times, starts) if len(starts) else starts
            docs_with = np.diff(np.concatenate([starts, [len(of_group)]]))
            keys = list(names)
            for key in keys:
                held.setdefault(key, {})
            for at, n, d in zip(of_group[starts].tolist(), sums.tolist(), docs_with.tolist(), strict=True):
                term = words.values[at % width]
                if term:
                    mine = held[keys[at // width]]
                    known = mine.get(term)
                    if known is None:
                        mine[term] = [n, d]
                        size += 1
                    else:
                        known[0] += n
                        known[1] += d
            if size > _HELD:
                yield from told()
                size = 0
        yield from told()

    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(text(group_col).alias("g"), text(source_col).alias("s"), F.col(f"`{text_col}`").alias("text"))
    parts = rows.mapInArrow(run, "g string, s string, term string, n bigint, docs bigint")
    # Summed in the task that read them already, so a term has a few rows a task; dealt once for all that follows.
    return parts.repartition("g", "term").groupBy("g", "s", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 and the share of UNIT that each count has, two more added to every term's."""
    below = total + 2 * kept
    if not kept:
        return np.ones(len(counts), np.int64)
    if len(counts) and int(counts.max()) > (1 << 62) // UNIT - 2:  # beyond 64 bits
        return np.array([1 + UNIT * (int(c) + 2) // below for c in counts], np.int64)
    return 1 + UNIT * (counts.astype(np.int64) + 2) // below


def _parts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(p - q)² / (p + q), cut to whole numbers; shares are below 2³¹, so squares are exact."""
    return (p - q) * (p - q) // (p + q)


_CELL = "kind int, g string, a string, b string, term string, value bigint, seen bigint, rest bigint, kept bigint"


def _cell(top: int):
    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("s", "total", "kept", "whole")}
        cell = {c: table.column(c)[0].as_py() for c in ("g", "ga", "gb")}
        g, diagonal = cell["g"], cell["ga"] == cell["gb"]
        terms = table.column("term").combine_chunks().dictionary_encode() if table.num_rows else None
        codes = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        names = terms.dictionary.to_pylist()
        n, of_all = table.column("n").to_numpy(), table.column("of_all").to_numpy()
        side = table.column("side").to_numpy()
        heads = np.flatnonzero(codes < 0).tolist()
        sources = sorted({(int(side[i]), cols["s"][i]): i for i in heads}.items())
        place = {key: k for k, (key, _) in enumerate(sources)}
        row_source = np.array([place[int(x), y] for x, y in zip(side, cols["s"], strict=True)], np.int64)
        # Terms that nobody in the cell has are left to the sum; all others, and one such, have a column.
        counts = np.zeros((len(sources), len(names) + 1), np.int64)
        body = codes >= 0
        counts[row_source[body], codes[body]] = n[body]
        totals = [(int(cols["total"][i]), int(cols["kept"][i])) for _, i in sources]
        shares = np.stack([_shares(c, *t) for c, t in zip(counts, totals, strict=True)])
        out: dict[str, list] = {c.split()[0]: [] for c in _CELL.split(", ")}

        def add(**row):
            for c, v in out.items():
                v.append(row.get(c))

        left = [k for k, ((x, _), _) in enumerate(sources) if x == 0]
        right = left if diagonal else [k for k, ((x, _), _) in enumerate(sources) if x == 1]
        for k in left:
            others = [j for j in right if j > k] if diagonal else right
            if others:
                f = _parts(shares[k], shares[others])
                for j, value, rest in zip(others, f[:, :-1].sum(axis=1).tolist(), f[:, -1].tolist(), strict=True):
                    add(kind=0, g=g, a=sources[k][0][1], b=sources[j][0][1], value=value, seen=len(names), rest=rest, kept=totals[k][1])
        if diagonal and len(names):
            all_counts = np.zeros(len(names), np.int64)
            all_counts[codes[body]] = of_all[body]
            common = _shares(all_counts, int(cols["whole"][heads[0]]), totals[0][1])
            for k in left:
                p = shares[k, :-1]
                more = np.flatnonzero((counts[k, :-1] > 0) & (p > common))
                f = _parts(p[more], common[more])
                if len(f) > top:  # those that tie with the last of them may come before it by name
                    least = np.partition(f, len(f) - top)[len(f) - top]
                    more, f = more[f >= least], f[f >= least]
                for value, name in sorted(zip((-f).tolist(), [names[i].encode() for i in more], strict=True))[:top]:
                    add(kind=1, g=g, a=sources[k][0][1], term=name.decode(), value=-value)
        types = {"kind": pa.int32(), "value": pa.int64(), "seen": pa.int64(), "rest": pa.int64(), "kept": pa.int64()}
        return pa.table({c: pa.array(v, types.get(c, pa.string())) for c, v in out.items()})

    return run


def audit(
    docs: DataFrame, group_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP,
    sources: int | None = None, terms: int | None = None,
) -> DataFrame:
    """Rows (``group_col``, ``source_col``, part, item, value, rank).  Part ``pair``: every other source of the group with the divergence
    from it, the largest first.  Part ``term``: up to ``top`` terms that the source uses more than its group does.

    - Terms are runs of letters A to Z, lower-cased, and of characters beyond ASCII; those in at least ``min_docs`` texts of
      a group count.  All arithmetic is in whole numbers.
    - Null groups, sources and texts count as empty.  A source without terms takes part.  Texts of any length enter whole;
      rows that repeat count each.  Ties of values go by the item's bytes.
    - Other columns are left out, whatever their names.  An empty table gives no rows.
    """
    per_block, per_cell = SOURCES if sources is None else sources, TERMS if terms is None else terms
    everywhere = Window.partitionBy("g", "term")  # as many rows as sources, in the task that counted them
    counts = term_counts(docs, group_col, source_col, text_col).withColumn("of_all", F.sum("n").over(everywhere)).withColumn("in_docs", F.sum("docs").over(everywhere))
    found = durable(counts.where(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).select("g", "s", "term", "n", "of_all"))
    used, heads = found.where("term IS NOT NULL"), found.where("term IS NULL").select("g", "s")
    # How many blocks a group's sources and terms make: one row a group.
    ways = lambda n, size: F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("int")
    wide = heads.groupBy("g").agg(F.count(F.lit(1)).alias("sources"))
    long = used.groupBy("g", "term").agg(F.max("of_all").alias("of_all")).groupBy("g").agg(F.count(F.lit(1)).alias("kept"), F.sum("of_all").alias("whole"))
    groups = durable(wide.join(long, "g", "left").select("g", ways(F.col("sources"), per_block).alias("gs"), ways(F.coalesce("kept", F.lit(0)), per_cell).alias("ts"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("whole", F.lit(0)).alias("whole")))
    totals = used.groupBy("g", "s").agg(F.sum("n").alias("total"))
    head = heads.join(totals, ["g", "s"], "left").join(groups, "g").withColumn("total", F.coalesce("total", F.lit(0)))
    none = lambda t: F.lit(None).cast(t)
    rows = head.select("g", "s", none("string").alias("term"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("of_all"), "total", "kept", "whole", "gs", F.explode(F.sequence(F.lit(0), F.col("ts") - 1)).alias("tb"))
    zero = F.lit(0).cast("bigint")
    # What is known of a group is repeated for each share of its terms, so that a large group's rows meet it in many tasks.
    spread = groups.select("g", "gs", "ts", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))).alias("share"))
    body = used.withColumn("share", F.pmod(F.xxhash64("term", F.lit(2)), F.lit(_SHARES)).cast("int")).join(spread, ["g", "share"]).select("g", "s", "term", "n", "of_all", zero.alias("total"), zero.alias("kept"), zero.alias("whole"), "gs", F.pmod(F.xxhash64("term"), F.col("ts")).cast("int").alias("tb"))
    # Each slice goes to the cells of its block of sources with every block, itself among them.
    own = F.pmod(F.xxhash64("s", F.lit(1)), F.col("gs")).cast("int")
    sliced = rows.unionByName(body).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("gs") - 1)))
    dealt = sliced.withColumn("ga", F.least("own", "other")).withColumn("gb", F.greatest("own", "other")).withColumn("side", F.when(F.col("own") > F.col("other"), 1).otherwise(0)).drop("own", "other", "gs")
    cells = durable(dealt.groupBy("g", "ga", "gb", "tb").applyInArrow(_cell(top), _CELL))
    # Along the axis of the terms.
    met = cells.where("kind = 0").groupBy("g", "a", "b").agg((F.sum("value") + (F.max("kept") - F.sum("seen")) * F.max("rest")).alias("value"))
    pairs = met.select("g", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("item")), F.struct(F.col("b").alias("s"), F.col("a").alias("item")))).alias("e"), "value").select("g", "e.s", F.lit("pair").alias("part"), "e.item", "value")
    best = cells.where("kind = 1").select("g", F.col("a").alias("s"), F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("g", "s", "part").orderBy(F.col("value").desc(), "item"))
    ranked = pairs.unionByName(best).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select(F.col("g").alias(group_col), F.col("s").alias(source_col), "part", "item", "value", "rank")
