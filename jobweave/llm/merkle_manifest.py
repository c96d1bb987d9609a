"""A Merkle manifest of a table: a binary tree of row digests for each group, and one over the groups' roots.

Rows are put in order by sampled ranges and numbered within their group: a partition
only needs to know how many rows of its first group stand in earlier partitions.
Aligned blocks of ``2 ** BLOCK_LEVELS`` rows are hashed up to one node each.  Then
blocks swap nodes in rounds, as in a butterfly: in round r, the blocks whose numbers
differ in digit r alone (in base ``2 ** SWAP_LEVELS``) meet, and each of them hashes
the ancestors above them for itself.  So every block walks up to its group's root,
noting the siblings on its way, and nothing is handed down again.  Where the last
subtree of a group is cut short, its blocks also answer for those that are missing.

No key can fill a task: a block and a meeting have a bounded size, and rows that are equal
in every column are told apart by their place in the input.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.llm.components import durable

#: Levels below a block's node, and levels that a round of swaps adds.
BLOCK_LEVELS, SWAP_LEVELS = 12, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as the number of its UTF-8 bytes, a colon and itself, a null as ``-``."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _h(*nodes: bytes) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


def _climb(nodes: list[bytes], levels: int | None) -> list[list[bytes]]:
    """The nodes and those of so many levels above them (None: until one is left)."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([_h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def _beside(levels: list[list[bytes]], place: int) -> list[bytes | None]:
    """The sibling at each level but the last on the way up from a place, None where there is none."""
    return [row[s] if (s := (place >> j) ^ 1) < len(row) else None for j, row in enumerate(levels[:-1])]


def _fold(node: bytes, place: int, siblings: Sequence[bytes | None]) -> bytes:
    for s in siblings:
        node = _h(node) if s is None else _h(s, node) if place & 1 else _h(node, s)
        place >>= 1
    return node


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows (_g: string, never null, and others) with _pos, their place from 0 in their group by ``order``, nulls first."""
    keys = [F.col(c).asc_nulls_first() for c in ("_g", *order)]
    ordered = durable(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("_pid", F.spark_partition_id())
    counts = ordered.groupBy("_pid", "_g").agg(F.count(F.lit(1)).alias("n"))
    # Only a partition's first group can have begun earlier, and only its last can go on: one row a partition.
    ends = counts.groupBy("_pid").agg(F.min(F.struct("_g", "n")).alias("first"), F.max(F.struct("_g", "n")).alias("last")).orderBy("_pid").collect()
    ahead: dict[int, int] = {}
    group, seen = None, 0
    for r in ends:
        ahead[r["_pid"]] = seen if r["first"]["_g"] == group else 0
        if r["last"]["_g"] != group:
            group, seen = r["last"]["_g"], 0
        seen += r["last"]["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, following = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(codes)]]))
            first = np.zeros(len(starts), np.int64)
            if open_group is None:
                first[0] = ahead.get(batch.column(1)[0].as_py(), 0)
            elif names[codes[0]] == open_group:
                first[0] = following
            place = np.arange(len(codes)) - np.repeat(starts - first, sizes)
            open_group, following = names[codes[-1]], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns) if i != 1], pa.array(place, pa.int64())], out.fieldNames())

    others = [f for f in rows.schema.fields if f.name != "_g"]
    out = T.StructType([T.StructField("_g", T.StringType()), *others, T.StructField("_pos", T.LongType())])
    return ordered.select("_g", "_pid", *[f.name for f in others]).mapInArrow(run, out)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block (_g, _block), which stand together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["_g"], row["_block"]) != (held[0]["_g"], held[0]["_block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _block_levels(nodes: list[bytes], block: int, levels: int) -> list[list[bytes]]:
    """A block that is all of its group ends where one node is left; any other has all its levels."""
    return _climb(nodes, None if block == 0 and len(nodes) < 1 << levels else levels)


def _roots_of_blocks(numbered: DataFrame, levels: int) -> DataFrame:
    """_g, _block, node and _rows of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            nodes = [r["leaf"].encode() for r in rows]
            top = _block_levels(nodes, rows[0]["_block"], levels)[-1][0]
            yield pa.RecordBatch.from_pydict({"_g": [rows[0]["_g"]], "_block": [rows[0]["_block"]], "node": [top.decode()], "_rows": [len(rows)]})

    blocks = numbered.select("_g", F.shiftright("_pos", levels).alias("_block"), "_pos", "leaf")
    return blocks.repartition("_g", "_block").sortWithinPartitions("_g", "_block", "_pos").select("_g", "_block", "leaf").mapInArrow(run, "_g string, _block bigint, node string, _rows bigint")


_STATE = "_g string, _block bigint, node string, n bigint, path array<string>"


def _swapped(blocks: DataFrame, levels: int, swap: int) -> DataFrame:
    """Blocks (_g, _block, node, n: rows of the group) with node, their group's root, and path, the siblings from the block up to it."""
    state = durable(blocks.select("_g", "_block", "node", "n", F.array().cast("array<string>").alias("path")))
    width, stride = 1 << swap, 1
    count = F.ceil(F.col("n") / F.lit(1 << levels)).cast("bigint")
    most = state.agg(F.max(count)).first()[0] or 0
    done = None
    while stride < most:
        wide = F.col("_nb") > stride
        at = state.withColumn("_nb", count)
        finished = at.where(~wide).drop("_nb")
        done = finished if done is None else done.unionByName(finished)
        low, subtree = F.col("_block") % stride, F.floor(F.col("_block") / stride)
        last = F.floor((F.col("_nb") - 1) / stride)
        there = F.col("_nb") - last * stride  # blocks in the last subtree
        digit = subtree % width
        # The last subtree's blocks stand in for those that it lacks, unless nobody meets them there.
        slots = F.when((subtree == last) & (there < stride) & (digit > 0), F.sequence(low, F.lit(stride - 1).cast("bigint"), there)).otherwise(F.array(low))
        sent = at.where(wide).select("_g", F.floor(subtree / width).alias("high"), low.alias("low"), digit.alias("digit"), "node", "n", "_block", "path", F.explode(slots).alias("slot"))
        own = F.col("slot") == F.col("low")
        parts = F.struct("digit", "node", F.when(own, F.col("_block")).alias("block"), F.when(own, F.col("path")).alias("path"))
        met = sent.groupBy("_g", "high", "slot").agg(F.max("n").alias("n"), F.collect_list(parts).alias("met"))
        base = levels + (stride.bit_length() - 1)

        def run(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: dict[str, list] = {"_g": [], "_block": [], "node": [], "n": [], "path": []}
                for row in batch.to_pylist():
                    meeting = sorted(row["met"], key=lambda m: m["digit"])
                    up = min(swap, (row["n"] - 1).bit_length() - base)
                    climbed = _climb([m["node"].encode() for m in meeting], up)
                    for m in meeting:
                        if m["block"] is not None:
                            beside = [s and s.decode() for s in _beside(climbed, m["digit"])]
                            for name, v in (("_g", row["_g"]), ("_block", m["block"]), ("node", climbed[-1][m["digit"] >> up].decode()), ("n", row["n"]), ("path", m["path"] + beside)):
                                out[name].append(v)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("_g", pa.string()), ("_block", pa.int64()), ("node", pa.string()), ("n", pa.int64()), ("path", pa.list_(pa.string()))]))

        state = durable(met.select("_g", "n", "met").mapInArrow(run, _STATE))
        stride *= width
    return state if done is None else done.unionByName(state)


def _walked(numbered: DataFrame, levels: int, swap: int) -> DataFrame:
    """_g, _block, node (the group's root), n and path of each block."""
    blocks = durable(_roots_of_blocks(numbered, levels))
    sizes = blocks.groupBy("_g").agg(F.sum("_rows").alias("n"))
    return _swapped(blocks.join(sizes, "_g"), levels, swap)


def _with_heads(numbered: DataFrame, heads: DataFrame, levels: int) -> DataFrame:
    """The rows of each block behind the row of ``heads`` that holds what is known of it (as head)."""
    shape = heads.schema
    head = F.struct(*[c for c in heads.columns if c not in ("_g", "_block")])
    above = heads.select("_g", "_block", F.lit(-1).cast("bigint").alias("_pos"), head.alias("head"))
    of_head = T.StructType([f for f in shape.fields if f.name not in ("_g", "_block")])
    below = numbered.withColumn("_block", F.shiftright("_pos", levels)).withColumn("head", F.lit(None).cast(of_head))
    both = below.unionByName(above, allowMissingColumns=True)
    return both.repartition("_g", "_block").sortWithinPartitions("_g", "_block", "_pos")


def _top(subroots: DataFrame, levels: int, swap: int) -> DataFrame:
    """_g, root, rank (place among the groups) and tail (siblings from the group's root up) for rows (_g, leaf)."""
    named = subroots.select(F.lit("").alias("_g"), F.col("_g").alias("name"), "leaf")
    numbered = durable(_numbered(named, ["name"]))
    heads = _walked(numbered, levels, swap).select("_g", "_block", "node", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in _runs(batches):
            block, known = head["_block"], head["head"]
            climbed = _block_levels([r["leaf"].encode() for r in rows], block, levels)
            tails = [[s and s.decode() for s in _beside(climbed, i)] + known["path"] for i in range(len(rows))]
            yield pa.RecordBatch.from_pydict(
                {"_g": [r["name"] for r in rows], "root": [known["node"]] * len(rows), "rank": [r["_pos"] for r in rows], "tail": tails},
                pa.schema([("_g", pa.string()), ("root", pa.string()), ("rank", pa.int64()), ("tail", pa.list_(pa.string()))]),
            )

    return _with_heads(numbered, heads, levels).mapInArrow(run, "_g string, root string, rank bigint, tail array<string>")


def manifest(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", tampered: Mapping[str, Column] | None = None,
    block_levels: int | None = None, swap_levels: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``group_col``, leaf, subroot (of its group), root, proof_sha256 (digest of the siblings
    from the leaf up), siblings (null where a node is alone), folded_root and verified.

    - ``columns`` enter the leaf in this order.  ``tampered`` gives other values of some of them: folded_root is then what
      the tampered row and the true siblings come to, and verified says whether that is the root.
    - Rows of a group stand in order of ``id_col`` (null first), rows that share it in order of their leaves; a null
      group comes first and is a group like any other.
    - Empty texts, texts of any length and nulls in any column have leaves of their own; equal rows are leaves each.
    - Other columns are left out, whatever their names.  An empty table gives no rows.
    """
    levels = BLOCK_LEVELS if block_levels is None else block_levels
    swap = SWAP_LEVELS if swap_levels is None else swap_levels
    values = {c: F.col(f"`{c}`") for c in columns}
    plain = leaf(list(values.values()))
    other = leaf([*(values | dict(tampered)).values()]) if tampered else plain
    group = F.col(f"`{group_col}`").cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("_g"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{group_col}`").alias("_group"),
        plain.alias("leaf"), F.nullif(other, plain).alias("other"), F.monotonically_increasing_id().alias("_tie"),
    )
    numbered = durable(_numbered(durable(rows), ["_id", "leaf", "_tie"]).drop("_tie"))
    blocks = durable(_walked(numbered, levels, swap))
    top = _top(blocks.where("_block = 0").select("_g", F.col("node").alias("leaf")), levels, swap)
    heads = blocks.join(top, "_g").select("_g", "_block", "node", "path", "root", "rank", "tail")
    told = ["_id", "_group", "leaf", "subroot", "root", "proof_sha256", "siblings", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *members in _runs(batches):
            block, known = head["_block"], head["head"]
            climbed = _block_levels([r["leaf"].encode() for r in members], block, levels)
            path, tail = ([s and s.encode() for s in known[c]] for c in ("path", "tail"))
            above = b"".join(filter(None, path + tail))
            root, ends = known["root"].encode(), {}
            out: dict[str, list] = {c: [] for c in told}
            for i, r in enumerate(members):
                beside = _beside(climbed, i)
                node = _fold((r["other"] or r["leaf"]).encode(), i, beside)
                if node not in ends:  # nearly all rows of a block meet the same node here
                    ends[node] = _fold(_fold(node, block, path), known["rank"], tail)
                proof = sha256(b"".join(filter(None, beside)) + above).hexdigest()
                siblings = [s and s.decode() for s in beside] + known["path"] + known["tail"]
                for c, v in zip(told, (r["_id"], r["_group"], r["leaf"], known["node"], known["root"], proof, siblings, ends[node].decode(), ends[node] == root), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([
        T.StructField("_id", types["_id"]), T.StructField("_group", types["_group"]), *[T.StructField(c, T.StringType()) for c in told[2:6]],
        T.StructField("siblings", T.ArrayType(T.StringType())), T.StructField("folded_root", T.StringType()), T.StructField("verified", T.BooleanType()),
    ])
    arrow = to_arrow_schema(schema)
    found = _with_heads(numbered, heads, levels).select("_g", "_block", "_pos", "head", "_id", "_group", "leaf", "other").mapInArrow(run, schema)
    return found.select(F.col("_id").alias(id_col), F.col("_group").alias(group_col), *told[2:])
