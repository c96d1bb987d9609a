"""Organisation matching and duplicate listings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.config import DUPLICATE_SIMILARITY
from jobweave.functions.text import description_tokens, jaccard, normalize_location, normalize_org_name, normalize_title
from jobweave.operators.kept import kept
from jobweave.operators.merge import raw_merge


def org_match(names: DataFrame, orgs: DataFrame, name_col: str = "org_name") -> DataFrame:
    """names with org_slug: the organisation of the same normalised name, else the first one whose normalised
    name, longer than 8 characters, stands inside; ties by slug; null for none and for unknown names.

    Distinct names are matched.  For containment each name is cut at its words and met by its
    word-aligned starts of the lengths that the organisations' first words have, so no name meets every
    organisation: a name can hold an organisation only where that one's first word (or the end of a
    longer one) occurs, and the test on whole names decides.
    """
    norm = normalize_org_name(F.col(name_col))
    wanted = names.select(F.col(name_col)).distinct().select(name_col, norm.alias("_norm")).where((F.col("_norm") != "") & (F.col("_norm") != "unknown"))
    known = orgs.select("slug", normalize_org_name(F.col("name")).alias("_candidate")).where("_candidate <> ''")
    exact = wanted.join(known.groupBy("_candidate").agg(F.min("slug").alias("_slug")), F.col("_norm") == F.col("_candidate")).select(name_col, "_slug")
    # The pivot of a candidate is its second word if it has one (whole words then surround it), else its only word.
    words = F.split("_candidate", " ")
    whole = known.where((F.length("_candidate") > 8) & (F.size(words) >= 3)).withColumn("_pivot", words[1])
    ends = known.where((F.length("_candidate") > 8) & (F.size(words) < 3))
    met = wanted.select(name_col, "_norm", F.explode(F.array_distinct(F.split("_norm", " "))).alias("_pivot"))
    inside = met.join(whole, "_pivot").where(F.contains("_norm", F.col("_candidate")))
    # Candidates of one or two words may begin or end inside a word; they meet by the words' letters at their joint.
    two = ends.withColumn("_pivot", F.concat(F.substring(F.substring_index("_candidate", " ", 1), -4, 4), F.lit(" "), F.substring(words[1], 1, 1))).where(F.size(words) == 2)
    joints = wanted.select(name_col, "_norm", F.explode(F.regexp_extract_all("_norm", F.lit(r"(?=([a-z0-9]{1,4} [a-z0-9]))"), F.lit(1))).alias("_pivot")).distinct()
    inside_two = joints.join(two, "_pivot").where(F.contains("_norm", F.col("_candidate")))
    one = ends.where(F.size(words) == 1).withColumn("_pivot", F.substring("_candidate", 1, 8))
    starts = wanted.select(name_col, "_norm", F.explode(F.regexp_extract_all("_norm", F.lit(r"(?=([a-z0-9]{8}))"), F.lit(1))).alias("_pivot")).distinct()
    inside_one = starts.join(one, "_pivot").where(F.contains("_norm", F.col("_candidate")))
    both = [x.select(name_col, F.col("slug").alias("_slug")) for x in (inside, inside_two, inside_one)]
    held = both[0].unionByName(both[1]).unionByName(both[2]).groupBy(name_col).agg(F.min("_slug").alias("_held"))
    found = exact.join(held, name_col, "full_outer").select(name_col, F.coalesce("_slug", "_held").alias("org_slug"))
    return names.drop("org_slug").join(found, name_col, "left")


def _classes(items: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Items with equal title, place and words as one class (cid, b: hash of the title, place, size, tokens: hashes of the words),
    named by its smallest item, and the items of classes (id, cid).  Items without a title, and texts without words, are left out.

    Words are in no kept table: where they are asked for they are read again, of the item that names the class."""
    words = F.array_sort(F.transform(description_tokens(F.col("text")), lambda w: F.xxhash64(w)))
    rows = items.select(F.col(id_col).alias("id"), normalize_title(F.col("title")).alias("block"), normalize_location(F.col("location")).alias("place"), words.alias("tokens"))
    key = F.unhex(F.sha2(F.to_json(F.struct("block", "place", "tokens")), 256)).alias("key")
    rows = kept(rows.where((F.col("block") != "") & (F.size("tokens") > 0)).select("id", F.xxhash64("block").alias("b"), "place", F.size("tokens").alias("size"), key))
    classes = rows.groupBy("key").agg(F.min("id").alias("cid"), *[F.first(c).alias(c) for c in ("b", "place", "size")])
    members = rows.join(classes.select("key", "cid"), "key").select("id", "cid")
    return classes.drop("key").join(items.select(F.col(id_col).alias("cid"), words.alias("tokens")), "cid"), members


#: Classes, and words of them, that a part of a block holds at most, about; share of all pairs of two parts above which a word is
#: a column of a matrix, columns at a time, and pairs of other words at a time.
MEMBERS, WEIGHT, DENSE, COLUMNS, PAIRS = 4096, 1 << 20, 0.005, 1024, 1 << 22


def _cells(classes: DataFrame, threshold: float) -> DataFrame:
    """cid, place and cells (name, side) of the classes in blocks with several: any two of a block whose sizes allow the threshold
    share one cell.  A small block is a cell; a larger one is dealt into levels of size, which only meet themselves and
    the next, and these into parts, every two of which are a cell."""
    sized = F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")
    blocks = classes.groupBy("b").agg(*sized).where("n > 1").select("b", ((F.col("n") > MEMBERS) | (F.col("weight") > WEIGHT)).alias("wide"))
    level = F.floor(F.log(F.col("size")) / F.lit(math.log(1 / max(threshold, 1e-9)) + 1e-9))
    rows = classes.join(blocks, "b").select("cid", "b", "place", "size", F.when(F.col("wide"), level).alias("level"))
    groups = rows.where("level IS NOT NULL").groupBy("b", "level").agg(*sized)
    parts = F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    rows = rows.join(groups.groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("level", parts))).alias("parts")), "b", "left")
    of = lambda step: F.coalesce(F.try_element_at("parts", F.col("level") + step), F.lit(0))
    each = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.pmod(F.xxhash64("cid", F.lit(7)), of(0)).cast("int")
    cell = lambda kind, low, i, j, side: F.struct(F.concat_ws("/", "b", kind, low.cast("string"), i.cast("string"), j.cast("string")).alias("cell"), side.cast("int").alias("side"))
    same = F.transform(each(of(0)), lambda p: cell(F.lit("same"), F.col("level"), F.least(p, own), F.greatest(p, own), p < own))
    above = F.transform(each(of(1)), lambda p: cell(F.lit("next"), F.col("level"), own, p, F.lit(0)))
    below = F.transform(each(of(-1)), lambda p: cell(F.lit("next"), F.col("level") - 1, p, own, F.lit(1)))
    whole = F.array(F.struct(F.col("b").cast("string").alias("cell"), F.lit(0).alias("side")))
    return rows.select("cid", "place", F.when(F.col("level").isNull(), whole).otherwise(F.concat(same, above, below)).alias("cells"))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many words each two sets have in common."""
    sides = (left, right)
    values, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in sides]
    codes = np.split(codes, [len(owners[0])])
    held = [np.bincount(c, minlength=len(values)).astype(np.int64) for c in codes]
    pairs = held[0] * held[1]
    dense = pairs >= DENSE * len(left) * len(right)
    out = np.zeros((len(left), len(right)), np.float32)  # exact up to 2^24 words
    columns = np.cumsum(dense) - 1
    for low in range(0, int(dense.sum()), COLUMNS):
        has = []
        for x, owner, code in zip(sides, owners, codes, strict=True):
            at = np.flatnonzero(dense[code] & (columns[code] >= low) & (columns[code] < low + COLUMNS))
            has.append(np.zeros((len(x), COLUMNS), np.float32))
            has[-1][owner[at], columns[code[at]] - low] = 1
        for s in range(0, len(left), 1024):
            out[s : s + 1024] += has[0][s : s + 1024] @ has[1].T
    # Every pair that a rarer word makes is counted by itself.
    rare = (pairs > 0) & ~dense
    at = np.flatnonzero(rare[codes[0]])
    place, code = owners[0][at], codes[0][at]
    order = np.argsort(codes[1], kind="stable")
    other, starts = owners[1][order], np.cumsum(held[1]) - held[1]
    ends = np.cumsum(held[1][code])
    s = 0
    while s < len(at):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIRS, side="right")))
        n = held[1][code[s:e]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(out.reshape(-1), np.repeat(place[s:e], n) * len(right) + other[np.repeat(starts[code[s:e]], n) + within], np.float32(1))
        s = e
    return out


def _spanning(near: np.ndarray, one: bool) -> np.ndarray:
    """As many of the links as join what they join: near[x, y] links x with y, of the same rows (one) or of two."""
    seen = [np.zeros(near.shape[0], bool)]
    seen.append(seen[0] if one else np.zeros(near.shape[1], bool))
    out = [np.empty((0, 2), np.int64)]
    for first in np.flatnonzero(near.any(axis=1)).tolist():
        todo = [] if seen[0][first] else [(first, 0)]
        seen[0][first] = True
        while todo:
            x, side = todo.pop()
            new = np.flatnonzero((near[:, x] if side else near[x]) & ~seen[1 - side])
            seen[1 - side][new] = True
            out.append(np.stack([new, np.full(len(new), x)] if side else [np.full(len(new), x), new], axis=1))
            todo += [(y, 0 if one else 1 - side) for y in new.tolist()]
    return np.concatenate(out)


def class_pairs(classes: DataFrame, threshold: float = DUPLICATE_SIMILARITY, spanning: bool = False) -> DataFrame:
    """Pairs a < b of classes with the same title, the same place (or none on one side) and similar words;
    with ``spanning`` as many of each cell's as join what all of them do.

    Titles block the pairs.  The classes of a block meet in cells of bounded size, each compared in one task with the
    words of its members, so neither candidates nor words for them make a table.
    """
    dealt = _cells(kept(classes.select(*[F.col(c).alias(c) for c in ("cid", "b", "place", "size")]).distinct()), threshold).join(classes.select(F.col("cid").alias("named"), "tokens"), F.col("cid") == F.col("named")).select("cid", "place", "tokens", F.explode("cells").alias("c"))
    rows = dealt.select(F.col("c.cell").alias("cell"), F.col("c.side").alias("side"), "cid", "place", "tokens").repartition("cell").sortWithinPartitions("cell", "side", "cid")

    def compared(held: list[tuple[int, int, str, np.ndarray]]) -> pa.RecordBatch:
        left, right = ([h for h in held if h[0] == side] for side in (0, 1))
        one, right = not right, right or left
        a, b = (np.array([h[1] for h in x], np.int64) for x in (left, right))
        places = {p: i for i, p in enumerate(dict.fromkeys(["", *[h[2] for h in held]]))}  # 0 is none
        at, to = (np.array([places[h[2]] for h in x], np.int64) for x in (left, right))
        n, m = (np.array([len(h[3]) for h in x], np.float64) for x in (left, right))
        share = _common([h[3] for h in left], [h[3] for h in right]) if len(left) else np.zeros((0, len(b)), np.float32)
        similarity = lambda i, j: share[i, j].astype(np.float64) / (n[i] + m[j] - share[i, j].astype(np.float64))
        near = np.zeros(share.shape, bool)
        for i in range(len(a)):
            some = np.flatnonzero((share[i] > 0) & ((at[i] == to) | (at[i] == 0) | (to == 0)) & (a[i] != b))
            near[i, some[similarity(np.full(len(some), i), some) >= threshold]] = True
        x, y = (_spanning(near, one).T if spanning else np.nonzero(near & (a[:, None] < b[None, :]) if one else near)) if len(a) else (np.empty(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a[x], b[y])), pa.array(np.maximum(a[x], b[y])), pa.array(similarity(x, y))], ["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str, np.ndarray]] = []
        cell = None
        for batch in batches:
            cells, sides, ids, places = (batch.column(i).to_pylist() for i in range(4))
            ends, flat = batch.column(4).offsets.to_pylist(), batch.column(4).values.to_numpy()
            for i, c in enumerate(cells):
                if c != cell:
                    if len(held) > 1:
                        yield compared(held)
                    held, cell = [], c
                if held and held[-1][:2] == (sides[i], ids[i]):
                    continue  # a repeated item
                held.append((sides[i], ids[i], places[i], flat[ends[i] : ends[i + 1]].copy()))
        if len(held) > 1:
            yield compared(held)

    return rows.mapInArrow(run, "a bigint, b bigint, similarity double")


def dup_pairs(items: DataFrame, threshold: float = DUPLICATE_SIMILARITY, id_col: str = "id") -> DataFrame:
    """Pairs a < b of items (id, title, location, text) with the same normalised title, the same place (or none on
    one side) and similar descriptions.  Items without a title, and texts without words, pair with nothing.

    Equal items are compared once, as classes; this table names all their pairs, so it is as long as they are many.
    dup_clusters() takes the classes and does not.
    """
    classes, members = _classes(items, id_col)
    pairs = kept(class_pairs(classes, threshold))  # the dear part, compared by numpy in tasks
    of = lambda n: members.select(F.col("cid").alias(f"c{n}"), F.col("id").alias(n))
    across = pairs.withColumnsRenamed({"a": "ca", "b": "cb"}).join(of("a"), "ca").join(of("b"), "cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    within = of("a").join(of("b").withColumnRenamed("cb", "ca"), "ca").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


def closure(pairs: DataFrame) -> DataFrame:
    """id and cluster (the smallest id that pairs reach), for every id in a pair.

    Each round an id takes the smallest cluster among its neighbours, then its cluster's cluster, until nothing changes.
    """
    both = kept(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("cluster")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("cluster").alias("near"))
        low = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("cluster", "near").alias("low"), F.col("cluster").alias("was"))
        jump = labels.select(F.col("id").alias("low"), F.col("cluster").alias("jumped"))
        moved = kept(low.join(jump, "low", "left").select("id", F.least("low", F.coalesce("jumped", "low")).alias("cluster"), "was"))
        labels = moved.select("id", "cluster")
        if moved.where("cluster <> was").isEmpty():
            return labels


def dup_clusters(items: DataFrame, threshold: float = DUPLICATE_SIMILARITY, id_col: str = "id") -> DataFrame:
    """id, cluster, size, rank and canonical_id of all duplicates: rank 1, the canonical one, has the longest text, ties by source_url."""
    classes, members = _classes(items, id_col)
    # A class is named by its smallest item, so clusters of classes are those of their items.
    found = members.join(closure(class_pairs(classes, threshold, spanning=True)).withColumnRenamed("id", "cid"), "cid", "left").select("id", F.coalesce("cluster", "cid").alias("cluster"))
    several = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = found.join(several, "cluster").join(items.select(F.col(id_col).alias("id"), "source_url", F.length("text").alias("chars")), "id")
    order = Window.partitionBy("cluster").orderBy(F.col("chars").desc(), "source_url", "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return members.select(
        "id", "cluster", "size", F.row_number().over(order).alias("rank"), F.first("id").over(whole).alias("canonical_id"),
        F.first("source_url").over(whole).alias("canonical_url"),
    )


def dup_decisions(listings: DataFrame, threshold: float = DUPLICATE_SIMILARITY) -> DataFrame:
    """id, status and duplicate_of for the active listings to be hidden: all of a cluster but its canonical one."""
    found = dup_clusters(listings.where("status = 'active'"), threshold)
    return found.where("rank > 1").select("id", F.lit("hidden").alias("status"), F.col("canonical_url").alias("duplicate_of"))


def hide_duplicates(listings: DataFrame, apply: bool = False, threshold: float = DUPLICATE_SIMILARITY) -> DataFrame:
    """The decisions, or with ``apply`` the listings with them carried out."""
    decided = dup_decisions(listings, threshold)
    if not apply:
        return decided
    marks = decided.select("id", F.col("status").alias("_status"), F.to_json(F.struct(F.col("duplicate_of").alias("duplicateOf"))).alias("_mark"))
    raw = F.when(F.col("_mark").isNotNull(), raw_merge(F.col("raw"), F.col("_mark"))).otherwise(F.col("raw"))
    return listings.join(marks, "id", "left").withColumn("status", F.coalesce("_status", "status")).withColumn("raw", raw).drop("_status", "_mark")
