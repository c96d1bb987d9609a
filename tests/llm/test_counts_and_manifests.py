"""Source divergence, token counts and manifests against brute force, and on odd tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import unicodedata
import zlib

import pytest
import tokenizers
from pyspark.sql import functions as F

pytest.importorskip("jobweave.llm.queries")
from jobweave.llm import merkle_manifest, queries, source_divergence, token_counts  # noqa: E402

WORD_BPE = queries.vocabulary("word_bpe_49k.json")


# --- divergence ---------------------------------------------------------------------------------------------------------------


def _divergences(rows, min_docs, top):
    """By the definition, over rows (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [(g, s, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t))) for g, s, t in rows]
    out = []
    for lang in {g for g, _, _ in terms}:
        mine = [(s, t) for g, s, t in terms if g == lang]
        docs = collections.Counter(x for _, t in mine for x in set(t))
        kept = sorted(x for x, n in docs.items() if n >= min_docs)
        count = {s: collections.Counter(x for s2, t in mine if s2 == s for x in t if docs[x] >= min_docs) for s, _ in mine}
        whole = sum(count.values(), collections.Counter())
        share = lambda c: {x: 1 + 10**9 * (c[x] + 2) // (sum(c.values()) + 2 * len(kept)) for x in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted((-sum(f(p[s][x], p[o][x]) for x in kept), o.encode()) for o in p if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            more = sorted((-f(p[s][x], q[x]), x.encode()) for x in kept if count[s][x] and p[s][x] > q[x])[:top]
            out += [(lang, s, "term", x.decode(), -v, k + 1) for k, (v, x) in enumerate(more)]
    return sorted(out)


def _random_texts(rng, n):
    words = [f"{c}{d}" for c in "abcdefgh" for d in "xyz"] + ["Ünlü", "naïve", "日本", "A", "it's", "x1y", "é"]
    for i in range(n):
        source = rng.choice(["s0"] * 5 + [f"s{k}" for k in range(9)] + [None])
        yield rng.choice(["en", "en", "de", None]), source, " ".join(rng.choices(words, weights=[1 + (i % 7 == k % 7) * 9 for k in range(len(words))], k=rng.randint(0, 40)))


@pytest.mark.parametrize("sources, terms", [(32, 8192), (2, 3), (1, 1)])
def test_divergence_by_the_definition(spark, sources, terms):
    rows = [*_random_texts(random.Random(3), 300), ("fr", "only", "one"), ("fr", "two", None), ("it", "", ""), ("en", "empty", "1 2 3")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("value", F.lit("clash")).repartition(5)
    got = source_divergence.audit(docs, min_docs=4, top=3, sources=sources, terms=terms)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == _divergences(rows, 4, 3)


def test_divergence_of_a_hot_source_long_texts_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "_HELD", 3)  # counts leave the task in many parts
    rows = [("en", "hot", f"alpha beta w{'abcdefghij'[i % 10]}") for i in range(400)] + [("en", f"s{i}", "alpha " * 40_000 + "beta gamma") for i in range(5)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    assert sorted(tuple(r) for r in source_divergence.audit(docs, min_docs=2, sources=2, terms=2).collect()) == _divergences(rows, 2, 10)
    assert source_divergence.audit(docs.limit(0)).count() == 0


def test_counts_beyond_64_bits():
    import numpy as np

    big = np.array([0, 10**13], np.int64)
    assert source_divergence._shares(big, 10**13, 2).tolist() == [1 + 10**9 * (c + 2) // (10**13 + 4) for c in big.tolist()]


# --- token counts -------------------------------------------------------------------------------------------------------------

PARTS = ["a", "b", "e", "t", "h", "'", "s", "re", "ll", "é", "é", "İ", "ß", "1", "½", "!", "..", "日", "한", "한", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "|>",
         "Σ", "ing", "tion", "Q", "́", "‍", "नमस्ते", "　", " ", "\x1c", "\x00", " ", "\n\n", "it's", "DON'T"]


def _plain_counts(text, tok):
    """Tokens of every prefix that ends at no place inside a combining sequence."""
    joins = token_counts._joins_back()
    for i in range(len(text) + 1):
        if i == len(text) or not i or not (unicodedata.combining(text[i]) or text[i] in joins):
            yield i, len(tok.encode(text[:i], add_special_tokens=False).ids)


def test_every_prefix_has_the_library_s_count(spark):
    tok, rng = tokenizers.Tokenizer.from_file(WORD_BPE), random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", " \n ", "unbelievably long-winded" * 40]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = collections.defaultdict(list)
    table = token_counts.prefix_table(docs, WORD_BPE, part=8).cache()
    for r in table.orderBy("doc_id", "part").collect():
        mine = found[r["doc_id"]]
        assert r["begin"] == max(0, len(mine) - 1) and mine[-1:] in ([], r["counts"][:1])
        mine[-1:] = r["counts"]
    for i, t in enumerate(texts):
        assert len(found[i]) == len(t or "") + 1
        for at, n in _plain_counts(t or "", tok):
            assert found[i][at] == n, (t, at)
    # Truncation and budgets from the table.
    for limit in (0, 1, 7):
        got = {r["doc_id"]: r["n_chars"] for r in token_counts.longest_within(table, limit).collect()}
        assert got == {i: max(at for at, n in enumerate(c) if n <= limit) for i, c in found.items()}
    asked = [(i, at) for i in range(0, len(texts), 7) for at in (0, 3, 8, 20, 10**6)]
    got = token_counts.tokens_at(table, spark.createDataFrame(asked, "doc_id long, at long"), part=8).collect()
    assert sorted((r["doc_id"], r["at"], r["n_tokens"]) for r in got if r["n_tokens"] is not None) == sorted((i, at, found[i][at]) for i, at in asked if at < len(found[i]))
    assert len(got) == len(asked)


def test_count_query_and_odd_rows(spark, sf_dir):
    tok = tokenizers.Tokenizer.from_file(WORD_BPE)
    docs = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf_dir, "documents").collect()}
    got = queries.op12_token_counts(spark, sf_dir).collect()
    want = {i: len(e.ids) for i, e in zip(docs, tok.encode_batch(list(docs.values()), add_special_tokens=False), strict=True)}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and all(r["n_bytes"] == len(docs[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    odd = [(1, None, "x"), (None, "two words", "y"), (None, "two words", "y"), (1, "", None), (2, "x" * 300_000 + " " + "word " * 50_000, "z"), (3, "ab1!" * 50_000, "z")]
    df = spark.createDataFrame(odd, "doc_id long, text string, n_tokens string")
    rows = token_counts.count_tokens(df, WORD_BPE).collect()
    assert rows[0].__fields__ == ["doc_id", "text", "n_tokens"]
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(tok.encode(t or "", add_special_tokens=False).ids) for _, t, _ in odd)
    assert token_counts.count_tokens(df.limit(0), WORD_BPE).count() == 0 and token_counts.prefix_table(df.limit(0), WORD_BPE).count() == 0
    with pytest.raises(ValueError):
        token_counts.PrefixCounter(queries.vocabulary("byte_bpe_50k.json"))


def test_words_leave_the_tables_when_they_are_full(monkeypatch):
    tok = tokenizers.Tokenizer.from_file(WORD_BPE)
    monkeypatch.setattr(token_counts, "_WORDS_HELD", 20)
    monkeypatch.setattr(token_counts, "_PAIRS_HELD", 5)
    counter = token_counts.PrefixCounter(WORD_BPE)
    for w in ["internationalisation", "hello", "internationalisation", "123abc", "they'll"] * 2:
        assert list(counter.run(w)) == [n for _, n in itertools.islice(_plain_counts(w, tok), 1, None)]


# --- manifests ----------------------------------------------------------------------------------------------------------------


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return _hash(*[told(row[c]) for c in merkle_manifest.COLUMNS])


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_hash(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def _manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row by the definition."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
        trees[g] = _tree([_leaf(r) for r in groups[g]])
    top = _tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            bad = r["n_chars"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node, siblings = _leaf(r | {"n_chars": r["n_chars"] + 1} if bad else r), []
            for levels, at in ((trees[g], i), (top, k)):
                for row in levels[:-1]:
                    run = row[at // 2 * 2 : at // 2 * 2 + 2]
                    siblings += [x for j, x in enumerate(run) if j != at % 2]
                    run[at % 2] = node
                    node, at = _hash(*run), at // 2
            out.append((r["doc_id"], _leaf(r), trees[g][-1][0], top[-1][0], _hash(*siblings), node, node == top[-1][0]))
    return sorted(out, key=str)


MANIFEST_SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string"


def _found(spark, rows, partitions=4, **kw):
    df = spark.createDataFrame([tuple(r.get(c) for c in (*merkle_manifest.COLUMNS, "root")) for r in rows], MANIFEST_SCHEMA).repartition(partitions)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle_manifest.manifest(df, tampered={"n_chars": changed}, **kw)
    return sorted([tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


def _rows(sizes):
    n = itertools.count()
    return [{"doc_id": i, "source": f"s{i % 3}", "lang": g, "n_chars": None if i % 11 == 0 else i, "text": None if i % 13 == 0 else f"téxt {i}"} for g, size in sizes for i in itertools.islice(n, size)]


@pytest.mark.parametrize("levels, swap", [(12, 4), (1, 1), (0, 2), (2, 1)])
def test_manifest_by_the_definition(spark, levels, swap):
    # Sizes around powers of two, a hot group, a lone leaf and the null group.
    rows = _rows([("en", 150), (None, 9), ("de", 8), ("fr", 1), ("", 7), ("日本", 33)])
    want = _manifest(rows)
    assert _found(spark, rows, block_levels=levels, swap_levels=swap) == want
    assert {v[-1] for v in want} == {True, False}


def test_manifest_of_many_sizes(spark):
    for size in (2, 3, 5, 11, 17, 21, 27):
        rows = _rows([("en", size)])
        assert _found(spark, rows, block_levels=0, swap_levels=2) == _manifest(rows), size


def test_manifest_of_odd_rows(spark):
    same = {"doc_id": 5, "source": "s", "lang": "en", "n_chars": 3, "text": "abc", "root": "clash"}
    rows = [same] * 9 + [same | {"doc_id": None}] * 5 + [same | {"text": "long " * 60_000}, same | {"text": ""}, dict.fromkeys(same), dict.fromkeys(same)]
    got = _found(spark, rows, block_levels=1, swap_levels=1)
    assert got == _manifest(rows)
    assert _found(spark, []) == []


def test_siblings_lead_to_the_root(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    rows = merkle_manifest.manifest(docs).collect()
    assert len(rows) == docs.count() and all(r["verified"] for r in rows) and len({r["root"] for r in rows}) == 1
    digest = {(r["leaf"], r["proof_sha256"]) for r in rows if r["proof_sha256"] == _hash(*filter(None, r["siblings"]))}
    assert len(digest) == len({(r["leaf"], r["proof_sha256"]) for r in rows})
