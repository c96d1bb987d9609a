"""Each operator against brute force, round trips or held-out labels, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

pytest.importorskip("jobweave.llm.queries")
from jobweave.llm import (  # noqa: E402
    blocks, chat_format, components, embedding_dedup, exact_dedup, language_id, minhash_dedup, packing, pii, queries, secret_scan, sentencepiece_codec, toxicity,
)

#: Null, empty, blank, very long and repeated texts, ties, a null identifier, and columns with clashing names.
ODD = [
    (1, None, "x", "a"), (2, "", "x", "a"), (3, " ", "x", "a"), (4, "one", "x", None), (5, "word " * 30_000, None, "b"), (6, "same text here again", "x", "b"), (6, "same text here again", "x", "b"),
    (7, "same text here  again", "x", "b"), (None, "same text here again", "x", "b"), (8, "日本語 テキスト 😀", "x", "b"),
]
ODD_SCHEMA = "doc_id long, text string, kept string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def test_exact_dedup(spark, odd, none, monkeypatch):
    got = exact_dedup.mark_duplicates(odd).collect()
    assert len(got) == len(ODD) and not {"kept", "score"} - set(got[0].asDict())
    same = [r for r in got if r["keep_id"] == 6]
    assert [r["group_size"] for r in same] == [4] * 4 and sum(r["kept"] for r in same) == 1
    assert {r["doc_id"]: r["keep_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1: 1, 2: 1, 3: 3}
    assert exact_dedup.mark_duplicates(none).count() == 0
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6, 8]
    # The same through the path for texts with very many copies.
    monkeypatch.setattr(exact_dedup, "MIN_HOT_ROWS", 0)
    hot = exact_dedup.mark_duplicates(odd, payload=[]).collect()
    key = lambda rows: sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in rows)
    assert key(hot) == key([r for r in got])


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 9), (9, 2), (7, 8), (8, 7), (3, 3), (None, 1)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.connected_components(links).collect()}
    assert got == {2: 2, 4: 2, 5: 2, 9: 2, 7: 7, 8: 7}
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components.connected_components(chain).collect()} == {0}


def _near(texts: dict[int, str], width: int):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    label = {k: k for k in sets}
    keys = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in keys:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return sets, label


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_against_brute_force(spark, width):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(400)]
    texts: dict[int, str] = {}
    for g in range(60):
        base = rng.choices(words, k=rng.choice([3, 12, 80, 300]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(rng.choice([0, 1, len(t) // 40])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts[len(texts)] = " ".join(t).title() if rng.random() < 0.2 else "\n".join(t)
    big = rng.choices(words, k=200)
    for _ in range(120):  # one group larger than a small node
        t = list(big)
        t[rng.randrange(200)] = rng.choice(words)
        texts[len(texts)] = " ".join(t)
    sets, label = _near(texts, width)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=width).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {k: len(s) for k, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == label
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_small_groups_beside_a_hot_group(spark):
    rng, fresh = random.Random(5), iter(range(1_000_000))
    swapped = lambda words, places: [f"x{next(fresh)}" if i in places else w for i, w in enumerate(words)]
    base = [f"w{i}" for i in range(200)]
    texts = [swapped(base, {rng.randrange(200)}) for _ in range(400)]
    for _ in range(60):  # two texts with 0.85 of each other's words and 0.75 to 0.79 of any hot text's
        places = rng.sample(range(200), 32)
        middle = swapped(base, set(places[:16]))
        texts += [swapped(middle, set(places[16:24])), swapped(middle, set(places[24:]))]
    texts = {k: " ".join(t) for k, t in enumerate(texts)}
    words = {k: set(t.split()) for k, t in texts.items()}
    near = {(a, b) for a in words for b in words if a < b and 5 * len(words[a] & words[b]) >= 4 * len(words[a] | words[b])}
    assert {p for p in near if p[1] >= 400} == {(k, k + 1) for k in range(400, 520, 2)}
    got = minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: 0 if k < 400 else k - k % 2 for k in texts}


def test_meetings_join_by_full_sets(monkeypatch):
    monkeypatch.setattr(minhash_dedup, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    for _ in range(30):
        m = int(rng.integers(2, 30))
        base = rng.integers(-(2**62), 2**62, 60)
        sets = [np.unique(np.concatenate([base[rng.random(60) < 0.92], rng.integers(-(2**62), 2**62, int(rng.integers(0, 9)))])) for _ in range(m)]
        ids, comps = rng.permutation(1000)[:m].astype(np.int64), rng.integers(0, m, m).astype(np.int64)
        links = minhash_dedup._joins(ids, comps, sets, 80)
        near = {(int(ids[i]), int(ids[j])) for i in range(m) for j in range(m) if ids[i] < ids[j] and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
        assert set(links) <= near

        def groups(pairs):
            label = dict(zip(ids.tolist(), comps.tolist(), strict=True))
            for a, b in pairs:
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
            return label

        assert groups(links) == groups(near) and len(links) == len(set(comps.tolist())) - len(set(groups(near).values()))


@pytest.mark.parametrize("width", [2, 5])
def test_shingles_of_blocks_with_few_words(width):
    texts = [" ".join("abcdef"[:n]) for n in range(7)]
    whole, bounds = minhash_dedup.shingle_sets(pa.array(texts), width, minhash_dedup._WordHashes())
    for n, text in enumerate(texts):
        alone, ends = minhash_dedup.shingle_sets(pa.array([text]), width, minhash_dedup._WordHashes())
        assert ends.tolist() == [0, max(n - width + 1, min(n, 1))] and alone.tolist() == whole[bounds[n] : bounds[n + 1]].tolist()


def test_near_dedup_on_odd_tables(odd, none):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(odd, width=2).collect()}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (6, 6, True), (7, 6, False), (None, 6, False), (8, 8, True)} <= got
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_secrets_against_plain_patterns(spark, sf_dir, documents):
    plain = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    order = secret_scan.KINDS
    extra = {-1: "ſecret=abcdef1 Token : 'zz9zz9' AKIA" + "A1" * 9 + " AKIAB " + "0a" * 12 + "G passwd=12345"}
    for k, d in {**documents, **extra}.items():
        want = [("assign", m.start(), m.end()) for m in plain.finditer(d) if len(m[2]) >= 6] + [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", d) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", d) if len(m[0]) >= 24]
        assert [s[:3] for s in secret_scan.base_spans(d)] == sorted(want, key=lambda s: (s[1], order.index(s[0]))), k
        assert not want or secret_scan._screened(pa.array([d]))[0] == [0]
    got = queries.op1_secret_scan(spark, sf_dir).collect()
    assert len(got) == len(documents) and sum(r["n_hex"] for r in got) == sum(len(re.findall("[0-9a-f]{24,}", d)) for d in documents.values())


def test_novel_secrets(spark, odd, none):
    texts = [(1, "the bearer eyJhbGciOiJIUzI1Nid9xQ7pL2 is set"), (2, "auth: your_password_here and authorization_header_value"), (3, 'token = "q1w2e3r4t5" token = "q1w2e3r4t5"'), (4, None), (5, "the api-key eyJhbGciOiJIUzI1Nid9xQ7pL2 is set")]
    found = secret_scan.find_secrets(spark.createDataFrame(texts, "doc_id long, text string"))
    kinds = {r["doc_id"]: [s["kind"] for s in r["secrets"]] for r in found.collect()}
    assert kinds == {1: ["novel"], 2: [], 3: ["assign", "assign"], 4: [], 5: ["novel"]}
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(found).collect()}
    assert masked[1] == "the bearer [SECRET] is set" and masked[3] == 'token = "[SECRET]" token = "[SECRET]"' and masked[4] is None
    assert secret_scan.find_secrets(odd).where(F.size("secrets") > 0).count() == 0 and secret_scan.find_secrets(none).count() == 0


def test_copied_secrets_stay_new(spark):
    texts = [f"the bearer QwZrTyXxCvBnMaSdFgHj is {x}" for x in ("set", "set", "set", "gone")]
    found = secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [[s["kind"] for s in r["secrets"]] for r in found] == [["novel"]] * 4


def test_toxicity_on_held_out_labels(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        t = rng.choices(words, k=rng.choice([5, 30, 300])) + ([rng.choice(["vile", "rotten"]) + rng.choice(["ish", "est", "ly"])] if toxic else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t), "x"))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, marks, queries.fold() != 1))
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i] >= 0.7 for i in held if i % 5 == 0]) > 0.95 and np.mean([got[i] >= 0.7 for i in held if i % 5]) < 0.02


def test_toxicity_of_contradictory_rows(spark):
    docs = spark.createDataFrame([(1, "vile b"), (1, "vile a"), (2, "calm"), (3, "vile c"), (4, "calm d")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    models = [toxicity.fit(d, m, F.lit(True)) for d, m in ((docs, marks), (docs.orderBy(F.desc("text")), marks.orderBy("toxic").repartition(3)))]
    assert models[0].keys.tolist() == models[1].keys.tolist() and models[0].intercept == models[1].intercept


def test_toxicity_query(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table has few held-out labels
    got = queries.op2_toxicity(spark, larger).collect()
    toxic = {r["doc_id"]: r["toxic"] for r in queries.table(spark, larger, "labels").collect()}
    assert len(got) == queries.table(spark, larger, "documents").count() and all(r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) > 0.9


def test_follow_the_leader_against_the_definition():
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    labels = np.array([int("a" in t) for t in texts])
    features = toxicity.Featurizer()
    sets = []
    for t in texts:
        kinds, bounds = features(pa.array([t]))
        sets.append(set(kinds[:, bounds[0] : bounds[1]].ravel().tolist()) - {0})
    often = {f for s in sets for f in s if sum(f in x for x in sets) > 1}
    z, n, b, l1 = dict.fromkeys(often, 0.0), dict.fromkeys(often, 0.0), [0.0, 0.0], toxicity.FEWEST_L1
    weight = lambda z, n, l1: 0.0 if abs(z) <= l1 else -(z - np.sign(z) * l1) / ((toxicity.BETA + np.sqrt(n)) / toxicity.ALPHA + toxicity.L2)
    for _ in range(toxicity.EPOCHS):
        for own, y in zip(sets, labels.tolist(), strict=True):
            w, w0 = {f: weight(z[f], n[f], l1) for f in own & often}, weight(*b, 0.0)
            g = 1 / (1 + np.exp(-(sum(w.values()) + w0))) - y
            for f, v in w.items():
                z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / toxicity.ALPHA * v
                n[f] += g * g
            b = [b[0] + g - (np.sqrt(b[1] + g * g) - np.sqrt(b[1])) / toxicity.ALPHA * w0, b[1] + g * g]
    want = {f: weight(z[f], n[f], l1) for f in often if weight(z[f], n[f], l1)}
    keys, weights, intercept = toxicity.fit_rows(pa.array(texts), labels)
    assert keys.tolist() == sorted(want) and np.allclose(weights, [want[k] for k in sorted(want)]) and abs(intercept - weight(*b, 0.0)) < 1e-9 and len(want) > 3


def test_toxicity_on_odd_tables(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd, empty, F.lit(True))
    assert toxicity.score(odd, model).where("score BETWEEN 0 AND 1").count() == len(ODD) and toxicity.score(none, model).count() == 0
    both = spark.createDataFrame([(5, 1), (6, 0), (1, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, both, F.lit(True))).count() == len(ODD)


def test_best_fit_packing(spark, odd, none, documents):
    path = queries.vocabulary("byte_bpe_50k.json")
    docs = spark.createDataFrame(list(documents.items()), "doc_id long, text string")
    whole = packing._tokenizer(path)
    ids = {k: whole.encode(t, add_special_tokens=False).ids + [0] for k, t in documents.items()}
    pieces = packing.pack(docs, path).collect()
    sequences: dict[int, list] = {}
    back: dict[int, list] = {}
    for p in pieces:
        assert len(p["ids"]) == p["length"] <= 2048
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        back.setdefault(p["doc_id"], []).append((p["piece"], p["start"], p["ids"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    for k, parts in back.items():
        assert [i for _, _, part in sorted(parts) for i in part] == ids[k]
        assert len(parts) == 1 or all(len(part) == 2048 for n, _, part in sorted(parts) if n)
    assert len(sequences) <= 1.03 * sum(map(len, ids.values())) / 2048 + 4  # one task's last sequence each
    rows = packing.pack(odd, path).collect()
    assert sum(r["length"] for r in rows) == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ODD)
    assert packing.pack(none, path).count() == 0


def test_bins_close_fullest_first():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 2, 9, 8, 1, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (3, 8), (4, 0)]


def _strings(n: int) -> list[str | None]:
    rng = random.Random(1)
    parts = [" ", "  ", "a", "é", "\n", "\t", "'s", "1", "23", "!", "▁", "word", "The ", "日", "\xa0", "　", "\x85", "\x1c", "\r\n", "<s>", "<|endoftext|>", "\x00"]
    return [None, "", " ", "a\n\n b", *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(n))]


def test_chunked_encoding_is_exact(spark, documents, odd, none):
    strings = _strings(1500) + list(documents.values())
    model, separable = sentencepiece_codec._model(queries.vocabulary("piece_bpe_32k.model"))
    filled = [s or "" for s in strings]
    assert separable and sentencepiece_codec.encode_texts(pa.array(strings), queries.vocabulary("piece_bpe_32k.model")).to_pylist() == model.encode(filled)
    path = queries.vocabulary("byte_bpe_50k.json")
    flat, sizes = packing.encode_texts(pa.array(strings), path)
    want = [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch(filled, add_special_tokens=False)]
    assert flat.tolist() == [i for ids in want for i in ids] and sizes.tolist() == list(map(len, want)) and 50256 in flat


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    rng = random.Random(4)
    parts = ["a", "b1", "Zoë", "日本", "1", "23", "!", "'s", " ", " ", " ", "  ", "\n", "\t", "▁", "\xa0", "word"]
    strings = ["".join(rng.choices(parts, k=400)) for _ in range(300)] + [" ".join("%x" % rng.getrandbits(30) for _ in range(5000))]
    path, whole = queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("byte_bpe_50k.json")
    model, _ = sentencepiece_codec._model(path)
    tokenizer = tokenizers.Tokenizer.from_file(whole)
    monkeypatch.setattr(packing, "LONG", 30)
    monkeypatch.setattr(sentencepiece_codec, "gaps", lambda text: blocks.gaps(text, 30))
    monkeypatch.setattr(sentencepiece_codec, "DECODED", 5)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    opens = np.array([len(p) > 1 and p[0] == "▁" != p[1] for p in pieces])
    assert sum(len(blocks.gaps(s, 30)) > 3 for s in strings) > 200
    for s in strings:
        assert packing.encode_texts(pa.array([s]), whole)[0].tolist() == tokenizer.encode(s, add_special_tokens=False).ids
        ids = sentencepiece_codec.encode_texts(pa.array([s]), path).to_pylist()[0]
        assert ids == model.encode(s) and sentencepiece_codec._decoded(model, opens, np.array(ids)) == model.decode(ids)


def test_chunk_table_is_bounded():
    table = blocks.ChunkTable(lambda words: blocks.flattened([[len(w)] * 2 for w in words]), limit=20_000)
    for k in range(50):
        words = [f"{k}-{i}" for i in range(60)]
        flat, ends = table.gather(table.rows(words))
        assert flat.tolist() == [len(w) for w in words for _ in range(2)] and ends[-1] == 120
        assert table.held <= 20_000 and len(table.index) <= 20_000 // table.ENTRY


def test_packing_query_has_the_digest_of_each_piece(spark, sf_dir, documents):
    tokenizer = tokenizers.Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for k, t in documents.items()}
    got = queries.op4_packing(spark, sf_dir).collect()
    for r in got:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(own.tobytes()) and len(own) == r["length"]
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))


def test_sentencepiece_round_trip(spark, sf_dir, documents, odd, none):
    path = queries.vocabulary("piece_bpe_32k.model")
    model, _ = sentencepiece_codec._model(path)
    for r in queries.op10_sentencepiece(spark, sf_dir).collect():
        ids = model.encode(documents[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, path), path).collect()
    assert sorted(r["decoded"] for r in back) == sorted(model.decode(model.encode(t or "")) for _, t, *_ in ODD)
    assert sentencepiece_codec.encode(none, path).count() == 0


def _kneser_ney(words: list[str]):
    """Shares of grams and what contexts leave, from the definitions."""
    level: dict[str, int] = {}
    for w in words:
        m = f"\x02{w}\x03"
        for e in range(1, len(m)):
            g = m[max(0, e + 1 - language_id.ORDER) : e + 1]
            level[g] = level.get(g, 0) + 1
    direct, rest = {}, {}
    for order in range(language_id.ORDER, 0, -1):
        now = {g: c for g, c in level.items() if len(g) == order}
        ones, twos = (sum(c == k for c in now.values()) for k in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        for h in {g[:-1] for g in now}:
            own = {g: c for g, c in now.items() if g[:-1] == h}
            rest[h] = d * len(own) / sum(own.values())
            direct |= {g: max(c - d, 0) / sum(own.values()) for g, c in own.items()}
        level = {g: c for g, c in level.items() if len(g) < order}
        for g in now:
            if order > 1:
                level[g[1:]] = level.get(g[1:], 0) + 1
    return direct, rest


def test_models_against_the_definition(spark):
    rng = random.Random(2)
    words = {k: ["".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(400)] for k, letters in (("x", "abc"), ("y", "bcdé"))}
    docs = spark.createDataFrame([(i, " ".join(w[i::5]), k) for k, w in words.items() for i in range(5)], "doc_id long, text string, lang string")
    models = language_id.fit(docs, F.lit(True))
    assert models.languages == ["x", "y"]
    for y, k in enumerate(models.languages):
        direct, rest = _kneser_ney(words[k])
        for g, v in direct.items():
            assert abs(models.direct.look_up(language_id._hash_grams([g], len(g)), 2)[0, y] - v) < 1e-6
        for h, v in rest.items():
            assert abs(models.rest.look_up(language_id._hash_contexts([h], len(h)), 2)[0, y] - v) < 1e-6
        # The characters behind a context have all of its probability, but for characters never seen.
        for head in ("b", "bc", "cb", "bcbb"):
            log = models.log_probabilities([head + c for c in "abcdé"] + [head])[0][:, y].astype(float)
            ends = models.log_probabilities([head + c + "b" for c in "abcdé"])[0][:, y]
            assert np.isfinite(log).all() and np.isfinite(ends).all()
            total = 0.0
            for c in [*"abcdé", "\x03"]:
                points = np.frombuffer(f"\x02{head}{c}".encode("utf-32-le"), np.uint32)
                at, hashes, orders = language_id._grams(points, np.array([0]))
                contexts, p = language_id._contexts(points, at, orders), models.floor
                for n in range(orders[-1]):
                    p = models.direct.look_up(hashes[n][-1:] ^ np.uint64(n), 2)[0, y] + models.rest.look_up(contexts[n][-1:], 2)[0, y] * p
                total += p
            assert 0.97 < total <= 1.0 + 1e-6
    assert language_id.Table(np.array([], np.uint64), np.array([]), np.array([]), 1.0).look_up(np.array([5], np.uint64), 2).tolist() == [[1.0, 1.0]]


def test_language_scores_of_long_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "ab ba abab", "x"), (1, "cd dc cdcd dd", "y"), (2, "abba ab ba ab cd " * 300, None)], "doc_id long, text string, lang string")
    models = language_id.fit(docs, F.lit(True))
    whole = language_id.entropies(docs, models).collect()
    monkeypatch.setattr(language_id, "gaps", lambda text: blocks.gaps(text, 50))
    cut = next(language_id.entropies(docs.where("doc_id = 2").withColumn("letters", F.lit("")), models).toLocalIterator())
    assert cut["letters"] == whole[2]["letters"] and np.allclose(cut["entropy"], whole[2]["entropy"])


def test_language_query(spark, sf_dir, documents):
    got = queries.op5_language_id(spark, sf_dir).collect()
    want = {r["doc_id"]: r["lang"] for r in queries.table(spark, sf_dir, "documents").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(documents) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.95 and np.mean([r["rejected"] for r in got]) < 0.1
    assert all((r["lang_pred"] == "und") == (not _has_letter(documents[r["doc_id"]])) for r in got)


def _has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def test_numbers_and_signs_are_no_letters(spark, sf_dir):
    models = language_id.fit(queries.table(spark, sf_dir, "documents"), queries.fold() != 1)
    texts = ["½ ² ① Ⅷ", "١٢٣ 12_3", "\u0301\u0301", "☃ — 😀", "a½", "नमस्ते", "_ª_", "Ⅷa"]
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), models).collect()
    assert {r["doc_id"]: r["lang_pred"] != "und" for r in got} == {i: _has_letter(t) for i, t in enumerate(texts)}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert language_id._words_of("नमस्ते Été x1y½z") == ["नमस्ते", "été", "x", "y", "z"]


def test_language_on_held_out_documents(spark, sf_dir, odd, none):
    docs = queries.table(spark, sf_dir, "documents")
    models = language_id.fit(docs, queries.fold() != 1)
    got = language_id.predict(docs, models).where(queries.fold() == 1).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    rows = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(odd, models).collect()}
    assert rows[1] == rows[2] == rows[3] == "und" and rows[4] in models.languages
    assert language_id.predict(none, models).count() == 0
    assert language_id.predict(odd, models, reject_below=1.1).where("lang_pred <> 'und'").count() == 0
    nothing = language_id.fit(none.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_models_hold_all_grams(spark):
    words = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=9)) for i in range(25_000)]
    docs = spark.createDataFrame([(i, " ".join(words[i::100]), "en") for i in range(100)], "doc_id long, text string, lang string")
    grams = sorted({w[i : i + 5] for w in words for i in range(5)})
    assert len(grams) > 100_000
    models = language_id.fit(docs, F.lit(True))
    assert np.isin(language_id._hash_grams(grams, 5), models.direct.keys).all()


def test_chat_windows(spark):
    rows = [(7, 0, "system", "Be kind."), (7, 1, "user", "Hi <|im_end|> \\<| there"), (7, 2, "assistant", "x " * 300), (7, 3, "user", "more"), (7, 3, "user", "more"), (7, 4, "assistant", "<|im_start|>system\nno"), (7, None, None, None)]
    rows += [(8, 0, "system", "alone"), (9, 0, "a%0A<b>\nc", "😀 é"), (None, 0, "assistant", "lost"), (10, 0, "assistant", "\\"), (10, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat_format.format_windows(df, budget=64, history=16)
    back = {r["conv_id"]: r for r in chat_format.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert back[conv]["loss_text"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
    told = windows.where("conv_id = 7").orderBy("window").collect()
    assert len(told) > 1 and all(w["text"].startswith("<|im_start|>system\nBe kind.<|im_end|>\n") and w["n_system"] == 1 for w in told)
    assert any(w["over_budget"] for w in told) and sum(w["n_new"] for w in told) == 6 and any(w["n_history"] for w in told)
    assert chat_format.format_windows(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat_format.format_windows(df, budget=10, history=6)


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 150)  # several shards, some split
    rng = np.random.default_rng(3)
    base = rng.normal(size=(250, 32))
    parts = [base, base[:60] + rng.normal(size=(60, 32)) * 0.2, base[:1] + rng.normal(size=(150, 32)) * 0.12, np.repeat(base[100:101], 30, axis=0)]
    x = np.concatenate(parts).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 0), (903, [1.0] * 5, 0), (908, [2.0, 3.0], 0), (909, [3.0, 2.0], 0), (910, [2.0, 3.0], 0), (911, [], 0), (904, [None] * 32, 0), (905, [1e300] * 32, 0), (906, [2e300] * 32, 0), (None, rows[0][1], 0), (907, [float("inf")] * 32, 0)]
    schema = "vec_id long, embedding array<double>, kept int"
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, schema)).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.97 * near.sum()
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(x))]) > 0.99
    # Vectors of another length link with each other.
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (908, 909, 910)] == [(2, 908)] * 3
    assert all(got[i]["n_links"] == 0 for i in (900, 901, 902, 903, 904, 907, 911)) and got[905]["n_links"] == got[906]["n_links"] == 1
    assert got[None]["n_links"] == 0 and not got[None]["kept"]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_embeddings_are_all_compared_where_the_search_finds_too_few(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 40)
    monkeypatch.setattr(embedding_dedup, "PROBES", (1,))
    monkeypatch.setattr(embedding_dedup, "LEAST_RECALL", 1.0)
    monkeypatch.setattr(embedding_dedup, "DEGREE", 1)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 12))
    x = np.concatenate([x + rng.normal(size=x.shape) * 0.25 for _ in range(8)])
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist() and {r["audited_recall"] for r in got.values()} == {1.0}


def _pii(d: str):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", d)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", d) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    found += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", d) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", d) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_copied_regions_train_the_field_once(spark, monkeypatch):
    texts = ["call +1 (555) 010-9999 now"] * 2000 + [f"mail a{i}@b.org now" for i in range(30)]
    monkeypatch.setattr(pii, "fit_regions", lambda rows: pii.Field(np.full((len(pii.FEATURES), len(pii.KINDS)), float(len(rows))), np.zeros((len(pii.KINDS) + 1, len(pii.KINDS)))))
    field = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most=20)
    assert field.weights[0, 0] == 20


def test_pii_query_against_plain_patterns(spark, sf_dir, documents):
    for r in queries.op9_pii(spark, sf_dir).collect():
        want = _pii(documents[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, _, _ in want) for k in pii.KINDS]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_pii_patterns_are_exact(documents):
    rng = random.Random(3)
    parts = ["a", "b@c", ".", "@", "1", "22", "333", "+", "-", " ", "(", ")", "_", "x.y", "4111111111111111", "é", "+1 (555) 010-9999", "       "]
    for d in [*documents.values(), *("".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(20_000))]:
        want = _pii(d)
        assert pii.base_spans(d) == want
        assert not want or pii._screened(pa.array([d]))[0] == [0]


def test_semi_markov_field(spark, sf_dir, odd, none):
    docs = queries.table(spark, sf_dir, "documents")
    field = pii.fit(docs)
    examples = [e for r in docs.select("text").collect() for e in pii._labelled(r["text"])]
    gold = sum(len(g) for _, g in examples)
    assert gold and sum(len(set(field.decode(t)[0]) & set(g)) for t, g in examples) > 0.9 * gold
    # The best segmentation is the best of all of them.
    text = "to +1 (555) 010-9999 or a.b@c.org"
    atoms, segments, x = pii.Field.lattice(text)
    scores = x @ field.weights
    best, _ = field._run(len(atoms), segments, scores, best=True)
    every = []

    def walk(at, last, total):
        if at == len(atoms):
            every.append(total)
            return
        walk(at + 1, len(pii.KINDS), total)
        for k, (i, j) in enumerate(segments):
            if i == at:
                for y in range(len(pii.KINDS)):
                    walk(j, y, total + scores[k, y] + field.moves[last, y])

    walk(0, len(pii.KINDS), 0.0)
    assert abs(max(every) - best[-1].max()) < 1e-6
    total, _ = field._run(len(atoms), segments, scores, best=False)
    assert abs(np.logaddexp.reduce(every) - np.logaddexp.reduce(total[-1])) < 1e-6
    assert pii.find_pii(odd, field).count() == len(ODD) and pii.find_pii(none, field).count() == 0
    assert pii.fit(none).decode("nothing here")[0] == []


def test_each_entity_by_its_own_probability(spark, sf_dir):
    field = pii.fit(queries.table(spark, sf_dir, "documents"))
    one = "host 10.0.12.255 up"
    # A long list has every entity that a line alone has, wherever pieces end.
    alone = pii.added_spans(field, one, [])
    listed = pii.added_spans(field, " ".join([one] * 40), [])
    step = len(one) + 1
    assert alone == [("ip", 5, 16)] and listed == [(k, a + step * i, b + step * i) for i in range(40) for k, a, b in alone]


def test_wrongly_strong_members_are_compared_all_the_same(spark, monkeypatch):
    # With this bound every pair of a group counts as strong, and nodes of more than four have leaders.
    for name, value in (("STRONG", 0.62), ("AUDITED", 1), ("SMALL", 4), ("FULL", 4)):
        monkeypatch.setattr(minhash_dedup, name, value)
    rng = random.Random(6)
    texts: dict[int, str] = {}
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(100)]
        for _ in range(8):
            t = list(base)
            for at in rng.sample(range(100), rng.choice([4, 8, 12])):
                t[at] = f"x{len(texts)}n{at}"
            texts[len(texts)] = " ".join(t)
    _, label = _near(texts, 1)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=1).collect()
    assert np.mean([r["component_id"] == label[r["doc_id"]] for r in got]) > 0.995


def test_all_are_compared_where_trees_find_too_few(spark, monkeypatch):
    rng = random.Random(9)
    texts: dict[int, str] = {}
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(3):
            t = list(base)
            for at in rng.sample(range(60), 3):
                t[at] = f"x{len(texts)}n{at}"
            texts[len(texts)] = " ".join(t)
    monkeypatch.setattr(minhash_dedup, "MOST_TREES", 1)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 50)
    monkeypatch.setattr(minhash_dedup, "meetings", lambda *_: spark.createDataFrame([], "key long, id long, comp long"))
    _, label = _near(texts, 1)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == label and {r["audited_recall"] for r in got} == {0.0}


def test_a_large_group_meets_in_the_first_wave_alone(spark, monkeypatch):
    rng, fresh = random.Random(3), iter(range(1_000_000))
    base = [f"w{i}" for i in range(120)]
    texts = {k: " ".join(f"x{next(fresh)}" if i in own else w for i, w in enumerate(base)) for k in range(600) for own in [set(rng.sample(range(120), 4))]}
    sizes = []
    tried = minhash_dedup.meetings

    def counted(*given):
        found = components.durable(tried(*given))
        sizes.append((found.count(), found.groupBy("key").count().agg(F.max("count")).first()[0]))
        return found

    monkeypatch.setattr(minhash_dedup, "meetings", counted)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=1).collect()
    assert {r["component_id"] for r in got} == {0}
    # Rows grow with the members, not with their pairs, and no meeting is large.
    assert sizes[0][0] < 40 * len(texts) and sizes[0][1] <= minhash_dedup.MEETING and all(n == 0 for n, _ in sizes[1:])


def test_trees_are_added_until_the_audit_is_met(spark, monkeypatch):
    rng = random.Random(7)
    texts: dict[int, str] = {}
    for g in range(400):
        base = [f"g{g}w{i}" for i in range(60)] if g % 2 else [f"c{rng.randrange(90)}" for _ in range(60)]
        for _ in range(2):
            t = list(base)
            for at in rng.sample(range(60), 4):
                t[at] = f"x{len(texts)}n{at}"
            texts[len(texts)] = " ".join(t)
    used = []
    tried = minhash_dedup.meetings
    monkeypatch.setattr(minhash_dedup, "meetings", lambda *a: used.append(a[2]) or tried(*a))
    _, label = _near(texts, 1)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=1, trees=1).collect()
    assert len(used) > 1 and used[0] == range(1) and used[1].start in (0, 1)
    assert np.mean([r["component_id"] == label[r["doc_id"]] for r in got]) > 0.98


def test_stages_on_odd_tables(spark, sf_dir):
    cp = pytest.importorskip("corpus_pipeline")
    rows = [(1, None, "en", "a", 5), (2, "", None, "a", None), (3, "password = abcdefgh1", "en", None, 20), (4, "one two three four five six", "en", "a", 27), (4, "seven eight nine ten eleven twelve", "en", "a", 1),
            (None, "one two three four five six", "en", "a", 27), (None, "nobody else says these six words", "en", "a", 1), (None, "nobody else says these six words", "de", "a", 1), (5, "word " * 60_000, "en", "b", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.drop_toxic(spark, odd, sf_dir).columns == odd.columns
    near = cp.drop_near_copies(spark, odd, sf_dir).collect()
    assert sorted(str(r["doc_id"]) + (r["text"] or "")[:9] for r in near) == sorted(["1", "2", "3password ", "4one two t", "4seven eig", "Nonenobody el", "5word word"])
    left = odd
    for _, stage in cp.STAGES:
        left = stage(spark, left, sf_dir)
    assert {r["doc_id"] for r in left.collect()} <= {1, 2, 3, 4, 5, None}
    none = odd.limit(0)
    for _, stage in cp.STAGES[:-1]:
        none = stage(spark, none, sf_dir)
        assert none.columns == odd.columns and none.count() == 0
    assert cp.STAGES[-1][1](spark, none, sf_dir).count() == 0


def test_checkpoints_need_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        components.shared_folder(Session)


def test_pipeline(spark, sf_dir):
    cp = pytest.importorskip("corpus_pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    columns = docs.columns
    clean = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(set(re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in left.values())) >= len(left) - 1
    assert all(not secret_scan.base_spans(t) or "[SECRET]" in t for t in left.values())
    assert set(left) < set(clean) and len(left) > 0.7 * len(clean)
    packed = cp.run(spark, sf_dir)
    assert packed.select("doc_id").distinct().count() == len(left)


def test_languages_are_calibrated_on_all_training_documents(spark):
    """Temperature and threshold are those of every row: of 4,000 rows a few are least certain, and a sample misses most of them."""
    models = language_id.Models(["a", "b"], language_id.Table(*[np.empty(0, t) for t in (np.uint64, np.int16, np.float32)], 0.0), language_id.Table(*[np.empty(0, t) for t in (np.uint64, np.int16, np.float32)], 1.0), 0.5)
    n = 4000
    rows = spark.range(n).selectExpr("id", "IF(id % 2 = 0, 'a', 'b') AS lang", "3L AS letters", f"IF(id % 2 = 0, array(1.0D, 1.0D + id / {n}), array(1.0D + id / {n}, 1.0D)) AS entropy")
    got = language_id.calibrated(rows, models, keep=0.9)
    gap = np.arange(n) / n
    score = lambda t: 1 / (1 + np.exp(-gap * t))
    assert got.temperature == min((float(-np.log(score(t)).mean()), t) for t in language_id.TEMPERATURES)[1]
    assert got.threshold == pytest.approx(np.sort(score(got.temperature))[int((n - 1) * 0.1)], abs=1e-9)


def test_members_of_a_large_node_meet_few_times_and_all_pairs_meet():
    n = minhash_dedup.FULL
    members = (np.full(n, 7, np.uint64), np.arange(n), np.arange(n), np.zeros((n, minhash_dedup.COORDINATES), np.uint8))
    keys, ids, _, _ = minhash_dedup._block_meetings(members)
    assert len(ids) <= 3 * n
    met = np.zeros((n, n), bool)
    for k in np.unique(keys):
        some = ids[keys == k]
        assert len(some) <= minhash_dedup.MEETING
        met[np.ix_(some, some)] = True
    assert met.all()
