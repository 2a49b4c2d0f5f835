"""BPE against the tokenizers library; SimHash and mixing against brute force; edge cases of these, licences and order MinHash."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from ravelin.llm import bpe, licences, mixing, orderhash, simhash
from ravelin.llm.queries import QUERIES

ODD = [(1, "Abc abc. abc\tx", "a", 1), (1, "Abc abc. abc\tx", "a", 1), (2, None, None, 2), (3, "", "b", 3), (None, "one", "b", 4), (4, "word " * 3000, "a", 5)]
SCHEMA = "doc_id long, text string, source string, score long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_bpe(spark, tables):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = ["a!<|endoftext|> b <|endoftext|>", None, "", " \n\n  \t x  y\x1c z\x85 ​ ", "日本語 😀😀 ñandú it's 123 x² Ⅷ ½", "a" * 300 + "=-" * 200, "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.unionByName(spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text"))
    for r in bpe.with_tokens(docs, path).collect():
        e = own.encode(r["text"] or "", add_special_tokens=False)
        assert r["token_ids"] == e.ids
        assert r["decoded"] == own.decode(e.ids, skip_special_tokens=False) == (r["text"] or "")
    assert bpe.with_tokens(docs.limit(0), path).count() == 0
    clash = bpe.with_tokens(docs.withColumn("token_ids", F.lit("x")).limit(2), path)
    assert dict(clash.dtypes)["token_ids"] == "array<int>"


def test_gadgets_by_brute_force():
    """On a tiny alphabet, words are encoded as by merging pairs in order of rank."""
    pairs = [(b"a", b"a"), (b"aa", b"a"), (b"a", b"b"), (b"ab", b"aa"), (b"b", b"b"), (b"aaa", b"b"), (b"bb", b"bb")]
    vocabulary = {bytes([b]): b for b in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(pairs)}
    rank = {p: i for i, p in enumerate(pairs)}
    machine = bpe.Automaton(pairs, vocabulary, {})

    def plain(word):
        parts = [bytes([c]) for c in word]
        while True:
            best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if best is None:
                return [vocabulary[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = np.random.default_rng(1)
    words = [bytes(rng.choice([97, 98], int(n)).tolist()) for n in rng.integers(1, 70, 600)]
    arcs, ends = machine.encode_words(words)
    for i, w in enumerate(words):
        assert machine.ids[arcs[ends[i] : ends[i + 1]]].tolist() == plain(w), w


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(prints):
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for f in prints:
        for g in prints:
            if (f ^ g).bit_count() <= 2:
                root[find(f)] = find(g)
    return {f: find(f) for f in prints}


def test_simhash(spark, tables, odd):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    own = {r["doc_id"]: fingerprint(r["text"]) for r in docs.collect()}
    find = groups(sorted(set(own.values())))
    least = {}
    for i, f in sorted(own.items()):
        least.setdefault(find[f], i)
    for r in QUERIES["op1_simhash"](spark, tables).collect():
        assert r["fingerprint"] == f"{own[r['doc_id']]:016x}" and r["component_id"] == least[find[own[r["doc_id"]]]]
    got = simhash.with_components(odd.withColumn("fingerprint", F.lit("x")))
    assert got.count() == len(ODD) and "score" in got.columns
    assert {r["component_id"] for r in got.where("doc_id in (2, 3)").collect()} == {2}
    assert simhash.with_components(odd.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [48, 2])
def test_links_of_crowded_buckets(spark, crowd):
    rng, seen = np.random.default_rng(0), [12345]
    for _ in range(250):
        f = seen[int(rng.integers(len(seen)))]
        for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            f ^= 1 << int(b)
        seen.append(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    seen = sorted(set(seen))
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in seen], "f long"), 2, crowd)
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = groups(seen)
    assert len({(got.get(signed(f), signed(f)), want[f]) for f in seen}) == len(set(want.values())) == len({got.get(signed(f), signed(f)) for f in seen})


def test_masks_cover():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks()]
    assert len(masks) == 7 and all(any(not (m >> i & 1 or m >> j & 1) for m in masks) for i in range(64) for j in range(i))


def test_mixing(spark, tables, odd):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = QUERIES["op3_mixing"](spark, tables).toPandas().merge(docs.select("doc_id", "source", "text").toPandas(), on="doc_id")
    assert (got["size"] == got["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))).all()
    s = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    weight = np.array([1 + i % 3 for i in range(len(s))], float)
    target, free = np.zeros(len(s)), np.ones(len(s), bool)
    while True:
        target[free] = (s["size"].sum() - target[~free].sum()) * weight[free] / weight[free].sum()
        over = free & (target > 3 * s["size"].to_numpy())
        if not over.any():
            break
        target[over], free = 3 * s["size"].to_numpy()[over], free & ~over
    assert np.allclose(target, s["target"]) and (abs(s["taken"] - s["target"]) < 1).all() and (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix(docs.repartition(3))[0].toPandas()
    assert (again.sort_values("doc_id")["taken"].to_numpy() == got.sort_values("doc_id")["taken"].to_numpy()).all()
    rows, slots = mixing.mix(odd.withColumn("size", F.lit("x")))
    assert rows.count() == len(ODD) and rows.where("size = 0 and taken > 0").count() == 0
    assert slots.groupBy("_row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n")).join(rows, "_row").where("n <> taken").count() == 0
    assert mixing.mix(odd.limit(0))[0].count() == 0 and mixing.mix(odd.where("doc_id = 3"))[0].first()["taken"] == 0


def test_small_sources_are_capped(spark):
    docs = spark.createDataFrame([(1, "a b", "s1"), (2, "x " * 100, "s2"), (3, "y", "s3")], "doc_id long, text string, source string")
    assert {r["doc_id"]: (r["target"], r["taken"]) for r in mixing.mix(docs)[0].collect()} == {1: (6.0, 6), 2: (94.0, 94), 3: (3.0, 3)}


def test_licences(spark, odd):
    mit = licences.TEMPLATES["MIT/text"]
    texts = {1: "x " + mit.replace("sublicense", "zzz"), 2: "All rights reserved. " * 40 + licences.TEMPLATES["GPL/header"], 3: " ".join(mit.split()[:30]), 4: "y " * 500 + "Released under the MIT License."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["template"]): r for r in licences.scan(docs).collect()}
    assert set(got) == {(1, "MIT/text"), (2, "Proprietary/reserved"), (2, "GPL/header"), (4, "MIT/short")}
    assert got[1, "MIT/text"]["first_word"] == 1 and got[4, "MIT/short"]["first_word"] == 500 and got[2, "Proprietary/reserved"]["matches"] == 40
    assert licences.scan(odd).count() == 0 and licences.scan(docs, templates={}).count() == 0
    assert licences.scan(docs.union(docs)).count() == 8




def test_orderhash(spark, tables, odd):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id", ascending=False)
    texts, ids = docs["text"].tolist(), docs["doc_id"].tolist()
    got = {r["doc_id"]: r for r in QUERIES["op9_orderhash"](spark, tables).collect()}
    for i, t in enumerate(texts):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]
        assert got[ids[i]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[ids[i]]["n_chars"] == len(t)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.9
    rows = orderhash.with_edits(odd.withColumn("near_next", F.lit("x"))).collect()
    assert len(rows) == len(ODD)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 1}) == 1
    assert all(r["fingerprint"] == orderhash.EMPTY * orderhash.CELLS for r in rows if not r["text"])
    assert orderhash.with_edits(odd.limit(0)).count() == 0
    alone = orderhash.with_edits(odd.where("doc_id = 4")).first()
    assert alone["near_next"] == 1.0 and set(alone["fingerprint"]) != {"."}


def test_orderhash_tells_order_and_repeats(spark):
    w = [f"w{i}" for i in range(400)]
    texts = [" ".join(w), " ".join(w[200:] + w[:200]), " ".join(w * 2), " ".join(w[:200] + ["x"] + w[200:])]
    p = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    f = [r["fingerprint"] for r in orderhash.with_fingerprint(p).orderBy("doc_id").collect()]
    pairs = spark.createDataFrame([(f[0], x) for x in f[1:]], "a string, b string").select(orderhash.likeness(F.col("a"), F.col("b")).alias("n")).collect()
    moved, doubled, inserted = (r["n"] for r in pairs)
    assert inserted > 0.85 and 0.2 < moved < inserted and doubled < 0.6
