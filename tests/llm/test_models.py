"""Held-out quality, brute force and edge cases of the trained operators, and the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ravelin.llm import ann, language, maxent, quality, toxicity
from ravelin.llm.common import fold
from ravelin.llm.queries import QUERIES

ODD = [(1, "Abc abc.", 1, "en"), (1, "Abc abc.", 1, "en"), (2, None, None, None), (3, "", 0, "fr"), (None, "one", 1, "x"), (4, "12 34 !!", 0, None), (5, "word " * 2000, 1, "fr")]
SCHEMA = "doc_id long, text string, toxic int, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_folds(spark):
    assert {r["id"]: r["f"] for r in spark.range(50).select("id", fold("id", 7).alias("f")).collect()} == {i: remainder(i, 7) for i in range(50)}


def test_language(spark, tables, odd):
    got = QUERIES["op2_language"](spark, tables).toPandas().merge(spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang", "text").toPandas(), on="doc_id")
    assert (got["held_out"] == got["doc_id"].map(lambda i: remainder(i, 4) == 2)).all() and got["score"].between(0, 1).all()
    assert (got["lang"] == got["lang_pred"])[got["held_out"]].mean() > 0.97
    model = language.train(odd)
    rows = language.with_language(odd.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == len(ODD) and all((r["lang_pred"] == "und" and r["score"] == 0 and r["ambiguous"]) == (r["doc_id"] in (2, 3, 4)) for r in rows)
    nothing = language.train(odd.limit(0))
    assert {r["lang_pred"] for r in language.with_language(odd, nothing).collect()} == {"und"}
    single = language.train(odd.where("lang = 'en'"))
    assert language.with_language(odd.where("doc_id = 1"), single).first()["score"] == 1.0
    assert language.with_language(odd.limit(0), model).count() == 0


def test_codewords():
    for n in (2, 3, 4, 5, 6, 9):
        c = language.codewords(n)
        gap = min((c[i] != c[j]).sum() for i in range(n) for j in range(i))
        assert gap >= (1 if n == 2 else 2) and (np.abs(c.sum(axis=0)) < n).all()


def test_toxicity(spark, odd):
    rng = np.random.default_rng(0)
    syllables = ["th", "an", "er", "on", "in", "re", "st", "ou", "ing", "ble"]
    plain = lambda: [("".join(rng.choice(syllables, int(rng.integers(1, 4))))) for _ in range(120)]
    bad = ["idiot", "scum", "pathetic", "worthless"]
    rows = []
    for i in range(800):
        words, toxic = plain(), int(i % 4 == 0)
        for _ in range(6 * toxic):
            words.insert(int(rng.integers(len(words))), str(rng.choice(bad)))
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = fold("doc_id", 5) == 0
    model = toxicity.train(docs.where(~held), docs.where(~held).select("doc_id", "toxic"))
    got = toxicity.with_toxicity(docs.where(held), model).toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.9 and got["score"].between(0, 1).all()
    again = toxicity.with_toxicity(odd.withColumn("score", F.lit("x")), model).collect()
    assert len(again) == len(ODD) and len({r["score"] for r in again if r["doc_id"] in (2, 3)}) == 1
    assert toxicity.with_toxicity(odd.limit(0), model).count() == 0
    none = toxicity.train(odd.limit(0), odd.limit(0))
    assert {r["predicted"] for r in toxicity.with_toxicity(odd, none).collect()} == {0}
    few = toxicity.train(odd, odd)
    assert toxicity.with_toxicity(odd, few).where("score between 0 and 1").count() == len(ODD)


def test_windows():
    raw, spans, n = toxicity.windows(["One, two\nthree four five", "", "x", " . "], 3, 2)
    cut = [raw[a : a + b].split() for a, b in spans.tolist()]
    assert n.tolist() == [2, 0, 1, 0] and cut == [[b"One", b"two", b"three"], [b"three", b"four", b"five"], [b"x"]]


def test_quality(spark, tables, odd):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    got = QUERIES["op4_quality"](spark, tables).toPandas().merge(spark.read.parquet(f"{tables}/labels.parquet").toPandas(), on="doc_id")
    good = got[got["quality"] == 1]
    assert good["keep"].mean() > 0.95 and got[got["quality"] == 0]["keep"].mean() < 0.5
    model = quality.train(docs)
    rows = quality.with_quality(odd.withColumn("keep", F.lit("x")), model).collect()
    assert len(rows) == len(ODD) and all(r["keep"] == 0 for r in rows if not r["text"])
    assert quality.with_quality(odd.limit(0), model).count() == 0
    assert quality.with_quality(odd, quality.train(docs.limit(0))).count() == len(ODD)


def test_em_finds_accuracies():
    rng, n = np.random.default_rng(3), 20_000
    truth = rng.random(n) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.9, 0.8, 0.9])
    votes = np.where(rng.random((n, 9)) < right, np.where(truth, quality.GOOD, quality.BAD)[:, None], np.where(truth, quality.BAD, quality.GOOD)[:, None])
    votes[rng.random((n, 9)) < 0.3] = quality.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = quality.estimate(patterns, counts.astype(float))
    assert abs(found.prior - 0.8) < 0.03 and np.abs(np.array(list(found.accuracies().values())) - right).max() < 0.03


def test_ann(spark, tables):
    e = spark.read.parquet(f"{tables}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.array(e["embedding"].tolist(), float), e["vec_id"].to_numpy()
    got = QUERIES["op8_hnsw"](spark, tables).toPandas()
    hits = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and (np.diff(own["score"]) >= 0).all()
        assert np.allclose(own["score"], d[[int(np.flatnonzero(ids == v)[0]) for v in own["vec_id"]]])
        hits.append(len(set(own["vec_id"]) & set(ids[best])))
    assert np.mean(hits) >= 9


def test_ann_odd_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(100, [1.0, 2.5]), (200, None), (201, [0.0, 0.0]), (202, [float("nan"), 1.0]), (203, [None, 1.0]), (204, []), (205, [1.0, 2.0, 3.0]), (0, [9.0, 9.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(v.where("vec_id in (5, 100, 200, 201, 205)"), ann.index(v)).collect()
    near = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (5, 100, 200, 201, 205)}
    assert near[5] == [(i, 0.0) for i in (0, 1, 2, 3, 4, 6, 7, 8, 9, 10)] and near[100] == [(i, 0.5) for i in range(10)]
    assert near[200] == near[201] == near[205] == []
    assert ann.nearest(v.limit(0), ann.index(v)).count() == 0 and ann.nearest(v, ann.index(v.limit(0))).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    layers = ann.build(x)
    q = rng.normal(size=(50, 16))
    found = ann.search(x, layers, q, 96)
    best = np.argsort(((x[None] - q[:, None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) for a, b in zip(found, best, strict=True)]) >= 9.5
    assert layers[0][1].shape[1] <= 2 * ann.LINKS and len(layers) > 1


def test_maxent(spark, tables, odd):
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [None] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    c = Counter(t for i, ts in docs.items() if remainder(i, 7) != 2 for t in ts)
    n, v = sum(c.values()), len(c)
    got = QUERIES["op10_maxent"](spark, tables).collect()
    assert len(got) == len(docs)
    for r in got:
        ts = docs[r["doc_id"]]
        assert r["n_tokens"] == len(ts) and r["n_known"] == sum(c[t] > 0 for t in ts) and r["train_tokens"] == n and r["held_out"] == (remainder(r["doc_id"], 7) == 2)
        assert math.isclose(r["base_score"], sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    model = maxent.train(odd)
    rows = maxent.with_scores(odd.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == len(ODD) and len({(r["n_tokens"], r["base_score"], r["score"]) for r in rows if r["doc_id"] == 1}) == 1
    assert all(r["n_tokens"] == 1 for r in rows if not r["text"])
    assert maxent.with_scores(odd.limit(0), model).count() == 0
    empty = maxent.with_scores(odd, maxent.train(odd.limit(0))).collect()
    assert all(r["base_score"] == 0 and r["score"] < 0 for r in empty)


def test_probabilities_add_up(spark, odd):
    """Over all words, known and not, the model's next-word probabilities add up to one."""
    import pyarrow as pa

    model = maxent.train(odd.where("text is not null"))
    t = maxent.Tokens(maxent.Lexicon(model), pa.array(["abc", "one word", ""]))
    z = sum(model.weights[r + f] for r, f in zip(t.rows, maxent.ROWS[:4], strict=True)) + model.bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    chosen = np.exp(maxent.class_scores(model, t))
    assert np.allclose(chosen, p[np.arange(len(t.kind)), t.kind], atol=1e-5)
    z = model.fine[t.fine_rows[0]] + model.fine_bias[t.suffix]
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(np.exp(maxent.part_scores(model, t)), p[np.arange(len(t.part)), t.part], atol=1e-5)
    sums = {}
    for r in model.counts.collect():
        if r["h"] not in model.heads[: maxent.FREQUENT]:
            k = (r["k"], r["h"] >> 59 & maxent.SUBS - 1)
            sums[k] = sums.get(k, 0) + r["c"] + 1
    assert all(math.isclose(sums.get((k, s), 0) + 1, 10 ** model.norm[k, s], rel_tol=1e-9) for k in range(maxent.SUFFIXES) for s in range(maxent.SUBS))


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "1234 5678", None, "src0", 9), (10**6 + 1, docs.first()["text"], "en", "src1", 5)], docs.schema)
    before = docs.unionByName(junk)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, tables)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        after = corpus_pipeline.durable(after)
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        had = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert ids <= had and len(ids) > 0.5 * len(had)
        if name == "language_id":
            assert 10**6 not in ids and 10**6 + 1 in ids
        if name == "simhash_near_dedup":
            assert 10**6 + 1 not in ids and after.count() == len(ids)
        before = after
    assert before.where(F.size("token_ids") != F.col("n_tokens")).count() == 0
    assert before.where(F.sha2("text", 256) != F.col("decoded_sha256")).count() == 0


def test_pipeline_on_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    assert docs.count() == 0


def test_toxic_passages_are_told_by_their_runs():
    s = toxicity.Settings(least_passages=3, least_ratio=2.0)
    toxic = [b" the idiot said ", b" an idiot came ", b" idiot and more ", b" the plain sea "]
    ordinary = [b" the plain sea ", b" the plain road ", b" the plain house "]
    assert toxicity.tell(toxic, ordinary, s) == toxic[:3]
    key, of = toxicity.runs([b"aaaaaaa", b"abc", b"abcdef"], 6)
    assert of.tolist() == [0, 2] and len(set(key.tolist())) == 2


def test_toxicity_by_a_slow_version(spark, tables):
    """Scores equal those of windows cut by splitting and compressed one at a time."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    s, tools = model.settings, model.compressors()
    assert model.ordinary != model.toxic and zstandard.ZstdCompressionDict(model.toxic).dict_id()
    breaks = str.maketrans({chr(b): " " for b in toxicity.PARTS})
    for r in toxicity.with_toxicity(docs.limit(40), model).collect():
        words = r["text"].lower().translate(breaks)
        cut, at = [], [i for i in range(len(words)) if words[i] != " " and (i == 0 or words[i - 1] == " ")]
        ends = [next((j for j in range(i, len(words)) if words[j] == " "), len(words)) for i in at]
        for i in range(0, max(1, -(-(len(at) - s.window) // s.step) + 1) if at else 0):
            group = range(i * s.step, min(i * s.step + s.window, len(at)))
            cut.append((" " + words[at[group[0]] : ends[group[-1]]] + " ").encode())
        ordinary, toxic = ([len(t.compress(w)) for w in cut] for t in tools)
        shorter, closer = [len(w) - x for w, x in zip(cut, toxic, strict=True)], [a - b for a, b in zip(ordinary, toxic, strict=True)]
        counts = [sum(x >= t for x in shorter) for t in s.shorter] + [sum(x >= t for x in closer) for t in s.closer]
        counts += [sum(x >= a and y >= b for x, y in zip(shorter, closer, strict=True)) for a, b in s.both] + [len(cut)]
        z = model.curve[0] + sum(w * math.log1p(c) for w, c in zip(model.curve[1:], counts, strict=True))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-6, abs_tol=1e-9)
