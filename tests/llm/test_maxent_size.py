"""The language model's classes and features are all there, and its scores equal a slow version's."""

import math

import numpy as np
import pyarrow as pa

from ravelin.llm import maxent


def test_classes_and_three_words_back():
    assert (maxent.FREQUENT, maxent.SUFFIXES, maxent.CLASSES) == (24, 39, 64)
    weights = np.random.default_rng(0).normal(size=(maxent.ROWS[-1], maxent.CLASSES)).astype(np.float32)
    none = np.zeros(0, np.int64)
    model = maxent.Model(10, 6, 2, none, none, np.zeros(maxent.CLASSES, np.float32), np.zeros((maxent.SUFFIXES, maxent.SUBS), np.float32), np.zeros((maxent.SUFFIXES, maxent.SUBS)), weights)
    t = maxent.Tokens(maxent.Lexicon(model), pa.array(["a b c d", "x b c d"]))
    scores = maxent.class_scores(model, t)
    assert max(int((r + f).max()) for r, f in zip(t.rows, maxent.ROWS[:4], strict=True)) < maxent.ROWS[-1] and scores[3] != scores[8]


def hash_of(word):
    """The word's 63-bit hash, and its class's number among the suffix classes, byte by byte."""
    m, a = (1 << 64) - 1, 0x9E3779B97F4A7C15
    h = sum((b + 1) * pow(a, i, 1 << 64) for i, b in enumerate(word)) & m
    h = ((h ^ h >> 32) * a) & m
    h = max((h ^ h >> 29) >> 1, 1)
    tail = word[-1] + (word[-2] + 1 << 9 if len(word) > 1 else 0) + (word[-3] + 1 << 18 if len(word) > 2 else 0)
    return h, ((tail * a & m) >> 33) % maxent.SUFFIXES


def slow_score(model, counts, text):
    """log10 of the text's probability, word by word with dictionaries."""
    heads = {int(h): i for i, h in enumerate(model.heads[: maxent.FREQUENT])}
    words = (text or "").encode().lower().split()
    history, total = [], 0.0
    for w in [*words, None]:
        h, suffix = hash_of(w) if w is not None else (0, None)
        kind = maxent.END if w is None else heads.get(h, maxent.FREQUENT + suffix)
        back = lambda k: history[-k] if len(history) >= k else (0, maxent.CLASSES)
        rows = [maxent.ROWS[k] + back(k + 1)[0] for k in range(3)] + [maxent.ROWS[3] + back(1)[1] * (maxent.CLASSES + 1) + back(2)[1]]
        z = model.bias.astype(float) + sum(model.weights[r].astype(float) for r in rows)
        total += z[kind] / math.log(10) - math.log10(np.exp(z).sum())
        if maxent.FREQUENT <= kind < maxent.END:
            s = kind - maxent.FREQUENT
            row = ((kind * maxent.BUCKETS + back(1)[0]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - maxent.FINE_BITS
            z = model.fine_bias[s].astype(float) + model.fine[row]
            p = h >> 59 & maxent.SUBS - 1
            total += z[p] / math.log(10) - math.log10(np.exp(z).sum()) + math.log10(counts.get(h, 0) + 1) - model.norm[s, p]
        history.append(((h >> 20) % (maxent.BUCKETS - 1) + 1 if w is not None else 0, kind))
    return total


def test_scores_by_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    few = docs.where("doc_id % 3 = 0")
    model = maxent.train(docs.where("doc_id % 3 <> 1"))
    assert np.abs(model.weights).max() > 0 and np.abs(model.fine).max() > 0
    counts = {r["h"]: r["c"] for r in model.counts.collect()}
    odd = spark.createDataFrame([(-1, None), (-2, "Zebra  a\tA zebra"), (-3, "")], "doc_id long, text string")
    texts = few.unionByName(odd)
    plain = {r["doc_id"]: r["text"] for r in texts.collect()}
    for r in maxent.with_scores(texts, model).collect():
        assert math.isclose(r["score"], slow_score(model, counts, plain[r["doc_id"]]), rel_tol=1e-4), r["doc_id"]
    # Words that are not sent along meet their counts in a join, with the same result.
    everywhere = {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in maxent.with_scores(texts, model).collect()}
    model.heads, model.counts_of_heads = model.heads[: maxent.FREQUENT], model.counts_of_heads[: maxent.FREQUENT]
    for r in maxent.with_scores(texts, model).collect():
        score, base, known = everywhere[r["doc_id"]]
        assert r["n_known"] == known and math.isclose(r["score"], score, rel_tol=1e-9) and math.isclose(r["base_score"], base, rel_tol=1e-9)
