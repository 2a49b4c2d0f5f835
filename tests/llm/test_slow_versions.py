"""Language ID and quality against plain-Python versions; vector search over many shards."""

import math

import numpy as np
import pytest

from ravelin.llm import ann, language, quality

MASK = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


def slow_language(model, text):
    raw = (text or "").lower().encode()
    margins = np.zeros(len(model.weights))
    count = 0
    for n in model.sizes:
        for i in range(len(raw) - n + 1):
            key = n
            for b in raw[i : i + n]:
                key = key * 257 + b & MASK
            margins += model.weights[:, (key * ODD & MASK) >> 64 - model.slot_bits]
            count += 1
    margins /= max(count, 1)
    loss = [sum(math.log1p(math.exp(-6.0 * m * c)) for m, c in zip(margins, code, strict=True)) for code in model.codes]
    share = 1 / sum(math.exp(min(loss) - x) for x in loss)
    known = any(c.isalpha() for c in text or "")
    return (model.names[loss.index(min(loss))], share) if known else ("und", 0.0)


def test_language_by_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs.where("doc_id % 4 <> 1"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 2500][:80] + [(-1, None), (-2, ""), (-3, "12 .."), (-4, "é"), (-5, "a")]
    for r in language.with_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        name, share = slow_language(model, r["text"])
        assert r["lang_pred"] == name and math.isclose(r["score"], share, rel_tol=1e-4, abs_tol=1e-9) and r["ambiguous"] == (r["score"] < model.ambiguous_below)


def kind(b):
    c = chr(b)
    if b >= 128 or "a" <= c <= "z":
        return 2
    if "A" <= c <= "Z":
        return 3
    if "0" <= c <= "9":
        return 4
    if c == "\n" or b <= 32:
        return 1 if c == "\n" else 0
    return 5 if c in ".,;:'\"()-" else 9 + b % 16


def slow_facts(text):
    raw = (text or "").encode()
    kinds = [kind(b) for b in raw]
    words, at = [], None
    for i, k in enumerate([*kinds, 0]):
        if k > 1 and at is None:
            at = i
        elif k <= 1 and at is not None:
            words.append((at, i))
            at = None
    n, spelt = max(len(words), 1), [raw[a:b] for a, b in words]
    visible = max(sum(k > 1 for k in kinds), 1)
    loud = sum(kinds[b - 1] >= 9 and b >= 2 and kinds[b - 2] >= 9 for _, b in words)
    letters = sum(k in (2, 3) for k in kinds)
    same = sum(x == y for x, y in zip(spelt, spelt[1:]))
    return [len(words), sum(k == 3 for k in kinds) / max(letters, 1), sum(k >= 9 for k in kinds) / visible, loud / n, raw.count(b"|") / n, len(set(spelt)) / n, same / n, visible / n, sum(kinds[b - 1] == 5 for _, b in words) / n], kinds


def slow_score(model, text):
    m, kinds = slow_facts(text)
    pattern = quality.votes(np.array([m]))[0]
    logs = [math.log(p) + sum(math.log(model.labels.table[side, k, v]) for k, v in enumerate(pattern)) for side, p in ((0, 1 - model.labels.prior), (1, model.labels.prior))]
    posterior = 1 / (1 + math.exp(logs[0] - logs[1]))
    runs = [((a * 1024 + b * 32 + c) * ODD & MASK) >> 53 for a, b, c in zip(kinds, kinds[1:], kinds[2:])]
    z = sum(model.weights[r] for r in runs) / max(len(kinds) - 2, 1) + model.bias
    z += model.weights[quality.SLOTS + min(int(math.log2(m[0] + 1)), 7)] + model.weights[quality.SLOTS + 8 + min(int(m[5] * 8), 7)] + model.weights[quality.SLOTS + 16 + min(int(m[6] * 8), 7)]
    return posterior, 1 / (1 + math.exp(-z))


def test_quality_by_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 4000][:120] + [(-1, None), (-2, ""), (-3, "| a | b |\n"), (-4, "!! ?? so so so $$$$"), (-5, "x")]
    for r in quality.with_quality(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        posterior, score = slow_score(model, r["text"])
        assert math.isclose(r["posterior"], posterior, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-6, abs_tol=1e-9)
        assert abs((posterior + score) / 2 - 0.5) < 1e-9 or r["keep"] == int((posterior + score) / 2 >= 0.5)


def test_recall_over_many_shards(spark, tables):
    table = spark.read.parquet(f"{tables}/embeddings.parquet").select("vec_id", "embedding")
    e = table.toPandas().sort_values("vec_id")
    x, ids = np.array(e["embedding"].tolist(), float), e["vec_id"].to_numpy()
    graphs = ann.index(table, shard_rows=20)
    assert graphs.count() >= 20
    got = ann.nearest(table.where("vec_id % 10 = 0"), graphs, block=16, step=5).toPandas()
    hits = []
    for q in ids[ids % 10 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits.append(len(set(got[got["query_id"] == q]["vec_id"]) & set(ids[best])) / 10)
    assert np.mean(hits) >= 0.95
    with pytest.raises(ValueError):
        ann.nearest(table, graphs, k=11)
    wide = ann.nearest(table.limit(3), ann.index(table, k=25), k=25)
    assert wide.count() == 75
