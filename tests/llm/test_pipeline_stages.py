"""The pipeline's stages against brute force, over planted near copies."""

import numpy as np

import corpus_pipeline


def near_copies_left(rows, shingle=5, least=0.8):
    """ids that stay: the least of each connected group, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(shingle, len(w))
        sets.append({b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or common >= least * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best[find(i)] = min(doc_id, best.get(find(i), doc_id))
    return set(best.values())


def planted():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    rows = []
    for _ in range(25):
        base = text(int(rng.integers(40, 400)))
        rows.append(" ".join(base))
        for share in (0.005, 0.01, 0.015, 0.02, 0.03, 0.05):
            w = [str(rng.choice(vocabulary)) if x < share else a for a, x in zip(base, rng.random(len(base)), strict=True)]
            rows.append(" ".join(w))
    base = text(300)
    for _ in range(120):  # a crowded group, many of whose members are only joined through others
        w = list(base)
        for p in rng.choice(300, int(rng.integers(1, 12)), replace=False):
            w[p] = str(rng.choice(vocabulary))
        rows.append(" ".join(w))
    rows += [rows[0].upper(), " ".join(text(3)), "one two", "One  two"]
    return [(int(i), rows[k]) for k, i in enumerate(rng.permutation(len(rows)))]


def test_near_dedup_by_brute_force(spark, tables):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, tables).collect())
    want = near_copies_left(rows)
    assert got == sorted(want) and len(want) < len(rows) / 2


def test_near_dedup_of_the_tables_by_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, tables).collect())
    assert got == sorted(near_copies_left([(r["doc_id"], r["text"]) for r in docs.collect()]))
