"""Order MinHash against a plain-Python version, and the order of rows with crowded and null keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import orderhash
from ravelin.llm.queries import QUERIES

PLACE = (1 << orderhash.PLACE_BITS) - 1


def slow_fingerprints(spark, texts, k=3, take=2):
    """Hashes come from Spark's xxhash64, all else from dictionaries and sorting."""

    def hashed(rows, kind):
        d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, {kind}")
        return [r["h"] for r in d.select("i", F.xxhash64(*[c for c in d.columns if c != "i"]).alias("h")).orderBy("i").collect()]

    grams = []
    for t in texts:
        w = (t or "").split()
        n = max(len(w) - k + 1, min(len(w), 1))
        grams.append([tuple(w[i : i + k] + [None] * (k - len(w[i : i + k]))) for i in range(n)])
    flat = [g for gs in grams for g in gs]
    first = [h & ~PLACE for h in hashed(flat, ", ".join(f"w{i} string" for i in range(k)))]
    rows, at = [], 0
    for gs in grams:
        seen = {}
        for place in range(len(gs)):
            h = first[at + place]
            rows.append((h, seen.setdefault(h, 0)))
            seen[h] += 1
        at += len(gs)
    second = hashed(rows, "h long, n int")
    out, at, tuples, where = [], 0, [], []
    for d, gs in enumerate(grams):
        cells = {}
        for place in range(len(gs)):
            q = (second[at + place] & ~PLACE) | place
            cells.setdefault((q & (1 << 64) - 1) >> 64 - orderhash.CELL_BITS, []).append(q)
        at += len(gs)
        for c, qs in cells.items():
            chosen = sorted(sorted(qs)[:take], key=lambda q: q & PLACE)
            tuples.append(([q & ~PLACE for q in chosen],))
            where.append((d, c))
        out.append([orderhash.EMPTY] * orderhash.CELLS)
    for (d, c), h in zip(where, hashed(tuples, "a array<long>"), strict=True):
        out[d][c] = f"{h & (1 << 64) - 1:016x}"[: orderhash.DIGITS]
    return ["".join(x) for x in out]


def test_fingerprints_by_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 3000][:60]
    rows += [(-1, "a b a b a b a b c"), (-2, ""), (-3, "one"), (-4, None), (-5, "x " * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in orderhash.with_fingerprint(table).collect()}
    assert [got[i] for i, _ in rows] == slow_fingerprints(spark, [t for _, t in rows])


def test_likeness_by_brute_force(spark, tables):
    size = orderhash.DIGITS
    part = lambda f: [f[i : i + size] for i in range(0, len(f), size)]
    rows = sorted(QUERIES["op9_orderhash"](spark, tables).collect(), key=lambda r: -r["doc_id"])
    for i, r in enumerate(rows):
        for name, other in (("near_edited", r["edited_fingerprint"]), ("near_next", rows[(i + 1) % len(rows)]["fingerprint"])):
            pairs = [(a, b) for a, b in zip(part(r["fingerprint"]), part(other), strict=True) if (a, b) != (orderhash.EMPTY,) * 2]
            assert abs(r[name] - (sum(a == b for a, b in pairs) / len(pairs) if pairs else 1.0)) < 1e-12


@pytest.mark.parametrize("per_range", [4, 7, 1000])
def test_next_of_crowded_keys(spark, per_range):
    rng = np.random.default_rng(3)
    keys = [*rng.integers(0, 60, 150).tolist(), *[7] * 60, *[None] * 50]
    d = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "k long, t string")
    got = orderhash.with_next(d, "k", ["t"], F.xxhash64("t"), {}, per_range).select("k", "t", F.xxhash64("t").alias("h"), "next_t").collect()
    order = sorted(got, key=lambda r: (r["k"] is None, -(r["k"] or 0), r["h"]))
    assert len(got) == len(keys) and [r["next_t"] for r in order] == [r["t"] for r in order[1:] + order[:1]]
    clash = orderhash.with_edits(d.withColumnsRenamed({"k": "doc_id", "t": "text"}).withColumns({c: F.lit(1) for c in ("_range", "_tie", "_last", "body")}))
    assert {"_range", "_tie", "_last", "body"} <= set(clash.columns) and clash.count() == len(keys)
