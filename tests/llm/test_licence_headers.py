"""Short notices beside long ones are found wherever they stand among the windows."""

import re

import numpy as np
import pytest

from ravelin.llm import licences


@pytest.mark.parametrize("long", ["BSD/text", "Apache-2.0/header"])
def test_reserved_before_a_long_notice(spark, long):
    header = "Copyright 2020 Foo Inc. All rights reserved. " + licences.TEMPLATES[long]
    docs = spark.createDataFrame([(i, "filler " * i + header) for i in range(licences.STEP)], "doc_id long, text string")
    got = {(r["doc_id"], r["template"]): r["first_word"] for r in licences.scan(docs).collect()}
    assert all(got.get((i, "Proprietary/reserved")) == i + 4 for i in range(licences.STEP))
    assert all((i, long) in got for i in range(licences.STEP))


def slow_scan(text, least=0.8):
    """template: (containment, first_word, matches), by trying every stretch of the text."""
    words = re.findall("[a-z0-9]+", (text or "").lower())
    out = {}
    for name, template in licences.TEMPLATES.items():
        t = re.findall("[a-z0-9]+", template.lower())
        k = min(licences.SHINGLE, len(t))
        want = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        n = len(want)
        runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        share = {i: len(want & set(runs[i : i + n + n // 4 + licences.SHINGLE + 1])) / n for i, r in enumerate(runs) if r in want}
        good = sorted(i for i, s in share.items() if s >= least)
        if good:
            matches, end = 0, -1
            for i in good:
                if i >= end:
                    matches, end = matches + 1, i + n
            out[name] = (max(share.values()), good[0], matches)
    return out


def test_by_brute_force(spark, tables):
    rng = np.random.default_rng(4)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    mit = licences.TEMPLATES["MIT/text"]
    rows += [(-1, f"{mit} {mit}\n{mit}"), (-2, None), (-3, "")]
    for i in range(200):  # notices of all templates, some words changed, at all offsets
        words = licences.TEMPLATES[sorted(licences.TEMPLATES)[i % len(licences.TEMPLATES)]].split()
        words = ["zzz" if rng.random() < 0.02 * (i % 3) else w for w in words]
        rows.append((-10 - i, " ".join(["filler"] * int(rng.integers(0, 90)) + words + ["more"] * int(rng.integers(0, 90)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["template"]): (r["containment"], r["first_word"], r["matches"]) for r in licences.scan(docs).collect()}
    want = {(i, name): found for i, text in rows for name, found in slow_scan(text).items()}
    assert got == want and got[-1, "MIT/text"][2] == 3


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License", 7, 8, 9, 10)], "doc_id long, text string, h long, place long, r long, n long")
    r = licences.scan(docs).first()
    assert (r["h"], r["place"], r["r"], r["n"], r["template"], r["matches"]) == (7, 8, 9, 10, "MIT/short", 1)
