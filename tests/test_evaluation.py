"""Saved indexes, prompts, encoders, extraction and the pieces of evaluation that SQL does not show."""

import pytest
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import analytics, chunking, fusion, sparse, web
from ravelin.plans import presets
from ravelin.sources import files


def one(spark, expr, x):
    return spark.createDataFrame([(x,)], "x string").select(expr.alias("y")).first()["y"]


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ﬁre-side cat", "Cats", "en"), (2, "dog dog cat", "Dogs", "en"), (3, None, None, "fr")], "i long, t string, h string, l string")
    index = sparse.build(docs, "i", "t", "h", "l")
    index.save(f"{tmp_path}/index")
    again = sparse.load(spark, f"{tmp_path}/index")
    asked = spark.createDataFrame([(7, "fire cat"), (8, "dogs")], "query_id long, question string")
    rows = lambda x: sorted(map(tuple, sparse.search(x, asked, 5).collect()))
    assert rows(index) == rows(again) and [r[1] for r in rows(again) if r[0] == 7][:1] and (again.n, again.avg_len) == (index.n, index.avg_len)
    assert [r["term"] for r in index.postings.where("chunk_id = 1 and term like 'fi%'").orderBy("term").collect()] == ["fire", "fire-side"]


def test_nfkc_reaches_only_other_texts(spark):
    assert one(spark, T.nfkc(F.col("x")), "ﬁne ² abc") == "fine 2 abc" and one(spark, T.nfkc(F.col("x")), "plain") == "plain" and one(spark, T.nfkc(F.col("x")), None) is None


def test_signals(spark):
    s = one(spark, T.query_signals(F.col("x")), "Who played in Sept. 1999 and May 2001?")
    assert (s["years"], s["months"], s["is_temporal"]) == (["1999", "2001"], ["may", "september"], True)
    assert not one(spark, T.query_signals(F.col("x")), "Who is the mayor")["is_temporal"] and not one(spark, T.query_signals(F.col("x")), None)["is_temporal"]
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    late = "x " * 700 + "1999 concert"
    assert one(spark, T.chunk_signals(none, none, F.col("x"), empty, empty, F.lit(None).cast("boolean")), late)["years"] == []


def test_sentences():
    text = 'Dr. Who met Mr. Fox, e.g. There. He left! "Why?" (She asked.) Then no. 5 stayed vs. Them.'
    assert chunking.sentences(text) == ["Dr. Who met Mr. Fox, e.g. There.", "He left!", '"Why?" (She asked.) Then no.', "5 stayed vs. Them."]
    assert chunking.sentences("  ") == []


def test_cleaning_order(spark):
    assert one(spark, T.clean(F.col("x")), "a[1, 2] b[3] c [note 4] d[Citation needed] e") == "a b c d e"


def test_extraction(spark):
    long, wiki = "word " * 60, "<body><p>" + "fact " * 60 + "</p>\n\n<p>x</p></body>"
    pages = spark.createDataFrame([("http://a.org/1", "a.org", f"<title>T</title><body><p>{long}</p></body>"), ("http://a.org/2", "a.org", "<p>short</p>"), ("http://en.wikipedia.org/w", "en.wikipedia.org", wiki), ("u", "d", None)], "url string, domain string, html string")
    good, bad = web.extract_documents(pages)
    assert {r["url"]: r["title"] for r in good.collect()} == {"http://a.org/1": "T", "http://en.wikipedia.org/w": ""} and bad.count() == 0
    links = spark.createDataFrame([(1, "<A HREF='x'>a</A> <a class=\"c\" href = \"y\">b</a> <a href=\" \">c</a> <abbr href=\"z\">")], "p long, html string")
    assert sorted(r["href"] for r in web.links(links, "p", "html").collect()) == ["x", "y"]


def test_presets(spark):
    questions = spark.createDataFrame([(1, "cat"), (2, " "), (None, "dog")], "query_id long, question string")
    assert presets.usable(questions).count() == 1 and len(presets.PRESETS) == 8
    assert presets.retrieve(presets.PRESETS["closed_book"], questions, None, None, None).count() == 0
    with pytest.raises(ValueError):
        presets.retrieve(presets.Preset(mode="other"), questions, None, None, None)
    encode = presets.encoder(lambda: lambda texts: [[len(t), 0.0] for t in texts], "Find it")
    assert [list(r["v"]) for r in questions.where("query_id = 1").select(encode(F.col("question")).alias("v")).collect()] == [[1.0, 0.0]]
    score = fusion.logit_scorer(lambda: lambda prompts: [float(len(p)) for p in prompts], batch=2)
    assert all(r["s"] > 50 for r in questions.where("question is not null").select(score(F.col("question"), F.lit("body")).alias("s")).collect())


def test_budget_by_characters(spark):
    rows = spark.createDataFrame([(1, 1, 10, "aa bb cc"), (1, 2, 11, "dddd eeee ffff gggg"), (1, 3, 12, "hh")], "query_id long, rank int, chunk_id long, text string")
    got = {r["chunk_id"]: r["text"] for r in fusion.budget(rows, 5, T.word_count, least_chars=3).collect()}
    assert got == {10: "aa bb cc", 11: "dddd eeee "}


def test_sources(spark, tmp_path):
    path = f"{tmp_path}/crawl.yaml"
    files.write_config(path, [files.domain_entry("a.org", ["http://a.org"], deny_patterns=["x"]), files.domain_entry("b.org", [])], ["y"])
    assert [(d["domain"], d["deny_patterns"], d["max_pages"]) for d in files.read_config(path, ["a.org"])] == [("a.org", ["y", "x"], 500)]
    assert files.read_manifest(spark, f"{tmp_path}/none.jsonl").count() == 0
    pdf = spark.createDataFrame([("d", 1, "two "), ("d", 0, "one"), ("d", 2, " "), ("d", 3, "late")], "k string, page int, text string")
    assert files.join_pdf_pages(pdf, "k", max_pages=3).first()["text"] == "one\n\ntwo"
    rows, seen = files.observed(spark.range(10), "job", even=F.col("id") % 2 == 0)
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"scanned": 10, "even": 5}
    assert files.report("R", {"S": spark.createDataFrame([(1, 0.5)], "a int, b double")}) == "# R\n\n## S\n\n| a | b |\n| --- | --- |\n| 1 | 0.5000 |\n"
    assert one(spark, T.utc_now(), "x").endswith("+00:00") and one(spark, T.number(F.col("x")), "1.5") == 1.5 and one(spark, T.number(F.col("x")), "x") == 0.0
    assert one(spark, T.method_label(F.col("x"), F.lit("exp8")), "hybrid_rrf") == "Hybrid (RRF, MiniLM)" and one(spark, T.method_label(F.col("x")), "other") == "other" and one(spark, T.four_decimals(F.lit(0.5)), "x") == "0.5000"


def test_shown(spark):
    row = spark.createDataFrame([(["a", "b", "c", "d"], ["x", "y"])], "t array<string>, s array<string>").select(analytics.shown(F.col("t"), F.col("s")).alias("p")).first()["p"]
    assert [tuple(r) for r in row] == [("a", "x"), ("b", "y")]


def test_allocation_with_many_strata(spark):
    strata = spark.createDataFrame([(f"s{i:03}", 1 if i else 5000) for i in range(100)], "stratum string, n long")
    got = {r["stratum"]: r["take"] for r in analytics.allocation(strata, 150).collect()}
    assert sum(got.values()) == 150 and min(got.values()) == 1 and got["s000"] == 51


def test_dense_search_by_brute_force(spark):
    import numpy as np

    from ravelin.operators import dense

    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 4)), 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (903, [1.0, 2.0]), (904, [])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 30)] + [(901, [1.0, None, 0.0, 0.0]), (903, [1.0, 2.0])], "query_id long, embedding array<double>")
    got = {}
    for r in dense.search(asked, vectors, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    for i in range(0, 300, 30):
        s = np.round(x @ x[i], 6)
        assert got[i] == [(int(j), float(s[j])) for j in np.lexsort((-np.arange(300), -s))[:5]]
    assert set(got) == {*range(0, 300, 30), 903} and got[903] == [(903, 5.0)]
    assert dense.search(asked.limit(0), vectors, 5).count() == dense.search(asked, vectors.limit(0), 5).count() == 0
