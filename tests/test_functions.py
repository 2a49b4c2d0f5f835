from pyspark.sql import functions as F

from ravelin.functions import questions as Q
from ravelin.functions import text as T
from ravelin.operators import analytics, chunking, fusion, web
from ravelin.plans.presets import answer, clean_answer, format_context


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_tokens(spark):
    x = F.col("x")
    assert one(spark, T.tokens(x), "Étion It's well-known 3/4 A’b") == ["tion", "it's", "it", "s", "well-known", "well", "known", "3/4", "3", "4", "a'b", "a", "b"]
    assert one(spark, T.tokens(x)) == []


def test_clean(spark):
    raw = "Jump to search\nA  fact [12] here [3, 4] and\tmore https://x.org/a b\n\n\n\nReferences\nold\n\nlast"
    got = one(spark, T.clean(F.col("x"), drop_urls=True, stop_sections=True), raw)
    assert got == "A fact here and more [link] b"


def test_temporal(spark):
    x = F.col("x")
    assert one(spark, T.months(x), "Sept 3 and May 2, 2021; market") == ["may", "september"]
    assert one(spark, T.years(x), "2021, 1999, 2021, 12021") == ["1999", "2021"]


def test_question_types(spark):
    for q, kind in [("When is it?", "event_date"), ("How many cats", "numeric"), ("Name the cats", "list"), ("Where is it", "entity_location"), ("Who is it", "entity_location"), ("Tell me", "description"), ("", "description")]:
        assert one(spark, Q.question_type(F.col("x")), q) == kind


def test_chunker():
    s = chunking.ChunkSettings()
    assert chunking.chunk_text(None, s) == [] and chunking.chunk_text(" \n", s) == []
    assert chunking.chunk_text(" few words. ", s) == [(None, "few words.", 0, 10)]
    para = " ".join(f"word{i} is here." for i in range(60))
    doc = f"OVERVIEW SECTION\n{para}\n\nDetails of it all:\n- one thing\n- another\n\n- third\n{para}"
    got = chunking.chunk_text(doc, s)
    assert [c[0] for c in got][0] == "OVERVIEW SECTION" and "Details of it all:" in [c[0] for c in got]
    assert all(c[3] - c[2] == len(c[1]) for c in got)
    assert got[1][1].startswith(" ".join(para.split()[-30:]))
    long = " ".join(f"w{i}" for i in range(400))
    assert [len(p.split()) for p in chunking.pieces(long, s)] == [160, 160, 140]
    low = chunking.ChunkSettings(max_words=20)
    assert all(len(p.split()) <= 160 for p in chunking.pieces(long, low))


def test_html():
    page = """<html><head><title> A page </title><script>x</script></head><body><nav>menu</nav><div class="ad big">buy</div>
    <article><h1>Head</h1><p>One <b>two<br>three <a href="http://www.q.org/z">http://q.org</a> <a href="/y">shown</a> see https://r.org/1 end</article><p>out</body></html>"""
    title, text = web.readable(page)
    assert title == "A page"
    assert text.split("\n") == ["Head", "One", "two", "three", "q.org", "shown", "see [link] end"]
    assert web.readable(None) == ("", "")


def test_urls(spark):
    rules = web.CrawlSettings("x.org", deny_patterns=["/private"])
    urls = {"http://x.org/a": True, "https://www.x.org/": True, "ftp://x.org/": False, "http://y.org/": False, "http://x.org/Private": False, None: False}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", web.allowed(F.col("u"), rules).alias("ok")).collect()
    assert {r["u"]: r["ok"] for r in rows} == urls
    assert spark.createDataFrame([("http://x.org/a/b", "../c#d")], "b string, h string").select(web.absolute(F.col("b"), F.col("h")).alias("y")).first()["y"] == "http://x.org/c"


def test_mmr_and_context(spark):
    rel = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.9), (1, 3, 0.5)], "query_id long, chunk_id long, rel double")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    assert [r["chunk_id"] for r in fusion.mmr(rel, vec, 3, 0.5).orderBy("rank").collect()] == [1, 3, 2]
    ret = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate([4, 5, 6])], "query_id long, chunk_id long, rank int")
    sel = spark.createDataFrame([(1, 5, 1)], "query_id long, chunk_id long, rank int")
    docs = spark.createDataFrame([(4, "a"), (5, "a"), (6, "")], "chunk_id long, doc_id string")
    assert [r["chunk_id"] for r in fusion.context(sel, ret, docs, 5).orderBy("rank").collect()] == [5, 6]


def test_answers(spark):
    cleaned = lambda t: one(spark, clean_answer(F.col("x")), t)
    assert cleaned("Answer: Paris\n- paris\n2. 'Rome'\nAnswers") == "Paris; Rome; Answers"
    assert cleaned("Answers:\nA: one\n\n3)two") == "one; two" and cleaned("Answer") == "Answer" and cleaned("-Paris") == "Paris"
    assert cleaned("A: x") == "x" and cleaned("Final:final: y") == "y" and cleaned(' "quoted" ') == "quoted" and cleaned("  \n ") == "" and cleaned(None) == ""
    rows = spark.createDataFrame([(1, "where is the cat", 1, "A dog ran. The cat is here."), (2, "zzz", 1, "none")], "query_id long, question string, rank int, text string")
    assert {r["query_id"]: r["answer"] for r in answer(rows).collect()} == {1: "The cat is here.", 2: "I don't know"}
    assert one(spark, format_context(F.lit(1), F.lit("T"), F.lit(None).cast("string"), F.lit("u"), F.col("x")), "b") == "[1] Title: T | URL: u\nb"


def test_allocation(spark):
    s = spark.createDataFrame([("a", 98), ("b", 1), ("c", 1)], "stratum string, n long")
    assert {r["stratum"]: r["take"] for r in analytics.allocation(s, 10).collect()} == {"a": 8, "b": 1, "c": 1}
    assert sum(r["take"] for r in analytics.allocation(s, 2).collect()) == 2
    assert {r["stratum"]: r["take"] for r in analytics.allocation(s, 100).collect()} == {"a": 98, "b": 1, "c": 1}
    rows = spark.range(100).selectExpr("id", "'a' AS s")
    takes = spark.createDataFrame([("a", 7)], "stratum string, take long")
    assert analytics.sample(rows, takes, "s", "id").count() == 7
