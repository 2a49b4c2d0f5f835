"""Columns of the input named like what operators use or add, repeated ids, null texts, ties: for each operator and each stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ravelin.llm import mixing, nearcopies, simhash

NAMES = ["_s", "_r", "_source", "_key", "__least", "least", "root", "group", "s", "k", "h", "n", "f", "size", "target", "taken", "source_size", "_times", "token_ids", "decoded", "score", "rank", "p", "q"]


def widened(docs):
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES})


def untouched(rows, made=()):
    return all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in NAMES if c not in made)


@pytest.fixture(scope="module")
def docs(spark):
    body = "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn "
    texts = [(1, body * 3), (2, "a b c d e f g"), (2, "a b c d e f g"), (5, "a b c d e f g"), (5, "another text with other words in it altogether"), (3, None), (4, ""), (6, body * 3 + "more"), (7, "x")]
    return widened(spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long"))


def test_operators_keep_clashing_columns(docs):
    rows = mixing.mix(docs)[0].collect()
    assert untouched(rows, ["size", "target", "taken", "source_size"]) and len(rows) == 9
    rows = mixing.mix(docs, names={"size": "own_size", "target": "aim", "taken": "got", "source_size": "total"})[0].collect()
    assert untouched(rows) and sum(r["got"] for r in rows) > 0
    assert untouched(simhash.with_components(docs).collect())
    assert untouched(nearcopies.with_groups(docs).collect(), ["group"])


def test_ties_of_the_mix(spark):
    same = spark.createDataFrame([(1, "a b c", "s")] * 40 + [(None, "d e", "s")] * 40 + [(None, None, None)] * 5, "doc_id long, text string, source string")
    one, two = (sorted((r["doc_id"] or 0, r["taken"]) for r in mixing.mix(d)[0].collect()) for d in (same, same.repartition(3)))
    assert one == two and sum(t for _, t in one) == 200


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[2:])
def test_stages_keep_clashing_columns(spark, docs, tables, name, stage):
    out = stage(spark, docs, tables)
    made = ["token_ids"] if name == "bpe_tokens" else []
    assert [c for c in out.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")].count("token_ids") == 1
    assert set(docs.columns) <= set(out.columns) and untouched(out.collect(), made)


def test_near_copies_are_decided_by_row(spark, docs, tables):
    """Of equal texts one row stays, even if another row with the same id stays for its own text."""
    got = sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, docs, tables).collect())
    assert [i for i, _ in got] == [1, 2, 3, 5, 7] and [t for i, t in got if i == 5] == ["another text with other words in it altogether"]
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.drop_near_copies(spark, nameless, tables).count() == 5


def test_mixing_stage_by_brute_force(spark, docs, tables):
    mixed = {(r["doc_id"], r["text"]): r["taken"] / r["size"] for r in mixing.mix(docs)[0].where("size > 0").collect()}
    got = corpus_pipeline.mix_sources(spark, docs, tables).groupBy("doc_id", "text").count().collect()
    for r in got:
        own = mixing.mix(docs)[0].where((F.col("doc_id") == r["doc_id"]) & (F.col("text") == r["text"])).collect()
        assert r["count"] == sum(int(o["taken"] / o["size"] + 0.5) for o in own)
    assert all(t >= 0 for t in mixed.values())


def test_filtering_stages_by_brute_force(spark, tables):
    """What language ID and toxicity keep is what their operators' own columns say, document by document."""
    from ravelin.llm import language, toxicity

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, None, "s", 0), (-2, "1 2 3", None, "s", 5), (-3, "", "en", "s", 0)], docs.schema))
    said = language.with_language(docs, language.train(docs)).collect()
    want = sorted(r["doc_id"] for r in said if r["lang_pred"] != "und" and r["score"] >= 0.6)
    assert want == sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, tables).collect()) and not {-1, -2, -3} & set(want)
    model = toxicity.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    want = sorted(r["doc_id"] for r in toxicity.with_toxicity(docs, model).collect() if r["score"] < 0.5)
    assert want == sorted(r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, tables).collect())
