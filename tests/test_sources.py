import pytest

from ravelin.sources import files as S
from ravelin.streaming import ingest


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "a, b"\nc'), ("2", "x")], "qid string, answer string")
    S.write_jsonl(df, f"{tmp_path}/j")
    S.write_jsonl(df, f"{tmp_path}/j", append=True)
    assert S.read_jsonl(spark, f"{tmp_path}/j", "qid string, answer string").count() == 4
    S.write_csv(df, f"{tmp_path}/c", ["qid", "answer", "none"])
    assert sorted(r["answer"] for r in S.read_csv(spark, f"{tmp_path}/c").collect()) == ['say "a, b"\nc', "x"]
    S.write_answers(df.union(spark.createDataFrame([("zz", "no")], df.schema)), f"{tmp_path}/a")
    assert S.read_answers(spark, f"{tmp_path}/a").count() == 2


def test_questions_and_index(spark, tmp_path):
    (tmp_path / "q.txt").write_text("﻿one\n\n two \n", encoding="utf-8")
    assert [tuple(r) for r in S.read_questions(spark, f"{tmp_path}/q.txt").collect()] == [("1", "one"), ("2", "two")]
    (tmp_path / "e.txt").write_text("\n")
    with pytest.raises(ValueError):
        S.read_questions(spark, f"{tmp_path}/e.txt")
    S.save_index(spark, f"{tmp_path}/i", spark.range(3), {"model": "m"})
    assert S.load_index(spark, f"{tmp_path}/i", {"model": "m"})[0].count() == 3
    with pytest.raises(ValueError):
        S.load_index(spark, f"{tmp_path}/i", {"model": "n"})


def test_last_and_config(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("", 3)], "k string, v int").coalesce(1)
    assert [tuple(r) for r in S.last_per_key(df, "k").collect()] == [("a", 2)]
    (tmp_path / "c.yaml").write_text("global_deny_patterns: [x]\ndomains:\n- {domain: d.org, deny_patterns: [y]}\n")
    assert S.read_config(f"{tmp_path}/c.yaml")[0]["deny_patterns"] == ["x", "y"]
    (tmp_path / "p/h").mkdir(parents=True)
    (tmp_path / "p/h/1.HTML").write_text("<p>x")
    assert S.read_pages(spark, f"{tmp_path}/p").first()["domain"] == "h"
    assert S.markdown_table(df.where("v = 1"), ["k", "v"]).endswith("| a | 1 |")


def test_stream(spark, tables, tmp_path):
    schema = spark.read.parquet(f"{tables}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{tables}/events.parquet").union(spark.read.parquet(f"{tables}/events.parquet").limit(50)).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in")
    once = ingest.distinct(ingest.read(spark, f"{tmp_path}/in", schema), "event_id", "ts")
    ingest.append(once, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == spark.read.parquet(f"{tables}/events.parquet").count()
