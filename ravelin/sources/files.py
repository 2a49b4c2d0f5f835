"""Readers and writers of the record files around a retrieval corpus."""

from __future__ import annotations

import json
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_SCHEMA = """chunk_id string, doc_id string, domain string, source_url string, final_url string, title string, section_heading string,
 text string, char_start int, char_end int, content_type string, source string, retrieved_at string, years array<string>, months array<string>, has_event_terms boolean"""
MANIFEST_SCHEMA = "url string, retrieved_at string, status int, content_type string, saved_path string, skipped boolean, error string"


def work_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share; where unset (tests, a laptop), one in the warehouse."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (place or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a table of their own in the shared folder, which goes when the driver ends, and read again."""
    spark, path = df.sparkSession, f"{work_folder(df.sparkSession)}/{name}_{uuid4().hex[:12]}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A record per line; a malformed line fails the read, or is skipped where not strict."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document: an array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(qid, answer) of a JSON object; keys that are not digits are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("qid", "answer")).where(F.col("qid").rlike("^[0-9]+$"))


def write_answers(df: DataFrame, path: str) -> None:
    """The answers as one JSON object: questions are few, one line each in the corpus of questions."""
    df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("qid", "answer"))))).alias("value")).write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns, missing ones empty."""
    out = df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    out.na.fill("").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question) of a text file: non-empty stripped lines, numbered from 1 in file order; an empty file is an error."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    lines = lines.select("n", F.trim(F.regexp_replace("value", "^﻿", "")).alias("question")).where("question <> ''")
    if lines.isEmpty():
        raise ValueError(f"no questions in {path}")
    return lines.select(F.row_number().over(W.orderBy("n")).cast("string").alias("id"), "question")


def read_pages(spark: SparkSession, path: str, patterns: str = "*.{html,htm,pdf,HTML,HTM,PDF}") -> DataFrame:
    """(path, domain, content_type, content) of raw files; the domain is the folder a file is in."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", patterns).option("recursiveFileLookup", "true").load(path)
    kind = F.when(F.lower("path").endswith(".pdf"), "application/pdf").otherwise("text/html")
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("domain"), kind.alias("content_type"), "content")


def join_pdf_pages(pages: DataFrame, key: str, page: str = "page", text: str = "text", max_pages: int | None = None) -> DataFrame:
    """The text of documents whose pages another tool has read: the first `max_pages`, in order, blank ones left out, a blank line between."""
    rows = pages.where(F.col(page) < max_pages) if max_pages is not None else pages
    kept = rows.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.trim(F.col(text)).alias("t"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias(text))


def observed(df: DataFrame, name: str, **counts):
    """The rows, and an Observation whose `get` tells, once they have been written, how many there were and how many met each condition."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("scanned"), *[F.count_if(c).alias(n) for n, c in counts.items()]), seen


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest records with their place in the file, for the last of a path to count; malformed lines are skipped, a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA + ", line long")
    return read_jsonl(spark, path, MANIFEST_SCHEMA, strict=False).where("saved_path is not null").withColumn("line", F.monotonically_increasing_id())


def read_config(path: str, domains: list[str] | None = None) -> list[dict]:
    """Domain entries of a crawl configuration, or some of them, the global deny patterns merged into each."""
    import yaml

    spec = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    deny = spec.get("global_deny_patterns") or []
    entries = [d for d in spec.get("domains") or [] if not domains or d.get("domain") in domains]
    return [d | {"deny_patterns": list(dict.fromkeys([*deny, *(d.get("deny_patterns") or [])]))} for d in entries]


def domain_entry(domain: str, seeds: list[str], max_pages: int = 500, max_depth: int = 2, delay_s: float = 1.0, **more) -> dict:
    """One domain of a crawl configuration, with the settings' usual values."""
    usual = {"out_subdir": domain.replace(".", "_"), "allowed_schemes": ["http", "https"], "same_domain_only": True, "strip_query": False, "keep_query_params": [], "allow_patterns": [], "deny_patterns": []}
    return {"domain": domain, "seeds": list(seeds), "max_pages": max_pages, "max_depth": max_depth, "delay_s": delay_s} | usual | more


def write_config(path: str, domains: list[dict], global_deny: list[str], user_agent: str = "ravelin", out_dir: str = "raw", manifest: str = "raw/manifest.jsonl") -> None:
    """A crawl configuration that `read_config` reads."""
    import yaml

    spec = {"version": 1, "user_agent": user_agent, "out_dir": out_dir, "manifest_path": manifest, "global_deny_patterns": list(global_deny), "domains": domains}
    Path(path).write_text(yaml.safe_dump(spec, sort_keys=False, allow_unicode=True), encoding="utf-8")


def last_per_key(df: DataFrame, key: str) -> DataFrame:
    """The last record of each key in file order; blank keys are left out."""
    n = df.withColumn("_line", F.monotonically_increasing_id()).where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "")
    whole = F.struct(*df.columns)
    return n.groupBy(key).agg(F.max_by(whole, "_line").alias("r")).select("r.*")


def save_index(spark: SparkSession, path: str, chunks: DataFrame, meta: dict) -> None:
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").write.mode("overwrite").json(f"{path}/meta")


def load_index(spark: SparkSession, path: str, expect: dict | None = None) -> tuple[DataFrame, dict]:
    """The stored rows and what was stored about them; raises where `expect` says otherwise, such as for another model."""
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])
    for k, v in (expect or {}).items():
        if meta.get(k) != v:
            raise ValueError(f"index has {k}={meta.get(k)!r}, not {v!r}")
    return spark.read.parquet(f"{path}/chunks"), meta


def markdown_table(df: DataFrame, columns: list[str], limit: int = 1000) -> str:
    """A report table of a small result."""
    rows = df.select(*columns).limit(limit).collect()
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])


def report(title: str, sections: dict[str, DataFrame]) -> str:
    """A Markdown report: each section a table of a small result."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df, df.columns)}" for name, df in sections.items())]) + "\n"
