"""A corpus pipeline of five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of `documents`; the last adds the tokens. `run`
writes what a stage returns as Parquet in the shared folder and reads it again for the next. All stages take null and repeated
rows and empty tables as their operators define: language ID drops texts without a letter, near-dedup keeps one row of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import bpe, language, mixing, nearcopies, toxicity
from ravelin.llm.common import durable, fresh, table
from ravelin.llm.queries import TOKENIZER


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is ambiguous; learns from the documents with a `lang`."""
    pred, score, unsure = fresh("pred"), fresh("score"), fresh("unsure")
    out = language.with_language(docs, language.train(docs), pred=pred, score=score, ambiguous=unsure)
    return out.where((F.col(pred) != language.UNDETERMINED) & ~F.col(unsure)).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the compression distance predicts to be toxic; learns from the labelled ones among those here."""
    score, toxic = fresh("score"), fresh("toxic")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), settings=toxicity.BY_WORD)
    return toxicity.with_toxicity(docs, model, score=score, predicted=toxic).where(F.col(toxic) == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more) one document, that with the smallest id.

    Of several with that id, the one with the smallest hash of its text; of equal rows of it, one. Ids count as larger if null. What
    stays is decided on ids and hashes; texts move once, to meet the decision.
    """
    root, n, m = fresh("root"), fresh("times"), fresh("m")
    row = [fresh("row"), fresh("row")]  # 128 bits that name an id and its text
    marked = docs.withColumns({r: F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(seed)) for r, seed in zip(row, (1, 2), strict=True)})
    rows = nearcopies.with_roots(marked, "text", root, shingle=5, least=0.8, keep=["doc_id", *row])
    distinct = rows.groupBy(root, *row).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias(n))
    best = distinct.groupBy(root).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *row, n)).alias(m))
    kept = durable(best.select(*[F.col(f"{m}.{c}").alias(c) for c in (*row, n)]))
    found = marked.join(kept, row)
    return found.where(F.col(n) == 1).unionByName(found.where(F.col(n) > 1).dropDuplicates(row)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings the sources to their target weights: each document as often as the mix takes it, rounded to whole documents."""
    names = {c: fresh(c) for c in ("_row", "size", "source_size", "target", "taken")}
    size, taken, times = names["size"], names["taken"], fresh("times")
    mixed, _ = mixing.mix(docs, names=names)
    mixed = mixed.where(F.col(size) > 0).withColumn(times, F.round(F.col(taken) / F.col(size)).cast("int")).where(F.col(times) > 0)
    return mixed.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids, and n_tokens, ids_sha256 and decoded_sha256, which show the round trip; columns of these names are replaced."""
    ids, decoded = fresh("ids"), fresh("decoded")
    made = ["token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    out = bpe.with_tokens(docs, TOKENIZER, tokens=ids, decoded=decoded)
    return out.select(*[c for c in docs.columns if c not in made], F.col(ids).alias("token_ids"), *bpe.digests(ids, decoded))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bpe_tokens", tokenize),
]

#: None: trained models, hashes and a learned tokenizer are beyond SQL; tests/llm hold the stages against brute force or their operators' own columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = before = durable(stage(spark, docs, sf_dir), instead_of=before)
    return STAGES[-1][1](spark, docs, sf_dir)
