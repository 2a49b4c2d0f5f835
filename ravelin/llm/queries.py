"""The registered queries of the training-data operators, thin over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import ann, bpe, language, licences, maxent, mixing, orderhash, quality, simhash, toxicity
from ravelin.llm.common import fold, table

#: The tokenizer file of op5 and the pipeline.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.with_components(docs, keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    model = language.train(docs.where(~held_out))
    return language.with_language(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return docs.select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.with_quality(docs, quality.train(docs)).select("doc_id", "posterior", "score", "keep")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    return docs.select("doc_id", *bpe.digests("token_ids", "decoded"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "template", "containment", "first_word", "matches")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = fold("doc_id", 5) == 0
    model = toxicity.train(docs.where(~held_out), labels.where(~held_out), settings=toxicity.BY_WORD)
    return toxicity.with_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors.where("vec_id % 100 = 0"), ann.index(vectors))


def op9_orderhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = orderhash.with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    edited = F.sha2("edited", 256).alias("edited_sha256")
    return docs.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 7) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = maxent.train(docs.where(~F.col("held_out")))
    return maxent.with_scores(docs, model, keep=["doc_id", "held_out"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_simhash": op1_simhash, "op2_language": op2_language, "op3_mixing": op3_mixing, "op4_quality": op4_quality, "op5_bpe": op5_bpe, "op6_licences": op6_licences, "op7_toxicity": op7_toxicity, "op8_hnsw": op8_hnsw, "op9_orderhash": op9_orderhash, "op10_maxent": op10_maxent}
ORACLES: dict[str, str] = {}
