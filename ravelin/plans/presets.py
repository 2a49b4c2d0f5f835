"""Retrieval presets and the life of a question: retrieve, judge depth, rerank, assemble context, answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.text import chunk_signals, query_signals, strip, temporal_score, text, tokens
from ravelin.operators import dense, fusion, sparse

IDK = "I don't know"


@dataclass(frozen=True)
class Preset:
    mode: str = "hybrid"
    fusion: str = "rrf"
    w_dense: float = 0.5
    w_sparse: float = 0.5
    k_context: int = 20
    use_mmr: bool = True
    adaptive: bool = True
    pool: int = 200
    k: int = 100
    stage1_k: int = 60
    temporal: bool = False
    encoder: str = "main"


PRESETS = {
    "closed_book": Preset("closed_book", k_context=0, adaptive=False),
    "dense": Preset("dense", w_dense=1.0, w_sparse=0.0),
    "sparse": Preset("sparse", w_dense=0.0, w_sparse=1.0, use_mmr=False),
    "hybrid_rrf": Preset(),
    "hybrid_minmax": Preset(fusion="minmax"),
    "hybrid_rrf_no_mmr": Preset(use_mmr=False),
    "hybrid_rrf_temporal": Preset(temporal=True),
    "hybrid_rrf_second_encoder": Preset(encoder="second"),
}
#: The methods that an evaluation compares, in the order that reports list them.
METHODS = ("sparse", "dense", "hybrid_rrf", "hybrid_minmax")


def usable(queries: DataFrame) -> DataFrame:
    """The questions that have an id and a text."""
    filled = lambda c: strip(text(F.col(c).cast("string"))) != ""
    return queries.where(filled("query_id") & filled("question"))


def grid(methods: dict[str, Preset], queries: DataFrame, index: sparse.SparseIndex | None, query_vectors: DataFrame | None, vectors: DataFrame | None) -> DataFrame:
    """Every question by every method: method and what `retrieve` gives."""
    parts = [retrieve(p, queries, index, query_vectors, vectors).withColumn("method", F.lit(name)) for name, p in methods.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def encoder(load: Callable[[], Callable[[list[str]], list[list[float]]]], instruction: str | None = None) -> Callable[[Column], Column]:
    """An encoding of texts as unit vectors: `load` is called once a worker and gives a function of texts to vectors.

    Questions are encoded behind `instruction`, chunks with none.
    """

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for p in parts:
            x = np.array(model(p.tolist()), np.float32).reshape(len(p), -1)
            yield pd.Series(list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)))

    return lambda c: encode(c if instruction is None else F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), c))


def temporal_pairs(candidates: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, is_temporal, tscore) of the candidates, for `fusion.stage1_relevance`.

    `chunks` has chunk_id, title, section_heading, text and the metadata years, months and has_event_terms.
    """
    asked = queries.select("query_id", query_signals(F.col("question")).alias("q"))
    about = chunk_signals(F.col("title"), F.col("section_heading"), F.col("text"), F.col("years"), F.col("months"), F.col("has_event_terms"))
    rows = candidates.select("query_id", "chunk_id").join(asked, "query_id").join(chunks.select("chunk_id", about.alias("c")), "chunk_id")
    return rows.select("query_id", "chunk_id", F.col("q.is_temporal").alias("is_temporal"), temporal_score(F.col("q.is_temporal"), F.col("q.years"), F.col("q.months"), F.col("c.years"), F.col("c.months"), F.col("c.event")).alias("tscore"))


def retrieve(p: Preset, queries: DataFrame, index: sparse.SparseIndex | None, query_vectors: DataFrame | None, vectors: DataFrame | None) -> DataFrame:
    """(query_id, chunk_id, score, rank) by the preset's mode, nothing for a closed book; an unknown mode or fusion is an error.

    Questions without an id or a text are left out.
    """
    queries = usable(queries)
    if p.mode == "closed_book":
        return queries.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    if p.mode == "sparse":
        return sparse.search_with_feedback(index, queries, max(p.k, p.pool))
    if p.mode == "dense":
        return dense.search(query_vectors, vectors, max(p.k, p.pool))
    if p.mode != "hybrid" or p.fusion not in ("rrf", "minmax"):
        raise ValueError(f"cannot retrieve in mode {p.mode!r} with fusion {p.fusion!r}")
    d, s = dense.search(query_vectors, vectors, p.pool), sparse.search_with_feedback(index, queries, p.pool)
    fuse = fusion.rrf if p.fusion == "rrf" else fusion.minmax_fusion
    return fuse(d, s, p.k, p.w_dense, p.w_sparse, k_dense=p.pool, k_sparse=p.pool)


def extractive_answer(question: Column, context: Column) -> Column:
    """The stand-in for a generator: the context sentence that shares most tokens with the question."""
    words = F.array_distinct(tokens(question))
    scored = F.transform(F.split(context, r"(?<=[.!?])\s+"), lambda s: F.struct(F.size(F.array_intersect(words, tokens(s))).alias("n"), s.alias("s")))
    best = F.array_max(F.filter(scored, lambda x: x["n"] > 0))["s"]
    return F.coalesce(F.trim(best), F.lit(IDK))


def answer(contexts: DataFrame, generate: Callable[[Column, Column], Column] = extractive_answer) -> DataFrame:
    """(query_id, answer) of (query_id, question, rank, text)."""
    g = contexts.groupBy("query_id", "question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("c"))
    return g.select("query_id", clean_answer(generate(F.col("question"), F.col("c"))).alias("answer"))


# Fixed values.
PREFIXES = r"^(?:Answer:\s*)?(?:answer:\s*)?(?:A:\s*)?(?:Final:\s*)?(?:final:\s*)?"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ANSWER_SYSTEM = (
    "You are a question answering system.\nAnswer the question based on the provided context and your knowledge.\nOutput ONLY the answer (no explanations).\n"
    "KEEP YOUR ANSWER CONCISE AND NO MORE THAN ONE SENTENCE.\nDo not specify if the answer comes from context or is based on your own knowledge.\nAnswer in English ONLY.\n"
)


def _unquoted(c: Column) -> Column:
    """Without white space, then double, then single quotes at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), '^"+|"+$', ""), "^'+|'+$", ""))


def clean_answer(c: Column) -> Column:
    """An answer without leading labels; its lines without bullets, numbers, labels and quotes, repeats dropped case-blind, joined by semicolons.

    A first line of several that only says "answer" is dropped.
    """
    lines = F.split(strip(F.regexp_replace(strip(text(c)), PREFIXES, "")), LINE_BREAK)
    bare = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(s), r"^[-*•]\s*", ""), r"^\d+[.)]\s*", ""), PREFIXES, "")
    lines = F.filter(F.transform(lines, lambda s: _unquoted(bare(s))), lambda s: s != "")
    first = F.lower(F.regexp_replace(F.get(lines, 0), ":+$", ""))
    lines = F.when((F.size(lines) > 1) & first.isin("answer", "answers"), F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
    once = F.aggregate(lines, F.array().cast("array<string>"), lambda have, s: F.when(F.exists(have, lambda h: F.lower(h) == F.lower(s)), have).otherwise(F.concat(have, F.array(s))))
    return _unquoted(F.array_join(once, "; "))


def format_context(i: Column, title: Column, section: Column, url: Column, body: Column) -> Column:
    """A numbered passage: what is known of it in the first line, then its text."""
    named = lambda label, c: F.when(strip(text(c)) != "", F.concat(F.lit(label), strip(text(c))))
    head = F.concat_ws(" | ", named("Title: ", title), named("Section: ", section), named("URL: ", url))
    return F.concat(F.lit("["), i.cast("string"), F.lit("]"), F.when(head != "", F.concat(F.lit(" "), head)).otherwise(""), F.lit("\n"), strip(text(body)))


def answer_prompt(question: Column, contexts: Column) -> Column:
    """What a generator is asked, given formatted passages in order; ANSWER_SYSTEM goes before it."""
    return F.concat(F.lit("Context:\n"), F.array_join(contexts, "\n\n"), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))
