"""Rank fusion, confidence and everything between retrieved lists and the context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions.text import strip, text, tokens
from ravelin.operators.sparse import minmax, ranked


def _order(score: str = "score", key: str = "chunk_id") -> list[Column]:
    return [F.desc(score), F.desc(key)]


def _pools(dense: DataFrame, sparse: DataFrame, k_dense: int, k_sparse: int) -> tuple[DataFrame, DataFrame]:
    return dense.where(F.col("rank") <= k_dense), sparse.where(F.col("rank") <= k_sparse)


def rrf(dense: DataFrame, sparse: DataFrame, k: int, w_dense: float = 0.6, w_sparse: float = 0.4, base: int = 60, k_dense: int = 200, k_sparse: int = 200) -> DataFrame:
    """Weighted reciprocal ranks; a list that lacks the chunk adds nothing."""
    d, s = _pools(dense, sparse, k_dense, k_sparse)
    both = d.select("query_id", "chunk_id", F.col("rank").alias("rd")).join(s.select("query_id", "chunk_id", F.col("rank").alias("rs")), ["query_id", "chunk_id"], "full")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(float(base)) + F.col(r)), F.lit(0.0))
    fused = both.select("query_id", "chunk_id", F.round(part(w_dense, "rd") + part(w_sparse, "rs"), 8).alias("score"))
    return ranked(fused, "query_id", _order(), k)


def minmax_fusion(dense: DataFrame, sparse: DataFrame, k: int, w_dense: float = 0.6, w_sparse: float = 0.4, k_dense: int = 200, k_sparse: int = 200) -> DataFrame:
    """Weighted min-max scores, each scaled within its own pool."""
    d, s = _pools(dense, sparse, k_dense, k_sparse)
    scaled = lambda x, n: x.select("query_id", "chunk_id", minmax(F.col("score"), "query_id").alias(n))
    both = scaled(d, "md").join(scaled(s, "ms"), ["query_id", "chunk_id"], "full")
    fused = both.select("query_id", "chunk_id", F.round(w_dense * F.coalesce("md", F.lit(0.0)) + w_sparse * F.coalesce("ms", F.lit(0.0)), 8).alias("score"))
    return ranked(fused, "query_id", _order(), k)


def confidence(retrieved: DataFrame) -> DataFrame:
    """(query_id, confidence) of each question's first 12, min-max scaled: .55 gap + .25 top + .20 lead over ranks 3 to 6."""
    top = retrieved.where(F.col("rank") <= 12).withColumn("m", minmax(F.col("score"), "query_id"))
    at = lambda r: F.coalesce(F.max(F.when(F.col("rank") == r, F.col("m"))), F.lit(0.0))
    lead = F.greatest(F.lit(0.0), at(1) - F.coalesce(F.avg(F.when(F.col("rank").between(3, 6), F.col("m"))), F.lit(0.0)))
    value = 0.55 * (at(1) - at(2)) + 0.25 * at(1) + 0.2 * lead
    return top.groupBy("query_id").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 6).alias("confidence"))


def adaptive_depth(scores: DataFrame, k: int = 100, stage1: int = 56, below: float = 0.18, deep: int = 160, deep_stage1: int = 56) -> DataFrame:
    low = F.col("confidence") < below
    return scores.select("query_id", "confidence", F.when(low, F.greatest(F.lit(deep), F.lit(k))).otherwise(k).alias("k"), F.when(low, F.greatest(F.lit(deep_stage1), F.lit(stage1))).otherwise(stage1).alias("stage1_k"))


def stage1_relevance(retrieved: DataFrame, similarity: DataFrame | None, temporal: DataFrame | None = None, stage1_k: int = 60, weight: float = 0.2) -> DataFrame:
    """(query_id, chunk_id, rel): .8 scaled cosine + .2 scaled fused score of the first stage1_k, then the temporal share for temporal questions.

    `similarity` has (query_id, chunk_id, cos), None in sparse mode; `temporal` (query_id, chunk_id, is_temporal, tscore).
    """
    rows = retrieved.where(F.col("rank") <= stage1_k).withColumn("mf", minmax(F.col("score"), "query_id"))
    if similarity is None:
        rows = rows.withColumn("rel", F.col("mf"))
    else:
        rows = rows.join(similarity, ["query_id", "chunk_id"]).withColumn("rel", 0.8 * minmax(F.col("cos"), "query_id") + 0.2 * F.col("mf"))
    if temporal is not None:
        w = min(max(weight, 0.0), 0.35)
        rows = rows.join(temporal, ["query_id", "chunk_id"], "left").withColumn("mt", minmax(F.coalesce("tscore", F.lit(0.0)), "query_id"))
        rows = rows.withColumn("rel", F.when(F.coalesce("is_temporal", F.lit(False)), (1 - w) * F.col("rel") + w * F.col("mt")).otherwise(F.col("rel")))
    return rows.select("query_id", "chunk_id", F.round("rel", 6).alias("rel"))


def no_mmr(relevance: DataFrame, k: int) -> DataFrame:
    return ranked(relevance, "query_id", _order("rel"), k)


def mmr(relevance: DataFrame, vectors: DataFrame, k: int = 18, trade: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, rank): greedy picks of trade * rel - (1 - trade) * largest cosine to those picked; ties to the earlier candidate.

    Candidates per question are bounded by the stage-1 depth, so each group is small; rounding as in the SQL twin: cosines 6, values 8.
    """
    rows = relevance.join(vectors, "chunk_id").select("query_id", "chunk_id", "rel", F.col("embedding").cast("array<double>").alias("e"))

    def pick(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values(["rel", "chunk_id"], ascending=False, kind="stable").reset_index(drop=True)
        x, rel = np.array(of["e"].tolist(), np.float64), of["rel"].to_numpy()
        sims, taken, nearest = np.round(x @ x.T, 6), [0], None
        while len(taken) < min(k, len(of)):
            nearest = sims[taken[-1]] if nearest is None else np.maximum(nearest, sims[taken[-1]])
            value = np.round(trade * rel - (1 - trade) * nearest, 8)
            value[taken] = -np.inf
            taken.append(int(value.argmax()))
        return pd.DataFrame({"query_id": of["query_id"].iloc[0], "chunk_id": of["chunk_id"].to_numpy()[taken], "rank": np.arange(1, len(taken) + 1)})

    return rows.groupBy("query_id").applyInPandas(pick, "query_id long, chunk_id long, rank int")


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column], k: int = 18) -> DataFrame:
    """(query_id, chunk_id, score, rank) of (query_id, chunk_id, question, text) by a scorer of question and text."""
    scored = candidates.withColumn("score", scorer(F.col("question"), F.col("text"))).select("query_id", "chunk_id", "score")
    return ranked(scored, "query_id", _order(), k)


def overlap_scorer(question: Column, body: Column) -> Column:
    """The stand-in for a model's yes-minus-no logit: the share of the question's distinct tokens that the text has."""
    q, t = F.array_distinct(tokens(question)), F.array_distinct(tokens(body))
    return F.round(F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)), 6)


def logit_scorer(load: Callable[[], Callable[[list[str]], list[float]]], batch: int = 16) -> Callable[[Column, Column], Column]:
    """A scorer from a model: `load` is called once a worker and gives a function of prompts to yes-minus-no logits, called for `batch` prompts at a time."""

    def scorer(question: Column, body: Column) -> Column:
        @F.pandas_udf("double")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for p in parts:
                prompts = p.tolist()
                yield pd.Series([x for i in range(0, len(prompts), batch) for x in model(prompts[i : i + batch])], dtype=float)

        return score(rerank_prompt(question, F.lit(""), F.lit(""), body))

    return scorer


# What the model is told.
RERANK_SYSTEM = "You are a passage reranker for retrieval.\nDecide whether the passage is useful to answer the question.\nOutput only one token: yes or no.\n"
RERANK_ASK = "Is this passage useful for answering the question? Answer:"


def rerank_prompt(question: Column, title: Column, heading: Column, body: Column, most: int = 1000) -> Column:
    """What a reranking model is asked about a passage, cut to `most` characters."""
    named = lambda label, c: F.when(strip(text(c)) != "", F.concat(F.lit(label), strip(text(c))))
    about = F.concat_ws(" | ", named("Title: ", title), named("Section: ", heading))
    cut = F.substring(strip(text(body)), 1, most)
    passage = F.when(about != "", strip(F.concat(about, F.lit("\n"), cut))).otherwise(cut)
    return F.concat(F.lit("Question: "), question, F.lit("\n\nPassage:\n"), passage, F.lit("\n\n" + RERANK_ASK))


def context(selected: DataFrame, retrieved: DataFrame, doc_of: DataFrame, k: int, dedup: bool = True) -> DataFrame:
    """(query_id, chunk_id, rank): the selected ones, filled up from the retrieved ones, the first of each document, k in all."""
    both = selected.select("query_id", "chunk_id", "rank", F.lit(0).alias("stage")).unionByName(retrieved.select("query_id", "chunk_id", "rank", F.lit(1).alias("stage")))
    rows = both.join(doc_of, "chunk_id")
    alone = F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string"))
    doc = F.trim(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("key", F.when(doc != "", doc).otherwise(alone) if dedup else alone)
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("query_id", "key").orderBy("stage", "rank"))).where("n = 1").drop("n", "key")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("stage", "rank"))
    return first.withColumn("place", place).where(F.col("place") <= k).select("query_id", "chunk_id", F.col("place").alias("rank"))


def budget(ranked_texts: DataFrame, most: int, count: Callable[[Column], Column], least_chars: int = 200) -> DataFrame:
    """The prefix of (query_id, rank, chunk_id, text) that fits `most` tokens; the next one cut to the longest prefix of it, in characters, that still fits, if over `least_chars`.

    The prefix is found by halving, for the one text a question that does not fit. `count` must not fall as a text grows.
    """
    rows = ranked_texts.withColumn("tok", count(F.col("text")).cast("long"))
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("total", F.sum("tok").over(w)).withColumn("left", F.lit(most).cast("long") - (F.col("total") - F.col("tok")))
    whole = rows.where(F.col("total") <= most).select("query_id", "rank", "chunk_id", "text")
    over = rows.where((F.col("total") > most) & (F.col("left") > 0)).select("query_id", "rank", "chunk_id", F.trim("text").alias("text"), "left")
    # The first that does not fit is the only one with room left before it.
    steps = F.array(*[F.lit(1 << i).cast("long") for i in reversed(range(24))])
    fits = lambda n: (n <= F.length("text")) & (count(F.substr(F.col("text"), F.lit(1), n.cast("int"))) <= F.col("left"))
    best = F.aggregate(steps, F.lit(0).cast("long"), lambda at, jump: F.when(fits(at + jump), at + jump).otherwise(at))
    cut = over.withColumn("n", best).where(F.col("n") > least_chars).select("query_id", "rank", "chunk_id", F.substr(F.col("text"), F.lit(1), F.col("n").cast("int")).alias("text"))
    return whole.unionByName(cut)
