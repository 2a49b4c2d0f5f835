"""Retrieval-quality and faithfulness analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions import questions as Q
from ravelin.functions import text as T


def details(retrieved: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """One row per (query, method): diversity, the evidence proxy, and ordered lists of what was retrieved.

    `retrieved` has method, query_id, chunk_id, rank; `chunks` chunk_id, doc_id, domain, title, source_url, text.
    """
    rows = retrieved.where(F.col("rank") <= k).join(chunks, "chunk_id").join(queries, "query_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "domain", "title", "source_url", "text")))
    distinct = lambda c: F.count_distinct(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)))
    g = rows.groupBy("method", "query_id", "question").agg(distinct("doc_id").alias("doc_diversity"), distinct("domain").alias("domain_diversity"), ordered.alias("r"), F.max(F.length(F.trim("text"))).alias("longest"))
    g = g.withColumn("question_type", Q.question_type(F.col("question")))
    blob = F.array_join("r.text", "\n")
    meta = F.array_join(F.transform("r", lambda x: F.concat_ws(" ", F.coalesce(x["source_url"], F.lit("")), F.coalesce(x["domain"], F.lit("")))), " ")
    hit = Q.evidence_hit(F.col("question_type"), F.col("question"), blob, meta, F.col("longest"))
    return g.select("query_id", "question", "question_type", "method", F.lit(k).alias("k"), "doc_diversity", "domain_diversity", hit.alias("evidence_proxy_hit"),
                    F.col("r.chunk_id").alias("top_chunk_ids"), F.col("r.doc_id").alias("top_doc_ids"), F.col("r.domain").alias("top_domains"),
                    F.slice("r.title", 1, 3).alias("top_titles"), F.slice(F.transform("r.text", lambda t: T.snippet(t)), 1, 3).alias("top_snippets"))


def shown(titles: Column, snippets: Column, most: int = 3) -> Column:
    """Titles with their snippets, up to `most`; the shorter list decides how many."""
    n = F.least(F.size(titles), F.size(snippets), F.lit(most))
    return F.slice(F.arrays_zip(titles.alias("title"), snippets.alias("snippet")), F.lit(1), F.greatest(n, F.lit(0)))


def all_methods(rows: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """The totals of `summary` for each of the methods in their order, with 0 questions and means of 0 for one without rows."""
    listed = rows.sparkSession.createDataFrame(list(enumerate(methods)), "place int, method string")
    totals = rows.where(F.col("question_type").isNull()).drop("question_type")
    values = [c for c in totals.columns if c != "method"]
    return listed.join(totals, "method", "left").select("place", "method", *[F.coalesce(c, F.lit(0)).alias(c) for c in values])


def ablation(totals: DataFrame, first: str, second: str, label: str) -> DataFrame:
    """The rows of two methods and, if both are there, one of the first less the second."""
    values = [c for c in totals.columns if c != "method"]
    both = totals.where(F.col("method").isin(first, second))
    of = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    gap = both.agg(F.lit(label).alias("method"), *[(of(first, c) - of(second, c)).alias(c) for c in values]).where(F.col(values[0]).isNotNull())
    return both.select("method", *values).unionByName(gap)


def faithfulness_sheet(queries: DataFrame, closed: DataFrame, rag: DataFrame, contexts: DataFrame, chunks: DataFrame, top: int = 3) -> DataFrame:
    """One row per question to be labelled by hand: both answers (empty where missing), and the first `top` passages side by side.

    `closed` and `rag` have qid and answer; `contexts` query_id, chunk_id, rank; `chunks` chunk_id, title, domain, source_url, text.
    """
    parts = ("chunk_id", "title", "domain", "source_url", "snippet")
    told = contexts.where(F.col("rank") <= top).join(chunks, "chunk_id", "left").withColumn("snippet", T.snippet(F.col("text"), 220))
    cell = lambda i, c: F.coalesce(F.max(F.when(F.col("rank") == i, F.col(c).cast("string"))), F.lit("")).alias(f"ctx{i}_{c}")
    wide = told.groupBy("query_id").agg(*[cell(i, c) for i in range(1, top + 1) for c in parts])
    answer = lambda df, name: df.select(F.col("qid").cast("string").alias("qid"), F.col("answer").alias(name))
    q = queries.select(F.col("query_id").cast("string").alias("qid"), Q.question_type(F.col("question")).alias("question_type"), "question")
    rows = q.join(answer(closed, "closed_answer"), "qid", "left").join(answer(rag, "rag_answer"), "qid", "left")
    rows = rows.join(wide.withColumn("qid", F.col("query_id").cast("string")).drop("query_id"), "qid", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    empty = [F.lit("").alias(c) for c in ("closed_label", "rag_label", "annotation_notes")]
    return rows.select("qid", "question_type", "question", blank("closed_answer"), blank("rag_answer"), *empty, *[blank(f"ctx{i}_{c}") for i in range(1, top + 1) for c in parts])


def example_rows(selected: DataFrame, types: DataFrame, queries: DataFrame) -> DataFrame:
    """The chosen examples with their type and question, empty where unknown. `selected` has bucket and qid, `types` qid and question_type, `queries` qid and question."""
    # Fixed values.
    titles = {"hybrid_wins_dense": "Hybrid > Dense", "hybrid_wins_sparse": "Hybrid > Sparse", "hybrid_qwen_vs_hybrid_minilm": "Hybrid GTE-Qwen vs Hybrid MiniLM", "hybrid_failure_cases": "Hybrid Failure"}
    named = F.col("bucket")
    for name, title in titles.items():
        named = F.when(F.col("bucket") == name, title).otherwise(named)
    first = types.groupBy(F.col("qid").cast("string").alias("qid")).agg(F.min("question_type").alias("question_type"))
    rows = selected.select(named.alias("bucket"), F.col("qid").cast("string").alias("qid")).join(first, "qid", "left").join(queries.select(F.col("qid").cast("string").alias("qid"), "question"), "qid", "left")
    return rows.select("bucket", "qid", F.coalesce("question_type", F.lit("")).alias("question_type"), F.coalesce("question", F.lit("")).alias("question"))


def summary(rows: DataFrame) -> DataFrame:
    """Means by method and by method and type, in one pass over two grouping sets; question_type is null in the totals."""
    return rows.groupingSets([["method"], ["method", "question_type"]], "method", "question_type").agg(
        F.count("*").alias("n_queries"), F.round(F.avg("doc_diversity"), 4).alias("doc_diversity_mean"),
        F.round(F.avg("domain_diversity"), 4).alias("domain_diversity_mean"), F.round(F.avg("evidence_proxy_hit"), 4).alias("evidence_proxy_rate"),
    )


def pivot(by_type: DataFrame, value: str, types: list[str]) -> DataFrame:
    return by_type.where(F.col("question_type").isNotNull()).groupBy("method").pivot("question_type", types).agg(F.first(value)).na.fill(0.0)


def label_rates(sheet: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of the labels supported, unsupported and idk (column `label`, as written), 0 where there are none."""
    n = T.normalize_label(F.col("label"))
    g = sheet.withColumn("l", n).groupBy(*by).agg(F.count_if(F.col("l") != "").alias("labelled"), *[F.count_if(F.col("l") == x).alias(x) for x in ("supported", "unsupported", "idk")])
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    answered = F.col("supported") + F.col("unsupported")
    return g.select(*by, "labelled", "supported", "unsupported", "idk", rate(F.col("supported"), F.col("labelled")).alias("support_rate"), rate(F.col("idk"), F.col("labelled")).alias("idk_rate"), rate(F.col("unsupported"), answered).alias("hallucination_rate"))


def label_delta(rates: DataFrame, side: str, minuend: str, subtrahend: str, by: list[str]) -> DataFrame:
    """The difference of the rounded rates of two sides."""
    pick = lambda s, c: F.coalesce(F.max(F.when(F.col(side) == s, F.col(c))), F.lit(0.0))
    names = ("support_rate", "idk_rate", "hallucination_rate")
    return rates.groupBy(*by).agg(*[F.round(pick(minuend, c) - pick(subtrahend, c), 4).alias(f"{c}_delta") for c in names])


def faithfulness(sheet: DataFrame, kind: str = "question_type") -> DataFrame:
    """Rates of both sides and their differences, overall (kind null) and by kind; a blank kind is "unknown".

    `sheet` has the kind, closed_label and rag_label. Gains are positive where retrieval helps: more support, less hallucination.
    """
    named = F.when(F.trim(F.coalesce(F.col(kind), F.lit(""))) == "", "unknown").otherwise(F.trim(F.col(kind)))
    sides = F.array(F.struct(F.lit("closed_book").alias("side"), F.col("closed_label").alias("label")), F.struct(F.lit("rag_hybrid_rrf").alias("side"), F.col("rag_label").alias("label")))
    rows = sheet.select(named.alias("kind"), F.explode(sides).alias("x")).select(F.explode(F.array(F.col("kind"), F.lit(None).cast("string"))).alias("kind"), "x.side", "x.label")
    rates = label_rates(rows.where(T.normalize_label(F.col("label")) != ""), ["kind", "side"])
    of = lambda s, c: F.coalesce(F.max(F.when(F.col("side") == s, F.col(c))), F.lit(0.0))
    rag, closed = "rag_hybrid_rrf", "closed_book"
    gains = rates.groupBy("kind").agg(F.round(of(rag, "support_rate") - of(closed, "support_rate"), 4).alias("support_rate_gain"), F.round(of(closed, "hallucination_rate") - of(rag, "hallucination_rate"), 4).alias("hallucination_rate_reduction"))
    back = F.col("r.kind").eqNullSafe(F.col("g.kind"))
    return rates.alias("r").join(gains.alias("g"), back).select("r.*", "support_rate_gain", "hallucination_rate_reduction")


def example_buckets(rows: DataFrame, n: int = 2) -> DataFrame:
    """(bucket, qid, place): the first n question ids, as text, of each bucket, in one pass.

    `rows` has qid, dense_hit, sparse_hit, hybrid_hit, answer, other_answer (of the second embedder) and question_type. Where the two
    answers differ, those of which only one admits not to know come first, then by type and id, both descending.
    """
    fits = lambda name, cond: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    mine, other, differ = T.strip(T.text(F.col("answer"))), T.strip(T.text(F.col("other_answer"))), "hybrid_qwen_vs_hybrid_minilm"
    held = F.array(
        fits("hybrid_wins_dense", (F.col("hybrid_hit") == 1) & zero("dense_hit")),
        fits("hybrid_wins_sparse", (F.col("hybrid_hit") == 1) & zero("sparse_hit")),
        fits(differ, (mine != "") & (other != "") & (mine != other)),
        fits("hybrid_failure_cases", (F.col("hybrid_hit") == 0) | T.is_idk(F.col("answer"))),
    )
    told = (T.is_idk(mine) != T.is_idk(other)).cast("int")
    each = rows.where(F.col("hybrid_hit").isNotNull()).select(F.col("qid").cast("string").alias("qid"), told.alias("told"), T.text(F.col("question_type")).alias("type"), F.explode(F.array_compact(held)).alias("bucket"))
    own = lambda c: F.when(F.col("bucket") == differ, F.col(c))
    order = W.partitionBy("bucket").orderBy(own("told").desc(), own("type").desc(), own("qid").desc(), "qid")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("bucket", "qid", "place")


def joined_hits(details: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, dense_hit, sparse_hit, hybrid_hit) of retrieval details (method, qid, evidence_proxy_hit): hybrid must be there, others may be null."""
    hit = lambda m: F.max(F.when(F.col("method") == m, F.col("evidence_proxy_hit")))
    per = details.groupBy("qid").agg(hit("dense").alias("dense_hit"), hit("sparse").alias("sparse_hit"), hit("hybrid_rrf").alias("hybrid_hit"))
    return questions.select("qid").join(per.where(F.col("hybrid_hit").isNotNull()), "qid")


def allocation(strata: DataFrame, size: int) -> DataFrame:
    """(stratum, n, take): proportional shares by largest remainder; `strata` has stratum and n > 0, a row each.

    Whole parts first, what is left to the largest remainders (of equal ones the last name first). Then strata without a row get one
    each, if `size` allows for all, from whichever has most: the units above 1 are ranked by height, and the highest are given away.
    """
    all_rows = W.partitionBy()
    total, exact = F.sum("n").over(all_rows), F.lit(float(size)) * F.col("n") / F.sum("n").over(all_rows)
    rows = strata.withColumns({"total": total, "base": F.floor(exact), "rest": F.round(exact - F.floor(exact), 9)})
    rows = rows.withColumns({"left": F.lit(size) - F.sum("base").over(all_rows), "place": F.row_number().over(W.orderBy(F.desc("rest"), F.desc("stratum")))})
    rows = rows.withColumn("got", F.when(F.col("total") <= size, F.col("n")).otherwise(F.col("base") + (F.col("place") <= F.col("left")).cast("long")))
    rows = rows.withColumn("bare", F.when(F.count("*").over(all_rows) <= size, F.count_if(F.col("got") == 0).over(all_rows)).otherwise(0))
    # Who gives: the units above 1 that are highest. At the level where as many stand above as are wanted, the first names give the rest.
    level = rows.where("got > 1").select("stratum", "got", "bare", F.explode(F.expr("sequence(2, least(got, 1 + bare + 1))")).alias("back"))
    level = level.withColumn("height", F.col("got") - F.col("back") + 2)
    units = level.withColumn("nth", F.row_number().over(W.orderBy(F.desc("height"), "stratum"))).where("nth <= bare")
    given = units.groupBy("stratum").agg(F.count("*").alias("given"))
    order = F.row_number().over(W.orderBy(F.col("got") > 0, "stratum"))
    out = rows.join(given, "stratum", "left").withColumns({"order": order, "all_given": F.sum("given").over(all_rows)})
    take = F.when((F.col("got") == 0) & (F.col("bare") > 0) & (F.col("order") <= F.coalesce("all_given", F.lit(0))), 1).otherwise(F.col("got") - F.coalesce("given", F.lit(0)))
    return out.select("stratum", "n", take.cast("long").alias("take"))


def sample(rows: DataFrame, takes: DataFrame, stratum: str, key: str, seed: int = 13) -> DataFrame:
    """The allocated number of rows of each stratum, by hash order."""
    order = F.row_number().over(W.partitionBy(stratum).orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key))
    return rows.withColumn("place", order).join(takes.select(F.col("stratum").alias(stratum), "take"), stratum).where("place <= take").drop("place", "take")
