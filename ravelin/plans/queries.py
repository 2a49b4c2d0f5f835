"""Registered queries of the retrieval operators over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions import questions as Q
from ravelin.functions import text as T
from ravelin.operators import analytics, chunking, dense, fusion, sparse, web
from ravelin.plans import presets
from ravelin.sources.files import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- tokens and BM25 -------------------------------------------------------------------------------------------------------------

# SQL of the tokens of column `x`: compounds followed by their parts.
SQL_TOKENS = """flatten(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+(?:[-/''’][a-z0-9]+)*'),
 lambda t: CASE WHEN regexp_matches(t, '[-/''’]') THEN list_concat([replace(t, '’', '''')], regexp_split_to_array(replace(t, '’', ''''), '[-/'']')) ELSE [t] END))"""
SQL_BM25 = f"""
WITH d AS (SELECT doc_id AS chunk_id, {SQL_TOKENS.format(x="text")} AS toks FROM documents),
len AS (SELECT chunk_id, toks, (len(toks) + least(128, greatest(len(toks) - 1, 0)))::DOUBLE AS dl FROM d),
fig AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS l FROM len),
p AS (SELECT chunk_id, dl, unnest(toks) AS term FROM len),
tf AS (SELECT chunk_id, dl, term, count(*)::DOUBLE AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
q AS (SELECT item_id AS query_id, unnest({SQL_TOKENS.format(x="text")}) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM q GROUP BY ALL),
s AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / l))), 4) AS score
 FROM qt JOIN tf USING (term) JOIN df USING (term), fig GROUP BY query_id, chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INT AS rank FROM s)"""


#: Indexes that this session has written, by application and folder of tables.
_SAVED: dict[tuple[str, str], str] = {}


def docs_index(spark: SparkSession, d: str) -> sparse.SparseIndex:
    """The index of the documents, written once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _SAVED:
        path = f"{work_folder(spark)}/index_{uuid4().hex[:12]}"
        sparse.build(table(spark, d, "documents"), "doc_id", "text", place=path).save(path)
        _SAVED[key] = path
    return sparse.load(spark, _SAVED[key])


def bench_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({SQL_TOKENS.format(x='text')}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query(f"SELECT doc_id, len(t) + least(128, greatest(len(t) - 1, 0)) AS doc_len FROM (SELECT doc_id, {SQL_TOKENS.format(x='text')} AS t FROM documents)")
def doc_length_with_bigrams(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", (F.size(t) + T.bigram_count(t, 128)).cast("long").alias("doc_len"))


@query(SQL_BM25 + " SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return sparse.search(docs_index(spark, d), bench_questions(spark, d), 10)


SQL_PRF = SQL_BM25 + f""", base AS (SELECT * FROM r WHERE rank <= 10), seen AS (SELECT query_id, rank, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM base JOIN d USING (chunk_id) WHERE rank <= 8),
 w AS (SELECT query_id, term, round(sum(1.0::DOUBLE / rank), 6) AS weight, min(rank * 10000000000 + pos) AS first FROM seen s WHERE len(term) >= 2 AND NOT EXISTS (SELECT 1 FROM qt WHERE qt.query_id = s.query_id AND qt.term = s.term) GROUP BY query_id, term),
 more AS (SELECT query_id, term FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, first) <= 6),
 q2 AS (SELECT * FROM qt WHERE query_id IN (SELECT query_id FROM more) UNION ALL SELECT query_id, term, 1.0::DOUBLE FROM more),
 s2 AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / l))), 4) AS score FROM q2 JOIN tf USING (term) JOIN df USING (term), fig GROUP BY query_id, chunk_id),
 second AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) <= 10),
 mb AS (SELECT *, {{mm}} AS m FROM base WINDOW w AS (PARTITION BY query_id)), ms AS (SELECT *, {{mm}} AS m FROM second WINDOW w AS (PARTITION BY query_id)),
 mix AS (SELECT query_id, chunk_id, CASE WHEN query_id IN (SELECT query_id FROM more) THEN round(0.65::DOUBLE * coalesce(mb.m, 0) + 0.35::DOUBLE * coalesce(ms.m, 0), 6) ELSE mb.score END AS score FROM mb FULL JOIN ms USING (query_id, chunk_id))"""
SQL_PRF = SQL_PRF.replace("{mm}", "CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END")


@query(SQL_PRF + " SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INT AS rank FROM mix QUALIFY rank <= 10")
def bm25_prf_topk(spark: SparkSession, d: str) -> DataFrame:
    return sparse.search_with_feedback(docs_index(spark, d), bench_questions(spark, d), 10)


# --- dense search and fusion -----------------------------------------------------------------------------------------------------

SQL_DENSE = """
dn AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
 FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INT AS rank FROM dn)"""
SQL_BOTH = SQL_BM25 + "," + SQL_DENSE + ", sp AS (SELECT * FROM r WHERE rank <= 50), dp AS (SELECT * FROM dr WHERE rank <= 50)"
SQL_RRF = SQL_BOTH + """, f AS (SELECT query_id, chunk_id, round(coalesce(0.5::DOUBLE / (60 + dp.rank), 0) + coalesce(0.5::DOUBLE / (60 + sp.rank), 0), 8) AS score
 FROM dp FULL JOIN sp USING (query_id, chunk_id)), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INT AS rank FROM f)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def bench_vectors(spark: SparkSession, d: str) -> DataFrame:
    """By convention the vector of a question is that with its id."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(table(spark, d, "embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")


def pools(spark: SparkSession, d: str, depth: int = 50) -> tuple[DataFrame, DataFrame]:
    return dense.search(bench_vectors(spark, d), vectors(spark, d), depth), sparse.search(docs_index(spark, d), bench_questions(spark, d), depth)


def fused(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    return fusion.rrf(*pools(spark, d), k, 0.5, 0.5)


@query("WITH " + SQL_DENSE + " SELECT query_id, chunk_id, score, rank FROM dr WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(bench_vectors(spark, d), vectors(spark, d), 10)


@query(SQL_RRF + " SELECT query_id, chunk_id, score, rank FROM fr WHERE rank <= 10")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, 10)


SQL_MM = "CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"


@query(SQL_BOTH + f""", dm AS (SELECT *, {SQL_MM} AS m FROM dp WINDOW w AS (PARTITION BY query_id)), sm AS (SELECT *, {SQL_MM} AS m FROM sp WINDOW w AS (PARTITION BY query_id)),
 f AS (SELECT query_id, chunk_id, round(0.5::DOUBLE * coalesce(dm.m, 0) + 0.5::DOUBLE * coalesce(sm.m, 0), 8) AS score FROM dm FULL JOIN sm USING (query_id, chunk_id)),
 fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INT AS rank FROM f) SELECT query_id, chunk_id, score, rank FROM fr WHERE rank <= 10""")
def minmax_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.minmax_fusion(*pools(spark, d), 10, 0.5, 0.5)


SQL_CONF = SQL_RRF + f""", t AS (SELECT *, {SQL_MM} AS m FROM fr WHERE rank <= 12 WINDOW w AS (PARTITION BY query_id)),
 c AS (SELECT query_id, coalesce(max(m) FILTER (rank = 1), 0) AS a, coalesce(max(m) FILTER (rank = 2), 0) AS b, coalesce(avg(m) FILTER (rank BETWEEN 3 AND 6), 0) AS e FROM t GROUP BY query_id),
 cf AS (SELECT query_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.55::DOUBLE * (a - b) + 0.25::DOUBLE * a + 0.2::DOUBLE * greatest(0.0::DOUBLE, a - e))), 6) AS confidence FROM c)"""


@query(SQL_CONF + " SELECT query_id, confidence, CASE WHEN confidence < 0.18 THEN 160 ELSE 100 END AS k, 56 AS stage1_k FROM cf")
def retrieval_confidence(spark: SparkSession, d: str) -> DataFrame:
    return fusion.adaptive_depth(fusion.confidence(fused(spark, d)))


SQL_REL = SQL_RRF + f""", c0 AS (SELECT fr.query_id, fr.chunk_id, fr.rank, fr.score, dn.score AS cos FROM fr JOIN dn USING (query_id, chunk_id) WHERE fr.rank <= 60),
 mf AS (SELECT query_id, chunk_id, cos, {SQL_MM} AS mf FROM c0 WINDOW w AS (PARTITION BY query_id)),
 rel AS (SELECT query_id, chunk_id, round(0.8::DOUBLE * {SQL_MM.replace("score", "cos")} + 0.2::DOUBLE * mf, 6) AS rel FROM mf WINDOW w AS (PARTITION BY query_id))"""


def relevance(spark: SparkSession, d: str) -> DataFrame:
    cand = fused(spark, d, 60).join(vectors(spark, d).select("chunk_id"), "chunk_id", "left_semi")
    v, q = vectors(spark, d), bench_vectors(spark, d).withColumnRenamed("embedding", "qe")
    pairs = cand.join(v, "chunk_id").join(q, "query_id")
    dot = F.aggregate(F.zip_with("embedding", "qe", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return fusion.stage1_relevance(cand, pairs.select("query_id", "chunk_id", F.round(dot, 6).alias("cos")))


@query(SQL_REL + " SELECT query_id, chunk_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, chunk_id DESC)::INT AS rank FROM rel QUALIFY rank <= 18")
def stage1_rerank(spark: SparkSession, d: str) -> DataFrame:
    return fusion.no_mmr(relevance(spark, d), 18)


SQL_MMR = SQL_REL.replace("WITH d AS", "WITH RECURSIVE d AS", 1) + """, cand AS (SELECT query_id, array_agg(chunk_id ORDER BY rel DESC, chunk_id DESC) AS ids, array_agg(rel ORDER BY rel DESC, chunk_id DESC) AS rels, count(*) AS m FROM rel GROUP BY query_id),
 sim AS (SELECT a.query_id, a.chunk_id AS x, b.chunk_id AS y, round(list_inner_product(u.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS s FROM rel a JOIN rel b USING (query_id) JOIN embeddings u ON u.vec_id = a.chunk_id JOIN embeddings v ON v.vec_id = b.chunk_id),
 pick AS (SELECT query_id, 1 AS rank, ids[1] AS chunk_id, [ids[1]] AS had FROM cand
 UNION ALL SELECT query_id, rank, chunk_id, had FROM (SELECT p.query_id, p.rank + 1 AS rank, c.chunk_id, list_append(p.had, c.chunk_id) AS had,
 row_number() OVER (PARTITION BY p.query_id ORDER BY round(0.75::DOUBLE * c.rel - 0.25::DOUBLE * (SELECT max(s) FROM sim WHERE sim.query_id = p.query_id AND sim.x = c.chunk_id AND list_contains(p.had, sim.y)), 8) DESC, c.rel DESC, c.chunk_id DESC) AS nth
 FROM pick p JOIN rel c ON c.query_id = p.query_id AND NOT list_contains(p.had, c.chunk_id) WHERE p.rank < 18) WHERE nth = 1)"""


@query(SQL_MMR + " SELECT query_id, chunk_id, rank::INT AS rank FROM pick")
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    return fusion.mmr(relevance(spark, d), vectors(spark, d), 18)


# Chunks share documents by a seventh of the id, so that there is something to keep apart.
@query(SQL_RRF + """, sel AS (SELECT query_id, chunk_id, rank FROM fr WHERE rank <= 6), u AS (SELECT *, 0 AS stage FROM sel UNION ALL SELECT query_id, chunk_id, rank, 1 FROM fr WHERE rank <= 50),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id // 7 ORDER BY stage, rank) AS nth FROM u), pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, rank)::INT AS place FROM o WHERE nth = 1)
 SELECT query_id, chunk_id, place AS rank FROM pl WHERE place <= 10""")
def context_backfill(spark: SparkSession, d: str) -> DataFrame:
    got = fused(spark, d)
    doc_of = got.select("chunk_id").distinct().withColumn("doc_id", F.floor(F.col("chunk_id") / 7))
    return fusion.context(got.where("rank <= 6"), got, doc_of, 10)


SQL_WORDS = r"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


@query(SQL_BM25 + f""", c AS (SELECT query_id, rank, chunk_id, text, {SQL_WORDS.format(x="text")} AS ws FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 10),
 t AS (SELECT *, sum(len(ws)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM c), l AS (SELECT *, 1500 - (total - len(ws)) AS room FROM t),
 pt AS (SELECT *, array_to_string(regexp_extract_all(trim(text), '\\S+\\s*')[1:room::INT], '') AS part FROM l),
 k AS (SELECT query_id, rank, chunk_id, CASE WHEN total <= 1500 THEN text WHEN room > 0 AND length(part) > 200 THEN part END AS text FROM pt)
 SELECT query_id, rank, chunk_id, md5(text) AS text_md5 FROM k WHERE text IS NOT NULL""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    top = bm25_topk(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return fusion.budget(top.select("query_id", "rank", "chunk_id", "text"), 1500, T.word_count).select("query_id", "rank", "chunk_id", F.md5("text").alias("text_md5"))


@query(SQL_BM25 + f""", qd AS (SELECT item_id AS query_id, list_distinct({SQL_TOKENS.format(x="text")}) AS qs FROM benchmark), o AS (SELECT query_id, chunk_id, round(len(list_intersect(qs, list_distinct(toks)))::DOUBLE / greatest(len(qs), 1), 6) AS score
 FROM r JOIN qd USING (query_id) JOIN d USING (chunk_id) WHERE rank <= 18) SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INT AS rank FROM o""")
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    top = sparse.search(docs_index(spark, d), bench_questions(spark, d), 18).select("query_id", "chunk_id")
    full = top.join(bench_questions(spark, d), "query_id").join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return fusion.rerank(full, fusion.overlap_scorer, 18)


# --- chunks and text -------------------------------------------------------------------------------------------------------------

SQL_WINDOWS = f"""w AS (SELECT doc_id, {SQL_WORDS.format(x="text")} AS ws FROM documents),
 i AS (SELECT doc_id, ws, unnest(range(0, greatest(0, ceil((len(ws) - 160) / 130.0))::INT + 1)) AS pos FROM w WHERE len(ws) > 0),
 c AS (SELECT doc_id, pos::INT AS pos, array_to_string(ws[pos * 130 + 1 : pos * 130 + 160], ' ') AS text FROM i)"""


@query(f"WITH {SQL_WINDOWS} SELECT doc_id, pos, md5(text) AS text_md5 FROM c")
def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.window_chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "pos", F.md5("text").alias("text_md5"))


@query(f"""WITH {SQL_WINDOWS}, l AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM c)
 SELECT doc_id, pos, md5(CASE WHEN b IS NULL THEN text ELSE array_to_string(regexp_split_to_array(b, ' ')[-30:], ' ') || chr(10) || chr(10) || text END) AS text_md5 FROM l""")
def overlap_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = chunking.window_chunks(table(spark, d, "documents"), "doc_id", "text")
    return chunking.with_overlap(cut, "doc_id").select("doc_id", "pos", F.md5("text").alias("text_md5"))


@query()
def segment_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.segment(table(spark, d, "documents"), "doc_id", "text")


# The tables hold none of what cleaning removes, so markers are put in, alike on both sides.
@query(r"""WITH m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Jump to search' || chr(10) || text || ' claim [12] and [3, 4] end' WHEN 1 THEN text || chr(10) || chr(10) || chr(10) || chr(10) || 'two   spaces	tab'
 WHEN 2 THEN 'see [citation needed] here' || chr(10) || 'Contents' || chr(10) || text ELSE text END AS x FROM documents),
 a AS (SELECT doc_id, array_to_string(list_filter(string_split(x, chr(10)), lambda s: NOT regexp_matches(lower(trim(s)), '^\s*(jump to navigation|jump to search|toggle.*|contents|hide|show)\s*$')), chr(10)) AS x FROM m),
 b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(?i)\[(?:\d+|note\s*\d+|citation needed)\]', '', 'g'), '\[(?:\d+(?:,\s*\d+)+)\]', '', 'g') AS x FROM a)
 SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(x, chr(10)), lambda s: rtrim(regexp_replace(s, '[ \t]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM b""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("doc_id") % 4, F.col("text")
    marked = F.when(k == 0, F.concat(F.lit("Jump to search\n"), t, F.lit(" claim [12] and [3, 4] end"))).when(k == 1, F.concat(t, F.lit("\n\n\n\ntwo   spaces\ttab")))
    marked = marked.when(k == 2, F.concat(F.lit("see [citation needed] here\nContents\n"), t)).otherwise(t)
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean(marked)).alias("text_md5"))


@query("SELECT page_id, sha1(url) AS url_id FROM pages")
def sha1_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.sha1_id(F.col("url")).alias("url_id"))


@query(r"""WITH e AS (SELECT o_orderkey, 'Order placed in ' || strftime(o_orderdate, '%B %Y') || CASE WHEN o_orderkey % 3 = 0 THEN ' for the festival' ELSE '' END AS t FROM orders)
 SELECT o_orderkey, regexp_extract(t, '\d{4}') AS year, lower(regexp_extract(t, 'in ([A-Z][a-z]+)', 1)) AS month, contains(t, 'festival') AS has_event_terms,
 round(CASE WHEN contains(t, '1996') THEN 1.0 ELSE -0.15 END + CASE WHEN contains(t, 'March') THEN 0.6 ELSE -0.1 END + CASE WHEN contains(t, 'festival') THEN 0.2 ELSE 0 END + 0.1, 2)::DOUBLE AS score FROM e""")
def temporal_score(spark: SparkSession, d: str) -> DataFrame:
    more = F.when(F.col("o_orderkey") % 3 == 0, " for the festival").otherwise("")
    t = F.concat(F.lit("Order placed in "), F.date_format("o_orderdate", "MMMM yyyy"), more)
    rows = table(spark, d, "orders").select("o_orderkey", t.alias("t")).withColumns({"y": T.years(F.col("t")), "m": T.months(F.col("t")), "ev": T.has_terms(F.col("t"), T.EVENT_TERMS)})
    asked = F.lit("what was held in March 1996")
    q = T.query_signals(asked)
    score = T.temporal_score(q["is_temporal"], q["years"], q["months"], F.col("y"), F.col("m"), F.col("ev"))
    return rows.select("o_orderkey", F.get("y", 0).alias("year"), F.get("m", 0).alias("month"), F.col("ev").alias("has_event_terms"), F.round(score, 2).alias("score"))


# --- pages -----------------------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]+)"', 1)) AS href FROM pages)""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return web.links(table(spark, d, "pages"), "page_id", "html")


@query(r"""SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://') AND ends_with(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.org') AND NOT regexp_matches(url, '(?i)utm_')""")
def url_filter(spark: SparkSession, d: str) -> DataFrame:
    rules = web.CrawlSettings(".org", deny_patterns=["utm_"])
    return table(spark, d, "pages").select("page_id", "url").where(web.allowed(F.col("url"), rules))


# Real links lead to no page of the table; pages of one host are linked in the order of their ids.
@query(r"""WITH RECURSIVE p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
 e AS (SELECT page_id AS src, lead(page_id) OVER (PARTITION BY host ORDER BY page_id) AS dst FROM p),
 b AS (SELECT min(page_id) AS node, 0 AS depth FROM p GROUP BY host UNION ALL SELECT dst, depth + 1 FROM b JOIN e ON node = src WHERE depth < 3 AND dst IS NOT NULL) SELECT node, min(depth)::INT AS depth FROM b GROUP BY node""")
def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("AUTHORITY")).alias("host"))
    edges = p.select(F.col("page_id").alias("src"), F.lead("page_id").over(W.partitionBy("host").orderBy("page_id")).alias("dst")).where("dst is not null")
    return web.traverse(p.groupBy("host").agg(F.min("page_id").alias("node")), edges, 3)


@query()
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", web.extract(F.col("html")).alias("x")).select("page_id", "x.title", "x.text")


@query(r"""WITH m AS (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status FROM pages WHERE page_id % 2 = 0)
 SELECT p.page_id, coalesce(m.url, '') AS source_url, m.status::VARCHAR AS status FROM pages p LEFT JOIN m USING (page_id)""")
def manifest_left_join(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").withColumn("path", F.concat(F.lit("html/"), F.col("page_id").cast("string")))
    status = F.when(F.col("page_id") % 5 == 0, 404).otherwise(200)
    some = pages.where("page_id % 2 = 0").select("url", status.alias("status"), F.col("path").alias("saved_path"), F.col("page_id").alias("line"))
    return web.with_manifest(pages.select("page_id", "path"), some).select("page_id", "source_url", F.col("status").cast("string").alias("status"))


# --- analytics -------------------------------------------------------------------------------------------------------------------

SQL_TYPE = r"""CASE WHEN q = '' THEN 'description' WHEN regexp_matches(q, '(^|[^\p{L}\p{N}_])((jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(t(ember)?)?|oct(ober)?|nov(ember)?|dec(ember)?)|(19|20)\d{2})([^\p{L}\p{N}_]|$)')
 OR regexp_matches(q, 'when|date|month|year|schedule|upcoming|event|festival|concert|performing|performance|show|calendar') THEN 'event_date'
 WHEN regexp_matches(q, 'how many|how much|number of|population|percent|rank|cost|price|distance|area|size|amount') THEN 'numeric' WHEN regexp_matches(q, 'name the|list|which are|what are the') THEN 'list'
 WHEN regexp_matches(q, 'where|located|location|address|in pittsburgh|website|url|site|webpage|web page|^(who |where |which |what is )') THEN 'entity_location' ELSE 'description' END"""
SQL_ASKED = """SELECT n_nationkey AS qid, CASE n_nationkey % 5 WHEN 0 THEN 'When did ' || n_name || ' open?' WHEN 1 THEN 'How many people live in ' || n_name || '?' WHEN 2 THEN 'What are the names of towns in ' || n_name || '?'
 WHEN 3 THEN 'Where is ' || n_name || '?' ELSE 'Tell about ' || n_name END AS question FROM nation UNION ALL SELECT 1000 + item_id, text FROM benchmark"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("n_nationkey") % 5, F.col("n_name")
    q = F.when(k == 0, F.concat(F.lit("When did "), name, F.lit(" open?"))).when(k == 1, F.concat(F.lit("How many people live in "), name, F.lit("?")))
    q = q.when(k == 2, F.concat(F.lit("What are the names of towns in "), name, F.lit("?"))).when(k == 3, F.concat(F.lit("Where is "), name, F.lit("?")))
    own = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), q.otherwise(F.concat(F.lit("Tell about "), name)).alias("question"))
    return own.unionByName(table(spark, d, "benchmark").select((F.col("item_id") + 1000).alias("qid"), F.col("text").alias("question")))


@query(f"SELECT question_type, count(*) AS n FROM (SELECT {SQL_TYPE} AS question_type FROM (SELECT lower(trim(question)) AS q FROM ({SQL_ASKED}))) GROUP BY question_type")
def question_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).groupBy(Q.question_type(F.col("question")).alias("question_type")).agg(F.count("*").alias("n"))


def detail_rows(spark: SparkSession, d: str) -> DataFrame:
    dn, sp = pools(spark, d)
    lists = dn.where("rank <= 10").withColumn("method", F.lit("dense")).unionByName(sp.where("rank <= 10").withColumn("method", F.lit("sparse")))
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("domain"), F.lit("").alias("title"), F.lit("").alias("source_url"), "text")
    return analytics.details(lists, chunks, bench_questions(spark, d))


SQL_SUMMARY = SQL_BOTH + f""", l AS (SELECT query_id, chunk_id, rank, 'dense' AS method FROM dp WHERE rank <= 10 UNION ALL SELECT query_id, chunk_id, rank, 'sparse' FROM sp WHERE rank <= 10),
 g AS (SELECT method, query_id, lower(trim(b.text)) AS q, count(DISTINCT doc_id) AS dd, count(DISTINCT source) AS sd, max(length(trim(d.text))) AS longest, string_agg(d.text, chr(10) ORDER BY rank) AS blob
 FROM l JOIN documents d ON doc_id = chunk_id JOIN benchmark b ON item_id = query_id GROUP BY method, query_id, b.text),
 ty AS (SELECT *, {SQL_TYPE} AS question_type FROM g)"""


@query(SQL_SUMMARY + " SELECT query_id, method, question_type, dd AS doc_diversity, sd AS domain_diversity FROM ty")
def diversity_by_method(spark: SparkSession, d: str) -> DataFrame:
    return detail_rows(spark, d).select("query_id", "method", "question_type", "doc_diversity", "domain_diversity")


@query(SQL_SUMMARY + """ SELECT method, question_type, count(*) AS n_queries, round(avg(dd), 4) AS doc_diversity_mean, round(avg(sd), 4) AS domain_diversity_mean FROM ty GROUP BY GROUPING SETS ((method), (method, question_type))""")
def summary_by_method_type(spark: SparkSession, d: str) -> DataFrame:
    return analytics.summary(detail_rows(spark, d)).drop("evidence_proxy_rate")


SQL_HIT = r"""CASE question_type WHEN 'event_date' THEN regexp_matches(lb, '(^|[^\p{L}\p{N}_])((jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(t(ember)?)?|oct(ober)?|nov(ember)?|dec(ember)?)|(19|20)\d{2}|\d{1,2}:\d{2}\s*(am|pm)|am|pm)([^\p{L}\p{N}_]|$)')
 WHEN 'numeric' THEN regexp_matches(lb, '\d') WHEN 'list' THEN regexp_matches(blob, '(^|\n)\s*([-*•]|\d+\.)\s+') OR len(blob) - len(replace(blob, ',', '')) >= 3 OR len(blob) - len(replace(blob, ';', '')) >= 2
 WHEN 'entity_location' THEN CASE WHEN regexp_matches(q, 'website|url|site|webpage|web page') THEN regexp_matches(lb, '(^|[^\p{L}\p{N}_])[a-z0-9][a-z0-9.-]+\.(com|org|edu|gov|net|io)([^\p{L}\p{N}_]|$)')
 WHEN regexp_matches(q, 'where|located|location|address|pittsburgh') THEN contains(lb, 'pittsburgh, pa') OR regexp_matches(lb, '(^|[^\p{L}\p{N}_])\d{1,5}\s+[a-z0-9.\-''\s]{2,40}\s(st|street|ave|avenue|rd|road|blvd|boulevard|dr|drive|ln|lane|way|pkwy|parkway)([^\p{L}\p{N}_]|$)')
 ELSE longest > 60 END ELSE longest > 80 END"""


@query(SQL_SUMMARY + f" SELECT query_id, method, question_type, ({SQL_HIT})::INT AS evidence_proxy_hit FROM (SELECT *, lower(blob) AS lb FROM ty)")
def evidence_proxy(spark: SparkSession, d: str) -> DataFrame:
    return detail_rows(spark, d).select("query_id", "method", "question_type", "evidence_proxy_hit")


@query(SQL_SUMMARY + """ SELECT method, coalesce(round(avg(dd) FILTER (question_type = 'description'), 4), 0) AS description, coalesce(round(avg(dd) FILTER (question_type = 'event_date'), 4), 0) AS event_date,
 coalesce(round(avg(dd) FILTER (question_type = 'list'), 4), 0) AS list FROM ty GROUP BY method""")
def pivot_method_type(spark: SparkSession, d: str) -> DataFrame:
    return analytics.pivot(analytics.summary(detail_rows(spark, d)), "doc_diversity_mean", ["description", "event_date", "list"])


SQL_SHEET = """sheet AS (SELECT d.source AS kind, 'rag' AS side, CASE WHEN quality = 1 THEN 'Supported ' WHEN toxic = 1 THEN 'hallucinated' ELSE 'unknown' END AS label FROM labels JOIN documents d USING (doc_id)
 UNION ALL SELECT d.source, 'closed', CASE WHEN toxic = 1 THEN 's' WHEN quality = 0 THEN 'IDK' ELSE 'u' END FROM labels JOIN documents d USING (doc_id)),
 n AS (SELECT kind, side, CASE WHEN lower(trim(label)) IN ('supported', 's') THEN 'supported' WHEN lower(trim(label)) IN ('u', 'hallucinated') THEN 'unsupported' ELSE 'idk' END AS l FROM sheet),
 g AS (SELECT kind, side, count(*) AS labelled, count(*) FILTER (l = 'supported') AS supported, count(*) FILTER (l = 'unsupported') AS unsupported, count(*) FILTER (l = 'idk') AS idk FROM n GROUP BY kind, side),
 rt AS (SELECT *, round(coalesce(supported / nullif(labelled, 0), 0), 4) AS support_rate, round(coalesce(idk / nullif(labelled, 0), 0), 4) AS idk_rate, round(coalesce(unsupported / nullif(supported + unsupported, 0), 0), 4) AS hallucination_rate FROM g)"""


def rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("kind")), "doc_id")
    rag = F.when(F.col("quality") == 1, "Supported ").when(F.col("toxic") == 1, "hallucinated").otherwise("unknown")
    closed = F.when(F.col("toxic") == 1, "s").when(F.col("quality") == 0, "IDK").otherwise("u")
    both = F.array(F.struct(F.lit("rag").alias("side"), rag.alias("label")), F.struct(F.lit("closed").alias("side"), closed.alias("label")))
    return analytics.label_rates(rows.select("kind", F.explode(both).alias("x")).select("kind", "x.side", "x.label"), ["kind", "side"])


@query(f"WITH {SQL_SHEET} SELECT kind, side, labelled, supported, unsupported, idk, support_rate, idk_rate, hallucination_rate FROM rt")
def label_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(spark, d)


@query(f"""WITH {SQL_SHEET}, p AS (SELECT kind, side, support_rate AS s, idk_rate AS i, hallucination_rate AS h FROM rt)
 SELECT a.kind, round(a.s - b.s, 4) AS support_rate_delta, round(a.i - b.i, 4) AS idk_rate_delta, round(a.h - b.h, 4) AS hallucination_rate_delta FROM p a JOIN p b ON a.kind = b.kind AND a.side = 'rag' AND b.side = 'closed'""")
def label_delta(spark: SparkSession, d: str) -> DataFrame:
    return analytics.label_delta(rates(spark, d), "side", "rag", "closed", ["kind"])


SQL_EXAMPLES = """WITH r AS (SELECT doc_id::VARCHAR AS qid, quality AS hy, toxic AS de, quality * toxic AS sp, CASE WHEN doc_id % 9 = 0 THEN 'not sure' ELSE 'x' END AS a, CASE doc_id % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'x' ELSE '' END AS o, CASE WHEN doc_id % 2 = 0 THEN 'list' ELSE 'numeric' END AS t FROM labels),
 m AS (SELECT *, (lower(a) IN ('not sure') <> (lower(o) IN ('unknown', '')))::INT AS told FROM r),
 b AS (SELECT qid, 'hybrid_wins_dense' AS bucket, 0 AS told, '' AS t FROM m WHERE hy = 1 AND de = 0 UNION ALL SELECT qid, 'hybrid_wins_sparse', 0, '' FROM m WHERE hy = 1 AND sp = 0 UNION ALL SELECT qid, 'hybrid_failure_cases', 0, '' FROM m WHERE hy = 0 OR a = 'not sure'),
 p AS (SELECT bucket, qid, row_number() OVER (PARTITION BY bucket ORDER BY qid)::INT AS place FROM b
 UNION ALL SELECT 'hybrid_qwen_vs_hybrid_minilm', qid, row_number() OVER (ORDER BY told DESC, t DESC, qid DESC)::INT FROM m WHERE o <> '' AND a <> o), chosen AS (SELECT * FROM p WHERE place <= 2)"""


def examples(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    answer, other = F.when(i % 9 == 0, "not sure").otherwise("x"), F.when(i % 4 == 0, "y").when(i % 4 == 1, "Unknown").when(i % 4 == 2, "x").otherwise("")
    rows = table(spark, d, "labels").select(i.alias("qid"), F.col("quality").alias("hybrid_hit"), F.col("toxic").alias("dense_hit"), (F.col("quality") * F.col("toxic")).alias("sparse_hit"), answer.alias("answer"), other.alias("other_answer"), F.when(i % 2 == 0, "list").otherwise("numeric").alias("question_type"))
    return analytics.example_buckets(rows)


@query(SQL_EXAMPLES + " SELECT bucket, qid, place FROM chosen")
def example_buckets(spark: SparkSession, d: str) -> DataFrame:
    return examples(spark, d)


@query(SQL_EXAMPLES + """ SELECT CASE bucket WHEN 'hybrid_wins_dense' THEN 'Hybrid > Dense' WHEN 'hybrid_wins_sparse' THEN 'Hybrid > Sparse' WHEN 'hybrid_failure_cases' THEN 'Hybrid Failure' ELSE 'Hybrid GTE-Qwen vs Hybrid MiniLM' END AS bucket, qid,
 CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS question_type, coalesce(source, '') AS question FROM chosen LEFT JOIN documents ON doc_id::VARCHAR = qid""")
def example_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("question_type"), F.col("source").alias("question"))
    return analytics.example_rows(examples(spark, d), docs.where("qid % 3 = 0").drop("question"), docs.drop("question_type"))


@query("""WITH s AS (SELECT source AS stratum, count(*) AS n FROM documents GROUP BY source), x AS (SELECT *, 30.0::DOUBLE * n / sum(n) OVER () AS e FROM s),
 f AS (SELECT *, floor(e) AS base, round(e - floor(e), 9) AS rest FROM x), p AS (SELECT *, 30 - sum(base) OVER () AS lft, row_number() OVER (ORDER BY rest DESC, stratum DESC) AS place FROM f)
 SELECT stratum, n, (base + CASE WHEN place <= lft THEN 1 ELSE 0 END)::BIGINT AS take FROM p""")
def stratified_allocation(spark: SparkSession, d: str) -> DataFrame:
    return analytics.allocation(table(spark, d, "documents").groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("n")), 30)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unseen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


# --- fields, lists and depth -----------------------------------------------------------------------------------------------------

SQL_FIELD = "SELECT doc_id AS chunk_id, {w} AS w, {cap} AS cap, " + SQL_TOKENS.format(x="{x}") + " AS toks FROM documents"


@query("WITH f AS (" + " UNION ALL ".join(SQL_FIELD.format(w=w, cap=cap, x=x) for x, w, cap in (("source", 3, 48), ("lang", 2, 48), ("text", 1, 128))) + f"""),
 len AS (SELECT chunk_id, sum(len(toks) * w + least(cap, greatest(len(toks) - 1, 0)))::DOUBLE AS dl FROM f GROUP BY chunk_id), fig AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS l FROM len),
 p AS (SELECT chunk_id, w, unnest(toks) AS term FROM f), tf AS (SELECT chunk_id, term, sum(w)::DOUBLE AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
 q AS (SELECT item_id AS query_id, unnest({SQL_TOKENS.format(x="text || ' src' || (item_id % 20) || ' en'")}) AS term FROM benchmark), qt AS (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM q GROUP BY ALL),
 s AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / l))), 4) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (chunk_id), fig GROUP BY query_id, chunk_id)
 SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INT AS rank FROM s QUALIFY rank <= 10""")
def bm25_fields(spark: SparkSession, d: str) -> DataFrame:
    index = sparse.build(table(spark, d, "documents"), "doc_id", "text", "source", "lang", (3, 2, 1))
    asked_ = F.concat(F.col("text"), F.lit(" src"), (F.col("item_id") % 20).cast("string"), F.lit(" en"))
    return sparse.search(index, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), asked_.alias("question")), 10)


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({SQL_TOKENS.format(x='text')}) AS term FROM documents) GROUP BY term")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    return docs_index(spark, d).postings.groupBy("term").agg(F.count("*").alias("df"))


@query("WITH " + SQL_DENSE + f", p AS (SELECT *, {SQL_MM} AS m FROM dr WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)) SELECT query_id, chunk_id, round(m, 8) AS rel, rank FROM p WHERE rank <= 18")
def dense_only(spark: SparkSession, d: str) -> DataFrame:
    found = dense.search(bench_vectors(spark, d), vectors(spark, d), 50).withColumn("rel", F.round(sparse.minmax(F.col("score"), "query_id"), 8))
    return found.where("rank <= 18").select("query_id", "chunk_id", "rel", "rank")


@query(SQL_BM25 + f", pm AS (SELECT *, {SQL_MM} AS m FROM r WHERE rank <= 60 WINDOW w AS (PARTITION BY query_id)), o AS (SELECT query_id, chunk_id, round(m, 6) AS rel FROM pm) SELECT query_id, chunk_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, chunk_id DESC)::INT AS rank FROM o QUALIFY rank <= 18")
def sparse_only(spark: SparkSession, d: str) -> DataFrame:
    found = sparse.search(docs_index(spark, d), bench_questions(spark, d), 60)
    return fusion.no_mmr(fusion.stage1_relevance(found, None), 18)


@query(SQL_RRF + f", pm AS (SELECT *, {SQL_MM} AS m FROM fr WHERE rank <= 60 WINDOW w AS (PARTITION BY query_id)), o AS (SELECT query_id, chunk_id, round(m, 6) AS rel FROM pm) SELECT query_id, chunk_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, chunk_id DESC)::INT AS rank FROM o QUALIFY rank <= 10")
def no_mmr_rank(spark: SparkSession, d: str) -> DataFrame:
    return fusion.no_mmr(fusion.stage1_relevance(fused(spark, d, 60), None), 10)


@query(SQL_BM25 + f""", t AS (SELECT *, {SQL_MM} AS m FROM r WHERE rank <= 12 WINDOW w AS (PARTITION BY query_id)),
 c AS (SELECT query_id, coalesce(max(m) FILTER (rank = 1), 0) AS a, coalesce(max(m) FILTER (rank = 2), 0) AS b, coalesce(avg(m) FILTER (rank BETWEEN 3 AND 6), 0) AS e FROM t GROUP BY query_id),
 cf AS (SELECT query_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.55::DOUBLE * (a - b) + 0.25::DOUBLE * a + 0.2::DOUBLE * greatest(0.0::DOUBLE, a - e))), 6) AS confidence FROM c)
 SELECT query_id, CASE WHEN confidence < 0.5 THEN 160 ELSE 100 END AS k, CASE WHEN confidence < 0.5 THEN 80 ELSE 56 END AS stage1_k FROM cf""")
def adaptive_depth(spark: SparkSession, d: str) -> DataFrame:
    found = sparse.search(docs_index(spark, d), bench_questions(spark, d), 12)
    return fusion.adaptive_depth(fusion.confidence(found), below=0.5, deep_stage1=80).drop("confidence")


@query(SQL_RRF + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id // 7 ORDER BY rank) AS nth FROM fr WHERE rank <= 50)
 SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM o WHERE nth = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10""")
def doc_dedup(spark: SparkSession, d: str) -> DataFrame:
    got = fused(spark, d)
    doc_of = got.select("chunk_id").distinct().withColumn("doc_id", F.floor(F.col("chunk_id") / 7))
    return fusion.context(got.limit(0), got, doc_of, 10)


# --- time ------------------------------------------------------------------------------------------------------------------------


@query(r"""WITH q AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN 'Sold in ' || strftime(o_orderdate, '%b. %Y') WHEN 1 THEN 'Who came on ' || strftime(o_orderdate, '%d %B') WHEN 2 THEN 'How big is order ' || o_orderkey ELSE 'upcoming order ' || o_orderkey END AS t FROM orders),
 y AS (SELECT *, nullif(regexp_extract(t, '\b(?:19|20)\d{2}\b'), '') AS year FROM q)
 SELECT o_orderkey, year, CASE WHEN o_orderkey % 4 < 2 THEN lower(strftime(o_orderdate, '%B')) END AS month, year IS NOT NULL OR o_orderkey % 4 <> 2 AS is_temporal FROM y""")
def query_signals(spark: SparkSession, d: str) -> DataFrame:
    k, day, n = F.col("o_orderkey") % 4, F.col("o_orderdate"), F.col("o_orderkey").cast("string")
    q = F.when(k == 0, F.concat(F.lit("Sold in "), F.date_format(day, "MMM. yyyy"))).when(k == 1, F.concat(F.lit("Who came on "), F.date_format(day, "dd MMMM")))
    q = q.when(k == 2, F.concat(F.lit("How big is order "), n)).otherwise(F.concat(F.lit("upcoming order "), n))
    rows = table(spark, d, "orders").select("o_orderkey", T.query_signals(q).alias("s"))
    return rows.select("o_orderkey", F.get("s.years", 0).alias("year"), F.get("s.months", 0).alias("month"), F.col("s.is_temporal").alias("is_temporal"))


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '1990' ELSE strftime(o_orderdate, '%Y') END AS year, CASE WHEN o_orderkey % 3 = 0 THEN 'june' ELSE lower(strftime(o_orderdate, '%B')) END AS month, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS has_event_terms FROM orders""")
def temporal_metadata(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    body = F.concat(F.lit("Order placed in "), F.date_format("o_orderdate", "yyyy"), F.when(k % 5 == 0, " for the festival").otherwise(""))
    given = T.chunk_signals(F.lit("Orders"), F.date_format("o_orderdate", "MMMM"), body, F.when(k % 2 == 0, F.array(F.lit("1990"))).otherwise(none), F.when(k % 3 == 0, F.array(F.lit("June"))), k % 7 == 0)
    rows = table(spark, d, "orders").select("o_orderkey", given.alias("s"))
    return rows.select("o_orderkey", F.get("s.years", 0).alias("year"), F.get("s.months", 0).alias("month"), F.col("s.event").alias("has_event_terms"))


@query(SQL_RRF + f""", c0 AS (SELECT fr.query_id, fr.chunk_id, fr.score, dn.score AS cos FROM fr JOIN dn USING (query_id, chunk_id) WHERE fr.rank <= 60),
 mf AS (SELECT query_id, chunk_id, cos, {SQL_MM} AS mf FROM c0 WINDOW w AS (PARTITION BY query_id)), r0 AS (SELECT query_id, chunk_id, 0.8::DOUBLE * {SQL_MM.replace("score", "cos")} + 0.2::DOUBLE * mf AS rel0 FROM mf WINDOW w AS (PARTITION BY query_id)),
 ts AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN CASE WHEN chunk_id % 10 = 5 THEN 1.0::DOUBLE ELSE -0.15::DOUBLE END + CASE WHEN chunk_id % 3 = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + 0.1::DOUBLE ELSE 0.0::DOUBLE END AS t FROM r0),
 mt AS (SELECT *, {SQL_MM.replace("score", "t")} AS mt FROM ts WINDOW w AS (PARTITION BY query_id)), o AS (SELECT query_id, chunk_id, round(CASE WHEN query_id % 2 = 0 THEN 0.8::DOUBLE * rel0 + 0.2::DOUBLE * mt ELSE rel0 END, 6) AS rel FROM mt)
 SELECT query_id, chunk_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, chunk_id DESC)::INT AS rank FROM o QUALIFY rank <= 18""")
def temporal_rerank(spark: SparkSession, d: str) -> DataFrame:
    cand = fused(spark, d, 60).join(vectors(spark, d).select("chunk_id"), "chunk_id", "left_semi")
    pairs = cand.join(vectors(spark, d), "chunk_id").join(bench_vectors(spark, d).withColumnRenamed("embedding", "qe"), "query_id")
    dot = F.aggregate(F.zip_with("embedding", "qe", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    asked_ = bench_questions(spark, d).select("query_id", F.when(F.col("query_id") % 2 == 0, "held in 1995").otherwise("plain words").alias("question"))
    none = F.array().cast("array<string>")
    chunks = cand.select("chunk_id").distinct().select("chunk_id", *[F.lit("").alias(c) for c in ("title", "section_heading", "text")], F.array((F.col("chunk_id") % 10 + 1990).cast("string")).alias("years"), none.alias("months"), (F.col("chunk_id") % 3 == 0).alias("has_event_terms"))
    timed = presets.temporal_pairs(cand, asked_, chunks)
    return fusion.no_mmr(fusion.stage1_relevance(cand, pairs.select("query_id", "chunk_id", F.round(dot, 6).alias("cos")), timed), 18)


# --- documents, contexts and prompts ---------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, CASE WHEN contains(lower(url), 'a') THEN 'en.wikipedia.org' ELSE 'baseline' END AS domain, page_id % 3 = 0 OR page_id % 5 = 0 AS stop_sections, 'baseline:' || sha1(url) AS flat_id, 'web:' || page_id AS crawled_id FROM pages""")
def document_policy(spark: SparkSession, d: str) -> DataFrame:
    i, blank = F.col("page_id"), F.lit(None).cast("string")
    name = F.concat(F.when(F.lower("url").contains("a"), "X - Wikipedia").otherwise("x"), F.lit(".html"))
    stop = T.has_stop_sections(F.when(i % 3 == 0, "en.Wikipedia.org").otherwise("x.org"), blank, blank, F.when(i % 5 == 0, "Page - Wikipedia").otherwise("Wikipedia page"))
    return table(spark, d, "pages").select("page_id", T.file_domain(name).alias("domain"), stop.alias("stop_sections"), T.flat_doc_id(F.col("url")).alias("flat_id"), T.crawled_doc_id(F.lit("web"), F.concat(F.lit("raw/web/"), i.cast("string"), F.lit(".html"))).alias("crawled_id"))


@query("""SELECT source, count(*) AS scanned, count(*) FILTER (length(text) >= 200) AS kept FROM (SELECT 'crawl' AS source, text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'baseline_data', text FROM documents WHERE doc_id % 2 = 1) GROUP BY source""")
def long_enough(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    both = web.all_documents(docs.where("doc_id % 2 = 0").select("doc_id", "text"), docs.where("doc_id % 2 = 1").select("text", F.lit("f").alias("baseline_filename")))
    return both.groupBy("source").agg(F.count("*").alias("scanned"), F.count_if(F.length("text") >= 200).alias("kept"))


@query(r"""WITH RECURSIVE p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CASE WHEN page_id % 6 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 7 = 0 THEN 'image/png' ELSE 'Text/HTML; charset=utf-8' END AS raw FROM pages),
 u AS (SELECT url, status, CASE WHEN raw = 'image/png' THEN raw ELSE 'text/html' END AS content_type FROM p QUALIFY row_number() OVER (PARTITION BY url ORDER BY status, raw) = 1),
 e AS (SELECT url AS src, lead(url) OVER (PARTITION BY host ORDER BY page_id) AS dst FROM p), walk AS (SELECT DISTINCT url, 0 AS depth FROM p WHERE page_id < 25 UNION ALL SELECT dst, depth + 1 FROM walk JOIN e ON walk.url = src WHERE depth < 3 AND dst IS NOT NULL),
 b AS (SELECT url, min(depth)::INT AS depth FROM walk GROUP BY url), o AS (SELECT url, depth, status, content_type, sum((status = 200)::INT) OVER (ORDER BY depth, url ROWS UNBOUNDED PRECEDING) AS place FROM b JOIN u USING (url))
 SELECT url, depth, place::BIGINT AS place, status, content_type, status = 200 AS kept, status = 200 AND content_type <> 'text/html' AS skipped FROM o WHERE place <= 40""")
def crawl_budget(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    p = table(spark, d, "pages").select("page_id", "url", F.parse_url("url", F.lit("AUTHORITY")).alias("host"), F.when(i % 6 == 0, 404).otherwise(200).alias("status"), F.when(i % 7 == 0, "image/png").otherwise("Text/HTML; charset=utf-8").alias("content_type"))
    edges = p.select(F.col("url").alias("src"), F.lead("url").over(W.partitionBy("host").orderBy("page_id")).alias("dst")).where("dst is not null")
    rules = web.CrawlSettings("", [r["url"] for r in p.where("page_id < 25").select("url").collect()], max_pages=40, max_depth=3)
    return web.crawl(p, edges, rules)


@query(r"""SELECT doc_id, md5('[' || (doc_id % 5) || ']' || CASE WHEN doc_id % 3 = 0 THEN ' Title: ' || source || ' | URL: u' || doc_id WHEN doc_id % 3 = 1 THEN ' Section: ' || lang ELSE '' END || chr(10) || trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS passage_md5,
 md5(CASE WHEN doc_id % 3 = 0 THEN source || chr(10) WHEN doc_id % 3 = 1 THEN lang || chr(10) ELSE '' END || trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS embed_md5 FROM documents""")
def context_format(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    title, heading, url = F.when(i % 3 == 0, F.concat(F.lit(" "), F.col("source"))), F.when(i % 3 == 1, F.col("lang")).otherwise(" "), F.when(i % 3 == 0, F.concat(F.lit("u"), i.cast("string")))
    passage = presets.format_context(i % 5, title, heading, url, F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(passage).alias("passage_md5"), F.md5(T.embed_text(title, heading, F.col("text"))).alias("embed_md5"))


@query("SELECT doc_id, coalesce(source, '?') || '; ' || coalesce(lang, '?') AS answer FROM documents")
def answer_cleaning(spark: SparkSession, d: str) -> DataFrame:
    source, lang = F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?"))
    said = F.concat(F.lit(" Answer: Answers:\n- "), source, F.lit('\n2) "'), lang, F.lit('"\n\n* Final: '), F.upper(source), F.lit("\n"))
    return table(spark, d, "documents").select("doc_id", presets.clean_answer(said).alias("answer"))


SQL_PROMPT = SQL_BM25 + r""", c AS (SELECT query_id, rank, source, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS body FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 3)"""


@query(SQL_PROMPT + r""", j AS (SELECT query_id, string_agg('[' || rank || '] Title: ' || source || chr(10) || body, chr(10) || chr(10) ORDER BY rank) AS ctx FROM c GROUP BY query_id)
 SELECT query_id, md5('Context:' || chr(10) || ctx || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:') AS prompt_md5 FROM j JOIN benchmark ON item_id = query_id""")
def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    top = bm25_topk(spark, d).where("rank <= 3").join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text"), "chunk_id")
    one = F.struct("rank", presets.format_context(F.col("rank"), F.col("source"), F.lit(""), F.lit(""), F.col("text")).alias("p"))
    g = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["p"]).alias("ctx")).join(bench_questions(spark, d), "query_id")
    return g.select("query_id", F.md5(presets.answer_prompt(F.col("question"), F.col("ctx"))).alias("prompt_md5"))


@query(SQL_PROMPT + r""" SELECT query_id, rank, md5('Question: ' || text || chr(10) || chr(10) || 'Passage:' || chr(10) || 'Title: ' || source || chr(10) || trim(body[1:1000], ' ' || chr(10) || chr(9) || chr(13)) || chr(10) || chr(10) || 'Is this passage useful for answering the question? Answer:') AS prompt_md5 FROM c JOIN benchmark ON item_id = query_id""")
def rerank_prompts(spark: SparkSession, d: str) -> DataFrame:
    top = bm25_topk(spark, d).where("rank <= 3").join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text"), "chunk_id").join(bench_questions(spark, d), "query_id")
    return top.select("query_id", "rank", F.md5(fusion.rerank_prompt(F.col("question"), F.col("source"), F.lit(""), F.col("text"))).alias("prompt_md5"))


# --- evaluation sheets -----------------------------------------------------------------------------------------------------------

SQL_CELLS = ", ".join(f"coalesce(max(CASE WHEN rank = {i} THEN {x} END), '') AS ctx{i}_{c}" for i in (1, 2, 3) for c, x in (("chunk_id", "chunk_id::VARCHAR"), ("title", "lang"), ("domain", "source"), ("source_url", "'u' || doc_id"), ("snippet", "snip")))


@query("WITH " + SQL_DENSE + f""", c AS (SELECT query_id, rank, chunk_id, lang, source, doc_id, trim(replace(text, chr(10), ' ')) AS s FROM dr LEFT JOIN documents ON doc_id = chunk_id WHERE rank <= 3), n AS (SELECT *, CASE WHEN length(s) <= 220 THEN s ELSE rtrim(s[1:219]) || '…' END AS snip FROM c),
 w AS (SELECT query_id, {SQL_CELLS} FROM n GROUP BY query_id), q AS (SELECT *, lower(trim(text)) AS q FROM benchmark)
 SELECT item_id::VARCHAR AS qid, {SQL_TYPE} AS question_type, text AS question, CASE WHEN item_id % 2 = 0 THEN 'a' || item_id ELSE '' END AS closed_answer, CASE WHEN item_id % 3 = 0 THEN 'b' || item_id ELSE '' END AS rag_answer, '' AS closed_label, '' AS rag_label, '' AS annotation_notes, w.* EXCLUDE (query_id) FROM q JOIN w ON query_id = item_id""")
def faithfulness_sheet(spark: SparkSession, d: str) -> DataFrame:
    questions, i = bench_questions(spark, d), F.col("query_id")
    said = lambda letter, n: questions.where(i % n == 0).select(i.alias("qid"), F.concat(F.lit(letter), i.cast("string")).alias("answer"))
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("title"), F.col("source").alias("domain"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("source_url"), "text")
    top = dense_topk(spark, d).where("rank <= 3")
    return analytics.faithfulness_sheet(questions.join(top, "query_id", "left_semi"), said("a", 2), said("b", 3), top, chunks)


@query("""WITH r AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'unknown' ELSE source END AS kind, CASE WHEN toxic = 1 THEN 'supported' WHEN quality = 0 THEN 'idk' ELSE 'unsupported' END AS c, CASE WHEN quality = 1 THEN 'supported' WHEN toxic = 1 THEN 'unsupported' ELSE 'idk' END AS g FROM labels JOIN documents USING (doc_id)),
 u AS (SELECT kind, 'closed_book' AS side, c AS l FROM r UNION ALL SELECT kind, 'rag_hybrid_rrf', g FROM r), v AS (SELECT * FROM u UNION ALL SELECT NULL, side, l FROM u),
 n AS (SELECT kind, side, count(*) AS labelled, count(*) FILTER (l = 'supported') AS supported, count(*) FILTER (l = 'unsupported') AS unsupported, count(*) FILTER (l = 'idk') AS idk FROM v GROUP BY kind, side),
 t AS (SELECT *, round(supported / labelled, 4) AS support_rate, round(idk / labelled, 4) AS idk_rate, round(coalesce(unsupported / nullif(supported + unsupported, 0), 0), 4) AS hallucination_rate FROM n),
 k AS (SELECT kind, round(coalesce(max(support_rate) FILTER (side = 'rag_hybrid_rrf'), 0) - coalesce(max(support_rate) FILTER (side = 'closed_book'), 0), 4) AS support_rate_gain, round(coalesce(max(hallucination_rate) FILTER (side = 'closed_book'), 0) - coalesce(max(hallucination_rate) FILTER (side = 'rag_hybrid_rrf'), 0), 4) AS hallucination_rate_reduction FROM t GROUP BY kind)
 SELECT t.*, support_rate_gain, hallucination_rate_reduction FROM t JOIN k ON t.kind IS NOT DISTINCT FROM k.kind""")
def faithfulness_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    kind = F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("source"))
    closed = F.when(F.col("toxic") == 1, "s").when(F.col("quality") == 0, "IDK").otherwise("u")
    rag = F.when(F.col("quality") == 1, "Supported ").when(F.col("toxic") == 1, "hallucinated").otherwise("unknown")
    return analytics.faithfulness(rows.select(kind.alias("question_type"), closed.alias("closed_label"), rag.alias("rag_label")))


SQL_TOTALS = SQL_SUMMARY + ", tot AS (SELECT method, count(*) AS n_queries, round(avg(dd), 4) AS doc_diversity_mean, round(avg(sd), 4) AS domain_diversity_mean FROM ty GROUP BY method)"


@query(SQL_TOTALS + """ SELECT place::INT AS place, m AS method, coalesce(n_queries, 0) AS n_queries, coalesce(doc_diversity_mean, 0) AS doc_diversity_mean, coalesce(domain_diversity_mean, 0) AS domain_diversity_mean
 FROM (VALUES (0, 'sparse'), (1, 'dense'), (2, 'hybrid_rrf'), (3, 'hybrid_minmax')) v(place, m) LEFT JOIN tot ON method = m""")
def method_totals(spark: SparkSession, d: str) -> DataFrame:
    return analytics.all_methods(analytics.summary(detail_rows(spark, d)).drop("evidence_proxy_rate"), presets.METHODS)


@query(SQL_TOTALS + """ SELECT * FROM tot UNION ALL SELECT 'Delta (dense - sparse)', a.n_queries - b.n_queries, a.doc_diversity_mean - b.doc_diversity_mean, a.domain_diversity_mean - b.domain_diversity_mean FROM tot a JOIN tot b ON a.method = 'dense' AND b.method = 'sparse'""")
def embedder_ablation(spark: SparkSession, d: str) -> DataFrame:
    totals = analytics.summary(detail_rows(spark, d)).where("question_type is null").drop("question_type", "evidence_proxy_rate")
    return analytics.ablation(totals, "dense", "sparse", "Delta (dense - sparse)")


@query("""WITH h AS (SELECT doc_id AS qid, quality AS hybrid_hit, CASE WHEN doc_id % 2 = 0 THEN toxic END AS dense_hit, CASE WHEN doc_id % 3 = 0 THEN toxic END AS sparse_hit FROM labels WHERE doc_id % 5 <> 0) SELECT qid, dense_hit, sparse_hit, hybrid_hit FROM h""")
def joined_hits(spark: SparkSession, d: str) -> DataFrame:
    rows, i = table(spark, d, "labels"), F.col("doc_id")
    of = lambda method, n, left, hit: rows.where(i % n != 0 if left else i % n == 0).select(F.lit(method).alias("method"), i.alias("qid"), F.col(hit).alias("evidence_proxy_hit"))
    told = of("hybrid_rrf", 5, True, "quality").unionByName(of("dense", 2, False, "toxic")).unionByName(of("sparse", 3, False, "toxic"))
    return analytics.joined_hits(told, rows.select(i.alias("qid")))
