"""Mixing sources to target weights on a low-discrepancy schedule, with DataFrame operations only.

The mix is a sequence of slots of equally many words. The points of the base-2 van der Corput sequence are mapped through the
cumulative weights of the sources, in whole slots, so each source holds exactly its share of them, spread as evenly as the
sequence allows. A source's documents are shuffled by hash into a stream that is read up to `most` times and cut into blocks of
the same length; the k-th slot of a source takes its k-th block. The last block is cut where the target is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.llm.common import durable, fresh, word_count

#: Rows that one task orders at a time, in the two-level running sums and ranks.
CHUNK = 2_000


def targets(sizes: DataFrame, most: float = 3.0, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: _source, sid (1, 2, ... by code point, null last), docs (with words), source_size, target.

    The weights repeat over the sources and share all words; a target stops at `most` times its source's size, and what is over is
    shared again by weight until none is above. That is the level l at which min(most * size, weight * l) adds up to all words; with
    the sources in order of size per weight, those below the level come first, so running sums find it. The windows run over the
    summed table of sources, a row each.
    """
    s = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    s = s.withColumn("sid", F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy((F.col("cap") / F.col("w")).asc(), "sid")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    all_rows = W.partitionBy()
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("w").over(after)).withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "sid", "level"))).over(all_rows)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("found")))
    return s.withColumn("found", level).select("_source", "sid", "docs", "source_size", target.alias("target"))


def running(df: DataFrame, group: str, chunk: Column, order: list, value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the group before each row, in the order of (chunk, *order).

    Sums per chunk are added up first, so that a group with a third of all rows is spread over its chunks.
    """
    df = df.withColumn("_chunk", chunk)
    sums = df.groupBy(group, "_chunk").agg(F.sum(value).alias("_sum"))
    ahead = W.partitionBy(group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = W.partitionBy(group, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    df = df.join(sums, (F.col(group) == F.col("_g")) & (F.col("_chunk") == F.col("_c")))
    return df.withColumn(name, F.col("_in") + F.col("_ahead")).drop("_chunk", "_in", "_g", "_c", "_ahead")


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, sid, rank): the source of each slot and which of its blocks the slot takes, from 0.

    `sources` has sid, first (its first point) and quota (its points); `slots` is the sum of the quotas.
    """
    spark, bits = sources.sparkSession, max(1, (slots - 1).bit_length())
    cell = max(1, slots >> 10)  # points are matched to sources by cells, about a thousand of them
    cells = sources.where("quota > 0").select("sid", "first", "quota", F.explode(F.expr(f"sequence(first div {cell}, (first + quota - 1) div {cell})")).alias("cell"))
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
    points = spark.range(0, 1 << bits).select(F.col("id").alias("slot")).withColumn("point", point).where(F.col("point") < slots)
    held = points.withColumn("cell", F.expr(f"point div {cell}")).join(cells, "cell").where("point >= first and point < first + quota")
    return running(held.select("slot", "sid"), "sid", F.expr(f"slot div {CHUNK}"), ["slot"], F.lit(1), "rank").select("slot", "sid", "rank")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = 1024, most: int = 3,
        weights: tuple[float, ...] = (1, 2, 3), keep: list[str] | None = None, names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents with their part in the mix, and the mix itself.

    The first result has the columns of `docs` (or those in `keep`) and _row, size, source_size, target and taken: the words of the
    document and of its source, the source's target, and the words that the mix takes of the document, repeats counted, which are
    at most `most` times its size. `names` gives them other names. The second lists what each slot takes: slot, _row, pass, from_word,
    to_word.

    A source's taken words are its target rounded to whole words. A null text has no words and is never taken, nor is an empty
    one; a null source is a source, last in order. Repeated rows are documents of their own. Ties of the shuffle go by key, text and
    size, so reruns agree. Columns of `docs` named like the new ones are replaced. An empty table gives empty results.
    """
    named = {c: c for c in ("_row", "size", "source_size", "target", "taken")} | (names or {})
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in named.values()]
    row, own, hashed, of, size = (fresh(c) for c in ("row", "key", "hash", "source", "size"))
    facts = {row: F.monotonically_increasing_id(), own: F.col(key), hashed: F.xxhash64(F.col(key), F.col(text), F.lit(11)), of: F.col(source), size: word_count(F.col(text))}
    rows = durable(docs.withColumns(facts).select(*kept, *facts))
    plain = {row: "_row", own: "_key", hashed: "_hash", of: "_source", size: "size"}
    sizes = rows.select(*[F.col(a).alias(b) for a, b in plain.items()])
    goal = targets(sizes, most, weights).withColumn("words", F.least(F.round("target"), F.col("source_size") * most).cast("long"))
    goal = goal.withColumn("quota", F.ceil(F.col("words") / block).cast("long"))
    goal = durable(goal.withColumn("first", F.sum("quota").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)) - F.col("quota")))
    slots = goal.agg(F.sum("quota")).first()[0] or 0
    # As many chunks as a source's rows ask for, so that no chunk of any source is much larger than another.
    its = goal.select(F.col("_source").alias("_s"), "sid", "source_size", "words", F.greatest(F.lit(1), F.ceil(F.col("docs") / CHUNK)).alias("chunks"))
    stream = sizes.where("size > 0").join(its, F.col("_source").eqNullSafe(F.col("_s")))
    stream = running(stream, "sid", F.pmod(F.col("_hash"), F.col("chunks")), ["_hash", "_key", "size", "_row"], F.col("size"), "start")
    reads = stream.withColumn("pass", F.explode(F.expr(f"sequence(0, {most - 1})"))).withColumn("from_", F.col("pass") * F.col("source_size") + F.col("start"))
    reads = reads.where("from_ < words").withColumn("to_", F.least(F.col("from_") + F.col("size"), "words"))
    cut = reads.withColumn("rank", F.explode(F.expr(f"sequence(from_ div {block}, (to_ - 1) div {block})")))
    lo, hi = F.greatest("from_", F.col("rank") * block), F.least("to_", (F.col("rank") + 1) * block)
    parts = cut.select("_row", "sid", "rank", "pass", (lo - F.col("from_")).alias("from_word"), (hi - F.col("from_")).alias("to_word"))
    mixed = parts.join(schedule(goal.select("sid", "first", "quota"), slots), ["sid", "rank"]).select("slot", "_row", "pass", "from_word", "to_word")
    got, aim, total, taken = (fresh(c) for c in ("source", "target", "total", "taken"))
    sums = mixed.groupBy(F.col("_row").alias(row)).agg(F.sum(F.col("to_word") - F.col("from_word")).alias(taken))
    per = goal.select(F.col("_source").alias(got), F.col("source_size").alias(total), F.col("target").alias(aim))
    out = rows.join(per, F.col(of).eqNullSafe(F.col(got))).join(sums, row, "left")
    made = {"_row": F.col(row), "size": F.col(size), "source_size": F.col(total), "target": F.col(aim), "taken": F.coalesce(F.col(taken), F.lit(0)).cast("long")}
    return out.select(*kept, *[c.alias(named[n]) for n, c in made.items()]), mixed
