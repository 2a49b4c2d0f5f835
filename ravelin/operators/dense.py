"""Exact inner-product search: numpy over Arrow batches, the best k kept per task before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators.sparse import best, ranked

#: Questions are searched in blocks of this many, so that what is sent to the executors is bounded.
BLOCK = 20_000
#: Vectors and questions that are multiplied at once.
ROWS, QUESTIONS = 4096, 1024


def l2_normalize(v: Column) -> Column:
    """v / max(|v|, 1e-12)."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def usable(embedding: Column) -> Column:
    """Whether a vector is there and has no null or non-finite component."""
    return F.coalesce(F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False)) & (F.size(embedding) > 0)


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, score, rank) from (query_id, embedding) and (chunk_id, embedding); ties to the larger chunk id.

    Vectors that are null, empty or hold a null or non-finite component take no part; a question meets the vectors of its own length.
    """
    spark = queries.sparkSession
    numbered = queries.where(usable(F.col("embedding"))).select("query_id", F.col("embedding").cast("array<double>").alias("e"))
    found = spark.createDataFrame([], "query_id long, chunk_id long, score double")
    for size in numbered.groupBy(F.size("e").alias("d")).count().collect():  # the lengths in use are few
        blocks = max(1, -(-size["count"] // BLOCK))
        own = numbered.where(F.size("e") == size["d"])
        fit = vectors.where(usable(F.col("embedding")) & (F.size("embedding") == size["d"])).select(F.col("chunk_id").cast("long"), F.col("embedding").cast("array<double>"))
        for i in range(blocks):
            rows = (own if blocks == 1 else own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).collect()  # about BLOCK rows
            sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), np.array([r["e"] for r in rows], np.float64)))

            def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                names, q = sent.value
                top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                for batch in batches:
                    ids, flat = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()
                    x = flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, q.shape[1]))
                    parts = [top]
                    for at in range(0, len(x), ROWS):
                        for first in range(0, len(q), QUESTIONS):
                            scores = np.round(x[at : at + ROWS] @ q[first : first + QUESTIONS].T, digits)
                            n = len(scores)
                            least = np.partition(scores, n - k, axis=0)[n - k] if n > k else np.full(scores.shape[1], -np.inf)
                            row, j = np.nonzero(scores >= least)
                            parts.append((j + first, ids[at + row], scores[row, j]))
                    top = best(*(np.concatenate(c) for c in zip(*parts, strict=True)), k)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(names[top[0]], pa.int64()), "chunk_id": pa.array(top[1], pa.int64()), "score": pa.array(top[2], pa.float64())})

            found = found.unionByName(fit.mapInArrow(scan, "query_id long, chunk_id long, score double"))
    return ranked(found, "query_id", [F.desc("score"), F.desc("chunk_id")], k)
