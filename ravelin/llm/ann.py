"""Approximate nearest neighbours with a hierarchical navigable small-world graph per shard.

Equal vectors are one point that carries its smallest ids, as many as a result can show, so copies neither crowd a graph nor cut it
off. Points are dealt to shards of bounded size by hash. A shard's graph is built in bulk: each layer holds a hash-drawn share of
the points, and each point's nearest ones in the layer are thinned to those nearer to it than to each other, with links back. It is
stored as flat arrays: vectors, ids, and per layer a row of neighbour numbers for each point. Queries walk the layers of every shard
in blocks, all queries of a block in step; the shards' results are measured in double precision and merged.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.llm.common import durable

LINKS = 16  # per point and layer, twice as many in the lowest
NEAR = 64  # points looked at for them


def _near(vectors: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """For each point of `among`, the k others of it nearest to it, as positions in it."""
    x = vectors[among].astype(np.float32)
    norm, out = (x * x).sum(axis=1), []
    for i in range(0, len(x), 512):
        d = norm[None] - 2 * (x[i : i + 512] @ x.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(x) else np.argsort(d, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable")
        out.append(np.take_along_axis(part, order, 1))
    return np.concatenate(out)


def _thin(x: np.ndarray, points: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row of `near`, nearest first and -1 for none, up to `most` that are nearer to the point than to any taken before; -1 after them."""
    out = np.full((len(points), most), -1, np.int64)
    for i in range(0, len(points), 256):
        c, have = near[i : i + 256], near[i : i + 256] >= 0
        v = x[np.maximum(c, 0)]
        own = ((v - x[points[i : i + 256]][:, None]) ** 2).sum(axis=2)
        sq = (v * v).sum(axis=2)
        gap = sq[:, :, None] + sq[:, None] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        taken_at, count, at = np.full(own.shape, np.inf, np.float32), np.zeros(len(c), np.int64), np.arange(len(c))
        for j in range(c.shape[1]):
            take = have[:, j] & (taken_at[:, j] > own[:, j]) & (count < most)
            rows = at[take]
            out[i + rows, count[rows]] = c[rows, j]
            count[rows] += 1
            taken_at[rows] = np.minimum(taken_at[rows], gap[rows, j])
    return out


def build(vectors: np.ndarray, seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the lowest up: the points in each, and their neighbours as point numbers, -1 padded."""
    n, layers = len(vectors), []
    x = vectors.astype(np.float32)
    height = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(np.int64)
    for level in range(int(height.max()) + 1):
        points = np.flatnonzero(height >= level)
        most = LINKS * 2 if level == 0 else LINKS
        if len(points) == 1:
            layers.append((points, np.full((1, 1), -1, np.int64)))
            break
        near = points[_near(x, points, min(NEAR, len(points) - 1))]
        chosen = _thin(x, points, near, LINKS)
        # Links back, as far as there is room, nearest first; what does not fit is thinned again.
        a, b = np.repeat(points, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        edges = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)
        d = ((x[edges[:, 0]] - x[edges[:, 1]]) ** 2).sum(axis=1)
        order = np.lexsort((edges[:, 1], d, edges[:, 0]))
        edges = edges[order]
        starts = np.searchsorted(edges[:, 0], points)
        degree = np.diff(np.append(starts, len(edges)))
        wide = np.full((len(points), max(int(degree.max()), 1)), -1, np.int64)
        wide[np.arange(wide.shape[1]) < degree[:, None]] = edges[:, 1]
        full = np.full((len(points), most), -1, np.int64)
        full[:, : min(most, wide.shape[1])] = wide[:, :most]
        over = np.flatnonzero(degree > most)
        if len(over):
            again = _thin(x, points[over], wide[over, : 4 * most], most)
            spare = wide[over, :most]
            full[over] = np.where(again >= 0, again, spare)  # thinned rows keep near ones in the places left
        layers.append((points, full))
    return layers


def search(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, beam: int) -> np.ndarray:
    """For each query, the points that a walk with `beam` candidates ends with; -1 padded."""
    x, q = vectors.astype(np.float32), queries.astype(np.float32)
    at = np.full(len(q), layers[-1][0][0])
    row_of = np.full(len(x), -1, np.int64)
    for points, links in layers[:0:-1]:
        row_of[points] = np.arange(len(points))
        best = ((x[at] - q) ** 2).sum(axis=1)
        moving = np.arange(len(q))
        while len(moving):
            c = links[row_of[at[moving]]]
            d = np.where(c >= 0, ((x[np.maximum(c, 0)] - q[moving][:, None]) ** 2).sum(axis=2), np.inf)
            j = d.argmin(axis=1)
            better = d[np.arange(len(j)), j] < best[moving]
            moving, c, d, j = moving[better], c[better], d[better], j[better]
            at[moving], best[moving] = c[np.arange(len(j)), j], d[np.arange(len(j)), j]
    links = layers[0][1]
    rows = np.arange(len(q))
    found, dist, done = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), np.inf, np.float32), np.ones((len(q), beam), bool)
    found[:, 0], dist[:, 0], done[:, 0] = at, ((x[at] - q) ** 2).sum(axis=1), False
    seen = np.zeros((len(q), len(x)), bool)
    seen[rows, at] = True
    live = rows
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        j = open_.argmin(axis=1)
        go = np.isfinite(open_[np.arange(len(j)), j])
        live, j = live[go], j[go]
        if not len(live):
            break
        done[live, j] = True
        c = links[found[live, j]]
        new = (c >= 0) & ~seen[live[:, None], np.maximum(c, 0)]
        seen[live[:, None].repeat(c.shape[1], 1)[new], c[new]] = True
        d = np.where(new, ((x[np.maximum(c, 0)] - q[live][:, None]) ** 2).sum(axis=2), np.inf).astype(np.float32)
        all_d, all_c = np.concatenate([dist[live], d], 1), np.concatenate([found[live], c], 1)
        all_done = np.concatenate([done[live], ~new], 1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live], found[live], done[live] = (np.take_along_axis(y, keep, 1) for y in (all_d, all_c, all_done))
    return np.where(np.isfinite(dist), found, -1)


def points(vectors: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """(v, ids): each distinct usable vector, in double precision, with its `most` smallest keys.

    Not usable: null, empty or zero vectors, and those with a null or non-finite component.
    """
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.where(F.coalesce(fine, F.lit(False)) & F.col(key).isNotNull()).select(F.transform(v, lambda c: c + F.lit(0.0)).alias("v"), F.col(key).alias("id"))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= most)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, shard_rows: int = 16_384) -> DataFrame:
    """One row per shard: part, dim, points, k, graph (the flat arrays). Vectors of different lengths are in different shards.

    `k` is the most neighbours that will be asked for: of equal vectors, k + 1 ids are kept, as many as a result can show.
    """
    ids = k + 1
    pts = durable(points(vectors, key, vector, ids))
    shards = max(1, -(-pts.count() // shard_rows))
    dealt = pts.withColumns({"dim": F.size("v"), "part": F.pmod(F.xxhash64("v"), F.lit(shards))})

    def make(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("ids", key=lambda c: c.map(lambda a: a[0]))
        x = np.array(of["v"].tolist(), np.float64)
        held = [list(a) for a in of["ids"]]
        layers = build(x)
        arrays = {"x": x, "ids": np.array([i for a in held for i in a], np.int64), "at": np.concatenate([[0], np.cumsum([len(a) for a in held])])}
        arrays |= {f"{kind}{k}": a.astype(np.int32) for k, pair in enumerate(layers) for kind, a in zip("pn", pair, strict=True)}
        out = io.BytesIO()
        np.savez(out, **arrays)
        return pd.DataFrame({"part": of["part"][:1], "dim": of["dim"][:1], "points": [len(x)], "graph": [out.getvalue()]})

    graphs = dealt.groupBy("dim", "part").applyInPandas(make, "part long, dim int, points long, graph binary")
    return durable(graphs.select("part", "dim", "points", F.lit(k).alias("k"), "graph"))


def nearest(queries: DataFrame, graphs: DataFrame, k: int = 10, beam: int = 96, key: str = "vec_id", vector: str = "embedding", block: int = 16_384, step: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query but itself, by Euclidean distance; ties to smaller ids.

    A query that is not usable (see `points`) has no rows; one with fewer candidates has as many rows. Equal queries are searched once.
    An empty index or query table gives an empty result; asking for more neighbours than the index was made for is an error. Each
    (shard, block of queries) is one task's work, `step` queries at a time, so a shard's graph travels once for `block` queries.
    """
    if (made := graphs.agg(F.min("k")).first()[0]) is not None and made < k:
        raise ValueError(f"the index holds ids for {made} neighbours, not {k}")
    v = F.transform(F.col(vector), lambda c: c.cast("double") + F.lit(0.0))
    asked = durable(queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query_id"), v.alias("v")))
    wanted = points(asked, "query_id", "v", 1).select("v", F.col("ids")[0].alias("q"))
    wanted = durable(wanted)
    blocks = max(1, -(-wanted.count() // block))
    dealt = wanted.withColumns({"block": F.pmod(F.hash("q"), F.lit(blocks)).cast("int"), "dim": F.size("v")})
    # The stated queries against all rows, in blocks: every shard meets every block of its length once.
    parts = graphs.groupBy("dim").agg(F.collect_list("part").alias("parts"))
    ask = dealt.join(parts, "dim").select("dim", "block", "q", "v", F.explode("parts").alias("part"))
    hold = graphs.select("dim", "part", "graph", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def walk(index_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(index_rows) or not len(query_rows):
            return empty
        a = np.load(io.BytesIO(index_rows["graph"].iloc[0]))
        x, ids, at = a["x"], a["ids"], a["at"]
        layers = [(a[f"p{i}"].astype(np.int64), a[f"n{i}"].astype(np.int64)) for i in range(sum(name.startswith("p") for name in a.files))]
        q = np.array(query_rows["v"].tolist(), np.float64)
        hits = np.concatenate([search(x, layers, q[i : i + step], max(beam, k + 1)) for i in range(0, len(q), step)])
        who, slot = np.nonzero(hits >= 0)
        point = hits[who, slot]
        score = np.sqrt(((x[point] - q[who]) ** 2).sum(axis=1))
        n = at[point + 1] - at[point]
        spread = np.repeat(at[point] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = pd.DataFrame({"q": query_rows["q"].to_numpy()[np.repeat(who, n)], "vec_id": ids[spread], "score": np.repeat(score, n)})
        out = out.sort_values(["q", "score", "vec_id"])
        return out[out.groupby("q").cumcount() <= k]

    grouped = hold.groupBy("dim", "part", "block").cogroup(ask.groupBy("dim", "part", "block"))
    found = grouped.applyInPandas(walk, "q long, vec_id long, score double")
    order = W.partitionBy("q").orderBy("score", "vec_id")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("hits"))
    per = best.join(wanted, "q").select("v", "hits")
    rows = asked.join(per, "v").select("query_id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k).alias("hits"))
    return rows.select("query_id", F.posexplode("hits").alias("p", "h")).select("query_id", (F.col("p") + 1).alias("rank"), "h.vec_id", "h.score")
