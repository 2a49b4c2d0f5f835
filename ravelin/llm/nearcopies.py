"""Groups of near copies: texts whose sets of word shingles have a Jaccard similarity of `least` or more.

SimHash over the same shingles, with its covering tables, finds the nearest copies: fingerprints within two bits. It cannot reach 0.8:
such pairs differ in about 10 of 64 bits, some in 16, and tables that cover so many positions look at three or four bits each. So
BANDS bands of ROWS minima retrieve the rest. A pair at 0.8 meets in no band with probability (1 - 0.8 ** 4) ** 28 < 1e-6, one at 0.9
with less than 1e-12. Exact sets decide on every pair of either kind.

Buckets are not paired as they are. First every member is compared with its bucket's pivot, the one that meets most others in all
bands, as the text that a group was copied from does. Only buckets that still hold several groups go on: their members outside the
largest group are compared with all others there, in tiles of bounded size, each of which gives back no more links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import durable, fresh, text_chunks
from ravelin.llm.simhash import SEED, components, links, majority, shingle_hashes

BANDS, ROWS = 28, 4
#: Members of either side of a tile.
TILE = 512
FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def identity(s: np.ndarray) -> int:
    """A number for a set, signed."""
    return xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), BANDS) of signed keys; `sets` are not empty."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    if sets:
        h, first = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for i, f in enumerate(FACTORS):
            b = i // ROWS
            if i % ROWS == 0:
                out[:, b] = b
            out[:, b] = (out[:, b] ^ np.minimum.reduceat(h * f, first)) * MIX
            out[:, b] ^= out[:, b] >> np.uint64(29)
    return out.view(np.int64)


def _sketch(shingle: int):
    kind = pa.struct([("s", pa.int64()), ("n", pa.int32()), ("f", pa.int64()), ("keys", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<s long, n int, f long, keys array<long>>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [pa.array([], kind)]
            for some in text_chunks(texts):
                hashes = [shingle_hashes(t, shingle) for t in some.to_pylist()]
                prints = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
                sets = [np.unique(h) for h in hashes]
                n = np.array([len(s) for s in sets], np.int32)
                keys = band_keys([s for s in sets if len(s)])
                ends = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                parts.append(pa.StructArray.from_arrays([pa.array([identity(s) for s in sets], pa.int64()), pa.array(n), pa.array(prints), lists], fields=list(kind)))
            yield pa.concat_arrays(parts)

    return sketch


def _members(shingle: int):
    @F.arrow_udf("struct<s long, hs array<long>>")
    def members(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [pa.array([], pa.struct([("s", pa.int64()), ("hs", pa.list_(pa.int64()))]))]
            for some in text_chunks(texts):
                sets = [np.unique(shingle_hashes(t, shingle)) for t in some.to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                parts.append(pa.StructArray.from_arrays([pa.array([identity(s) for s in sets], pa.int64()), lists], ["s", "hs"]))
            yield pa.concat_arrays(parts)

    return members


def common_counts(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many elements each two of the sets share, as products of indicator matrices over some columns at a time."""
    n, owner = len(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    owner, column = owner[several], rank[column[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [first, first + columns])
        rows, at = np.unique(owner[lo:hi], return_inverse=True)
        x = np.zeros((len(rows), columns), np.float32)
        x[at, column[lo:hi] - first] = 1
        out[np.ix_(rows, rows)] += x @ x.T
    return out


def forest(s: np.ndarray, g: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between members of different groups at `least` or more, as few as join what is joined by them."""
    size, same = np.array([len(x) for x in sets], np.float32), common_counts(sets)
    a, b = np.nonzero(np.triu((same >= least * (size[:, None] + size[None] - same)) & (g[:, None] != g[None]), 1))
    root = {x: x for x in g.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(int(g[i])), find(int(g[j]))
        if x != y:
            root[x] = y
            out.append((int(s[i]), int(s[j])))
    return out


def _crowded(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) found in tiles among the members (k, s, g) of buckets with several groups.

    With m members in the largest group and u outside, a bucket has (u / TILE) * (m / TILE) + (u / TILE) ** 2 / 2 tiles.
    """
    per = members.groupBy("k", "g").agg(F.count("*").alias("m")).groupBy("k").agg(F.max(F.struct("m", "g")).alias("top"), F.sum("m").alias("all"))
    tiles = lambda c: F.ceil(c / TILE).cast("int")
    dealt = members.join(per.select("k", F.col("top.g").alias("main"), tiles(F.col("top.m")).alias("nm"), tiles(F.col("all") - F.col("top.m")).alias("nu")), "k")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("s", F.lit(7)), F.when(F.col("g") == F.col("main"), F.col("nm")).otherwise(F.col("nu"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # Tile (i, j) with j >= 0 holds the i-th part of those outside and the j-th of the largest group; (i, -1 - j) two parts of those outside.
    inside = F.transform(upto("nu"), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    outside = F.concat(
        F.transform(upto("nm"), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))),
        F.transform(F.filter(upto("nu"), lambda i: i != F.col("own")), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), (-1 - F.greatest(i, F.col("own"))).alias("j"))),
    )
    placed = dealt.select("k", "s", "g", F.explode(F.when(F.col("g") == F.col("main"), inside).otherwise(outside)).alias("t"))

    def link(of: pd.DataFrame) -> pd.DataFrame:
        found = forest(of["s"].to_numpy(), of["g"].to_numpy(), [np.asarray(x) for x in of["hs"]], least)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return placed.select("k", "s", "g", "t.i", "t.j").join(sets, "s").groupBy("k", "i", "j").applyInPandas(link, "a long, b long")


def with_roots(docs: DataFrame, text: str, root: str, shingle: int = 5, least: float = 0.8, keep: list[str] | None = None) -> DataFrame:
    """Adds `root`, a number that the documents of a group share and others do not; see `with_groups`."""
    sk, tx, s = fresh("sketch"), fresh("text"), fresh("set")
    kept = [c for c in (docs.columns if keep is None else keep) if c != root]
    rows = docs.withColumns({sk: _sketch(shingle)(F.col(text)), tx: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    n, f, keys = fresh("n"), fresh("f"), fresh("keys")
    rows = durable(rows.select(*kept, tx, F.col(f"{sk}.s").alias(s), F.col(f"{sk}.n").alias(n), F.col(f"{sk}.f").alias(f), F.col(f"{sk}.keys").alias(keys)))
    nodes = durable(rows.groupBy(F.col(s).alias("s"), F.col(n).alias("n")).agg(F.min(tx).alias("tx"), F.min(f).alias("f"), F.min(keys).alias("keys")))
    keyed = nodes.select("s", "n", "tx", F.explode("keys").alias("k"))
    # Alone in its bucket: no candidate.
    shared = durable(keyed.join(keyed.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "k"))
    crowd = shared.groupBy("s").agg(F.sum("c").alias("crowd"))
    pivots = shared.join(crowd, "s").groupBy("k").agg(F.max(F.struct("crowd", "s", "n")).alias("p"))
    # One text of each set that has candidates; copies are folded before texts move.
    wanted = shared.select("tx").distinct()
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("tx", F.xxhash64("t")).join(wanted, "tx", "left_semi").dropDuplicates(["tx"])
    sets = durable(texts.select(_members(shingle)(F.col("t")).alias("m")).select("m.s", "m.hs").dropDuplicates(["s"]))

    def sized(a, b):
        return F.least(a, b) >= F.lit(least) * F.greatest(a, b)

    to_pivots = shared.join(pivots, "k").where((F.col("s") != F.col("p.s")) & sized(F.col("n"), F.col("p.n"))).select(F.col("p.s").alias("a"), F.col("s").alias("b"))
    # SimHash links: fingerprints within two bits, each through the least set that has it.
    first = durable(nodes.where("n > 0").groupBy("f").agg(F.min("s").alias("s")))
    same = nodes.join(first.select("f", F.col("s").alias("a")), "f").where(F.col("s") != F.col("a")).select("a", F.col("s").alias("b"))
    near = links(first.select("f")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    near = near.join(first.select(F.col("f").alias("fa"), F.col("s").alias("a")), "fa").join(first.select(F.col("f").alias("fb"), F.col("s").alias("b")), "fb").select("a", "b")
    pairs = to_pivots.union(same).union(near).distinct()
    both = pairs.join(sets.select(F.col("s").alias("b"), F.col("hs").alias("hb")), "b").join(sets.select(F.col("s").alias("a"), F.col("hs").alias("ha")), "a")
    common = F.size(F.array_intersect("ha", "hb"))
    edges = durable(both.where(common >= F.lit(least) * (F.size("ha") + F.size("hb") - common)).select("a", "b"))
    found = components(edges)
    named = durable(shared.select("k", "s").join(found, F.col("s") == F.col("node"), "left").select("k", "s", F.coalesce("root", "s").alias("g")))
    # Buckets of the same members, as near copies have in many bands, are looked at once.
    member = F.xxhash64("s", F.lit(3))
    several = named.groupBy("k").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("c"), F.bit_xor(member).alias("x"), F.bit_xor(F.xxhash64("s", F.lit(5))).alias("y")).where("lo < hi")
    once = several.groupBy("c", "x", "y").agg(F.min("k").alias("k")).select("k")
    edges = durable(edges.union(_crowded(named.join(once, "k"), sets, least)))
    joined = nodes.select("s").join(components(edges), F.col("s") == F.col("node"), "left").select(F.col("s").alias(s), F.coalesce("root", "s").alias(root))
    return rows.select(*kept, s).join(joined, s).drop(s)


def with_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", group: str = "group", shingle: int = 5, least: float = 0.8, keep: list[str] | None = None) -> DataFrame:
    """Adds `group`: the least `key` reachable over pairs of texts with a Jaccard similarity of `least` or more, its own included.

    A null text counts as empty; texts without words are copies of each other. Equal sets are one node, so that a group of copies,
    however large, costs one row; repeated rows get one group; null keys take part but name a group only if it has no other.
    A column named like the new one is replaced; an empty table stays empty. `keep` lists the columns of `docs` to carry (default all).
    """
    root, own, low = fresh("root"), fresh("key"), fresh("low")
    kept = [c for c in (docs.columns if keep is None else keep) if c != group]
    rows = with_roots(docs.withColumn(own, F.col(key)), text, root, shingle, least, [*kept, own])
    named = rows.groupBy(root).agg(F.min(own).alias(low))
    return rows.join(named, root).withColumn(group, F.col(low)).select(*kept, group)
