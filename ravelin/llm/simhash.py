"""SimHash near-duplicates, found by covering locality-sensitive hashing.

For radius r, every bit position gets a non-zero vector of r + 1 bits. Each of the 2**(r+1) - 1 non-zero vectors v names a table,
which looks at the positions whose vector has an odd inner product with v. Any r positions leave some v with even products to
all of them, so two fingerprints that differ in r bits or fewer agree in what some table looks at: no pair is missed.

Within a bucket of a table, links are found without pairing all members: two fingerprints are within distance 2 exactly if the
balls of radius 1 around them meet. Small buckets are compared pairwise; each member of a larger one names the points of its ball,
and those that name one point are linked to the least of them. The cost is a fixed number of rows per member either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import durable, fresh

SEED = 42
BITS = 64


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 of a text's runs of `shingle` words, in order; fewer words are one run. A-Z alone are lowered, ASCII white space alone splits."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, k, digest = b" ".join(words), min(shingle, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(h: np.ndarray) -> np.uint64:
    """The bits that are set in over half the hashes; zero without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    """SimHash of each text as uint64."""
    return np.array([majority(shingle_hashes(t, shingle)) for t in texts], np.uint64)


def covering_masks(radius: int = 2, bits: int = BITS) -> list[int]:
    """The masks of the 2**(radius + 1) - 1 tables, as signed 64-bit numbers."""
    n = 1 << (radius + 1)
    vector = [1 + (i * 5 + i // (n - 1)) % (n - 1) for i in range(bits)]  # each non-zero vector as often as the next, spread out
    masks = [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


@F.arrow_udf(T.LongType())
def simhash3(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """SimHash over 3-word shingles as a signed number."""
    for texts in batches:
        yield pa.array(np.concatenate([fingerprints(texts.slice(i, 500).to_pylist(), 3) for i in range(0, len(texts), 500)] or [np.zeros(0, np.uint64)]).view(np.int64))


def links(prints: DataFrame, radius: int = 2, crowd: int = 48) -> DataFrame:
    """Pairs (a < b) of distinct values of `prints.f` whose links join all that differ in `radius` bits or fewer.

    A pair within the radius is either listed, or both its members are listed with one common member that is as near to both.
    `radius` is 1 or 2; `crowd` bounds the members of a bucket that are compared pairwise.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    masks = covering_masks(radius)
    keyed = prints.select("f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    # Alone in its bucket: no candidate. The counts are summed before the shuffle, so a hot bucket is a few rows.
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["t", "key"])
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    few = shared.where(F.col("n") <= crowd).groupBy("t", "key").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    heads = few.select("fs", F.explode("fs").alias("a"))
    pairs = heads.select("a", F.explode(F.filter("fs", lambda b: (b > F.col("a")) & near(b, F.col("a")))).alias("b"))
    # Members of crowded buckets name the points within one bit; one round serves all tables they are crowded in.
    many = shared.where(F.col("n") > crowd).select("f").distinct()
    balls = many.select("f", F.explode(F.concat(F.array("f"), *[F.array(F.col("f").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)))) for i in range(BITS)])).alias("z"))
    if radius == 1:
        balls = balls.where("z = f").select("f", "z").union(balls.where("z <> f").select("f", "z").join(many.withColumnRenamed("f", "z"), "z", "left_semi").select("f", "z"))
    least = balls.groupBy("z").agg(F.min("f").alias("a"), F.count("*").alias("n")).where("n > 1")
    ball_links = balls.join(least.select("z", "a"), "z").where(F.col("f") > F.col("a")).select("a", F.col("f").alias("b"))
    return pairs.union(ball_links).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of an edge (a, b) is connected with.

    Large-star and small-star turns, each a grouping of the remaining edges by node with a running minimum; the edges are written
    to the checkpoint folder after each turn, and the turns end when the edges no longer change.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(star).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = durable(small, instead_of=edges)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (now["n"], now["x"]) == mark:
            break
        mark = (now["n"], now["x"])
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def with_components(docs: DataFrame, key: str = "doc_id", text: str = "text", fingerprint: str = "fingerprint", component: str = "component_id", radius: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Adds each document's fingerprint (16 hex digits) and component: the least `key` reachable over links, its own included.

    Documents are linked where their fingerprints differ in `radius` bits or fewer. A null text counts as empty; texts without
    words have fingerprint zero and are linked like any other. Equal fingerprints are one node, so that a group of copies, however
    large, costs one row; repeated rows get one component; null keys take part but name a component only if it has no other.
    Columns named like the new ones are replaced; an empty table stays empty. Work: a fixed number of rows per distinct fingerprint.
    `keep` lists the columns of `docs` to carry to the result (all by default); what it leaves out, such as the texts, is not stored.
    """
    f, root, own, low = fresh("f"), fresh("root"), fresh("key"), fresh("least")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (fingerprint, component)]
    rows = durable(docs.withColumns({f: simhash3(F.col(text)), own: F.col(key)}).select(*kept, own, f))
    distinct = rows.groupBy(F.col(f).alias("f")).agg(F.min(own).alias("least"))
    found = components(links(distinct.select("f"), radius))
    joined = distinct.join(found, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("root", "f").alias(root))
    named = joined.groupBy(root).agg(F.min("least").alias(low))
    lookup = joined.select("f", root).join(named, root).select(F.col("f").alias(f), low)
    hexed = F.lower(F.lpad(F.hex(F.col(f)), 16, "0"))
    return rows.join(lookup, f).select(*kept, hexed.alias(fingerprint), F.col(low).alias(component))
