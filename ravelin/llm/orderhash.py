"""Order MinHash fingerprints of whole texts, with DataFrame operations only.

The k-mers of a text are runs of k words. Each is numbered by its occurrence in the text, so that repeats count, and the numbered
k-mer is hashed once. The top bits of the hash deal the k-mers into cells, as in one-permutation hashing; of each cell the `take`
k-mers with the smallest hashes are selected, put back into text order, and hashed as a tuple. Two texts agree in a cell if they
share its smallest k-mers in the same order, so that edits that move text count, not only those that change words. Work per text is
that of sorting its k-mers, whatever its length or repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.llm.common import durable, fresh, words

CELLS = 64
CELL_BITS = 6
PLACE_BITS = 26  # of a packed number; texts may have as many k-mers as this can number
DIGITS = 4
EMPTY = "." * DIGITS


def fingerprint(text: Column, k: int = 3, take: int = 2) -> Column:
    """CELLS groups of four hex digits, or four dots for a cell without k-mers.

    A null or empty text has dots only. A text of fewer than k words is one k-mer. Words are parted by ASCII white space.
    """
    place = (1 << PLACE_BITS) - 1

    def packed(w: Column) -> Column:
        n = F.greatest(F.size(w) - (k - 1), F.least(F.size(w), F.lit(1)))
        gram = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
        return F.when(n > 0, F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: gram(i).bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<long>"))

    hash_of = lambda x: x.bitwiseAND(F.lit(~place))
    at = lambda a, i: F.get(a, i)

    def starts(p: Column) -> Column:
        """For each packed k-mer, in order, the index of the first with its hash: links to the one before, doubled until all reach it."""
        link = F.transform(p, lambda x, i: F.when((i > 0) & (hash_of(at(p, i - 1)) == hash_of(x)), i - 1).otherwise(i))
        same = F.size(p) - F.size(F.array_distinct(F.transform(p, hash_of)))
        rounds = F.when(same > 1, F.sequence(F.lit(1), F.ceil(F.log2(same + 1)).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rounds, link, lambda have, _: F.transform(have, lambda j: at(have, j)))

    def numbered(p: Column, start: Column) -> Column:
        """Packed anew: the hash of (k-mer, occurrence), whose top bits are the cell, and the place in the text."""
        new = F.transform(p, lambda x, i: F.xxhash64(hash_of(x), i - at(start, i)).bitwiseAND(F.lit(~place)).bitwiseOR(x.bitwiseAND(F.lit(place))))
        return F.sort_array(new)

    cell = lambda x: F.shiftrightunsigned(x, 64 - CELL_BITS).cast("int")

    def least(q: Column) -> Column:
        """The first `take` of each cell."""
        return F.filter(q, lambda x, i: F.coalesce(cell(at(q, i - take)) != cell(x), F.lit(True)))

    def tuples(q: Column) -> Column:
        """(cell, hash of the tuple in text order) at the first selected k-mer of each cell."""
        heads = F.filter(F.sequence(F.lit(0), F.size(q) - 1), lambda i: F.coalesce(cell(at(q, i - 1)) != cell(at(q, i)), F.lit(True)))

        def one(i: Column) -> Column:
            group = F.filter(F.slice(q, i + 1, take), lambda x: cell(x) == cell(at(q, i)))
            ordered = F.transform(F.array_sort(F.transform(group, lambda x: F.struct(x.bitwiseAND(F.lit(place)).alias("a"), hash_of(x).alias("b")))), lambda s: s["b"])
            short = F.substring(F.lpad(F.lower(F.hex(F.xxhash64(ordered))), 16, "0"), 1, DIGITS)
            return F.struct(cell(at(q, i)).alias("k"), short.alias("v"))

        return F.map_from_entries(F.transform(heads, one))

    def rendered(q: Column) -> Column:
        found = lambda m: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.coalesce(F.element_at(m, c), F.lit(EMPTY))), "")
        return F.when(F.size(q) > 0, _let(tuples(q), found)).otherwise(EMPTY * CELLS)

    return _let(words(text), lambda w: _let(packed(w), lambda p: _let(starts(p), lambda s: _let(numbered(p, s), lambda q: _let(least(q), rendered)))))


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once: a transform of the one-element array that holds it."""
    return F.get(F.transform(F.array(value), use), 0)


def likeness(a: Column, b: Column) -> Column:
    """The share of cells that agree among those that either fingerprint fills; 1 for two empty ones."""
    part = lambda f, i: F.substr(f, i * DIGITS + 1, F.lit(DIGITS))
    cells = F.sequence(F.lit(0), F.lit(CELLS - 1))
    filled = F.size(F.filter(cells, lambda i: (part(a, i) != EMPTY) | (part(b, i) != EMPTY)))
    same = F.size(F.filter(cells, lambda i: (part(a, i) != EMPTY) & (part(a, i) == part(b, i))))
    return F.when(filled > 0, same / filled).otherwise(1.0)


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", k: int = 3, take: int = 2) -> DataFrame:
    """Adds the fingerprint; see `fingerprint`. Equal texts have equal fingerprints; a column named alike is replaced."""
    return docs.withColumn(name, fingerprint(F.col(text), k, take))


def _above(bounds: list[int], key: Column) -> Column:
    """How many of the ascending bounds are above the key, by binary search."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    jumps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    # The number of bounds that are not above the key, built up from its highest bit.
    below = F.aggregate(jumps, F.lit(0), lambda at, jump: F.when(F.coalesce(F.get(held, at + jump - 1) <= key, F.lit(False)), at + jump).otherwise(at))
    return F.lit(len(bounds)) - below


def with_next(docs: DataFrame, key: str, columns: list[str], tie: Column, derived: dict[str, Column], per_range: int = 4096, most: int = 1 << 17) -> DataFrame:
    """Adds `derived`, and next_<column> for each of `columns` and `derived`: that of the row that follows in descending order of `key`; after the last, the first.

    Rows are dealt to ranges of the key (a whole number), whose bounds are quantiles, `most` at most; a key, or null, with more rows
    than a range should have is split by its ties. Each range is ordered by itself and closed with a copy of the next range's first
    row. Ties of the key go by `tie`, equal ones in any order; null keys come last.
    """
    n = docs.select(key).count()
    size = max(per_range, -(-n // most))
    pieces = max(1, n // size)
    low, high = -(1 << 62), 1 << 62
    cuts = docs.select(F.percentile_approx(F.col(key), [i / pieces for i in range(1, pieces)], 10 * pieces).alias("q")).first()["q"] if pieces > 1 else []
    crowds = {r["k"]: r["n"] for r in docs.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > size).collect()}  # n / size at most
    bounds = sorted({int(c) for c in cuts or [] if low < c < high} | {b for k in crowds if k is not None for b in (k, k + 1)})
    side = F.when(F.col(key).isNull(), F.lit(len(bounds) + 1)).otherwise(_above(bounds, F.col(key)))
    crowded = [(k, -(-c // size)) for k, c in crowds.items()]
    number, nth, tied, last = fresh("range"), fresh("part"), fresh("tie"), fresh("last")
    ranged = docs.withColumns({number: side, tied: tie})
    # The hash's place among all hashes, from 0 to 1, in as many equal parts as the crowd needs.
    parts = F.lit(1)
    if crowded:
        held = F.map_from_arrays(F.array(*[F.lit(k).cast("long") for k, _ in crowded if k is not None]), F.array(*[F.lit(c) for k, c in crowded if k is not None])) if any(k is not None for k, _ in crowded) else None
        parts = F.when(F.col(key).isNull(), F.lit(dict(crowded).get(None, 1))).otherwise(F.coalesce(F.element_at(held, F.col(key)), F.lit(1)) if held is not None else F.lit(1))
    ranged = ranged.withColumn(nth, F.least(F.floor((F.col(tied) / F.lit(2.0**64) + 0.5) * parts), parts - 1).cast("int"))
    order = [F.col(key).desc_nulls_last(), F.col(tied)]
    own = F.struct(*[F.col(c) for c in columns])
    first = F.struct((-F.col(key)).alias("a"), F.col(tied).alias("b"), own.alias("c"))
    heads = durable(ranged.groupBy(number, nth).agg(F.coalesce(F.min(F.when(F.col(key).isNotNull(), first)), F.min(first)).alias("f")).select(F.col(number).alias("r"), F.col(nth).alias("p"), F.col("f.c").alias("c")))
    # Only the numbers of the ranges are put in order in one place; the rows that close them come by a join.
    every = W.partitionBy().orderBy("r", "p")
    spot = F.struct("r", "p")
    turns = heads.select("r", "p", F.coalesce(F.lead(spot).over(every), F.first(spot).over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("next"))
    turns = turns.select(F.col("r").alias(number), F.col("p").alias(nth), F.col("next.r").alias("r"), F.col("next.p").alias("p"))
    closing = turns.join(heads, ["r", "p"]).select(number, nth, *[F.col(f"c.{c}").alias(c) for c in columns], F.lit(1).alias(last))
    # Derived once per row and closing copy, here, and not for all rows that might be a range's first.
    rows = ranged.withColumn(last, F.lit(0)).unionByName(closing, allowMissingColumns=True).withColumns(derived)
    within = W.partitionBy(number, nth).orderBy(last, *order)
    out = rows.withColumns({f"next_{c}": F.lead(c).over(within) for c in [*columns, *derived]})
    return out.where(F.col(last) == 0).drop(number, nth, tied, last)


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, take: int = 2) -> DataFrame:
    """Adds n_chars, edited (the text whose last floor(n_chars / 2) code points give way to the first as many, or all, of the next
    document), fingerprint, edited_fingerprint, near_edited and near_next.

    The next document is that with the next smaller key, after the last the first; a single one follows itself. Rows with one key
    follow each other in the order of hashes of their texts and places in the table. A null text is empty; an empty table stays empty; columns of `docs` named
    like the new ones are replaced.
    """
    made = ["n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    body, own = fresh("body"), fresh("fingerprint")
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(body))
    # The place in the table tells rows with one key and one text apart, so that many of them can be dealt to several ranges.
    rows = with_next(rows, key, [body], F.xxhash64(body, F.monotonically_increasing_id()), {own: fingerprint(F.col(body), k, take)})
    n, half = F.length(body), F.expr(f"length({body}) div 2").cast("int")
    edited = F.concat(F.substr(F.col(body), F.lit(1), n - half), F.substr(F.col(f"next_{body}"), F.lit(1), half))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": edited, "fingerprint": F.col(own)})
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited"), k, take))
    rows = rows.withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col(f"next_{own}"))})
    return rows.select(*kept, *made)
