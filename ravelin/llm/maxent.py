"""A hashed maximum-entropy language model with a class-factored softmax of two levels.

P(word | history) = P(class | history) * P(part | class, history) * P(word | part). The class is read off the word: the most frequent
training words and the end of a text have classes of their own, every other word that of its last bytes; the words of such a class
are dealt to parts by hash. The class is predicted by a softmax over hashed features of the words before: the word one, two and three
back (the latter two are skips), and the pair of the last two classes. The part is predicted by a second softmax, over the class
joined with the word one back, so that history weighs the words within a class too. Within a part, words have their add-one
share of its training tokens, unknown words together that of one more word, so the probabilities of all next words add up to 1.

Weights are trained by distributed gradient updates: each task follows AdaGrad over its documents from the shared weights, and the
changes are averaged per weight row by how often each task met the feature; a round takes a fold of the documents, and the rounds
together take every training document once. Word counts are exact and stay a distributed table that grows with the corpus; only words
that hold a fixed share of all tokens, which bounds their number, are sent to the executors. The table of hashed weights is of fixed
size, because every task holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import HashTable, durable, fresh, hashed_words, sums_between, text_chunks

FREQUENT = 24  # classes of single words
SUFFIXES = 39  # classes by last bytes
END = FREQUENT + SUFFIXES
CLASSES = END + 1
SUBS = 16  # parts of a class by last bytes
#: A word with at least this share of the training tokens is sent to every executor; there are at most 1 / HEAD_SHARE of them, 16 bytes each.
HEAD_SHARE = 1 / 2_000_000
BUCKETS = 1 << 13
#: First row of each feature's weights: words one, two and three back, and pairs of classes; then the number of rows.
ROWS = (0, BUCKETS, 2 * BUCKETS, 3 * BUCKETS, 3 * BUCKETS + (CLASSES + 1) ** 2)
FINE_BITS = 16  # of the rows of the parts' feature
PARTS = 64  # the weights travel in so many pieces
BATCH = 8192
#: Tokens that a task of a gradient round has at least: what it sends back is as long as the weights.
LEAST_TOKENS = 1_000_000
#: So many zeros count in with the changes of each weight row, which holds back those of rare features.
SHRINK = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    tokens: int  # N
    types: int  # V
    ends: int
    heads: np.ndarray  # hashes of the words that are sent along, the most frequent first
    counts_of_heads: np.ndarray
    bias: np.ndarray
    fine_bias: np.ndarray  # suffix classes x parts
    norm: np.ndarray  # log10 of what the words of each suffix class and part add up to
    weights: np.ndarray = field(default_factory=lambda: np.zeros((ROWS[-1], CLASSES), np.float32))
    fine: np.ndarray = field(default_factory=lambda: np.zeros((1 << FINE_BITS, SUBS), np.float32))
    counts: DataFrame | None = None  # (h, k, c) of all training words; not sent along

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}

    def tables(self) -> list[np.ndarray]:
        return [self.weights, self.fine]


def suffix_class(tail: np.ndarray) -> np.ndarray:
    """The number, from 0, of the suffix class of words by their last three bytes."""
    return ((tail.astype(np.uint64) * _ODD) >> np.uint64(33)).astype(np.int64) % SUFFIXES


def part(h: np.ndarray) -> np.ndarray:
    return (h >> 59) & (SUBS - 1)


class Lexicon:
    """The words that are sent along, by hash."""

    def __init__(self, model: Model):
        self.model = model
        self.table = HashTable(model.heads, np.arange(len(model.heads)))
        self.count = np.append(model.counts_of_heads, 0)  # -1, for the others, is the last


class Tokens:
    """Texts' words as arrays, an end (hash 0) after each text's last word."""

    def __init__(self, lexicon: Lexicon, texts: pa.Array):
        words, tail, at = hashed_words(texts)
        self.ends = at + np.arange(len(texts) + 1)  # of each text's tokens
        n = int(self.ends[-1])
        self.word = np.ones(n, bool)
        self.word[self.ends[1:] - 1] = False
        self.hash, self.kind, self.count = np.zeros(n, np.int64), np.full(n, END), np.full(n, lexicon.model.ends, np.int64)
        head = lexicon.table.get(words)
        self.hash[self.word] = words
        self.kind[self.word] = np.where((head >= 0) & (head < FREQUENT), head, FREQUENT + suffix_class(tail))
        self.count[self.word] = lexicon.count[head]
        self.unsure = np.zeros(n, bool)  # not among the words sent along
        self.unsure[self.word] = head < 0
        place = np.arange(n) - np.repeat(self.ends[:-1], np.diff(self.ends))
        back = lambda x, k, none: np.where(place >= k, np.concatenate([np.full(k, none), x])[:n], none)
        slot = np.where(self.word, (self.hash >> 20) % (BUCKETS - 1) + 1, 0)
        one = back(slot, 1, 0)
        pair = back(self.kind, 1, CLASSES) * (CLASSES + 1) + back(self.kind, 2, CLASSES)
        self.rows = [one, back(slot, 2, 0), back(slot, 3, 0), pair]  # of each feature's own weights
        self.open = np.flatnonzero((self.kind >= FREQUENT) & (self.kind < END))
        own = self.kind[self.open] * BUCKETS
        mixed = (((own + one[self.open]).astype(np.uint64) * _ODD) >> np.uint64(64 - FINE_BITS)).astype(np.int64)
        self.fine_rows, self.suffix, self.part = [mixed], self.kind[self.open] - FREQUENT, part(self.hash[self.open])


def _logits(w: np.ndarray, firsts: tuple[int, ...], rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    z = np.take(w, rows[0] + firsts[0], axis=0, mode="clip")
    z += bias
    more = np.empty_like(z)
    for f, r in zip(firsts[1:], rows[1:], strict=True):
        z += np.take(w, r + f, axis=0, mode="clip", out=more)
    z -= z.max(axis=1, keepdims=True)
    return z


def _log_softmax(w: np.ndarray, firsts: tuple[int, ...], rows: list[np.ndarray], bias: np.ndarray, goal: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of the goals' probabilities; `of` chooses each row's bias."""
    out = np.empty(len(goal))
    for i in range(0, len(out), BATCH):
        cut = slice(i, i + BATCH)
        z = _logits(w, firsts, [r[cut] for r in rows], bias if of is None else bias[of[cut]])
        out[cut] = z[np.arange(len(z)), goal[cut]] - np.log(np.exp(z).sum(axis=1))
    return out


FINE_FIRSTS = (0,)


def class_scores(model: Model, t: Tokens) -> np.ndarray:
    """Natural logarithm of P(class | history) of each token."""
    return _log_softmax(model.weights, ROWS[:4], t.rows, model.bias, t.kind)


def part_scores(model: Model, t: Tokens) -> np.ndarray:
    """Natural logarithm of P(part | class, history) of each token of `t.open`."""
    return _log_softmax(model.fine, FINE_FIRSTS, t.fine_rows, model.fine_bias, t.part, t.suffix)


def _sums(z: np.ndarray, order: np.ndarray, first: np.ndarray, count: np.ndarray, turns: int = 16) -> np.ndarray:
    """Sums of the rows z[order[first:first + count]] of each run: most runs are short, so the k-th rows of all are added at once."""
    out, live = np.take(z, order[first], axis=0, mode="clip"), np.flatnonzero(count > 1)
    for k in range(1, turns):
        if not len(live):
            return out
        out[live] += np.take(z, order[first[live] + k], axis=0, mode="clip")
        live = live[count[live] > k + 1]
    for i in live:
        out[i] += z[order[first[i] + turns : first[i] + count[i]]].sum(axis=0)
    return out


def _descend(w: np.ndarray, firsts: tuple[int, ...], rows: list[np.ndarray], bias: np.ndarray, goal: np.ndarray, of: np.ndarray | None, squares: np.ndarray, seen: np.ndarray, rate: float) -> None:
    """One AdaGrad pass, in place. A feature's rows number 65,536 at most, which sorts them in linear time."""
    for i in range(0, len(goal), BATCH):
        cut = slice(i, i + BATCH)
        some = [r[cut] for r in rows]
        z = _logits(w, firsts, some, bias if of is None else bias[of[cut]])
        np.exp(z, out=z)
        z /= -z.sum(axis=1, keepdims=True)
        z[np.arange(len(z)), goal[cut]] += 1
        for f, r in zip(firsts, some, strict=True):
            order = np.argsort(r.astype(np.uint16), kind="stable")
            by = r[order]
            first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
            count = np.diff(np.append(first, len(r)))
            at = by[first] + f
            step = _sums(z, order, first, count)
            size = squares[at] + np.einsum("ij,ij->i", step, step) / step.shape[1]
            squares[at] = size
            seen[at] += count
            step *= (rate / np.sqrt(size + 1e-3))[:, None]
            w[at] += step


def follow(model: Model, t: Tokens, squares: list[np.ndarray], seen: list[np.ndarray], rate: float = 0.1) -> None:
    """One AdaGrad pass over the tokens for both softmaxes, in place."""
    _descend(model.weights, ROWS[:4], t.rows, model.bias, t.kind, None, squares[0], seen[0], rate)
    _descend(model.fine, FINE_FIRSTS, t.fine_rows, model.fine_bias, t.part, t.suffix, squares[1], seen[1], rate)


def _pieces(tables: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(table, rows) of each piece that the weights travel in."""
    return [(i, rows) for i, w in enumerate(tables) for rows in np.array_split(np.arange(len(w)), PARTS)]


def _gradient_round(model: Model, texts: DataFrame, adders: int) -> list[np.ndarray]:
    """The shared weights after a round over a fold's texts (the only column).

    Changes travel in half precision and are weighed by how often a task met their row where they are added up. They are added in two
    rounds, by `adders` tasks a piece first, so that none adds the pieces of all others.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        mine = replace(base, weights=base.weights.copy(), fine=base.fine.copy())
        squares, seen = ([np.zeros(len(w), np.float32) for w in base.tables()] for _ in range(2))
        lexicon = Lexicon(base)
        for batch in batches:
            for some in text_chunks(batch.column(0)):
                follow(mine, Tokens(lexicon, some), squares, seen)
        if seen[0].any():
            for k, (i, rows) in enumerate(_pieces(base.tables())):
                n = seen[i][rows]
                change = (mine.tables()[i][rows] - base.tables()[i][rows]).astype(np.float16)
                yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "d": pa.array([change.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})

    def weigh(of: pd.DataFrame) -> pd.DataFrame:
        n = [np.frombuffer(x, np.float32) for x in of["n"]]
        d = sum(np.frombuffer(x, np.float16).reshape(len(m), -1).astype(np.float32) * m[:, None] for x, m in zip(of["d"], n, strict=True))
        return pd.DataFrame({"part": of["part"][:1], "d": [d.tobytes()], "n": [np.sum(n, axis=0, dtype=np.float32).tobytes()]})

    def add(of: pd.DataFrame) -> pd.DataFrame:
        total = lambda col: np.sum([np.frombuffer(x, np.float32) for x in of[col]], axis=0, dtype=np.float32).tobytes()
        return pd.DataFrame({"part": of["part"][:1], "d": [total("d")], "n": [total("n")]})

    kind = "part int, d binary, n binary"
    changes = texts.mapInArrow(work, kind)
    some = changes.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(adders))).groupBy("part", "g").applyInPandas(lambda of: weigh(of), kind)
    found = {r["part"]: r for r in some.groupBy("part").applyInPandas(add, kind).collect()}
    out = [w.copy() for w in model.tables()]
    for k, (i, rows) in enumerate(_pieces(out)):
        if k in found:
            n = np.frombuffer(found[k]["n"], np.float32)
            out[i][rows] += np.frombuffer(found[k]["d"], np.float32).reshape(len(rows), -1) / (n + SHRINK)[:, None]
    shared.unpersist()
    return out


def word_counts(docs: DataFrame, text: str, pending: int = 1 << 20) -> DataFrame:
    """(h, k, c): of each word, by hash, its suffix class and count; h = 0 counts the texts. Tasks add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> pa.RecordBatch:
            h, k, c = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            return pa.RecordBatch.from_pydict({"h": h[order][first], "k": k[order][first], "c": np.add.reduceat(c[order], first)})

        for batch in batches:
            for some in text_chunks(batch.column(0)):
                words, tail, _ = hashed_words(some)
                h, first, c = np.unique(words, return_index=True, return_counts=True)
                held.append((np.append(h, 0), np.append(suffix_class(tail[first]), 0), np.append(c, len(some))))
                size += len(h)
                if size > pending:
                    yield added()
                    held, size = [], 0
        if held:
            yield added()

    rows = docs.select(F.col(text)).mapInArrow(count, "h long, k long, c long")
    return rows.groupBy("h", "k").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, text: str = "text", rounds: int = 2) -> Model:
    """Learns from every row of `docs`; a null text is empty. An empty table gives a model that knows no word."""
    everything = durable(word_counts(docs, text))
    total = everything.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("h") == 0, F.col("c"))).alias("ends")).first()
    n, types, ends = (total[x] or 0 for x in ("n", "v", "ends"))
    counts = everything.where("h > 0")
    # At most 1 / HEAD_SHARE rows of two numbers.
    heads = counts.where(F.col("c") >= max(1.0, n * HEAD_SHARE)).select("h", "c").toArrow()
    h, c = (heads.column(x).to_numpy().astype(np.int64) for x in ("h", "c"))
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    share, cell, kinds = np.zeros(CLASSES), np.zeros((SUFFIXES, SUBS)), np.zeros((SUFFIXES, SUBS))
    share[: min(FREQUENT, len(c))], share[END] = c[:FREQUENT], ends
    others = counts.where(~F.col("h").isin(h[:FREQUENT].tolist())) if len(h) else counts
    for r in others.groupBy("k", F.shiftright("h", 59).bitwiseAND(SUBS - 1).alias("s")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        cell[r["k"], r["s"]], kinds[r["k"], r["s"]] = r["c"], r["v"]
    share[FREQUENT:END] = cell.sum(axis=1)
    bias = np.log((share + 1) / (n + CLASSES)).astype(np.float32)
    fine_bias = np.log((cell + 1) / (cell.sum(axis=1, keepdims=True) + SUBS)).astype(np.float32)
    # A class or part without its word, of which there may be some on tiny tables, stays improbable but possible.
    model = Model(n, types, ends, h, c, bias, fine_bias, np.log10(cell + kinds + 1), counts=counts)
    fold = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(17)), F.lit(rounds))
    for k in range(rounds):
        tasks = max(1, int(n // (rounds * LEAST_TOKENS)))
        model.weights, model.fine = _gradient_round(model, docs.where(fold == k).select(text).coalesce(tasks), max(1, int(tasks**0.5)))
    return model


def with_scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens (words and the end), n_known, train_tokens, base_score (add-one unigram) and score, both log10 of the text's probability.

    Whole texts are scored. A null or empty text is its end alone. Equal texts get equal scores, repeated rows each their own row, null
    keys too; columns named like the new ones are replaced; an empty table stays empty. `keep` lists the columns to carry (default all).
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("n", pa.int64()), ("known", pa.int64()), ("head", pa.float64()), ("open", pa.float64()), ("model", pa.float64()), ("tail", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n long, known long, head double, open double, model double, tail array<long>>")
    def sweep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        lexicon = Lexicon(m)
        for texts in batches:
            parts = [pa.array([], kind)]
            for some in text_chunks(texts):
                t = Tokens(lexicon, some)
                log, scored, free = np.log10(t.count + 1.0), class_scores(m, t) / np.log(10), np.zeros(len(t.kind), bool)
                scored[t.open] += part_scores(m, t) / np.log(10) - m.norm[t.suffix, t.part]
                free[t.open] = True
                values = [np.diff(t.ends), sums_between((t.count > 0).astype(np.int64), t.ends), sums_between(log, t.ends), sums_between(log * free, t.ends), sums_between(scored, t.ends)]
                at = np.concatenate([[0], np.cumsum(t.unsure)])[t.ends].astype(np.int32)
                tails = pa.ListArray.from_arrays(pa.array(at), pa.array(t.hash[t.unsure]))
                parts.append(pa.StructArray.from_arrays([*map(pa.array, values), tails], fields=list(kind)))
            yield pa.concat_arrays(parts)

    s, row = fresh("swept"), fresh("row")
    swept = durable(docs.withColumn(s, sweep(F.col(text))).select(*kept, F.monotonically_increasing_id().alias(row), s))
    # The other words meet their counts in a join; all words that are frequent in training are out.
    met = swept.select(F.col(row).alias("r"), F.explode(f"{s}.tail").alias("h")).join(model.counts.select("h", "c"), "h")
    tail = met.groupBy("r").agg(F.count("*").alias("m"), F.round(F.sum(F.log10(F.col("c") + 1.0)), 10).alias("l"))
    tail = tail.select(F.col("r").alias(row), *[F.col(x).alias(f"{row}_{x}") for x in ("m", "l")])
    out = swept.join(tail, row, "left")
    rest, n = F.coalesce(F.col(f"{row}_l"), F.lit(0.0)), F.col(f"{s}.n")
    return out.select(
        *kept,
        n.alias("n_tokens"),
        (F.col(f"{s}.known") + F.coalesce(F.col(f"{row}_m"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col(f"{s}.head") + rest - n * float(np.log10(model.tokens + model.types + 1.0))).alias("base_score"),
        (F.col(f"{s}.open") + rest + F.col(f"{s}.model")).alias("score"),
    )
