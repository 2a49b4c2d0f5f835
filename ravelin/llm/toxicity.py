"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on passages of ordinary documents, one on passages of toxic documents: of these, the ones
that tell, as runs of bytes in them recur in many toxic passages and hardly in ordinary ones. A document is cut into overlapping windows
of a few words; each is compressed with either dictionary. The windows are counted by how much the toxic dictionary shortens them,
against their plain length and against the ordinary dictionary, at several thresholds. As a single word weighs little in a window, every
word may be compressed by itself as well (`BY_WORD`), said three times so that it is not stored plain, with a third dictionary: the words that tell, as
they stand in the toxic passages. The counts are turned into a probability by a logistic curve that is calibrated on documents kept from
training.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import durable, fresh, sums_between, text_chunks

#: Bytes that part words: ASCII white space and punctuation, but for the apostrophe.
PARTS = bytes(b for b in range(128) if not chr(b).isalnum() and chr(b) != "'")
PLAIN = bytes.maketrans(PARTS, b" " * len(PARTS))


@dataclass(frozen=True)
class Settings:
    per_class: int = 9000  # documents of each label that training may take, by hash order: a documented bound
    passages: int = 400_000  # distinct passages of each label, about, that the dictionaries may be trained on, by hash: a documented bound
    passage_bytes: int = 200  # longer passages, of words beyond any dictionary's use, train nothing; they are scored like all
    ordinary_bytes: int = 8192
    toxic_bytes: int = 6144
    run: int = 6  # bytes of the runs that tell toxic passages
    least_passages: int = 8
    least_ratio: float = 8.0
    passage: int = 3  # words of a passage, and from the start of one to that of the next
    passage_step: int = 2
    window: int = 4  # the same of the windows that are scored
    step: int = 2
    shorter: tuple[int, ...] = (3, 4, 5, 6, 7, 8, 9, 10)  # bytes less than the plain window
    closer: tuple[int, ...] = (-3, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7)  # bytes less than with the ordinary dictionary
    both: tuple[tuple[int, int], ...] = ((4, -1), (4, 1), (4, 3), (6, -1), (6, 1), (6, 3), (8, -1), (8, 1), (8, 3))
    word_bytes: int = 6144
    times: int = 3  # that a word is said in its own window
    sizes: tuple[int, ...] = ()  # bytes of a word's window with the dictionary of words; none: no windows of single words
    nearer: tuple[int, ...] = (1, 2, 3, 4, 5, 6)  # bytes less than with the ordinary dictionary
    level: int = 8

    @property
    def width(self) -> int:
        return len(self.shorter) + len(self.closer) + len(self.both) + 1 + len(self.sizes) * len(self.nearer)


#: What the queries use: single words count too.
BY_WORD = Settings(sizes=tuple(range(15, 23)))
#: Calibrating documents of each label below which single words do not count: their many thresholds would only fit the few texts.
LEAST_HELD = 30


@dataclass
class Toxicity:
    ordinary: bytes
    toxic: bytes
    curve: np.ndarray
    settings: Settings
    words: bytes = b" "

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        """Of the ordinary dictionary, of the toxic one and, where single words count, of that of words."""
        out = []
        for content in (self.ordinary, self.toxic, *([self.words] if self.settings.sizes else [])):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=self.settings.level)
            out.append(zstandard.ZstdCompressor(level=self.settings.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve[1:] + self.curve[0], -40, 40)))


def windows(texts: list[str], size: int, step: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as one run of plain bytes; (start, length) of each window in it; windows per text, 1 at least where it has a word."""
    flat = [t.encode().translate(PLAIN) for t in texts]
    raw = b" " + b" ".join(flat) + b" "
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in flat])])
    space = np.frombuffer(raw, np.uint8) == 32
    turn = np.flatnonzero(space[1:] != space[:-1])
    starts, stops = turn[::2], turn[1::2] + 2  # with the space before and after
    words = np.searchsorted(starts, bounds)
    count = np.diff(words)
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - size) // step)), 0)
    first = np.repeat(words[:-1], n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    last = np.minimum(first + size, np.repeat(words[1:], n)) - 1
    return raw, np.stack([starts[first], stops[last] - starts[first]], 1).astype(np.uint64), n


#: Words whose sizes a task keeps.
SEEN = 1 << 18


def word_sizes(flat: list[bytes], tools: list[zstandard.ZstdCompressor], s: Settings, seen: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(size, bytes less than with the ordinary dictionary) of all words' windows, one text after another, and the text of each."""
    split = pc.split_pattern(pa.array([t.decode() for t in flat], pa.large_string()), " ")
    text, found = pc.list_parent_indices(split), split.flatten()
    full = pc.not_equal(found, "")
    coded = found.filter(full).dictionary_encode()
    if len(seen) > SEEN:
        seen.clear()
    out = np.zeros((len(coded.dictionary), 2), np.int64)
    for i, w in enumerate(coded.dictionary.to_pylist()):
        if w not in seen:
            x = f" {w}".encode() * s.times + b" "
            size = len(tools[2].compress(x))
            seen[w] = (size, len(tools[0].compress(x)) - size)
        out[i] = seen[w]
    return out[coded.indices.to_numpy()], text.filter(full).to_numpy()


def features(texts: list[str], tools: list[zstandard.ZstdCompressor], s: Settings, seen: dict[str, tuple[int, int]] | None = None) -> np.ndarray:
    """Of each text: for each threshold, the log of 1 + the windows that reach it; the log of 1 + their number; the same of words."""
    raw, spans, n = windows(texts, s.window, s.step)
    counts = np.zeros((len(texts), s.width))
    if len(spans):
        segments = zstandard.BufferWithSegments(raw, spans.tobytes())
        ordinary, toxic = (np.array([len(x) for x in c.multi_compress_to_buffer(segments, threads=0)]) for c in tools[:2])
        shorter, closer = spans[:, 1].astype(np.int64) - toxic, ordinary - toxic
        ends = np.concatenate([[0], np.cumsum(n)])
        reached = [shorter >= t for t in s.shorter] + [closer >= t for t in s.closer] + [(shorter >= a) & (closer >= b) for a, b in s.both]
        for k, r in enumerate(reached):
            counts[:, k] = sums_between(r.astype(np.int64), ends)
        counts[:, len(reached)] = n
        if not s.sizes:
            return np.log1p(counts)
        each, text = word_sizes([t.encode().translate(PLAIN) for t in texts], tools, s, {} if seen is None else seen)
        at = len(reached) + 1
        for size in s.sizes:
            for less in s.nearer:
                counts[:, at] = np.bincount(text[(each[:, 0] <= size) & (each[:, 1] >= less)], minlength=len(texts))
                at += 1
    return np.log1p(counts)


def feature_udf(model, s: Settings, score: bool):
    """An Arrow UDF of the features, or of the score, of texts; `model` is a broadcast Toxicity."""

    @F.arrow_udf("double" if score else "array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tools, seen = model.value.compressors(), {}
        for texts in batches:
            rows = [np.zeros((0, s.width))]
            for some in text_chunks(pc.utf8_lower(texts.fill_null("")), 1 << 19):
                rows.append(features(some.to_pylist(), tools, s, seen))
            x = np.concatenate(rows)
            yield pa.array(model.value.probability(x)) if score else pa.array(list(x), pa.list_(pa.float64()))

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method; intercept first, without ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def passage_udf(s: Settings):
    """An Arrow UDF of a text's windows of plain bytes."""

    @F.arrow_udf("array<binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [pa.array([], pa.list_(pa.binary()))]
            for some in text_chunks(pc.utf8_lower(texts.fill_null("")), 1 << 19):
                raw, spans, n = windows(some.to_pylist(), s.passage, s.passage_step)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array([raw[a : a + b] for a, b in spans.tolist()], pa.binary())))
            yield pa.concat_arrays(parts)

    return run


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", settings: Settings | None = None) -> Toxicity:
    """Learns from documents that `labels` marks 0 or 1; other labels and nulls are left out, and a document marked both ways counts as toxic.

    At most `per_class` documents a label are taken, those with the smallest hash of their id; a quarter of them calibrates, the others
    train the dictionaries with about `passages` of their whole texts' distinct passages a label, or all if they are fewer. Of rows with one id, one
    calibrates. Without documents of both labels, the score is the share of toxic ones (0 if none at all).
    """
    s = settings or Settings()
    marks = labels.where(F.col(toxic).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(toxic).alias("y"))
    totals = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    prior = totals.get(1, 0) / max(sum(totals.values()), 1)
    ranked = [marks.where(F.col("y") == y).withColumn("h", F.xxhash64(F.col(key), F.lit(3))).orderBy("h", key).limit(s.per_class) for y in (0, 1)]
    # At most 2 x per_class rows of three numbers: small enough to send to every executor.
    chosen = F.broadcast(ranked[0].unionByName(ranked[1]).select(F.col(key).alias("k"), "y", (F.pmod("h", F.lit(4)) == 0).alias("held")))
    sample = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(chosen, "k")
    cut = sample.where(~F.col("held")).select("y", F.explode(passage_udf(s)("t")).alias("p")).where(F.length("p") <= s.passage_bytes)
    # Passages that stand on both sides count as ordinary; copies count once.
    once = durable(cut.groupBy("p").agg(F.min("y").alias("y")))
    found = {r["y"]: r["count"] for r in once.groupBy("y").count().collect()}
    # So many in 2 ** 20 hashes as leave about `passages`: no task sorts them.
    share = {y: min(1 << 20, (s.passages << 20) // max(found.get(y, 0), 1)) for y in (0, 1)}
    few = once.where(F.pmod(F.xxhash64("p"), F.lit(1 << 20)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).toArrow()
    own = {y: sorted(few.filter(pc.equal(few.column("y"), y)).column("p").to_pylist()) for y in (0, 1)}
    for rows in own.values():
        random.Random(5).shuffle(rows)
    if not own[0] or not own[1]:
        return Toxicity(b" ", b" ", np.array([_odds(prior)] + [0.0] * s.width), s)
    good = telling_runs(own[1], own[0], s)
    telling = with_runs(own[1], good, s)
    ordinary, toxic_ = _dictionary(own[0], s.ordinary_bytes, 32, 6), _dictionary(telling or own[1], s.toxic_bytes, 16, 8)
    model = Toxicity(ordinary, toxic_, np.zeros(s.width + 1), s, telling_words(telling, good, s))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = sample.where("held").select("k", "y", F.xxhash64("t").alias("h"), feature_udf(shared, s, False)("t").alias("x"))
    held = held.groupBy("k").agg(F.min("y").alias("y"), F.min_by("x", "h").alias("x")).collect()
    x, y = np.array([r["x"] for r in held]).reshape(len(held), -1), np.array([r["y"] for r in held], float)
    if s.sizes and min((y == 0).sum(), (y == 1).sum()) < LEAST_HELD:
        model.settings = s = replace(s, sizes=())
        model.curve, x = np.zeros(s.width + 1), x[:, : s.width]
    if len(set(y)) < 2:
        model.curve[0] = _odds(prior)
        return model
    model.curve = logistic(x, y)
    # The sample holds the labels in other shares than the table does.
    model.curve[0] += _odds(prior) - _odds(y.mean())
    return model


def _odds(share: float) -> float:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def runs(passages: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of `size` bytes (8 at most) of each passage, as numbers, and which passage they are of."""
    raw, ends = np.frombuffer(b"".join(passages), np.uint8), np.cumsum([0] + [len(p) for p in passages])
    key = np.zeros(max(len(raw) - size + 1, 0), np.uint64)
    for i in range(size):
        key = key * np.uint64(256) + raw[i : i + len(key)]
    of = np.repeat(np.arange(len(passages)), np.diff(ends))[: len(key)]
    inside = np.arange(len(key)) + size <= ends[of + 1]
    key, of = key[inside], of[inside]
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])[: len(key)]
    return key[new], of[new]


def run_counts(passages: list[bytes], size: int, slice_: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs and how many passages have each, some passages at a time."""
    key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(passages), slice_):
        more, m = np.unique(runs(passages[i : i + slice_], size)[0], return_counts=True)
        key, inverse = np.unique(np.concatenate([key, more]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([n, m]), len(key)).astype(np.int64)
    return key, n


def telling_runs(toxic: list[bytes], ordinary: list[bytes], s: Settings) -> np.ndarray:
    """The runs of bytes that stand in several toxic passages and, by share, much more rarely in ordinary ones."""
    (mine, n), (other, m) = run_counts(toxic, s.run), run_counts(ordinary, s.run)
    at = np.minimum(np.searchsorted(other, mine), max(len(other) - 1, 0))
    also = np.where(other[at] == mine, m[at], 0) if len(other) else np.zeros(len(mine))
    return mine[(n >= s.least_passages) & (n / len(toxic) >= s.least_ratio * (also + 1) / len(ordinary))]


def with_runs(passages: list[bytes], good: np.ndarray, s: Settings, slice_: int = 20_000) -> list[bytes]:
    """The passages that have one of these runs."""
    out = []
    for i in range(0, len(passages), slice_):
        key, of = runs(passages[i : i + slice_], s.run)
        out += [passages[i + k] for k in np.unique(of[np.isin(key, good)])]
    return out


def tell(toxic: list[bytes], ordinary: list[bytes], s: Settings, slice_: int = 20_000) -> list[bytes]:
    """The toxic passages with a telling run."""
    return with_runs(toxic, telling_runs(toxic, ordinary, s), s, slice_)


def telling_words(telling: list[bytes], good: np.ndarray, s: Settings) -> bytes:
    """The distinct words with a telling run, the most frequent last, where the compressor looks first."""
    words = Counter(with_runs([b" " + w + b" " for p in telling for w in p.split()], good, s))
    return b"".join(w for w, _ in sorted(words.items(), key=lambda x: (x[1], x[0])))[-s.word_bytes :] or b" "


def _dictionary(samples: list[bytes], size: int, segment: int, run: int) -> bytes:
    """A trained dictionary; of few samples, which the trainer refuses, their own text."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=run).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def with_toxicity(docs: DataFrame, model: Toxicity, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds a score from 0 to 1 and the prediction, 1 from 0.5 up.

    Whole texts are read, in windows. A null or empty text, or one without words, gets the score of no windows. Equal texts get
    equal scores; columns named like the new ones are replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = fresh("tox")
    out = docs.withColumn(new, feature_udf(shared, model.settings, True)(F.col(text)))
    return out.withColumn(score, F.col(new)).drop(new).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
