"""Quality from weak labels.

Several heuristic labellers vote good, bad or abstain on each document. Expectation-maximisation over the counts of vote patterns,
which cover all documents, estimates how often each labeller votes what on good and on bad documents, without any true label. The
posterior of a sample then trains a linear scorer over hashed runs of byte classes, which also sees what the labellers abstain on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import fresh, sums_between, text_bytes, text_chunks

LABELLERS = ("length", "capitals", "symbols", "loud_words", "bars", "distinct_words", "stutter", "word_length", "sentence_ends")
GOOD, ABSTAIN, BAD = 2, 1, 0
SLOTS = 1 << 11
EXTRA = 24  # slots for binned document-level facts, after the hashed ones
#: Documents whose posterior trains the scorer, by hash order: a documented bound.
SAMPLE = 6000

_KIND = np.full(256, 9, np.int64)  # byte classes: 0 space, 1 line end, 2 lower, 3 upper, 4 digit, 5 mild mark, 9 on: other marks
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or "a" <= _c <= "z":
        _KIND[_b] = 2
    elif "A" <= _c <= "Z":
        _KIND[_b] = 3
    elif "0" <= _c <= "9":
        _KIND[_b] = 4
    elif _c == "\n":
        _KIND[_b] = 1
    elif _b <= 32:
        _KIND[_b] = 0
    elif _c in ".,;:'\"()-":
        _KIND[_b] = 5
    else:
        _KIND[_b] = 9 + _b % 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def facts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: a row of measures (see `votes`); and the byte classes, with the texts' offsets, and the first bytes' text ends."""
    raw, ends = text_bytes(texts)
    kind = _KIND[raw]
    n = len(texts)
    count = lambda mask: sums_between(mask.astype(np.int64), ends)
    blank = kind <= 1
    first = np.zeros(len(raw) + 1, bool)
    first[ends[:-1][ends[:-1] < len(raw)]] = True
    first = first[: len(raw)]
    before = np.concatenate([[True], blank[:-1]])[: len(raw)] | first
    starts = ~blank & before
    words = count(starts)
    letters = count((kind == 2) | (kind == 3))
    last = np.concatenate([blank[1:], [True]])[: len(raw)] | np.concatenate([first[1:], [True]])[: len(raw)]
    marks = kind >= 9
    loud = marks & np.concatenate([[False], marks[:-1]])[: len(raw)] & last & ~starts  # the mark before is of the same word
    ended = (kind == 5) & last
    # Words as numbers: differences of a running polynomial hash, brought to a common power.
    at = np.flatnonzero(starts)
    stop = np.flatnonzero(~blank & last) + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(raw) + 1, _ODD)) if len(raw) else np.ones(1, np.uint64)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        back = np.cumprod(np.full(len(raw) + 1, inverse)) if len(raw) else np.ones(1, np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(power[: len(raw)] * (raw + np.uint64(1)))])
        word = (total[stop] - total[at]) * back[at] if len(at) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(n), words)
        same = np.concatenate([[False], (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])])[: len(word)]
        order = np.lexsort((word, owner))
        new = np.concatenate([[True], (word[order][1:] != word[order][:-1]) | (owner[order][1:] != owner[order][:-1])])[: len(word)]
        distinct = np.bincount(owner[order][new], minlength=n)
    w = np.maximum(words, 1)
    visible = np.maximum(count(~blank), 1)
    out = np.stack([words, count(kind == 3) / np.maximum(letters, 1), count(marks) / visible, count(loud) / w, count(raw == 124) / w, distinct / w,
                    np.bincount(owner, same, n) / w if len(word) else np.zeros(n), visible / w, count(ended) / w], 1)
    return out, kind, ends, words


def votes(m: np.ndarray) -> np.ndarray:
    """Columns in the order of LABELLERS: GOOD, ABSTAIN or BAD. The thresholds are round figures, not fitted."""
    words = m[:, 0]
    pick = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))
    enough = words >= 20
    return np.stack([
        pick(words < 2, (words >= 50) & (words <= 100_000)),
        pick(enough & (m[:, 1] > 0.3), enough & (m[:, 1] < 0.1)),
        pick(m[:, 2] > 0.08, enough & (m[:, 2] < 0.01)),
        pick(m[:, 3] > 0.15, enough & (m[:, 3] == 0)),
        pick(m[:, 4] > 0.15, enough & (m[:, 4] == 0)),
        pick((words >= 50) & (m[:, 5] < 0.25), (words >= 50) & (m[:, 5] > 0.5)),
        pick(enough & (m[:, 6] > 0.2), enough & (m[:, 6] < 0.05)),
        pick((m[:, 7] < 2) | (m[:, 7] > 15), enough & (m[:, 7] > 3) & (m[:, 7] < 10)),
        pick(enough & (m[:, 8] == 0), enough & (m[:, 8] > 0.03) & (m[:, 8] < 0.6)),
    ], 1).astype(np.int64)


def slots(kind: np.ndarray) -> np.ndarray:
    """The hashed slot of the run of three byte classes that begins at each byte."""
    key = kind[:-2] * 1024 + kind[1:-1] * 32 + kind[2:] if len(kind) > 2 else np.zeros(0, np.int64)
    return ((key.astype(np.uint64) * _ODD) >> np.uint64(53)).astype(np.int64)


def bins(m: np.ndarray) -> np.ndarray:
    """Slots of the binned length, share of distinct words and stutter."""
    return SLOTS + np.stack([np.minimum(np.log2(m[:, 0] + 1).astype(np.int64), 7), 8 + np.minimum((m[:, 5] * 8).astype(np.int64), 7), 16 + np.minimum((m[:, 6] * 8).astype(np.int64), 7)], 1)


@dataclass
class Labels:
    """What EM found: the share of good documents, and P(vote | class, it votes) as classes x labellers x votes, 1 for abstaining; class 1 is good."""

    prior: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        logs = np.log(self.table)[:, np.arange(len(LABELLERS)), v].sum(axis=2)
        z = logs[1] + np.log(self.prior) - logs[0] - np.log(1 - self.prior)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def accuracies(self) -> dict[str, float]:
        """Of each labeller, how often it is right when it votes."""
        weight = np.array([1 - self.prior, self.prior])
        right = weight[0] * self.table[0, :, BAD] + weight[1] * self.table[1, :, GOOD]
        spoke = right + weight[0] * self.table[0, :, GOOD] + weight[1] * self.table[1, :, BAD]
        return dict(zip(LABELLERS, right / spoke, strict=True))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Labels:
    """EM from a first guess that documents without a bad vote are good; counts are smoothed by one vote, so that a labeller without votes stays neutral."""
    good = 1.5 - 3.0 * (patterns == BAD).sum(axis=1)  # a complaint tells more than praise
    q = np.clip(1 / (1 + np.exp(-good)), 0.01, 0.99)
    labels = Labels(0.5, np.ones((2, len(LABELLERS), 3)))
    for _ in range(rounds):
        table = np.ones((2, len(LABELLERS), 3))
        for side, w in ((0, counts * (1 - q)), (1, counts * q)):
            for k in range(len(LABELLERS)):
                table[side, k] += np.bincount(patterns[:, k], w, 3)
        table[:, :, ABSTAIN] = 0  # to abstain is no evidence
        table /= table.sum(axis=2, keepdims=True)
        table[:, :, ABSTAIN] = 1
        labels = Labels(float(np.clip((counts * q).sum() / max(counts.sum(), 1), 1e-3, 1 - 1e-3)), table)
        new = labels.posterior(patterns)
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return labels


def _vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Votes, and each text's hashed vector: shares of the slots, and ones in its bins."""
    m, kind, ends, _ = facts(texts)
    s = slots(kind)
    x = np.zeros((len(texts), SLOTS + EXTRA), np.float32)
    for i in range(len(texts)):
        own = s[ends[i] : max(ends[i + 1] - 2, ends[i])]
        x[i, :SLOTS] = np.bincount(own, minlength=SLOTS) / max(len(own), 1)
    np.put_along_axis(x, bins(m), 1, axis=1)
    return votes(m), x


@dataclass
class Quality:
    labels: Labels
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors and scores."""
        m, kind, ends, _ = facts(texts)
        w = np.append(self.weights[slots(kind)], [0.0, 0.0])[: len(kind)]
        for k in (1, 2):  # not the runs into the next text
            at = ends[1:] - k
            w[at[at >= np.repeat(ends[:-1], 1)]] = 0
        z = sums_between(w, ends) / np.maximum(np.diff(ends) - 2, 1) + self.weights[bins(m)].sum(axis=1) + self.bias
        return self.labels.posterior(votes(m)), 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Quality:
    """EM over the vote patterns of all documents (at most 3 ** 9 numbers reach the driver), and the scorer over at most `sample` of them."""
    texts = F.coalesce(F.col(text), F.lit(""))

    @F.arrow_udf("int")
    def pattern(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        base = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            parts = [votes(facts(some)[0]) @ base for some in text_chunks(batch)]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int32))

    seen = docs.select(pattern(texts).alias("p")).groupBy("p").count().collect()
    codes = np.array([r["p"] for r in seen], np.int64).reshape(-1)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    labels = estimate(patterns, np.array([r["count"] for r in seen], float))

    @F.arrow_udf("struct<p int, x binary>")
    def vector(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        base = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            parts = [pa.array([], pa.struct([("p", pa.int32()), ("x", pa.binary())]))]
            for some in text_chunks(batch):
                v, x = _vectors(some)
                parts.append(pa.StructArray.from_arrays([pa.array((v @ base).astype(np.int32)), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["p", "x"]))
            yield pa.concat_arrays(parts)

    # The sample is a fixed number of the smallest hashes; its rows carry vectors of fixed size, not texts.
    chosen = docs.select(F.xxhash64(F.col(key), F.lit(29)).alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    got = docs.where(F.xxhash64(F.col(key), F.lit(29)) <= F.lit(chosen)).select(F.xxhash64(texts).alias("t"), vector(texts).alias("s")).orderBy("t").limit(sample).select("s").collect() if chosen is not None else []
    if not got:
        return Quality(labels, np.zeros(SLOTS + EXTRA), 0.0)
    x = np.stack([np.frombuffer(r["s"]["x"], np.float16) for r in got]).astype(np.float32)
    q = labels.posterior(np.array([r["s"]["p"] for r in got])[:, None] // 3 ** np.arange(len(LABELLERS)) % 3)
    x[:, :SLOTS] *= 30  # shares are small beside the bins
    w, b, squares = np.zeros(x.shape[1]), 0.0, np.full(x.shape[1], 1e-4)
    for _ in range(120):  # AdaGrad over the whole sample
        r = q - 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        g = x.T @ r / len(x) - 1e-4 * w
        squares += g * g
        w += 0.2 * g / np.sqrt(squares)
        b += 0.5 * float(r.mean())
    w[:SLOTS] *= 30
    return Quality(labels, w, b)


def with_quality(docs: DataFrame, model: Quality, text: str = "text", posterior: str = "posterior", score: str = "score", keep: str = "keep") -> DataFrame:
    """Adds the posterior of the votes, the scorer's score, both from 0 to 1, and keep, 1 where their mean is 0.5 or more.

    Whole texts are read. A null or empty text is judged by its lack of words. Equal texts get equal results; columns named like the
    new ones are replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<p double, s double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [shared.value.score(some) for some in text_chunks(batch)] or [(np.zeros(0), np.zeros(0))]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(side)) for side in zip(*parts, strict=True)], ["p", "s"])

    new = fresh("q")
    out = docs.withColumn(new, judge(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumns({posterior: F.col(f"{new}.p"), score: F.col(f"{new}.s")}).drop(new)
    return out.withColumn(keep, ((F.col(posterior) + F.col(score)) / 2 >= 0.5).cast("int"))
