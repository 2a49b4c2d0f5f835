"""Language identification with error-correcting output codes.

Each language gets a codeword; for each bit, a binary classifier over hashed byte n-grams tells the languages with that bit set
from the others. A text's margins are decoded to the codeword with the least summed logistic loss (loss-weighted decoding), and a
text is flagged ambiguous where the runner-up is nearly as near.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import fresh, sums_between, text_bytes, text_chunks

UNDETERMINED = "und"


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1, one a language: all distinct splits of the languages for up to 6, else the best-spread of seeded random codes."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 6:
        splits = [s for s in itertools.product((1.0, -1.0), repeat=n) if s[0] == 1 and -1.0 in s]
        return np.array(splits).T
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    tries = [rng.choice((-1.0, 1.0), (n, bits)) for _ in range(200)]
    spread = lambda c: ((c @ c.T)[~np.eye(n, dtype=bool)].max(), (np.abs(c.sum(axis=0)) == n).sum())
    return min(tries, key=spread)


def gram_slots(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The slot of the n-gram that begins at each byte."""
    key = np.full(max(len(raw) - n + 1, 0), n, np.uint64)
    for i in range(n):
        key = key * np.uint64(257) + raw[i : i + len(key)]
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Languages:
    names: list[str]
    codes: np.ndarray
    weights: np.ndarray  # bits of a codeword x slots
    sizes: tuple[int, ...] = (2, 3)
    slot_bits: int = 15
    ambiguous_below: float = 0.6

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Mean log-odds per n-gram of each text and bit; zero where a text has none."""
        raw, ends = text_bytes(pc.utf8_lower(texts))
        total, grams = np.zeros((len(texts), len(self.weights))), np.zeros(len(texts))
        for n in self.sizes:
            slots = gram_slots(raw, n, self.slot_bits)
            starts, stops = np.minimum(ends[:-1], len(slots)), np.maximum(np.minimum(ends[1:] - n + 1, len(slots)), np.minimum(ends[:-1], len(slots)))
            edges = np.stack([starts, stops], 1).ravel()
            edges = np.append(edges, edges[-1] if len(edges) else 0)
            for b, w in enumerate(self.weights):
                total[:, b] += sums_between(w[slots], edges)[::2]
            grams += stops - starts
        return total / np.maximum(grams, 1)[:, None]

    def decode(self, margins: np.ndarray, sharpness: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword, and its share, 0 to 1, of exp(-loss) over all codewords."""
        if not len(self.names):
            return np.full(len(margins), -1), np.zeros(len(margins))
        loss = np.logaddexp(0, -sharpness * margins[:, None, :] * self.codes[None]).sum(axis=2)
        near = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return near.argmax(axis=1), 1 / near.sum(axis=1)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", slot_bits: int = 15, sizes: tuple[int, ...] = (2, 3)) -> Languages:
    """Learns from every row of `docs` with a text and a language.

    What reaches the driver is one n-gram histogram of 2**slot_bits numbers a language, whatever the size of the table; languages
    are few (a row of the codeword table each). No labelled row: a model without languages, which answers `und`.
    """
    slots = 1 << slot_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("l").to_pylist()
            for name in set(names):
                rows = pa.array([x == name for x in names])
                into = seen.setdefault(name, np.zeros(slots, np.int64))
                for texts in text_chunks(batch.column("t").filter(rows)):
                    raw, ends = text_bytes(pc.utf8_lower(texts))
                    for n in sizes:
                        at = gram_slots(raw, n, slot_bits)
                        whole = np.ones(len(at), bool)  # not those that run into the next text
                        for k in range(1, n):
                            cut = ends[1:-1] - k
                            whole[cut[(cut >= 0) & (cut < len(at))]] = False
                        into += np.bincount(at[whole], minlength=slots)
        yield pa.RecordBatch.from_pydict({"l": pa.array(list(seen), pa.string()), "n": pa.array([v.tobytes() for v in seen.values()], pa.binary())})

    def add(of: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"l": of["l"][:1], "n": [np.sum([np.frombuffer(x, np.int64) for x in of["n"]], axis=0).tobytes()]})

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    part = rows.mapInArrow(count, "l string, n binary")
    # Two rounds of adding keep any one task to the square root of the number of partitions.
    some = part.withColumn("k", F.floor(F.rand(1) * 16)).groupBy("l", "k").applyInPandas(lambda of: add(of), "l string, n binary")
    found = {r["l"]: np.frombuffer(r["n"], np.int64) for r in some.groupBy("l").applyInPandas(add, "l string, n binary").collect()}
    names = sorted(found)
    codes = codewords(len(names))
    share = np.array([(found[x] + 0.5) / (found[x].sum() + 0.5 * slots) for x in names]).reshape(len(names), slots)
    weights = [np.log(share[c > 0].mean(axis=0) / share[c < 0].mean(axis=0)) for c in codes.T]
    return Languages(names, codes, np.array(weights, np.float32).reshape(codes.shape[1], slots), sizes, slot_bits)


def with_language(docs: DataFrame, model: Languages, text: str = "text", pred: str = "lang_pred", score: str = "score", ambiguous: str = "ambiguous") -> DataFrame:
    """Adds the predicted language, its score from 0 to 1, and whether the decision is ambiguous.

    A text that is null or has no letter is `und` with score 0 and ambiguous. Texts are read whole. Equal texts get equal results;
    columns named like the new ones are replaced; an empty table stays empty. The model (some MB, fixed by its parameters and the
    number of languages) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<k int, p double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            best, share = [np.zeros(0, int)], [np.zeros(0)]
            for some in text_chunks(texts.fill_null("")):
                k, p = m.decode(m.margins(some))
                best.append(k)
                share.append(p)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(best).astype(np.int32)), pa.array(np.concatenate(share))], ["k", "p"])

    new = fresh("lang")
    out = docs.withColumn(new, predict(F.col(text)))
    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & (F.col(f"{new}.k") >= 0)
    name = F.element_at(F.array(*map(F.lit, model.names or [UNDETERMINED])), F.greatest(F.col(f"{new}.k"), F.lit(0)) + 1)
    out = out.withColumns({pred: F.when(known, name).otherwise(UNDETERMINED), score: F.when(known, F.col(f"{new}.p")).otherwise(0.0)})
    return out.withColumn(ambiguous, F.col(score) < model.ambiguous_below).drop(new)
