"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    bare = F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS))


def word_count(c: Column) -> Column:
    """Number of words, without building them: every word is a non-space that starts the text or follows a space."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share; where unset (tests, a laptop), one in the warehouse."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (place or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints").rstrip("/")


def durable(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder, deleted when the driver ends. The table of `instead_of`, an earlier result, is deleted now."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{fresh('table').strip('_')}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(at)
    if instead_of is not None:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(instead_of._durable_path), True)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def fresh(prefix: str) -> str:
    """A column name that clashes with no input column."""
    return f"__{prefix}_{uuid4().hex[:8]}"


def list_chunks(lists: pa.ListArray, limit: int = 1 << 18) -> Iterator[pa.ListArray]:
    """Slices of whole lists of about `limit` elements each."""
    ends, at, n = lists.offsets.to_numpy(), 0, len(lists)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + limit, "right")) - 1)
        yield lists.slice(at, to - at)
        at = to


def text_chunks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of whole texts of about `limit` bytes each, so that what is built per slice stays small."""
    n = len(texts)
    if not n:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + limit, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and len + 1 offsets into them; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int32 if pa.types.is_string(texts.type) else np.int64
    ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def sums_between(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[ends[i]:ends[i + 1]], rows or scalars; zero where empty."""
    out = np.zeros((len(ends) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(ends[1:] > ends[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, ends[full], axis=0, dtype=out.dtype)
    return out


#: An odd factor whose powers number the places of a byte in a word.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, factor: np.uint64, n: int) -> np.ndarray:
    """The first n powers of a factor, kept for the next call."""
    if len(_powers[name]) < n:
        with np.errstate(over="ignore"):
            _powers[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 21), factor)]), dtype=np.uint64)
    return _powers[name][:n]


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' words, A-Z lower-cased, one after another: a hash (above 0, 63 bits), the last three bytes as a number, and len + 1 offsets.

    The hash is a polynomial in the bytes, mixed: differences of one running sum, so no word is cut out. Two given words share it with
    probability 2 ** -63.
    """
    raw, ends = text_bytes(texts)
    raw, n = _LOWERED[raw], len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    solid = ~_BLANK[raw]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0], last[-1] = True, True
    first[1:], last[:-1] = ~solid[:-1], ~solid[1:]
    full = ends[1:] > ends[:-1]
    first[ends[:-1][full]], last[ends[1:][full] - 1] = True, True
    start, stop = np.flatnonzero(solid & first), np.flatnonzero(solid & last)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_power("up", FACTOR, n) * (raw + np.uint64(1)), out=total[1:])
        h = (total[stop + 1] - total[start]) * _power("down", _INVERSE, n)[start]
        h = (h ^ (h >> np.uint64(32))) * FACTOR
    h = np.maximum(((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype(np.int64), 1)
    size = stop - start
    byte = lambda k: np.where(size >= k, raw[np.maximum(stop - k, 0)].astype(np.int64) + 1, 0)
    return h, raw[stop].astype(np.int64) + (byte(1) << 9) + (byte(2) << 18), np.searchsorted(start, ends)


class HashTable:
    """Open addressing over int64 keys of 0 or more, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(len(keys), 1)).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = left[self.keys[at] < 0]
            spot = at[self.keys[at] < 0]
            spot, first = np.unique(spot, return_index=True)
            self.keys[spot], self.values[spot] = keys[free[first]], values[free[first]]
            stay = self.keys[at] != keys[left]
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, or -1."""
        at = self.slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out
