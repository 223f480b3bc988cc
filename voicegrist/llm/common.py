"""Helpers shared by the training-data operators.

Row identity: a document row is known by ``(doc_id, xxhash64(text))``. Rows that repeat
both are interchangeable, so an operator may work on the pair once and give every such
row the same answer. Operators pick the columns they need first; further columns of the
input, whatever their names, never reach them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Character classes of the contracts, in Java's and Python's regex syntax.
NON_SPACE = r"[^\x20\x09-\x0D]+"

_LOWER_AZ = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A-Z lower-cased; every ASCII byte but 0-9 and a-z turned into a blank; bytes from \x80 kept.
_ALNUM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else (b + 32 if 65 <= b <= 90 else 32) for b in range(256))


#: hot_join: keys that can hold more than their share of rows, and rows below which no key is hot.
HOT_KEYS, HOT_LEAST = 100_000, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by bytes, as documents may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set and all runs on this machine (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Small results: checkpoint() into the shared folder, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Larger results: a Parquet table in the shared folder, read again by every consumer."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def hot_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the columns of facts, left-joined; facts has one row a key, no key is null, and a few keys may hold most rows.

    Fewer than HOT_KEYS keys can hold more than a HOT_KEYS-th of all rows each, so their facts are broadcast. All
    other groups are small, and meet their facts by a shuffle. rows is read three times and should be a stored table."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    most = max(HOT_LEAST, rows.count() // HOT_KEYS)
    hot = cut(sizes.where(F.col("n") > most).select(key).join(facts, key, "left"))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def row_key(text: str = "text") -> Column:
    return F.xxhash64(F.col(text))


def map_arrow(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and \\x09-\\x0D, as UTF-8."""
    return text.encode().split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A-Z lower-cased."""
    return text.encode().translate(_LOWER_AZ).split() if text else []


def alnum_words_of(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(_ALNUM).split() if text else []


class WordHash(dict):
    """word -> 64-bit hash, the same in every process; forgets all when it gets large."""

    LIMIT = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, modulo 2 ** 64, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, m, 1 << 64))])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(h: np.ndarray) -> np.ndarray:
    """Sums of the words' hashes times powers of the base: the hash of any run is a difference of two."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(len(h))[0], dtype=np.uint64)])


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end) of words."""
    return mixed((sums[ends] - sums[starts]) * _powers(len(sums))[1][starts])


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, from the words' hashes."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    sums = prefix_sums(h)
    return mixed((sums[k:] - sums[:-k]) * _powers(len(sums))[1][: len(h) - k + 1])


def minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each run of w hashes the place of its smallest (by the upper 32 bits, the first of equals)."""
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    held = 1
    while held < w:
        step = min(held, w - held)
        least = np.minimum(least[:-step], least[step:])
        held += step
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def bit_filter(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """One-hash Bloom filter as (word, mask) rows: at most bits / 64 rows, whatever the input's size."""
    slot = F.pmod(F.col(column), F.lit(bits))
    return hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, {bits}L) & 63 as int))")).alias("mask"))


def collected_filter(rows: DataFrame, bits: int) -> np.ndarray:
    """The filter as an array of bits / 8 bytes: a proven bound, so it may be broadcast."""
    t = rows.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[t.column("word").to_numpy()] = t.column("mask").to_numpy().view(np.uint64)
    return out


def in_filter(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slot = hashes & np.uint64(bits - 1)  # bits is a power of two: the same as pmod of the signed value
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
