"""Pieces the corpus operators share: words and their hashes, written tables.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so a document is
cut up without decoding it.  A word is identified by a 64-bit keyed hash of its
bytes; sequences of words by a hash of those.  All of it is numpy over the
buffer of an Arrow column; no Python object is made per word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskstream.sources.shared import drop, shared_dir, written  # noqa: F401  (the operators have these from here)

_ROOT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_ROOT, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240117)).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_WORD = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 19  # bytes hashed at a time
#: Bytes of text worked on at a time; a longer document is a piece of its own.
PIECE = 1 << 20

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of h[start:end], for each pair; equal sequences have equal hashes wherever they stand."""
    if not len(h):
        return np.zeros(len(start), np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_ROOT, len(h)), out=total[1:])
    return mix((total[end] - total[start]) * _power(_INVERSE, len(h) + 1)[start] + (end - start).astype(np.uint64))


def grams_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of h[i:i+k] for every i that leaves k values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return spans_hash(h, at, at + k)


@dataclass
class Words:
    """The words of some documents: byte bounds in data, hashes, and where each document's words begin."""

    data: np.ndarray
    bounds: np.ndarray  # of documents in data, one more than documents
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of documents in words, one more than documents
    hash: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles that lie within one document, and the bounds of documents among them."""
        n = np.maximum(np.diff(self.first) - k + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(bounds[-1]) + np.repeat(self.first[:-1] - bounds[:-1], n)
        return grams_hash(self.hash, k)[at] if len(at) else np.zeros(0, np.uint64), bounds


def words(texts: pa.Array, lower: bool = False, word_bytes: np.ndarray = _WORD) -> Words:
    """Null texts have no words. word_bytes tells for each byte value whether it belongs to words."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if lower:
        data = _LOWER[data]
    n = len(data)
    word = np.zeros(n + 2, bool)
    word[1:-1] = word_bytes[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds), bytes_hash(data, start, end))


def bytes_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], for spans in order."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        a, b = start[i], end[j - 1]
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * _power(_ROOT, b - a), out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * _power(_INVERSE, b - a + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def pieces(batches: Iterable[pa.RecordBatch], column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about size bytes of the column."""
    for batch in batches:
        length = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = length[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(length, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def crc_remainder(column: Column, n: int) -> Column:
    """crc32 of a value's text, modulo n."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def crc(value: int, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    # texts are large rows: by the default number of rows, batches would take most of a small executor; a caller's own settings stay
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sieved(df: DataFrame, column: str, ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """The rows of df whose long column is in ids of the same column, and few others: a one-hash Bloom filter.

    It is a table of bits / 64 rows at most, whatever ids holds, so broadcasting it is bounded; with more ids than bits
    it keeps everything. Use it before a join that settles the rest.
    """
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    bit = F.expr("shiftleft(cast(1 as bigint), cast(_place % 64 as int))")
    word = lambda d: d.withColumn("_place", place).withColumns({"_word": F.floor(F.col("_place") / 64), "_bit": bit})
    table = word(ids.select(column).where(F.col(column).isNotNull())).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return word(df).join(F.broadcast(table), "_word").where(F.col("_bit").bitwiseAND(F.col("_bits")) != 0).select(df.columns)
