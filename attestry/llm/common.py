"""Text as byte arrays: words, hashes and counts for whole Arrow batches at once.

Texts are read as UTF-8. A word is a run of bytes outside `[\\x20\\x09-\\x0D]`; none of
these bytes occurs inside a longer UTF-8 sequence, so byte runs are the words of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 1 << 20
LONG_WORD = 48

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Texts:
    """Some consecutive texts of a batch: bytes of text i are data[at[i]:at[i + 1]]."""

    first: int
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.at[i]:self.at[i + 1]].tobytes()


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    wide = np.int64 if large else np.int32
    at = np.frombuffer(offsets, wide, len(column) + 1, column.offset * wide().itemsize) if len(
        column) else np.zeros(1, wide)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8),
            at.astype(np.int64))


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of a column, about `size` bytes at a time; a longer text comes alone."""
    data, at = binary_column(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n)
        yield Texts(i, data[at[i]:at[j]], at[i:j + 1] - at[i])
        i = j


@dataclass
class Words:
    """Words of some texts: byte ranges, the text each is in, and first word of each text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # word index where each text begins, one more at the end

    def per_text(self) -> np.ndarray:
        return np.diff(self.first)


def words(t: Texts) -> Words:
    n = len(t.data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~IS_SPACE[t.data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[:n - 1] if n else begins[1:]
    stops = inside[:n] & ~inside[1:]
    cut = t.at[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = inside[cut]
    stops[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(start, t.at)
    return Words(start, end, np.repeat(np.arange(len(t)), np.diff(first)), first)


def word_hashes(t: Texts, w: Words, table: np.ndarray = AS_IS) -> np.ndarray:
    """A 64-bit hash of each word, its bytes mapped through `table` first."""
    length = w.end - w.start
    order = np.argsort(-np.minimum(length, LONG_WORD + 1), kind="stable")
    start, size = w.start[order], length[order]
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    data = table[t.data]
    at_least = np.searchsorted(-size, -np.arange(1, LONG_WORD + 1), "right")
    for k in range(LONG_WORD):
        live = at_least[k]
        if not live:
            break
        x = h[:live]
        x ^= x >> np.uint64(32)
        x += BYTE_CODES[data[start[:live] + k]]
        x *= np.uint64(0xD6E8FEB86659FD93)
    for i in np.flatnonzero(size > LONG_WORD):
        word = data[start[i]:start[i] + size[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    out = np.empty_like(h)
    out[order] = mix(h)
    return out


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` consecutive words (one value fewer per step of width)."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[k:k + n])
    return out


def sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the ranges first[i]:first[i + 1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def out_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type)
         for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def crc_fold(column: Column, folds: int = 3) -> Column:
    """crc32 of the value as text, modulo folds; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, absent ones as null, whatever else the table carries."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).alias(n) for n in names])
