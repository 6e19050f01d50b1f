"""Lines that a later document repeats, found by aligning pairs of documents.

1. Every line of every text is hashed. The shortest runs of `BLOCK_WORDS` words or more that
   start or end at a line are its windows; every line of a common block lies in a window that
   is common too. A window that several documents hold names pairs: each later holder with
   the first one, which holds the whole window, and, if it is rare (`RARE` holders or fewer),
   also with the holder just before it. Pairs grow with the lines, never with the square of
   a window's holders, and no line is left out for being common or short.
2. The line hashes of each pair are aligned by patience diff: lines that occur once on both
   sides and rise together are anchors, what lies between is aligned in turn, and equal
   lines next to aligned ones join them. Passages that occur twice or in another order stay
   unaligned, so each window of the later document that the alignment leaves is looked up
   among the runs of lines of the earlier one.
3. Common blocks of `BLOCK_WORDS` words or more are deleted from the later document: all of
   them, wherever and however often they occur on either side.

Earlier means smaller doc_id, null last, then the order of rows. Lines are compared without
white space at their ends; blank lines never start a block but may lie inside one, and leave
with it. A document wholly repeated keeps an empty text. Null text has no lines and stays
null. Rows may repeat an id; each row is a document. Further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.llm.common import SPACES, columns_of
from attestry.session import stored

BLOCK_WORDS, RARE = 10, 32


def line_hashes(text: bytes) -> tuple[list[int], list[int]]:
    """A 64-bit hash and the number of words of each line; a blank line has hash 0."""
    lines = [x.strip(SPACES) for x in text.split(b"\n")]
    return ([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
             if x else 0 for x in lines], [len(x.split()) for x in lines])


def lined(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, text, lines (hashes), sizes (words): a row per document."""
    source = columns_of(docs, "doc_id", "text")
    void = source.schema["doc_id"].dataType.simpleString() == "void"
    source = source.select(F.col("doc_id").cast("bigint") if void else F.col("doc_id"),
                           F.col("text").cast("string"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            lines, sizes = [], []
            for value in b.column(1):
                text = value.as_py()
                h, n = line_hashes(text.encode()) if text is not None else ([], [])
                lines.append(h)
                sizes.append(n)
            keys = np.arange(row, row + b.num_rows)
            row += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), b.column(0), b.column(1),
                 pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
                names=["row_key", "doc_id", "text", "lines", "sizes"])

    return source.mapInArrow(run, f"row_key bigint, doc_id {kind}, text string, "
                                  "lines array<bigint>, sizes array<int>")


def windows(sizes: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges (low, end) of the shortest runs of enough words from each line and up to each."""
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    full = np.flatnonzero(sizes)
    end = np.searchsorted(total, total[full] + block_words)
    fits = end < len(total)
    last = full[total[full + 1] >= block_words] + 1
    low = np.searchsorted(total, total[last] - block_words, "right") - 1
    both = np.unique(np.stack([np.concatenate([full[fits], low]),
                               np.concatenate([end[fits], last])]), axis=1)
    return both[0], both[1]


def window_keys(lines: np.ndarray, sizes: np.ndarray, block_words: int) -> np.ndarray:
    """Distinct hashes of the windows of a document; a window of one line has the line's."""
    low, end = windows(sizes, block_words)
    keys = lines[low]
    for k in np.flatnonzero(end - low > 1):
        keys[k] = int.from_bytes(hashlib.blake2b(
            lines[low[k]:end[k]].tobytes(), digest_size=8).digest(), "little", signed=True)
    return np.unique(keys)


def _keyed(table: DataFrame, block_words: int) -> DataFrame:
    """row_key, doc_id, line: a row per document and window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [window_keys(np.array(x, np.int64), np.array(n, np.int64), block_words)
                    for x, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64()))],
                names=["row_key", "doc_id", "keys"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.select("row_key", "doc_id", "lines", "sizes").mapInArrow(
        run, f"row_key bigint, doc_id {kind}, keys array<bigint>").select(
        "row_key", "doc_id", F.explode("keys").alias("line"))


def candidate_pairs(table: DataFrame, block_words: int = BLOCK_WORDS,
                    rare: int = RARE) -> DataFrame:
    """(early, late) row keys of documents that share a window."""
    held = _keyed(table, block_words).select(
        F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key").alias("place"),
        "line")
    first = held.groupBy("line").agg(F.count(F.lit(1)).alias("holders"),
                                     F.min("place").alias("first")).filter("holders > 1")
    shared = stored(held.join(first, "line").select("line", "holders", "place", "first"), "shared")
    star = shared.filter(F.col("place") != F.col("first")).select(
        F.col("first.row_key").alias("early"), F.col("place.row_key").alias("late"))
    # A rare window has few holders, so its window is small.
    before = F.lag("place").over(W.partitionBy("line").orderBy("place"))
    chain = shared.filter(F.col("holders").between(3, rare)).select(
        before.alias("before"), "place").filter("before IS NOT NULL").select(
        F.col("before.row_key").alias("early"), F.col("place.row_key").alias("late"))
    return star.unionAll(chain).distinct()


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (i, j), sorted by i, whose j rise too."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _once(lines: list[int], low: int, high: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for i in range(low, high):
        seen[lines[i]] = -1 if lines[i] in seen else i
    return {x: i for x, i in seen.items() if i >= 0 and x}


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], rising on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al == ah or bl == bh:
            continue
        mine, theirs = _once(a, al, ah), _once(b, bl, bh)
        anchors = rising(sorted((i, theirs[x]) for x, i in mine.items() if x in theirs))
        ends = [*anchors, (ah, bh)]
        if not anchors:
            continue
        # Between two anchors (and before the first) the same again, anchors included.
        i, j = al, bl
        for x, y in ends:
            todo.append((i, x, j, y))
            if (x, y) != (ah, bh):
                out.append((x, y))
            i, j = x + 1, y + 1
    return sorted(out)


def blocks(aligned: list[tuple[int, int]], b: list[int], sizes: list[int],
           block_words: int) -> list[tuple[int, int]]:
    """(first, end) ranges of `b` covered by unbroken aligned runs of enough words."""
    out, k = [], 0
    while k < len(aligned):
        e = k + 1
        while e < len(aligned) and aligned[e] == (aligned[e - 1][0] + 1, aligned[e - 1][1] + 1):
            e += 1
        low, high = aligned[k][1], aligned[e - 1][1] + 1
        while low < high and not b[low]:
            low += 1
        while high > low and not b[high - 1]:
            high -= 1
        if sum(sizes[low:high]) >= block_words:
            out.append((low, high))
        k = e
    return out


def unaligned(a: list[int], b: list[int], sizes: list[int], found: list[tuple[int, int]],
              block_words: int) -> list[tuple[int, int]]:
    """Windows of `b` outside of the `found` ranges that are runs of `a` too."""
    held = set(a)
    # Lines that a block may take: held by `a`, and how many of them are still to be found.
    common = np.array([x in held for x in b], bool)
    open_ = common & (np.array(sizes) > 0)
    for low, high in found:
        open_[low:high] = False
    if not open_.any():
        return []
    lacks, left = (np.concatenate([[0], np.cumsum(x)]) for x in (~common, open_))
    low, end = windows(np.array(sizes), block_words)
    ask = (lacks[low] == lacks[end]) & (left[low] < left[end])
    runs: dict[int, set[bytes]] = {}
    mine, theirs = np.array(a, np.int64).tobytes(), np.array(b, np.int64).tobytes()
    out = []
    for x, y in zip(low[ask].tolist(), end[ask].tolist(), strict=True):
        n = y - x
        if n not in runs:
            runs[n] = {mine[8 * i:8 * (i + n)] for i in range(len(a) - n + 1)}
        if theirs[8 * x:8 * y] in runs[n]:
            out.append((x, y))
    return out


def repeated(table: DataFrame, block_words: int = BLOCK_WORDS, rare: int = RARE) -> DataFrame:
    """row_key and the line ranges to delete from it (low, high), one row per block."""
    pairs = candidate_pairs(table, block_words, rare)
    a = table.select(F.col("row_key").alias("early"), F.col("lines").alias("a"))
    b = table.select(F.col("row_key").alias("late"), F.col("lines").alias("b"), "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for late, x, y, n in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    found = blocks(patience(x, y), y, n, block_words)
                    found += unaligned(x, y, n, found, block_words)
                    rows += [(late, low, high) for low, high in found]
            cols = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols],
                                             names=["row_key", "low", "high"])

    return pairs.join(a, "early").join(b, "late").select("late", "a", "b", "sizes").mapInArrow(
        run, "row_key bigint, low bigint, high bigint")


def without_lines(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int]:
    lines = text.split("\n")
    gone = np.zeros(len(lines), bool)
    for low, high in ranges:
        gone[low:high] = True
    return "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), int(gone.sum())


def deduplicate(docs: DataFrame, block_words: int = BLOCK_WORDS, rare: int = RARE) -> DataFrame:
    """doc_id, text without repeated blocks, n_lines, n_removed."""
    table = stored(lined(docs), "lines")
    # At most the lines of one document come together here.
    gone = repeated(table, block_words, rare).distinct().groupBy("row_key").agg(
        F.collect_list(F.struct("low", "high")).alias("ranges"))
    rows = table.select("row_key", "doc_id", "text").join(gone, "row_key", "left").select(
        "doc_id", "text", "ranges")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, removed = [], [], []
            for value, ranges in zip(b.column(1), b.column(2), strict=True):
                text, gone_ = value.as_py(), ranges.as_py()
                n.append(0 if text is None else text.count("\n") + 1)
                cut = 0
                if gone_:
                    text, cut = without_lines(text, [(r["low"], r["high"]) for r in gone_])
                texts.append(text)
                removed.append(cut)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()),
                 pa.array(removed, pa.int64())], names=["doc_id", "text", "n_lines", "n_removed"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_lines bigint, n_removed bigint")
