"""Runs of words: stretches that repeat with a smallest period and cannot be extended.

1. The words of a text become numbers, equal words equal numbers. A run of `COPIES` periods or
   more holds each of its `GRAM`-word windows twice, a period apart at most. So only stretches
   all of whose windows recur within a `COPIES`-th of the stretch can hold a run; the stretch
   shrinks until this is so. Nothing outside such stretches is part of any run asked for.
2. The first phase of Baier's suffix sorter groups the suffixes of a stretch by their longest
   Lyndon prefix, from the highest group down: a group's members extend the nearest open
   suffix to their left, by as many copies of the group's context as follow it. The length of a
   suffix's context when its group is taken is its entry of the Lyndon array; no second phase
   is needed. This is done under both orders of the words.
3. Every run has a Lyndon root that is such a prefix under one of the two orders. Each root is
   extended to both sides by longest common extensions: binary search over hashed prefixes,
   all roots at once. Runs found are held against the words themselves; should hashes have
   collided, the root is extended word by word.

Words are runs of characters outside `[\\x20\\x09-\\x0D]`. Null and empty texts have no words
and no runs. Any column but the text may be null, rows may repeat; each row is searched on its
own. Texts of any length are searched whole. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import columns_of

COPIES, LEAST = 4, 6
GRAM = 4  # at most twice the period of the shortest run, and below LEAST
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
Run = tuple[int, int, int]


def lyndon_lengths(s: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place."""
    n = len(s)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    rank = {c: k for k, c in enumerate(sorted(set(s)))}
    group = [rank[c] for c in s]
    top = len(rank)
    members: list[list[int]] = [[] for _ in range(top)]
    for i, g in enumerate(group):
        members[g].append(i)
    context = [1] * top
    below, above = list(range(-1, top - 1)), [*range(1, top), -1]
    out = [0] * n
    g = top - 1
    while g >= 0:
        size, followers = context[g], {}
        for i in members[g]:
            if group[i] != g:
                continue  # moved to a higher group since
            out[i] = size
            j, r = left[i], right[i]
            if r < n:
                left[r] = j
            if j >= 0:
                right[j] = r
                followers[j] = followers.get(j, 0) + 1
        members[g] = []
        moved: dict[tuple[int, int], list[int]] = {}
        for j, copies in followers.items():
            moved.setdefault((copies, group[j]), []).append(j)
        # More copies sort higher: they are placed first, the others between them and the old.
        for copies, old in sorted(moved, reverse=True):
            new, up = len(members), above[old]
            members.append(moved[copies, old])
            context.append(context[old] + copies * size)
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
            for j in members[new]:
                group[j] = new
        g = below[g]
    return out


def extensions(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far s matches to the left of places i and j and from them on (i < j)."""
    n = len(s)
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(n + 1, _BACK, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((s.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])

    def longest(most: np.ndarray, same) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            ok = same(half)
            low, high = np.where(ok, half, low), np.where(ok, high, half - 1)
        return low

    def equal(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (total[a + size] - total[a]) * back[a] == (total[b + size] - total[b]) * back[b]

    return (longest(i, lambda k: equal(i - k, j - k, k)),
            longest(n - j, lambda k: equal(i, j, k)))


def is_run(s: np.ndarray, run: Run) -> bool:
    start, length, period = run
    end = start + length
    return (bool((s[start:end - period] == s[start + period:end]).all())
            and (start == 0 or s[start - 1] != s[start - 1 + period])
            and (end == len(s) or s[end] != s[end - period]))


def extended(s: np.ndarray, at: int, period: int) -> Run:
    """The stretch around a root, word by word."""
    start, end = at, at + period
    while start > 0 and s[start - 1] == s[start - 1 + period]:
        start -= 1
    while end < len(s) and s[end] == s[end - period]:
        end += 1
    return start, end - start, period


def runs_of(s: np.ndarray, copies: int = COPIES, least: int = LEAST) -> list[Run]:
    """(start, length, period) of all runs of at least `copies` periods and `least` words."""
    if len(s) < least:
        return []
    plain = s.tolist()
    most = max(plain)
    period = np.array([*lyndon_lengths(plain), *lyndon_lengths([most - c for c in plain])])
    at = np.concatenate([np.arange(len(s))] * 2)
    fits = at + period < len(s)
    at, period = at[fits], period[fits]
    before, after = extensions(s, at, at + period)
    length = before + after + period
    long = np.flatnonzero((length >= copies * period) & (length >= least))
    out = set()
    for k in long.tolist():
        run = (int(at[k] - before[k]), int(length[k]), int(period[k]))
        if run not in out:
            out.add(run if is_run(s, run) else extended(s, int(at[k]), int(period[k])))
    return sorted((r for r in out if r[1] >= max(least, copies * r[2])),
                  key=lambda r: (r[0], r[2]))


def stretches(s: np.ndarray, copies: int = COPIES) -> list[tuple[int, int]]:
    """Ranges of words outside of which no run of `copies` periods has a word."""
    n = len(s) - GRAM + 1
    if n < 2:
        return []
    # Two steps of pairs, so that the numbers of windows fit 64 bits at any length.
    two = np.unique(s[:-1] * (int(s.max()) + 1) + s[1:], return_inverse=True)[1].astype(np.int64)
    gram = two[:-2] * (int(two.max()) + 1) + two[2:]
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    if not same.any():
        return []
    far = np.iinfo(np.int64).max // (2 * copies)
    gap = np.where(same, order[1:] - order[:-1], far)
    near = np.full(n, far)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    live = near < far
    while True:
        edge = np.flatnonzero(np.diff(np.r_[False, live, False]))
        first, last = edge[::2], edge[1::2]
        size = np.repeat(last - first + GRAM - 1, last - first)
        keep = copies * near[live] <= size
        if keep.all():
            return list(zip(first.tolist(), (last + GRAM - 1).tolist(), strict=True))
        live[live] = keep


def find(words: list[bytes]) -> list[Run]:
    """All runs of a list of words, by start, then period."""
    number: dict[bytes, int] = {}
    s = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    return sorted(((a + start, length, period) for a, b in stretches(s)
                   for start, length, period in runs_of(s[a:b])),
                  key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()),
                           ("period", pa.int64())]))


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs by start and period, and the text without their repetitions.

    The collapsed text holds the kept words joined by one space.
    """
    source = columns_of(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    kind = source.schema["doc_id"].dataType.simpleString()
    if kind == "void":
        source, kind = source.withColumn("doc_id", F.col("doc_id").cast("bigint")), "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                # Bytes split at just the six white-space characters of the word pattern.
                words = [(t.as_py() or "").encode().split() for t in part.column(1)]
                found = [find(w) for w in words]
                flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3).T
                ends = np.cumsum([0, *map(len, found)])
                text = [b" ".join(collapsed(w, f)) for w, f in zip(words, found, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(map(len, words), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                        [pa.array(c, pa.int64()) for c in flat], fields=list(RUNS.value_type))),
                    pa.array(text, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return source.mapInArrow(
        run, f"doc_id {kind}, n_words bigint, "
             "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
