"""Exact Jaccard join of word shingles by partitioning the universe of tokens.

Texts become sets of hashed shingles; texts with the same set are one class. Two sets that
link differ in at most H tokens, H growing with their sizes, so sizes are cut into bands
(sets that link lie in one band or two neighbouring ones) and each band has its own
partition of the hash range into H + 1 segments.

1. Pigeonhole. Linked sets agree on a whole segment. Every set is indexed by its non-empty
   segment subsets, one row (signature, class) each. Empty segments say nothing and get no row.
2. One-deletion neighbourhoods. If a pair agrees on q segments, all of them empty or given up
   (below), the others differ, at most q - 1 of them by two tokens or more. So among any q
   other segments one differs by exactly one token. A set with z empty segments publishes the
   neighbourhoods of its first z segments of `RICH` tokens or more: the shorter of the two
   prefixes has such a segment, and both sides hold tokens there. Subset meets neighbourhood
   in the same shuffle. Sets with fewer than z such segments publish what they have, and,
   among themselves, their empty segments.
3. Cost-based allocation. A signature held by more than `LIGHT` classes is dear. A set with k
   dear segments gives them up if it has z + 2k rich segments: of the 2k more, k at most are
   agreed on and k at most differ by more. It publishes the neighbourhoods of these too. Sets
   that have too few keep their dear segments.
4. Dear signatures that remain belong to sets alike in most segments, such as thousands of
   edited copies. Each such set is compared with one hub of the signature, the set with most
   dear segments, and keeps the tokens in which it differs from it. Sets that the links so
   far leave outside their hub's component are then held against all members of the hub, in
   blocks: two sets differ in the tokens in which those differences differ, which decides
   exactly. A neighbourhood signature that very many sets share is treated in the same way.
5. Every other candidate is verified on its texts, after the parities of hashed tokens, which
   differ in no more places than the sets in tokens, have ruled out the pairs that differ too
   much. Components follow from the links.

No bucket is capped, no member dropped. Shingles are compared as 64-bit hashes, classes as
128-bit hashes of their sets. Null and empty texts have no shingles and link with nothing.
Rows that repeat an id stay rows of their own; a component is named by its least doc_id.
Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import (
    LOWER,
    Texts,
    chunks,
    columns_of,
    mix,
    window_hashes,
    word_hashes,
    words,
)
from attestry.llm.components import components
from attestry.session import stored

WIDTH, PERCENT = 3, 90
LIGHT = 16
RICH = 4  # tokens of a segment whose neighbourhood is worth a row each
FILTER_WORDS = 1 << 16  # 64-bit words of the filter of wanted classes: 512 kB
REST_BLOCK, MEMBER_BLOCK = 256, 4096
MOST_SHINGLES = 1 << 32  # more than a string can hold
_SALT = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(t: Texts, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    w = words(t)
    h = word_hashes(t, w, LOWER)
    spans = window_hashes(h, width)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(spans[a:b - width + 1]))
        else:
            out.append(window_hashes(h[a:b], b - a) if b > a else h[a:a])
    return out


def class_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _short(c: bytes) -> int:
    return int.from_bytes(c[:8], "little", signed=True)


@lru_cache(maxsize=8)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size of each band, most tokens a larger partner has, number of segments."""
    low, upper, segments = [1], [], []
    while low[-1] < MOST_SHINGLES:
        low.append(low[-1] * 100 // percent + 1)
        a = low[-1] - 1
        upper.append(a * 100 // percent)
        segments.append((a + upper[-1]) * (100 - percent) // (100 + percent) + 1)
    return np.array(low), np.array(upper), np.array(segments)


def groups_of(n: int, percent: int) -> list[int]:
    """The bands a set of n tokens takes part in: its own and, as the larger, the one below."""
    low, upper, _ = bands(percent)
    k = int(np.searchsorted(low, n, "right")) - 1
    return [k, k - 1] if k and n <= upper[k - 1] else [k]


def segment_sums(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of token codes in each segment of the hash range, and where segments begin."""
    seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    at = np.searchsorted(seg, np.arange(m + 1, dtype=np.uint64))
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s ^ _SALT), out=total[1:])
    return total[at[1:]] - total[at[:-1]], at


def signature(sums: np.ndarray, group: int, segment: np.ndarray) -> np.ndarray:
    place = (np.uint64(group) << np.uint64(32)) + segment.astype(np.uint64)
    return mix(sums + mix(place + np.uint64(1)))


def deletions(s: np.ndarray, group: int, m: int, some: np.ndarray) -> np.ndarray:
    """Signatures of some segments with one token left out, for each of their tokens."""
    sums, at = segment_sums(s, m)
    length = at[some + 1] - at[some]
    seg = np.repeat(some, length)
    token = np.arange(len(seg)) - np.repeat(np.cumsum(length) - length, length) + at[seg]
    return signature(sums[seg] - mix(s[token] ^ _SALT), group, seg)


def rich_segments(at: np.ndarray, more: int) -> tuple[np.ndarray, int]:
    """The first rich segments, one per empty one and `more`; how many are lacking."""
    size = np.diff(at)
    need = int((size == 0).sum()) + more
    rich = np.flatnonzero(size >= RICH)[:need]
    return rich, need - len(rich)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of tokens per place, in at least as many places as tokens."""
    places = 1 << max(6, int(len(s) - 1).bit_length())
    at = (s & np.uint64(places - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=places) & 1, bitorder="little").tobytes()


def fewest_differences(x: bytes, y: bytes) -> int:
    """A lower bound, by their sketches, of the tokens in which two sets differ."""
    if len(x) < len(y):
        x, y = y, x
    v = int.from_bytes(x, "little")
    bits = 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        v = (v >> bits) ^ (v & ((1 << bits) - 1))
    return (v ^ int.from_bytes(y, "little")).bit_count()


def _texts(docs: DataFrame) -> DataFrame:
    source = columns_of(docs, "doc_id", "text")
    void = source.schema["doc_id"].dataType.simpleString() == "void"
    return source.select(F.col("doc_id").cast("bigint") if void else F.col("doc_id"),
                         F.col("text").cast("string"))


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def classes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, class c (null without shingles) and its first half c64."""
    source = _texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for t in chunks(b.column(1)) for s in shingle_sets(t, width)]
            c = [class_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(c, pa.binary()),
                 pa.array([_short(x) if x else None for x in c], pa.int64())],
                names=["doc_id", "n_shingles", "c", "c64"])

    return source.mapInArrow(
        run, f"doc_id {_kind(source)}, n_shingles bigint, c binary, c64 bigint")


def _pack(n, group, part):
    """Size of a set, band, and whether the signature lacks a token."""
    return (n << 11) | (group << 1) | part


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def index_of(s: np.ndarray, group: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set in a band: of its segments, and of those that lack a token."""
    sums, at = segment_sums(s, m)
    full = np.flatnonzero(at[1:] > at[:-1])
    own = signature(sums[full], group, full)
    if len(full) == m:
        return own, own[:0]
    some, lacking = rich_segments(at, 0)
    if lacking:
        void = np.flatnonzero(at[1:] == at[:-1])
        own = np.concatenate([own, signature(sums[void], group, void)])
    return own, deletions(s, group, m, some)


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """sig, c64, info for every class a task meets, once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = bands(percent)[2]
        met: set[bytes] = set()
        for b in batches:
            for t in chunks(b.column(0)):
                sig, c64, info = [], [], []
                for s in shingle_sets(t, width):
                    if not len(s) or (c := class_of(s)) in met:
                        continue
                    met.add(c)
                    for g in groups_of(len(s), percent):
                        own, parts = index_of(s, g, int(segments[g]))
                        sig += [own, parts]
                        c64.append(np.full(len(own) + len(parts), _short(c), np.int64))
                        info += [np.full(len(own), _pack(len(s), g, 0), np.int64),
                                 np.full(len(parts), _pack(len(s), g, 1), np.int64)]
                if len(met) > 1_000_000:
                    met.clear()
                if sig:
                    yield pa.RecordBatch.from_arrays(
                        [_long(np.concatenate(x)) for x in (sig, c64, info)],
                        names=["sig", "c64", "info"])

    return _texts(docs).select("text").mapInArrow(run, "sig bigint, c64 bigint, info bigint")


PAIR, DEAR, NEAR = 0, 1, 2


def _runs(percent: int, light: int):
    """Signature rows, whole ones first, to pairs (a, b) and rows of dear signatures.

    A whole signature is dear (DEAR) with more than `light` holders. One with holders that
    lack a token is dear (NEAR) once whole ones times others exceed light squared; its whole
    holders are NEAR rows too unless they are DEAR rows.
    """
    long = light * light + light + 2

    def out(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int8)), *[pa.array(c, pa.int64()) for c in columns]],
            names=["kind", "a", "b", "info"])

    def settle(sig, c64, info):
        """Pairs and dear rows of whole runs."""
        if not len(sig):
            return
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        length = np.diff(np.r_[first, len(sig)])
        part = (info & 1) == 1
        parts = np.add.reduceat(part.astype(np.int64), first)
        wholes = length - parts
        many, near = wholes > light, wholes * parts > light * light
        dear = np.repeat(many, length)
        for kind, rows in ((DEAR, dear & ~part), (NEAR, np.repeat(near, length) & (part | ~dear))):
            if rows.any():
                yield out(kind, sig[rows], c64[rows], info[rows])
        # Whole rows of a run meet the whole rows after them, and all rows that lack a token.
        others = np.repeat(first + wholes, length)
        x = np.arange(len(sig))
        later = np.where(part | dear, 0, others - x - 1)
        lacking = np.repeat(np.where(near, 0, parts), length) * ~part
        for start, count in ((x + 1, later), (others, lacking)):
            left, step = np.flatnonzero(count), 0
            while len(left):
                y = start[left] + step
                n1, n2 = info[left] >> 11, info[y] >> 11
                ok = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
                if ok.any():
                    a, b = c64[left[ok]], c64[y[ok]]
                    yield out(PAIR, a, b, np.zeros(len(a), np.int64))
                step += 1
                left = left[count[left] > step]

    def flood(sig, c64, info, whole: bool):
        """Rows of a run too long to wait for its end; `whole`: whole rows came before."""
        part = (info & 1) == 1
        if (~part).any():
            yield out(DEAR, sig[~part], c64[~part], info[~part])
        if part.any() and (whole or not part.all()):
            yield out(NEAR, sig[part], c64[part], info[part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        flooded, whole = None, False  # the signature of a long run, and if it has whole rows
        for b in batches:
            cols = [np.concatenate([r, c.to_numpy(zero_copy_only=False)])
                    for r, c in zip(rest, b.columns, strict=True)]
            if not len(cols[0]):
                continue
            keep = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
            cols = [c[keep] for c in cols]
            if flooded is not None:
                end = int(np.searchsorted(cols[0], flooded, "right"))
                # The last row of the batch before came along to be told from its repeats.
                yield from flood(*[c[1:end] for c in cols], whole)
                if end == len(cols[0]):
                    whole = whole or bool(((cols[2] & 1) == 0).any())
                    rest = [c[-1:] for c in cols]
                    continue
                cols, flooded = [c[end:] for c in cols], None
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            yield from settle(*[c[:cut] for c in cols])
            rest = [c[cut:] for c in cols]
            if len(rest[0]) > long:
                flooded, whole = rest[0][0], bool(((rest[2] & 1) == 0).any())
                wholes = (rest[2] & 1) == 0
                if 0 < wholes.sum() <= light:
                    # Few whole rows and many others: all of them meet at a hub.
                    yield out(NEAR, *rest)
                else:
                    yield from flood(*rest, whole)
                rest = [c[-1:] for c in rest]
        if flooded is None:
            yield from settle(*rest)

    return run


def wanted_filter(want: DataFrame) -> np.ndarray:
    """A bit for each wanted c64, in FILTER_WORDS words whatever their number."""
    at = F.pmod(F.col("c64"), F.lit(FILTER_WORDS))
    bit = F.pmod(F.expr(f"c64 div {FILTER_WORDS}"), F.lit(64)).cast("int")
    rows = want.select(at.alias("w"), F.expr("1L").alias("one"), bit.alias("bit")).groupBy("w").agg(
        F.bit_or(F.call_function("shiftleft", "one", "bit")).alias("bits")).collect()
    out = np.zeros(FILTER_WORDS, np.int64)
    for r in rows:
        out[r["w"]] = r["bits"]
    return out.view(np.uint64)


def class_texts(docs: DataFrame, want: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """c, c64, n, text for the wanted c64, from one document of each class."""
    source = _texts(docs)
    bits = wanted_filter(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in chunks(b.column(1)):
                rows, c, n = [], [], []
                for i, s in enumerate(shingle_sets(t, width)):
                    if not len(s):
                        continue
                    x = class_of(s)
                    short = _short(x)
                    # SQL's div rounds towards zero.
                    bit = int(abs(short) // FILTER_WORDS * (1 if short >= 0 else -1)) % 64
                    if int(bits[short % FILTER_WORDS]) >> bit & 1:
                        rows.append(t.first + i)
                        c.append(x)
                        n.append(len(s))
                if rows:
                    at = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(at), pa.array(c, pa.binary()), pa.array(n, pa.int64()),
                         b.column(1).take(at)], names=["doc_id", "c", "n", "text"])

    found = source.mapInArrow(run, f"doc_id {_kind(source)}, c binary, n bigint, text string")
    rep = known.join(want.select("c64").distinct(), "c64").select("c", "c64", "rep")
    f, r = found.alias("f"), rep.alias("r")
    return f.join(r, (F.col("f.c") == F.col("r.c")) & F.col("f.doc_id").eqNullSafe(F.col("r.rep"))
                  ).select("r.c", "r.c64", "f.n", "f.text")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, hub) pairs of c64 to (a, b, ca, cb, na, nb, shared, delta).

    Pairs whose sizes allow no link are left out unless one side is the other's hub; then
    delta holds the tokens in which the two sets differ.
    """
    a = texts.select(F.col("c64").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"),
                     F.col("text").alias("ta"))
    b = texts.select(F.col("c64").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"),
                     F.col("text").alias("tb"))
    sized = pairs.join(texts.select(F.col("c64").alias("a"), F.col("n").alias("na")), "a").join(
        texts.select(F.col("c64").alias("b"), F.col("n").alias("nb")), "b").filter(
        F.col("hub") | (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).groupBy(
        "a", "b").agg(F.max("hub").alias("hub"))
    both = sized.join(a, "a").join(b, "b").select(
        "a", "b", "ca", "cb", "na", "nb", "hub", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [[s for t in chunks(part.column(k)) for s in shingle_sets(t, width)]
                        for k in (7, 8)]
                shared = [overlap(x, y) for x, y in zip(*sets, strict=True)]
                delta = [np.setxor1d(x, y, assume_unique=True).tobytes() if hub else None
                         for x, y, hub in zip(*sets, part.column(6).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:6], pa.array(shared, pa.int64()), pa.array(delta, pa.binary())],
                    names=["a", "b", "ca", "cb", "na", "nb", "shared", "delta"])

    return both.mapInArrow(run, "a bigint, b bigint, ca binary, cb binary, na bigint, nb bigint, "
                                "shared bigint, delta binary")


def possible(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out."""
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(
                    [sketch(s) for t in chunks(b.column(2)) for s in shingle_sets(t, width)],
                    pa.binary())], names=["c64", "n", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb, sa, sb = (c.to_pylist() for c in b.columns[2:])
            ok = [fewest_differences(x, y) * (100 + percent) <= (n + m) * (100 - percent)
                  for n, m, x, y in zip(na, nb, sa, sb, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    made = stored(texts.select("c64", "n", "text").mapInArrow(
        sketches, "c64 bigint, n bigint, s binary"), "sketches")
    a = made.select(F.col("c64").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    b = made.select(F.col("c64").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    return pairs.distinct().join(a, "a").join(b, "b").filter(
        100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select(
        "a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def linked(percent: int):
    return 100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))


def allocation(dear: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(c64, g, k): a set's dear segments, whether it gives them up, the prefix it publishes."""
    held = dear.groupBy("c64", "g").agg(F.count(F.lit(1)).alias("k")).join(
        texts, "c64").select("c64", "g", "k", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = bands(percent)[2]
        for b in batches:
            g, k = (c.to_numpy(zero_copy_only=False) for c in b.columns[1:3])
            gives, prefix, i = [], [], 0
            for t in chunks(b.column(3)):
                for s in shingle_sets(t, width):
                    at = segment_sums(s, int(segments[g[i]]))[1]
                    rich, lacking = rich_segments(at, 2 * int(k[i]))
                    gives.append(not lacking)
                    prefix.append(int(rich[-1]) + 1 if not lacking else 0)
                    i += 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(gives, pa.bool_()), pa.array(prefix, pa.int64())],
                names=["c64", "g", "k", "gives", "prefix"])

    per = stored(held.mapInArrow(run, "c64 bigint, g int, k bigint, gives boolean, prefix bigint"),
                 "per")
    # One row per band, of which there are some two hundred. Who keeps dear segments publishes
    # as far as anyone of the band who gives them up.
    most = per.groupBy("g").agg(F.max("prefix").alias("most"))
    return per.join(F.broadcast(most), "g").select(
        "c64", "g", "k", "gives", F.when(F.col("gives"), F.col("prefix")).otherwise(
            F.col("most")).cast("int").alias("publish"))


def neighbours(records: DataFrame, texts: DataFrame, width: int, percent: int, light: int
               ) -> tuple[DataFrame, DataFrame]:
    """Sets whose published segments differ by one token: pairs (a, b), and (c64, hub).

    A signature is cheap while whole subsets times neighbourhoods stay within light squared;
    the holders of a dear one are compared with its hub.
    """
    rows = records.filter("publish > 0").join(texts, "c64").select(
        "c64", "g", "publish", "n", "k", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = bands(percent)[2]
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                c64, g, publish, n, dear = (c.to_pylist() for c in part.columns[:5])
                sets = [s for t in chunks(part.column(5)) for s in shingle_sets(t, width)]
                for i, s in enumerate(sets):
                    m = int(segments[g[i]])
                    sums, at = segment_sums(s, m)
                    some = np.arange(min(publish[i], m))
                    size = np.diff(at)[some]
                    whole = signature(sums[some[size > 0]], g[i], some[size > 0])
                    without = deletions(s, g[i], m, some[size >= RICH])
                    size = len(whole) + len(without)
                    yield pa.RecordBatch.from_arrays(
                        [_long(np.concatenate([whole, without])),
                         *[pa.array(np.full(size, x[i], np.int64)) for x in (c64, n, dear)],
                         pa.array(np.arange(size) < len(whole))],
                        names=["sig", "c64", "n", "k", "whole"])

    published = stored(rows.mapInArrow(
        run, "sig bigint, c64 bigint, n bigint, k bigint, whole boolean"), "published")
    met = published.groupBy("sig").agg(
        F.count(F.when(F.col("whole"), 1)).alias("wholes"),
        F.count(F.when(~F.col("whole"), 1)).alias("parts"),
        F.max(F.struct("k", "c64")).alias("h")).filter("wholes > 0 AND parts > 0").select(
        "sig", (F.col("wholes") * F.col("parts") <= light * light).alias("cheap"),
        F.col("h.c64").alias("hub"))
    held = stored(published.join(met, "sig").select("sig", "c64", "n", "whole", "cheap", "hub"),
                  "held")
    x = held.filter("cheap AND whole").select("sig", F.col("c64").alias("x"), F.col("n").alias("nx"))
    y = held.filter("cheap AND NOT whole").select(
        "sig", F.col("c64").alias("y"), F.col("n").alias("ny"))
    pairs = x.join(y, "sig").filter(
        (F.col("x") != F.col("y"))
        & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs, held.filter("NOT cheap AND c64 <> hub").select("c64", "hub").distinct()


def with_hub(rows: DataFrame, weight: str) -> DataFrame:
    """(c64, hub) for the holders of each signature; the hub is the one of most weight."""
    hub = rows.groupBy("sig").agg(F.max(F.struct(weight, "c64")).alias("h")).select(
        "sig", F.col("h.c64").alias("hub"))
    return rows.join(hub, "sig").filter(F.col("c64") != F.col("hub")).select(
        "c64", "hub").distinct()


def outside_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a hub that lie in different components.

    `members` is (hub, hub_root, c, root, n, delta); one side of a link is outside the hub's
    component. Two sets differ in just those tokens in which one of their deltas differs
    from the other, so deltas decide. Blocks of outsiders meet blocks of members, each pair
    of blocks in a task of its own; an outsider names one link into each component.
    """
    outside = F.col("root") != F.col("hub_root")
    size = members.groupBy("hub").agg(
        F.ceil(F.count(F.when(outside, 1)) / REST_BLOCK).cast("int").alias("rests"),
        F.ceil(F.count(F.lit(1)) / MEMBER_BLOCK).cast("int").alias("blocks")).filter("rests > 0")
    m = members.join(size, "hub").withColumn("at", F.xxhash64("c", F.lit(3)))
    kept = ("c", "root", "n", "delta")
    all_ = m.select("hub", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"),
                    F.pmod("at", "blocks").cast("int").alias("j"), *kept,
                    F.lit(False).alias("rest"))
    some = m.filter(outside).select(
        "hub", F.pmod(F.shiftright("at", 20), F.col("rests")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), *kept,
        F.lit(True).alias("rest"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root = pd.factorize(pdf["root"])[0]
        is_rest = pdf["rest"].to_numpy()
        u, v = pdf[is_rest], pdf[~is_rest]
        deltas = [np.frombuffer(d, np.uint64) for d in v["delta"]]
        length = np.array([len(d) for d in deltas], np.int64)
        tokens = np.concatenate([*deltas, np.zeros(0, np.uint64)])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], np.repeat(np.arange(len(v)), length)[order]
        n_v, root_v, name_v = v["n"].to_numpy(), root[~is_rest], v["c"].to_numpy()
        found = []
        for c, r, n, d in zip(u["c"], root[is_rest], u["n"], u["delta"], strict=True):
            own = np.frombuffer(d, np.uint64)
            low, high = (np.searchsorted(tokens, own, side) for side in ("left", "right"))
            meets = np.concatenate([*[owner[x:y] for x, y in zip(low, high, strict=True)],
                                    np.zeros(0, np.int64)]).astype(np.int64)
            common = np.bincount(meets, minlength=len(v))
            shared = (n + n_v - (len(own) + length - 2 * common)) // 2
            ok = np.flatnonzero((root_v != r) & (100 * shared >= percent * (n + n_v - shared)))
            for k in ok[np.unique(root_v[ok], return_index=True)[1]]:
                found.append((c, name_v[k]))
        return pd.DataFrame(found, columns=["a", "b"])

    return all_.unionAll(some).groupBy("hub", "i", "j").applyInPandas(run, "a binary, b binary")


def links(docs: DataFrame, known: DataFrame, width: int = WIDTH, percent: int = PERCENT,
          light: int = LIGHT) -> DataFrame:
    """Links (a, b) between classes that span their components; `known` is (c, c64, rep)."""
    found = stored(
        signatures(docs, width, percent).repartition("sig").sortWithinPartitions(
            "sig", F.col("info").bitwiseAND(F.lit(1)), "c64")
        .mapInArrow(_runs(percent, light), "kind tinyint, a bigint, b bigint, info bigint"),
        "found")
    pairs = found.filter(F.col("kind") == PAIR).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def holders(kind: int) -> DataFrame:
        return found.filter(F.col("kind") == kind).select(
            F.col("a").alias("sig"), F.col("b").alias("c64"),
            F.shiftright("info", 1).bitwiseAND(F.lit(1023)).cast("int").alias("g"),
            F.shiftright("info", 11).alias("n")).distinct()

    dear, lacking = stored(holders(DEAR), "dear"), stored(holders(NEAR), "lacking")
    pairs = stored(pairs, "pairs")
    want = pairs.select(F.col("a").alias("c64")).unionAll(
        pairs.select(F.col("b").alias("c64"))).unionAll(dear.select("c64")).unionAll(
        lacking.select("c64")).distinct()
    texts = stored(class_texts(docs, stored(want, "want"), known, width), "texts")
    records = stored(allocation(dear, texts, width, percent), "records")
    near, near_hubs = neighbours(records, texts, width, percent, light)
    kept = dear.join(records.filter("NOT gives").select("c64", "g", "k"), ["c64", "g"])
    # Whole holders of a signature that is dear both ways are in `dear`.
    meeting = lacking.select("sig", "c64", "n").unionAll(
        dear.join(lacking.select("sig").distinct(), "sig", "left_semi").select("sig", "c64", "n"))
    hubs = stored(with_hub(kept, "k").unionAll(with_hub(meeting, "n")).unionAll(
        near_hubs).distinct(), "hubs")
    plain = stored(possible(pairs.unionAll(near), texts, width, percent), "possible")
    plain = plain.withColumn("hub", F.lit(False))
    to_hub = hubs.select(F.least("c64", "hub").alias("a"), F.greatest("c64", "hub").alias("b"),
                         F.lit(True).alias("hub"))
    checked = stored(verified(plain.unionAll(to_hub), texts, width, percent), "checked")
    out = checked.filter(linked(percent)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    if hubs.isEmpty():
        return out
    root = components(out)
    known_pair = checked.filter("delta IS NOT NULL").alias("p")
    is_a = F.col("p.a") == F.col("h.c64")
    members = hubs.alias("h").join(
        known_pair, (F.col("p.a") == F.least("h.c64", "h.hub"))
        & (F.col("p.b") == F.greatest("h.c64", "h.hub"))).select(
        F.when(is_a, F.col("p.cb")).otherwise(F.col("p.ca")).alias("hub"),
        F.when(is_a, F.col("p.ca")).otherwise(F.col("p.cb")).alias("c"),
        F.when(is_a, F.col("p.na")).otherwise(F.col("p.nb")).alias("n"), "p.delta")
    hub_root = root.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    members = members.join(root.withColumnRenamed("node", "c"), "c", "left").join(
        hub_root, "hub", "left").select(
        "hub", F.coalesce("hub_root", "hub").alias("hub_root"), "c",
        F.coalesce("root", "c").alias("root"), "n", "delta")
    return out.unionAll(outside_links(stored(members, "members"), percent))


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT,
                light: int = LIGHT) -> DataFrame:
    """doc_id, n_shingles and component_id for every row."""
    table = stored(classes(docs, width), "classes")
    known = stored(table.filter("c IS NOT NULL").groupBy("c", "c64").agg(
        F.min("doc_id").alias("rep")), "known")
    root = components(links(docs, known, width, percent, light)).withColumnRenamed("node", "c")
    rooted = known.join(root, "c", "left").select(
        "c", "rep", F.coalesce("root", "c").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")),
                        "root").select("c", "component_id")
    # Rows without shingles skip the join; a class of very many rows is split by the join.
    full = table.filter("c IS NOT NULL").join(named, "c").select(
        "doc_id", "n_shingles", "component_id")
    return full.unionAll(table.filter("c IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
