"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

1. Each document becomes ids plus an end id; one longer than a sequence is cut, its first
   piece holding the remainder and all others a full sequence. Only lengths and checksums
   are kept.
2. A histogram of piece lengths (at most `capacity` rows) is all the planner sees. It fills
   a bin greedily, largest first, then swaps the bin's smallest piece for the two unpacked
   pieces that fill its widened gap best; the same bin is repeated while the histogram
   allows, so the plan holds runs of equal bins and its size does not grow with the corpus.
3. Pieces of one length are ranked in blocks; the rank picks bin and place.

Null text counts as empty: one end id. Any column but the text may be null, rows may repeat;
each row is packed on its own. An empty table gives an empty result. Further columns are
ignored.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import columns_of
from attestry.llm.ranking import ranked
from attestry.session import stored

SEQUENCE = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
CACHED_WORDS = 200_000
# Texts with longer runs of white space go to the second library: the first one's
# pattern matcher recurses on them. So do texts that hold an added token of the vocabulary.
SPACE_RUN = 1000

_TWO_SPACES = re.compile(r"\s\s|\x00")
_LONG_RUN = re.compile(r"\s{%d}" % SPACE_RUN)


class Encoder(dict):
    """Token ids as little-endian 32-bit bytes; remembers words, forgets all when full.

    Before a space between two other characters the vocabulary's pattern always breaks,
    so such texts are looked up word by word.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        path = public_tokenizers.path
        self._json = path(f"{vocabulary}.json")
        with open(self._json, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self._added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        with open(path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._plain = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = _packed(self._plain(word))
        self[word] = ids
        return ids

    @lru_cache(maxsize=1)  # noqa: B019 - one encoder per worker
    def _careful(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._json)

    __hash__ = object.__hash__

    def ids(self, text: str) -> bytes:
        added = self._added.search(text)
        if not added and not _TWO_SPACES.search(text):
            return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").split("\0")))
        if added or _LONG_RUN.search(text):
            return _packed(self._careful().encode(text, add_special_tokens=False).ids)
        return _packed(self._plain(text))


def _packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


PIECES = pa.schema([("row", pa.int32()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece: the remainder first, then full ones."""
    at, size = 0, length % capacity or capacity
    while at < length:
        yield at, size
        at, size = at + size, capacity


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = SEQUENCE,
           end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""
    source = columns_of(docs, "doc_id", "text").select(
        "doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), _packed([end_id])
        for b in batches:
            rows = []
            for i, text in enumerate(b.column(1)):
                ids = enc.ids(text.as_py() or "") + end
                for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((i, k, at, n, zlib.crc32(ids[4 * at:4 * (at + n)])))
            cols = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0])),
                 *[pa.array(c, t) for c, t in zip(cols[1:], PIECES.types[1:], strict=True)]],
                names=["doc_id", *PIECES.names[1:]])

    kind = source.schema["doc_id"].dataType.simpleString()
    if kind == "void":
        source, kind = source.withColumn("doc_id", F.col("doc_id").cast("long")), "bigint"
    return source.mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_pair(free: np.ndarray, least: int, most: int) -> tuple[int, int]:
    """Two free lengths with the largest sum in (least, most], or (0, 0).

    `free` holds how many pieces of each length are unpacked.
    """
    sizes = np.flatnonzero(free)
    sizes = sizes[sizes < most]
    if not len(sizes):
        return 0, 0
    # For each first piece, the largest second one that fits; of two equal ones, two are needed.
    at = np.searchsorted(sizes, np.minimum(most - sizes, sizes), "right") - 1
    alone = (at >= 0) & (sizes[at] == sizes) & (free[sizes] < 2)
    at = np.where(alone, at - 1, at)
    total = np.where(at >= 0, sizes + sizes[np.maximum(at, 0)], 0)
    k = int(np.argmax(total))
    return (int(sizes[k]), int(sizes[at[k]])) if total[k] > least else (0, 0)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Bins as (how often, lengths), most often repeated as long as nothing would change."""
    free = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        free[size] = n
    plan = []
    while free.any():
        left, gap, bin_ = free.copy(), capacity, []
        largest = capacity
        while gap:
            fits = np.flatnonzero(left[:min(gap, largest) + 1])
            if not len(fits):
                break
            largest = int(fits[-1])
            n = int(min(left[largest], gap // largest))
            bin_ += [largest] * n
            left[largest] -= n
            gap -= n * largest
            largest -= 1
        used = np.bincount(bin_, minlength=capacity + 1)
        need = used.copy()
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            a, b = best_pair(left, smallest, gap + smallest)
            if a:
                bin_ = [*bin_[:-1], a, b]
                used[smallest] -= 1
                for size in (a, b):
                    used[size] += 1
                    need[size] += 1
        times = int((free[need > 0] // need[need > 0]).min())
        plan.append((times, bin_))
        free -= times * used
    return plan


def slots(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """A row per place of a planned bin, ordered by length: each serves `times` ranks."""
    rows, sequence = [], 0
    for times, bin_ in plan:
        offset = 0
        for size in bin_:
            rows.append((size, sequence, offset, times))
            offset += size
        sequence += times
    size, seq, offset, times = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows \
        else (np.zeros(0, np.int64),) * 4
    order = np.argsort(size, kind="stable")
    size, seq, offset, times = size[order], seq[order], offset[order], times[order]
    start = np.cumsum(times) - times
    return {"size": size, "sequence": seq, "offset": offset, "start": start}


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = SEQUENCE,
         end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    table = stored(pieces(docs, vocabulary, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"]
              for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = slots(best_two_fit(counts, capacity))
    # Ranks of a length begin where those of all shorter lengths end.
    first = np.concatenate([[0], np.cumsum(np.bincount(
        list(counts), list(counts.values()), capacity + 1).astype(np.int64))])
    numbered = ranked(table, ["length"],
                      [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")],
                      F.concat_ws(":", F.col("doc_id").cast("string"), "piece", "ids_crc32"),
                      sum(counts.values()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            slot = first[length] + b.column(b.schema.get_field_index("rank")).to_numpy()
            k = np.searchsorted(places["start"], slot, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1],
                 pa.array(places["sequence"][k] + slot - places["start"][k], pa.int64()),
                 pa.array(places["offset"][k], pa.int64())],
                names=[*b.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return numbered.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")
