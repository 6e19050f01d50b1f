"""Exact duplicates through compressed radix tries that hold whole texts.

1. Each scan task inserts its texts into a trie; a text already there points to the row
   that brought it, a new one is its own representative. The trie is dropped when it holds
   `budget` bytes, so a text has one representative per task and budget at most, however
   many copies the corpus has.
2. Representatives are dealt out by length and content hash and sorted by both, which is the
   order of the trie's subtrees. A task inserts one subtree at a time, byte for byte, and
   lets it go when the next begins: Spark's sorter spills what waits. A terminal node keeps
   the smallest identifier that reached it.
3. Copies are counted per representative, then per terminal, and go back the same way, so
   no task meets all copies of a text.

Texts are equal when they are identical without the characters `[\\x20\\x09-\\x0D]`; null
counts as empty. Of equal texts the row with most code points in its original text stays,
then the smallest doc_id (null last), then the first row. Rows that repeat an id are rows of
their own: exactly one row of a group stays. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import SPACES
from attestry.session import stored

TRIE_BYTES = 24 << 20
_MARKS = "row_key bigint, rep_key bigint, n_bytes bigint, head bigint, code_points bigint, " \
         "sha256 string"


class Node:
    """A node of a radix trie: `edges` by first byte, `least` where a text ends."""

    __slots__ = ("edges", "least")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.least: int | None = None


def common_prefix(a: bytes, b: bytes) -> int:
    """How many leading bytes agree, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Whole byte strings in a compressed radix trie."""

    def __init__(self):
        self.root = Node()
        self.bytes = 0

    def insert(self, text: bytes, identifier: int) -> Node:
        """The terminal node of the text; it keeps the smallest identifier."""
        node, at = self.root, 0
        while at < len(text):
            found = node.edges.get(text[at])
            if found is None:
                end = Node()
                node.edges[text[at]] = (text[at:], end)
                self.bytes += len(text) - at
                node, at = end, len(text)
                break
            label, child = found
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = common_prefix(label, text[at:at + len(label)])
            fork = Node()
            fork.edges[label[k]] = (label[k:], child)
            node.edges[text[at]] = (label[:k], fork)
            node, at = fork, at + k
        node.least = identifier if node.least is None else min(node.least, identifier)
        return node


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACES)


def content_key(text: bytes) -> bytes:
    """Length and content hash: the first bytes on the way to a text's leaf."""
    return len(text).to_bytes(8, "big") + hashlib.sha256(text).digest()[:8]


def marked(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """`docs` with row_key, rep_key, n_bytes, head, code_points and sha256.

    row_key numbers rows by task and place; write the result before using it twice.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        trie = Trie()
        for b in batches:
            out = [[], [], [], [], [], []]
            for value in b.column(at):
                text = value.as_py() or ""
                plain = normalised(text.encode())
                digest = hashlib.sha256(plain).digest()
                rep = trie.insert(len(plain).to_bytes(8, "big") + digest[:8] + plain, row).least
                for column, v in zip(out, (row, rep, len(plain),
                                           int.from_bytes(digest[:8], "big", signed=True),
                                           len(text), digest.hex()), strict=True):
                    column.append(v)
                row += 1
                if trie.bytes > budget:
                    trie = Trie()
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array(c, pa.int64()) for c in out[:5]],
                 pa.array(out[5], pa.string())],
                names=[f"c{i}" for i in range(b.num_columns)] + ["row_key", "rep_key", "n_bytes",
                                                                 "head", "code_points", "sha256"])

    given = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(
        run, f"{given}, {_MARKS}")


def owners(reps: DataFrame, subtree: Callable[[int, int], object] = lambda n, head: (n, head)
           ) -> DataFrame:
    """(rep_key, n_bytes, head, text) to (rep_key, owner_rep), by tries over whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(nodes: list[tuple[int, Node]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in nodes], pa.int64()),
                 pa.array([n.least for _, n in nodes], pa.int64())],
                names=["rep_key", "owner_rep"])

        trie, current, nodes, ready = Trie(), None, [], []
        for b in batches:
            for key, n, head, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                          b.column(2).to_pylist(), b.column(3), strict=True):
                if current != subtree(n, head):
                    trie, current = Trie(), subtree(n, head)
                    ready += nodes
                    nodes = []
                    if len(ready) >= 10_000:
                        yield done(ready)
                        ready = []
                plain = normalised((text.as_py() or "").encode())
                nodes.append((key, trie.insert(plain, key)))
        yield done(ready + nodes)

    dealt = reps.select("rep_key", "n_bytes", "head", "text").repartition(
        F.col("n_bytes"), F.col("head")).sortWithinPartitions("n_bytes", "head")
    return dealt.mapInArrow(run, "rep_key bigint, owner_rep bigint")


def groups(docs: DataFrame, budget: int = TRIE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The marked table (columns c0.. as in `docs`) and a row per representative.

    The second table has rep_key, keep_row, keep_id and group_size.
    """
    table = stored(marked(docs, budget), "marked")
    names = dict(zip(docs.columns, table.columns, strict=False))
    doc_id = F.col(names["doc_id"])
    reps = table.filter("row_key = rep_key").select(
        "rep_key", "n_bytes", "head", F.col(names["text"]).alias("text"))
    best = F.min(F.struct((-F.col("code_points")).alias("shorter"), doc_id.isNull().alias("unnamed"),
                          doc_id.alias("doc_id"), F.col("row_key").alias("row_key")))
    per_rep = table.groupBy("rep_key").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    linked = stored(per_rep.join(owners(reps), "rep_key"), "owners")
    total = linked.groupBy("owner_rep").agg(F.sum("n").alias("group_size"),
                                            F.min("best").alias("stays"))
    return table, linked.join(total, "owner_rep").select(
        "rep_key", F.col("stays.row_key").alias("keep_row"),
        F.col("stays.doc_id").alias("keep_id"), "group_size")


def _with_text(docs: DataFrame) -> DataFrame:
    for name, kind in (("doc_id", "bigint"), ("text", "string")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    void = [f.name for f in docs.schema if f.dataType.simpleString() == "void"]
    docs = docs.withColumns({n: F.col(n).cast("bigint" if n == "doc_id" else "string")
                             for n in void})
    return docs.withColumn("text", F.col("text").cast("string"))


def duplicates(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row."""
    table, reps = groups(_with_text(docs).select("doc_id", "text"), budget)
    return table.join(reps, "rep_key").select(
        F.col("c0").alias("doc_id"), "keep_id", F.col("group_size").cast("long"),
        (F.col("row_key") == F.col("keep_row")).alias("kept"),
        F.col("sha256").alias("text_sha256"))


def deduplicated(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns."""
    docs = _with_text(docs)
    table, reps = groups(docs, budget)
    # A rep names one keep_row; equal ones of different reps are the same row.
    stay = reps.select(F.col("keep_row").alias("row_key")).distinct()
    given = table.columns[:len(docs.columns)]
    return table.join(stay, "row_key", "left_semi").select(
        *[F.col(g).alias(n) for g, n in zip(given, docs.columns, strict=True)])
