"""A Merkle manifest of a dataset that grows by appends, with a witness for every row.

Every row is a leaf. Leaves of one group, in the order of their ids, are combined two by two
(a last one alone) until one node remains, the group's subroot; the subroots, ordered by
group, give the root in the same way. A witness holds the siblings on the way to the root.

1. Leaves get their place in their group: sampled ranges of (group, id) are sorted, each task
   counts its rows per group, and the counts before a range are added. No group meets in one
   task.
2. Groups are cut into aligned blocks of `2 ** LEVELS` places. In a block leaves are appended
   one by one to a stack of open subtrees; when two of equal height meet, each one's root goes
   to the witnesses of all members of the other, and the two become one. At the block's end
   the subtrees still open are closed in the same way.
3. Block roots are appended as the leaves of the next layer, until every group has one block.
   A leaf's witness is that of its place in its block, then that of its block in the next
   layer, and so on.

`append` takes an earlier manifest and adds rows: full blocks behind the last place stay as
they are, only blocks that get new nodes are worked out again, in every layer. New rows may
not come before earlier ones of their group; ValueError otherwise.

Null ids come first, as does the null group; rows that repeat an id are ordered by their leaf.
Null values are hashed as `-`, so null and empty differ. Texts of any length are hashed whole.
An empty table has no rows and no root. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.llm.common import columns_of
from attestry.session import stored

LEVELS = 10
SIZE = 32  # bytes of a digest


def joined(*digests: bytes) -> bytes:
    """H of digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def told(column: Column) -> Column:
    """A value with its length in bytes, `-` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[told(c) for c in columns]).cast("binary"), 256))


class Block:
    """Nodes appended one by one: open subtrees, and a witness per node."""

    def __init__(self) -> None:
        self.witness: list[list[bytes]] = []
        self.open: list[tuple[int, int, bytes]] = []  # height, first member, root

    def _merge(self) -> None:
        (height, middle, right), (_, first, left) = self.open.pop(), self.open.pop()
        for w in self.witness[first:middle]:
            w.append(right)
        for w in self.witness[middle:]:
            w.append(left)
        self.open.append((height + 1, first, joined(left, right)))

    def append(self, node: bytes) -> None:
        self.open.append((0, len(self.witness), node))
        self.witness.append([])
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._merge()

    def close(self, levels: int) -> bytes:
        """The root, at the least height with a single node that is not below `levels`."""
        while len(self.open) > 1 or self.open[0][0] < levels:
            height, first, root = self.open.pop()
            if self.open and self.open[-1][0] == height:
                self.open.append((height, first, root))
                self._merge()
            else:
                self.open.append((height + 1, first, joined(root)))
        return self.open[0][2]


def folded(node: bytes, at: int, count: int, witness: bytes) -> bytes:
    """The root of `count` nodes that follows from the one at a place and its siblings."""
    used = 0
    while count > 1:
        if at ^ 1 < count:
            sibling = witness[used:used + SIZE]
            used += SIZE
            node = joined(sibling, node) if at & 1 else joined(node, sibling)
        else:
            node = joined(node)
        at, count = at >> 1, (count + 1) >> 1
    return node


def _same(left: str, right: str, *names: str) -> Column:
    return reduce(lambda a, b: a & b,
                  (F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names))


def placed(nodes: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """`nodes` with `at`, the 0-based place inside `grp` by key and node, behind earlier rows.

    `ends` has n, the rows a group has, and last, their greatest key. Rows equal in key and
    node are equal leaves; a running number deals them, so any number of them is split over
    tasks.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("grp", "key", "node", "_tie")]
    ranged = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(
        *keys).sortWithinPartitions(*keys).drop("_tie")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, n = TaskContext.get().partitionId(), None, -1
        for b in batches:
            within = []
            for g in b.column(0).to_pylist():
                n = n + 1 if g == group else 0
                group = g
                within.append(n)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * b.num_rows, pa.int64()),
                 pa.array(within, pa.int64())], names=[*b.schema.names, "_part", "_within"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    numbered = stored(ranged.mapInArrow(number, f"{fields}, _part bigint, _within bigint"),
                      "numbered")
    # A row per task and group in it; the tasks before give a group's offset.
    earlier = W.partitionBy("grp").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = numbered.groupBy("grp", "_part").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("key").isNotNull(), "key")).alias("low"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    if ends is not None:
        both = parts.alias("p").join(ends.alias("e"), _same("p", "e", "grp"), "left")
        if not both.filter("e.n IS NOT NULL AND (p.low.key IS NULL OR p.low.key <= e.last)").isEmpty():
            raise ValueError("appended rows come before earlier ones")
        parts = both.select("p.grp", "p._part", (
            F.col("p.before") + F.coalesce("e.n", F.lit(0))).alias("before"))
    return numbered.alias("n").join(parts.alias("o"), _same("n", "o", "grp", "_part")).select(
        *[F.col(f"n.`{c}`") for c in nodes.columns],
        (F.col("n._within") + F.col("o.before")).alias("at"))


def blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """grp, block, at, node to the same with witness; block roots have at -1.

    A group's first block is closed at its least height: either it is full, or the only one.
    """
    kind = nodes.schema["grp"].dataType.simpleString()

    def close(key: tuple, rows: list, block: Block, grp: pa.DataType) -> pa.RecordBatch:
        root, n = block.close(levels if key[1] else 0), len(rows) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * n, grp), pa.array([key[1]] * n, pa.int64()),
             pa.array([*[at for at, _ in rows], -1], pa.int64()),
             pa.array([*[node for _, node in rows], root], pa.binary()),
             pa.array([*map(b"".join, block.witness), b""], pa.binary())],
            names=["grp", "block", "at", "node", "witness"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, block, grp = None, [], Block(), None
        for b in batches:
            grp = b.schema.field(0).type
            for g, k, at, node in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (g, k) != key:
                    if rows:
                        yield close(key, rows, block, grp)
                    key, rows, block = (g, k), [], Block()
                rows.append((at, node))
                block.append(node)
        if rows:
            yield close(key, rows, block, grp)

    return nodes.select("grp", "block", "at", "node").repartition(
        "grp", "block").sortWithinPartitions("grp", "block", "at").mapInArrow(
        run, f"grp {kind}, block bigint, at bigint, node binary, witness binary")


@dataclass
class Manifest:
    """The rows (grp, key, node, carried columns, at) and the layers over them.

    A layer is (grp, block, at, node, witness), a block's root the row with at -1.
    """

    rows: DataFrame
    layers: list[DataFrame]
    levels: int = LEVELS


def _grown(old: DataFrame | None, new: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """A layer with (grp, at, node) rows added or replaced, and its changed roots.

    Blocks without such a row are carried over.
    """
    new = new.withColumn("block", F.shiftright("at", levels))
    if old is None:
        layer = stored(blocks(new, levels), "layer")
        changed = layer
    else:
        touched = new.select("grp", "block").distinct()
        again = old.filter("at >= 0").alias("o").join(
            touched.alias("t"), _same("o", "t", "grp", "block"), "left_semi").alias("g").join(
            new.alias("n"), _same("g", "n", "grp", "at"), "left_anti")
        changed = stored(blocks(again.select(*new.columns).unionByName(new), levels), "blocks")
        layer = changed.unionByName(old.alias("o").join(
            touched.alias("t"), _same("o", "t", "grp", "block"), "left_anti"))
    return layer, _roots(changed)


def _roots(layer: DataFrame) -> DataFrame:
    return layer.filter("at = -1").select("grp", F.col("block").alias("at"), "node")


def append(docs: DataFrame, grp: Column, key: Column, node: Column, *carried: Column,
           manifest: Manifest | None = None, levels: int = LEVELS) -> Manifest:
    """Rows added behind those of a manifest; `carried` columns stay with the row."""
    leaves = stored(docs.select(grp.alias("grp"), key.alias("key"), node.alias("node"), *carried),
                    "leaves")
    if manifest is None:
        none = leaves.limit(0).withColumn("at", F.lit(0).cast("bigint"))
        manifest, ends = Manifest(none, [], levels), None
    else:
        ends = manifest.rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"),
                                                F.max("key").alias("last"))
    if leaves.isEmpty():
        return manifest
    rows = stored(placed(leaves, ends), "rows")
    layers: list[DataFrame] = []
    new = rows.select("grp", "at", "node")
    for old in manifest.layers:
        layer, new = _grown(old, new, manifest.levels)
        layers.append(layer)
    # A new layer takes all roots of the one below, not only the changed ones.
    while not layers or not layers[-1].filter("block > 0").isEmpty():
        layer, _ = _grown(None, _roots(layers[-1]) if layers else new, manifest.levels)
        layers.append(layer)
    if manifest.layers:
        rows = manifest.rows.unionByName(rows)
    return Manifest(rows, layers, manifest.levels)


def witnesses(m: Manifest, above: DataFrame) -> DataFrame:
    """grp, at, witness of every row up to its subroot, and the columns of its group's `above`.

    A layer's row per block meets at most a block of rows below it, so no group is one key.
    """
    carried = [c for c in above.columns if c != "grp"]
    upper = above.withColumns({"at": F.lit(0).cast("bigint"), "witness": F.lit(b"")})
    for layer in reversed(m.layers):
        upper = layer.filter("at >= 0").alias("l").join(
            upper.alias("u"), (F.col("l.block") == F.col("u.at")) & _same("l", "u", "grp")).select(
            "l.grp", "l.at", F.concat("l.witness", "u.witness").alias("witness"),
            *[F.col(f"u.`{c}`") for c in carried])
    return upper


FOLDED = ("grp_at bigint, grp_total bigint, witness binary, "
          "top_at bigint, top_total bigint, top_witness binary, subroot binary, root binary")


def view(m: Manifest, *carried: str) -> DataFrame:
    """A row per leaf: key, grp, carried columns, leaf, its place and its group's, all siblings.

    The tree over the subroots is a manifest of one group of its own.
    """
    names = ("key", "grp", *carried)
    if not m.layers:
        none = [f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}" for x in FOLDED.split(", ")]
        return m.rows.selectExpr(*[f"`{c}`" for c in names], "node AS leaf", *none)
    counts = m.rows.groupBy("grp").agg(F.count(F.lit(1)).alias("grp_total"))
    subs = _roots(m.layers[-1]).alias("r").join(counts.alias("t"), _same("r", "t", "grp")).select(
        F.col("r.grp").alias("key"), "r.node", "t.grp_total")
    top = append(subs, F.lit(0), F.col("key"), F.col("node"), F.col("grp_total"), levels=m.levels)
    root = _roots(top.layers[-1]).first()["node"]
    total = top.rows.count()
    one = top.rows.limit(1).select("grp")
    under = top.rows.alias("s").join(witnesses(top, one).alias("w"), _same("s", "w", "at")).select(
        F.col("s.key").alias("grp"), F.col("s.node").alias("subroot"), "s.grp_total",
        F.col("s.at").alias("top_at"), F.lit(total).cast("bigint").alias("top_total"),
        F.col("w.witness").alias("top_witness"), F.lit(root).alias("root"))
    w = witnesses(m, under).alias("w")
    return m.rows.alias("r").join(w, _same("r", "w", "grp", "at")).select(
        *[F.col(f"r.`{c}`") for c in names], F.col("r.node").alias("leaf"),
        F.col("r.at").alias("grp_at"),
        *[F.col(f"w.`{x.split()[0]}`") for x in FOLDED.split(", ")[1:]])


def fold(rows: DataFrame, leaf: str, out: str) -> DataFrame:
    """`rows` of `view` with the root that follows from column `leaf` and the row's siblings."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(names.index(c)).to_pylist() for c in (
                leaf, "grp_at", "grp_total", "witness", "top_at", "top_total", "top_witness")]
            found = [folded(folded(x, at, n, w), top, m, v)
                     for x, at, n, w, top, m, v in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())],
                                             names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{out}` binary")


LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def documents(docs: DataFrame, manifest: Manifest | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of a table of documents, grouped by lang, ordered by doc_id.

    Carried along is `suspect`: for every seventh row, by hash, the leaf it would have with
    one more character counted, else null.
    """
    source = columns_of(docs, *LEAF).select(
        *[F.col(c).cast("bigint" if c in ("doc_id", "n_chars") else "string") for c in LEAF])
    changed = digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in LEAF])
    picked = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col(
        "n_chars").isNotNull()
    return append(source, F.col("lang"), F.col("doc_id"), digest(*[F.col(c) for c in LEAF]),
                  F.when(picked, changed).alias("suspect"), manifest=manifest, levels=levels)
