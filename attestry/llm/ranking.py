"""Ranks inside groups of any size: blocks are counted, then ranked one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def ranked(df: DataFrame, group: list[str], order: list[Column], spread: Column,
           rows: int, rank: str = "rank") -> DataFrame:
    """`df` with a 0-based rank inside each group.

    The order is by block (a hash of `spread`), then by `order`. A group is split into
    rows / BLOCK_ROWS blocks, so no task sorts a whole group, however large; only the
    block counts of a group come together. `rows` is the row count of `df`.
    """
    blocks = max(1, -(-rows // BLOCK_ROWS))
    at = df.withColumn("_block", F.pmod(F.xxhash64(spread, F.lit(71)), F.lit(blocks)))
    counts = at.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(*group, "_block").orderBy(*order)) - 1
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "_block")]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    a = at.withColumn("_within", within).alias("a")
    return a.join(offsets.alias("b"), cond).select(
        *[F.col(f"a.`{c}`") for c in df.columns],
        (F.col("a._within") + F.col("b._before")).cast("long").alias(rank))
