"""A listing's rows as arrays of bounded size, so that its pages meet them without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 64


def in_chunks(rows: DataFrame, order: list[str], *values: Column | str, name: str = "items",
              size: int = CHUNK) -> DataFrame:
    """(listing_id, chunk, items): at most `size` rows of a listing each, chunks from 0 on.

    A listing with very many rows becomes many chunks instead of one oversized row.
    """
    w = Window.partitionBy("listing_id").orderBy(*order)
    return rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size)).groupBy(
        "listing_id", "chunk").agg(F.collect_list(F.struct(*values)).alias(name))
