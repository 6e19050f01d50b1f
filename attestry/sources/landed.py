"""Landed files: the work list, listing documents and their enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from attestry import schemas as S
from attestry.functions.text import blank_to_null, stripped


def read_work_list(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """Header CSV, every column text; a byte-order mark on the first name is removed.

    Quotes inside a quoted value are doubled, and it may hold line breaks; such a file is
    read by one task, so give line_breaks=False for files known to have none. Columns are
    taken by name, missing ones are NULL. Rows are in the order of (file, row_no).
    """
    raw = (spark.read.option("header", True).option("multiLine", line_breaks)
           .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    named = raw.select("*", F.col("_metadata.file_path").alias("_file")).toDF(
        *[c.replace("﻿", "").strip() for c in raw.columns], "file")
    have = set(named.columns)
    return named.select(
        *[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in S.WORK_LIST],
        "file", F.monotonically_increasing_id().alias("row_no"))


def _place(work: DataFrame):
    """Where a row stands: its file and its place there, as far as the table knows."""
    return F.struct(*[c for c in ("file", "row_no") if c in work.columns])


def numeric_rows(work: DataFrame) -> DataFrame:
    rid = stripped(F.coalesce("resource_id", F.lit("")))
    return work.withColumn("rid", rid).filter(F.col("rid").rlike("^[0-9]+$")).withColumn(
        "rid", F.col("rid").try_cast("bigint"))


def work_list_index(work: DataFrame) -> DataFrame:
    """Per resource the first non-empty edit URL and how many services were curated."""
    url = blank_to_null(stripped(F.coalesce("service_edit_url", F.lit(""))))
    name = blank_to_null(stripped(F.coalesce("service_name", F.lit(""))))
    return numeric_rows(work).groupBy(F.col("rid").alias("resource_id")).agg(
        F.min_by(url, F.when(url.isNotNull(), _place(work))).alias("service_edit_url"),
        F.count(name).alias("n_curated"))


def curated_services(work: DataFrame) -> DataFrame:
    """(resource_id, row_no, service_name): curated names in row order, kept long."""
    name = blank_to_null(stripped(F.coalesce("service_name", F.lit(""))))
    return numeric_rows(work).select(F.col("rid").alias("resource_id"), "row_no",
                                     name.alias("service_name")).filter(
        F.col("service_name").isNotNull())


def _unwrapped(raw: DataFrame) -> DataFrame:
    fields = [f for f in raw.columns if f not in ("resource", "_corrupt_record")]
    inner = F.col("resource").isNotNull()
    return raw.select(*[
        F.when(inner, F.col(f"resource.{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def read_listings(spark: SparkSession, path: str, approved_only: bool = False,
                  listing_id: int | None = None) -> DataFrame:
    """Listing documents, one object or one array per file; wrapped or bare; corrupt skipped."""
    raw = (spark.read.schema(DataType.fromDDL(S.LANDED)).option("mode", "PERMISSIVE")
           .option("multiLine", True).json(path))
    docs = _unwrapped(raw).filter(F.col("name").isNotNull() & F.col("id").isNotNull())
    if approved_only:
        docs = docs.filter(F.col("status") == "approved")
    return docs if listing_id is None else docs.filter(F.col("id") == listing_id)


def read_listing_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same documents as one JSON object per line, which splits across tasks."""
    raw = (spark.read.schema(DataType.fromDDL(S.LANDED)).option("mode", "PERMISSIVE")
           .json(path))
    return _unwrapped(raw).filter(F.col("name").isNotNull() & F.col("id").isNotNull())


def missing_ids(index: DataFrame, landed: DataFrame, limit: int = 0) -> DataFrame:
    """Work-list ids not landed yet; a positive limit first keeps the lowest ids."""
    ids = index.select("resource_id").distinct()
    if limit > 0:
        ids = ids.orderBy("resource_id").limit(limit)
    return ids.join(landed.select(F.col("id").alias("resource_id")), "resource_id", "left_anti")


def enrich(listing: DataFrame, index: DataFrame) -> DataFrame:
    """Edit URL and curated-service count carried onto each listing."""
    extra = index.select(F.col("resource_id").alias("id"), "service_edit_url", "n_curated")
    return listing.drop("service_edit_url").join(extra, "id", "left")


def corpus_size(listing: DataFrame, service: DataFrame) -> DataFrame:
    """Listings and distinct services, each counted in its own pass over its own table."""
    a = listing.agg(F.count(F.lit(1)).alias("resources"))
    b = service.select("service_id").distinct().agg(F.count(F.lit(1)).alias("services"))
    return a.join(F.broadcast(b))
