"""Stored tables: captured pages, versioned claims, result documents, outcome logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import schemas as S
from attestry.functions.text import blank_to_null

OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
METHODS_AT_ONCE = "4"


def capture_key(method: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat(method, F.lit(":"), url), 256), 1, 24)


def write_captures(captures: DataFrame, path: str) -> None:
    """Captured pages by method; failed captures are kept, they need no second try."""
    spark = captures.sparkSession
    # The files of a few methods stay open side by side, so no text is sorted by method.
    before = spark.conf.get(OPEN_FILES, None)
    spark.conf.set(OPEN_FILES, METHODS_AT_ONCE)
    try:
        captures.withColumn("key", capture_key(F.col("method"), F.col("url"))).write.mode(
            "append").option("compression", "zstd").partitionBy("method").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(OPEN_FILES)
        else:
            spark.conf.set(OPEN_FILES, before)


def read_captures(spark: SparkSession, path: str, method: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if method is None else df.filter(F.col("method") == method)


def version_key() -> Column:
    """Identity of a listing version: a new one only when the listing moved."""
    raw = F.concat_ws(":", F.col("id").cast("string"), F.coalesce("updated_at", F.lit("")),
                      F.coalesce("name", F.lit("")))
    return F.substring(F.sha2(raw, 256), 1, 20)


def new_versions(listing: DataFrame, store: DataFrame) -> DataFrame:
    """Listings whose current version has no stored claims yet."""
    return listing.withColumn("version", version_key()).join(
        store.select("version").distinct(), "version", "left_anti")


def append_claims(claims: DataFrame, path: str) -> None:
    claims.write.mode("append").parquet(path)


def stored_listings(store: DataFrame) -> DataFrame:
    return store.select("version").distinct().agg(F.count(F.lit(1)).alias("cached_listings"))


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """Each part of a result document as its own table under one folder."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(out[name])
    return out


# ---------------------------------------------------------------- outcome logs

def append_outcomes(records: DataFrame, path: str) -> None:
    """Settled decisions to one log per outcome; records carry an outcome column."""
    records.write.mode("append").partitionBy("outcome").json(path)


def read_outcomes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(readable log rows, quarantined lines): a damaged line never blocks or hides the rest."""
    raw = spark.read.text(path)
    parsed = raw.select(
        F.col("value"), F.col("outcome") if "outcome" in raw.columns else F.lit(None).cast(
            "string").alias("outcome"),
        F.from_json("value", S.DECISION + ", row_no bigint, _corrupt_record string",
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
        .alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | blank_to_null(
        F.col("r.resource_id")).isNull()
    good = parsed.filter(~bad).select("outcome", "r.*").drop("_corrupt_record")
    quarantine = parsed.filter(bad & (F.trim("value") != "")).select("outcome", "value")
    return good, quarantine
