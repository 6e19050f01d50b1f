"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str | int = "*", app: str = "attestry", memory: str = "12g",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where unset."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="attestry-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    spark.conf.set("attestry.scratch", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    base = spark.conf.get("attestry.scratch", None) or shared_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Reliable checkpoint in the shared folder, so a lost executor costs a re-read only."""
    spark = df.sparkSession
    if spark.conf.get("attestry.scratch", None) is None:
        shared_dir(spark)
    return df.checkpoint(eager=True)


def stored(df, name: str = "stage"):
    """Write a table to the shared folder and read it back: a columnar lineage cut.

    For tables that several later passes scan, each pass reads only its columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df, column: str, name: str = "dealt", moved: bool = True):
    """Write a table to the shared folder in buckets of a column, and read it back.

    For tables that several later joins meet on that column: none of them moves its rows.
    moved=False where the rows lie by that column already, as behind a join or group on it.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, column) if moved else df
    rows.write.bucketBy(buckets, column).option("path", path).saveAsTable(table)
    out = spark.table(table)
    # The files stay, as the table only names them.
    spark.sql(f"DROP TABLE {table}")
    return out


def env_cores(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", str(default)))
