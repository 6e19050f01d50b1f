"""Streams: decisions, confirmations, update bursts and reviewer sessions.

Watermarks are one day by default and later rows are dropped. Every sink is
keyed by batch id, so a restarted batch overwrites its own output instead of
adding to it.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from attestry.functions.review import decision_of, outcome_of, parse_reply, settle_action
from attestry.session import scratch_path

WATERMARK = "1 day"


def read_stream(spark: SparkSession, schema, path: str, files_per_batch: int | None = None):
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def timed(stream: DataFrame, column: str, watermark: str = WATERMARK) -> DataFrame:
    """Event time as TIMESTAMP with a watermark; TIMESTAMP_NTZ cannot carry one."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(
        column, watermark)


def settle_replies(stream: DataFrame, kind: Column, reply: Column) -> DataFrame:
    """Reviewer replies to recordable decisions; illegal ones leave the item open."""
    asked = stream.withColumn("action", settle_action(kind, parse_reply(reply)["action"]))
    return asked.filter(F.col("action").isNotNull())


def decision_log(decisions: DataFrame) -> DataFrame:
    """ST1: recordable decisions, routed to their outcome logs."""
    return decisions.withColumns({"outcome": outcome_of(F.col("action")),
                                  "decision": decision_of(F.col("action")),
                                  "submitted": F.lit(False)}).filter(
        F.col("outcome").isNotNull())


def first_decisions(decisions: DataFrame, key: str = "resource_id",
                    order: tuple[str, ...] = ("decided_at", "action")) -> DataFrame:
    """The first decision on each resource; later ones are not recorded, however late.

    Whether a resource is decided is keyed state: a trigger touches the keys of its batch, not
    the log. Within a batch the first by `order` counts. No timeout, so no row is too late.
    """
    names = decisions.columns
    kinds = {f.name: f.dataType.simpleString() for f in decisions.schema}

    def first(keys, parts, state):
        best = None
        for part in parts:  # a resource's rows come in pieces of bounded size
            if state.exists:
                continue
            row = part.sort_values(list(order), na_position="first", kind="stable").head(1)
            if best is not None:
                row = pd.concat([best, row]).sort_values(
                    list(order), na_position="first", kind="stable").head(1)
            best = row
        if best is not None:
            state.update((True,))
            yield best[names]

    return decisions.groupBy(key).applyInPandasWithState(
        first, ", ".join(f"`{n}` {kinds[n]}" for n in names), "decided boolean", "append",
        GroupStateTimeout.NoTimeout)


def write_decisions(decisions: DataFrame, path: str, checkpoint: str, key: str = "resource_id",
                    order: tuple[str, ...] = ("decided_at", "action")) -> StreamingQuery:
    """First decisions, a folder per batch and outcome.

    The log is never read: a batch that runs again finds the state of its start and overwrites
    its own folders with the same rows.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "outcome")
         .parquet(path))

    return (first_decisions(decisions, key, order).writeStream.foreachBatch(sink)
            .outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_by_resource(decisions: DataFrame) -> DataFrame:
    """ST2: live latest decision per resource; partial state is one row per resource."""
    recorded = decisions.filter(outcome_of(F.col("action")).isNotNull())
    return recorded.groupBy("resource_id").agg(
        F.max_by(F.struct("action", "decided_at"), F.struct("decided_at", "row_no")).alias("d")
    ).select("resource_id", "d.action", "d.decided_at")


MOST_BATCHES = 8


class LatestTable:
    """Newest row per key: a snapshot and the batches since, behind a manifest.

    Every batch is a folder of changed rows. Once there are more than `most` of them they are
    merged with the snapshot into a newer one; the manifest, replaced by one rename, tells
    readers which snapshot holds and up to which batch, so they read it and the newer batches.
    Folders the manifest no longer needs are removed after it is in place. A batch that runs
    again overwrites its folder; one that the snapshot already holds changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], most: int = MOST_BATCHES):
        self.spark, self.path, self.key, self.most = spark, path.rstrip("/"), list(key), most
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def folders(self) -> list[str]:
        """Names of the data folders there are."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return sorted(n for n in names if n.startswith(("batch=", "snapshot=")))

    def held(self) -> int:
        """The newest batch that the snapshot holds, -1 without one."""
        if not self._exists("manifest"):
            return -1
        return int(self.spark.read.text(f"{self.path}/manifest").first()[0])

    def _batches(self, after: int) -> list[int]:
        found = [int(n.split("=")[1]) for n in self.folders() if n.startswith("batch=")]
        return sorted(n for n in found if n > after)

    def _rows(self, after: int, batches: list[int]) -> DataFrame | None:
        parts = [(after, f"snapshot={after}")] if after >= 0 else []
        parts += [(n, f"batch={n}") for n in batches]
        read = [self.spark.read.parquet(f"{self.path}/{name}").withColumn("_batch", F.lit(n))
                for n, name in parts]
        return reduce(DataFrame.unionByName, read) if read else None

    def read(self) -> DataFrame:
        held = self.held()
        return self._newest(self._rows(held, self._batches(held)))

    def _newest(self, rows: DataFrame) -> DataFrame:
        value = [c for c in rows.columns if c not in (*self.key, "_batch")]
        return rows.groupBy(*self.key).agg(
            F.max_by(F.struct(*value), "_batch").alias("v")).select(*self.key, "v.*")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        held = self.held()
        if batch_id <= held:
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        batches = self._batches(held)
        if len(batches) > self.most:
            self._merge(held, batches)

    def _merge(self, held: int, batches: list[int]) -> None:
        newest = batches[-1]
        self._newest(self._rows(held, batches)).write.mode("overwrite").parquet(
            f"{self.path}/snapshot={newest}")
        fresh = self._path(f"{self.path}/manifest-{newest}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(str(newest).encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        context.rename(fresh, self._path(f"{self.path}/manifest"), overwrite)
        for name in self.folders():
            kind, n = name.split("=")
            if int(n) < newest or (kind == "batch" and int(n) == newest):
                self._fs.delete(self._path(f"{self.path}/{name}"), True)


def write_updates(updates: DataFrame, path: str, checkpoint: str, key: list[str],
                  most: int = MOST_BATCHES) -> StreamingQuery:
    """Changed rows of an updating aggregate into a LatestTable."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        LatestTable(batch.sparkSession, path, key, most).write(batch, batch_id)

    return (updates.writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_rows(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The newest emitted row per key of a write_updates() sink."""
    return LatestTable(spark, path, key).read()


def remaining_queue(queue: DataFrame, latest: DataFrame, key: str = "resource_id") -> DataFrame:
    """Queue items nobody has decided yet."""
    return queue.join(latest.select(key), key, "left_anti")


def confirmation_clock(confirmations: DataFrame, listing: DataFrame) -> DataFrame:
    """ST3: the newest confirmation per (listing, field), joined to the listing it resets."""
    known = confirmations.join(listing, "listing_id")
    return known.groupBy("listing_id", "field", *[
        c for c in listing.columns if c != "listing_id"]).agg(
        F.max("confirmed_at").alias("confirmed_at"))


def update_bursts(updates: DataFrame, column: str = "ts", width: str = "1 day") -> DataFrame:
    """ST4: directory updates per tumbling day."""
    return updates.groupBy(F.window(column, width).alias("w")).agg(
        F.count(F.lit(1)).alias("updates")).select(
        F.col("w.start").alias("day"), "updates")


def daily_updates(updates: DataFrame, column: str = "ts", unit: str = "day") -> DataFrame:
    """The batch answer: counts by day or month."""
    return updates.groupBy(F.date_trunc(unit, F.col(column)).alias(unit)).agg(
        F.count(F.lit(1)).alias("updates"))


def reviewer_sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """ST5: answers and skips per reviewer session; skips are counted, never recorded."""
    return log.groupBy("decided_by", F.session_window("decided_at", gap).alias("w")).agg(
        F.count_if(F.col("action") != "skip").alias("answered"),
        F.count_if(F.col("action") == "skip").alias("skipped")).select(
        "decided_by", F.col("w.start").alias("started"), "answered", "skipped")


def write_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (df.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_to_end(start, spark: SparkSession, name: str) -> str:
    """Run a stream over everything available; returns the sink path."""
    out, chk = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = start(out, chk)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return out
