"""Structured Streaming re-aims of the reference's polling.

A poll is one ``availableNow`` run of a stream over what has landed since the
last one; the checkpoint under the shared folder is the "already processed"
ledger between runs, so files that arrive between polls, restarts and replays of
a failed batch all go through the same mechanism.

* X1 -- a landing folder polled once per new file: file source,
  ``maxFilesPerTrigger`` files a batch, ``maxFileAge`` for too-old files, files of
  finished batches moved to an archive folder (``cleanSource``).
* X2 -- duplicates across polls: ``dropDuplicatesWithinWatermark``.
* X3 -- period totals kept current: hourly totals in append mode, whose closed
  windows (``window_time``) feed a second windowed aggregation.  A row later than
  the watermark is dropped, a closed window's state goes, and a row is copied
  into the overlapping long windows only after it has been summed into its hour.
* X4 -- running totals per key: ``foreachBatch`` writes each batch's increment and
  commits a manifest of live parts keyed by batch id, so a replayed batch is a no-op.

Sinks and checkpoints live under the shared ``spark.checkpoint.dir``; nothing
is written to machine-local folders on a cluster.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

COMPACT_EVERY = 8  # increments that are read together at most


def poll_directory(spark: SparkSession, landing: str, schema: T.StructType, fmt: str = "csv",
                   max_file_age: str = "30d", files_per_batch: int | None = None, archive: str | None = None,
                   **options) -> DataFrame:
    """New files of a landing folder, each exactly once (checkpointed);
    files of finished batches move to ``archive``, if it is given."""
    r = spark.readStream.format(fmt).schema(schema).option("maxFileAge", max_file_age)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(landing)


class Poller:
    """A landing folder, a sink and the checkpoint between them; the folders of
    ``base`` are kept from poll to poll."""

    def __init__(self, spark: SparkSession, name: str, base: str | None = None):
        self.spark = spark
        self.base = base or scratch_path(spark, name)
        self.landing, self.archive = (os.path.join(self.base, d) for d in ("landing", "archive"))
        self.sink, self.checkpoint = (os.path.join(self.base, d) for d in ("out", "_checkpoint"))

    def land(self, df: DataFrame, fmt: str = "parquet", **options) -> None:
        """What a collector drops into the folder between two polls."""
        df.write.mode("append").format(fmt).options(**options).save(self.landing)

    def poll(self, stream: DataFrame, batch: Callable[[DataFrame, int], None] | None = None) -> None:
        """One run over everything that has landed, in append mode: into the Parquet
        sink, or into ``batch`` for every micro-batch."""
        w = stream.writeStream.outputMode("append").option("checkpointLocation", self.checkpoint).trigger(availableNow=True)
        w = w.foreachBatch(batch) if batch else w.format("parquet").option("path", self.sink)
        w.start().awaitTermination()

    def result(self) -> DataFrame:
        """Rows of committed batches only (the sink's own log says which files count)."""
        return self.spark.read.parquet(self.sink)


def dedupe_within_watermark(stream: DataFrame, keys: list[str], ts: str, horizon: str) -> DataFrame:
    """Drop repeats of ``keys`` seen within ``horizon`` of event time, in this
    or an earlier poll; older keys leave the state."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def period_totals(stream: DataFrame, ts: str, size: str, slide: str | None, lateness: str, value: str,
                  grain: str = "1 hour") -> DataFrame:
    """Count and exact sum per event-time window (tumbling, or sliding by
    ``slide``, a multiple of ``grain``), emitted when the watermark passes its end.

    Rows are summed per ``grain`` first; state holds one row for each open grain
    and one for each open window.  Rows whose grain the watermark has closed are dropped."""
    fine = stream.withWatermark(ts, lateness).groupBy(F.window(ts, grain).alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.rint(F.col(value) * 100).cast("long")).alias("cents"))
    at = F.window_time("g")
    win = F.window(at, size, slide) if slide else F.window(at, size)
    g = fine.groupBy(win.alias("w")).agg(F.sum("n").alias("events"), F.sum("cents").alias("cents"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events",
                    (F.col("cents") / 100.0).alias("total_value"))


class RunningTotals:
    """Per-key totals kept by ``foreachBatch``, idempotent by batch id.

    A batch writes its increment to a folder named by its id (a re-run overwrites
    it) and then commits a manifest row (batch id, live parts); the greatest
    batch id's row is the current version.  A batch the manifest has is skipped, so
    a batch that is re-run after a failure -- before or after the commit -- counts
    once.  Every ``compact_every`` increments are merged into one part, so the
    whole is not rewritten for each batch.  ``on_written`` is called between
    increment and commit (tests fail there)."""

    def __init__(self, spark: SparkSession, base: str, key: str, value: str, compact_every: int = COMPACT_EVERY,
                 on_written: Callable[[int], None] | None = None):
        self.spark, self.base, self.key, self.value = spark, base, key, value
        self.compact_every, self.on_written = compact_every, on_written
        self.manifest = os.path.join(base, "manifest")

    def current(self) -> tuple[int, list[str]]:
        """(last committed batch id, live parts); (-1, []) before the first.  Any
        failure to read the manifest but its absence stops the batch."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.manifest)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return -1, []
        rows = self.spark.read.schema("batch_id long, parts array<string>").parquet(self.manifest)
        row = rows.agg(F.max_by("parts", "batch_id").alias("parts"), F.max("batch_id").alias("b")).first()
        return (-1, []) if row["b"] is None else (row["b"], list(row["parts"]))

    def _merged(self, parts: list[str]) -> DataFrame:
        schema = self.spark.read.parquet(parts[0]).schema
        return self.spark.read.schema(schema).parquet(*parts).groupBy(self.key).agg(
            F.sum("events").alias("events"), F.sum("cents").alias("cents"))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        last, parts = self.current()
        if batch_id <= last:
            return  # a replay of a committed batch
        part = os.path.join(self.base, "parts", f"batch={batch_id}")
        batch.groupBy(self.key).agg(F.count(F.lit(1)).alias("events"),
                                    F.sum(F.rint(F.col(self.value) * 100).cast("long")).alias("cents")) \
            .write.mode("overwrite").parquet(part)
        parts = [*parts, part]
        if len(parts) > self.compact_every:
            whole = os.path.join(self.base, "parts", f"compact={batch_id}")
            self._merged(parts).write.mode("overwrite").parquet(whole)
            parts = [whole]
        if self.on_written:
            self.on_written(batch_id)
        self.spark.createDataFrame([(batch_id, parts)], "batch_id long, parts array<string>") \
            .coalesce(1).write.mode("append").parquet(self.manifest)

    def totals(self) -> DataFrame:
        _, parts = self.current()
        if not parts:
            raise ValueError("no batch has been committed yet")
        return self._merged(parts).select(self.key, "events", (F.col("cents") / 100.0).alias("total_value"))
