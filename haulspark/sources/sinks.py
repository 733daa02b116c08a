"""Sinks (S12-S15): the date-partitioned route store and report-bundle exports
(S11: store.py)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_route_store(fact: DataFrame, path: str, date_col: str = "route_date") -> None:
    """Routes partitioned by month (one folder per month keeps the file count
    manageable at scale); readers prune by the partition column.  Rows are
    rebalanced on the month: adaptive execution splits a month that holds too much
    and joins small ones.  Only the months that are written are replaced."""
    (fact.withColumn("route_month", F.date_format(F.col(date_col), "yyyy-MM")).hint("rebalance", "route_month")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("route_month").parquet(path))


def _envelope(df: DataFrame, section: str, name: str, generated_at: str, metadata: dict[str, str]) -> DataFrame:
    """Every line carries the report's name, time and metadata and one record."""
    meta = F.struct(*[F.lit(v).alias(k) for k, v in sorted(metadata.items())]) if metadata else F.lit(None).cast("string")
    return df.select(F.lit(name).alias("report_name"), F.lit(generated_at).alias("generated_at"), meta.alias("metadata"),
                     F.lit(section).alias("section"), F.struct(*df.columns).alias("record"))


def export_bundle(sections: dict[str, DataFrame], root: str, formats: list[str], name: str = "report",
                  generated_at: str = "", metadata: dict[str, str] | None = None, compression: str = "gzip") -> DataFrame:
    """Write every section in every format (csv with header, json lines in
    an envelope, parquet) into a staging folder of its own; a failing format does not
    stop the others.  The text formats are compressed (``compression``; 'none': plain
    files), as every json line repeats the envelope and the names of its fields.  Rows
    are counted while they are written.  The manifest --
    (section, format, path, rows, status), non-empty sections and failures -- is
    written last under ``root/manifest`` and is what makes the files count: an export
    that stops before leaves none."""
    spark = next(iter(sections.values())).sparkSession
    stage = os.path.join(root, f"files-{uuid.uuid4().hex}")
    rows = []
    for section, df in sections.items():
        for fmt in formats:
            out = os.path.join(stage, fmt, section)
            try:
                if fmt not in ("csv", "json", "parquet"):
                    raise ValueError(f"unsupported format {fmt}")
                seen = Observation()
                counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
                if fmt == "csv":
                    counted.write.option("header", True).option("compression", compression).csv(out)
                elif fmt == "json":
                    _envelope(counted, section, name, generated_at, metadata or {}).write.option("compression", compression).json(out)
                else:
                    counted.write.parquet(out)
                rows.append((section, fmt, out, int(seen.get["n"]), "ok"))
            except Exception as e:  # one failing format does not stop the others
                rows.append((section, fmt, out, 0, f"failed: {type(e).__name__}"))
    manifest = spark.createDataFrame(rows, "section string, format string, path string, rows long, status string")
    manifest.filter((F.col("rows") > 0) | (F.col("status") != "ok")).coalesce(1).write.mode("overwrite").parquet(os.path.join(root, "manifest"))
    return spark.read.parquet(os.path.join(root, "manifest"))
