"""Readers for the driver-provided Parquet tables.

Every read goes through ``spark.read.parquet`` so Catalyst prunes columns and
pushes filters into the scan.  Timestamps arrive as ``timestamp_ntz``; the
adapter casts them once to ``timestamp`` (session zone UTC).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
