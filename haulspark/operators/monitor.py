"""Monitoring as data operators.

Checks are rows (check, status, detail); rollups are aggregates over them.
Pipeline counters use ``DataFrame.observe`` so they are collected during the
pipeline's own action -- no extra pass over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

HEALTHY, WARNING, ERROR, CRITICAL = "Healthy", "Warning", "Error", "Critical"


def freshness(df: DataFrame, ts: str, as_of: str, hours: int = 24) -> DataFrame:
    """Rows created in the last ``hours`` before ``as_of`` against the
    total; Healthy when there are any."""
    lo = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0))
    g = df.agg(F.count_if((F.col(ts) >= lo) & (F.col(ts) < F.lit(as_of).cast("timestamp_ntz")))
               .cast("long").alias("recent_rows"), F.count(F.lit(1)).alias("total_rows"))
    return g.withColumn("status", F.when(F.col("recent_rows") > 0, HEALTHY).otherwise(WARNING))


def threshold_issues(metrics: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Long metric rows (keys..., metric, value) joined to (metric,
    threshold); value > threshold is an issue; issues joined with '; '.
    Per key at most one issue per metric, so the joined list is bounded by
    the threshold table."""
    j = metrics.join(thresholds, "metric")
    issue = F.when(F.col("value") > F.col("threshold"),
                   F.concat(F.col("metric"), F.lit(" above "), F.col("threshold").cast("string")))
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_list(issue)).alias("_i"))
    return g.select(*keys, F.array_join("_i", "; ").alias("issues"),
                    F.when(F.size("_i") > 0, WARNING).otherwise(HEALTHY).alias("status"))


def health_rollup(checks: DataFrame) -> DataFrame:
    """D3: any Error -> Critical, any Warning -> Warning, else Healthy."""
    g = checks.agg(F.count(F.lit(1)).alias("checks"),
                   F.count_if(F.col("status") == ERROR).cast("long").alias("errors"),
                   F.count_if(F.col("status") == WARNING).cast("long").alias("warnings"),
                   F.count_if(F.col("status") == HEALTHY).cast("long").alias("healthy"))
    return g.withColumn("overall", F.when(F.col("errors") > 0, CRITICAL)
                        .when(F.col("warnings") > 0, WARNING).otherwise(HEALTHY))


def observed(df: DataFrame, name: str = "pipeline") -> tuple[DataFrame, Observation]:
    """Attach pipeline counters to ``df``; read ``obs.get`` after the
    pipeline's action (e.g. the write)."""
    obs = Observation(name)
    out = df.observe(obs, F.count(F.lit(1)).alias("processed"),
                     F.count("total_hours").alias("calculated"),
                     F.count("calculated_distance").alias("geocoded"))
    return out, obs


def last_runs(runs: DataFrame, job: str, ts: str, result: str, success: str) -> DataFrame:
    """Per job: runs, successes, last run time and its result (of runs at
    the same time, the greatest result)."""
    return runs.groupBy(job).agg(F.count(F.lit(1)).alias("runs"),
                                 F.count_if(F.col(success)).cast("long").alias("successes"),
                                 F.max(ts).alias("last_run"),
                                 F.max_by(result, F.struct(ts, result)).alias("last_result"))
