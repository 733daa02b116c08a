"""Monitoring: D1-D4, D6 over the events table and the report fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as D
from ..plans.report_fact import report_fact
from ..sources.tables import table
from .registry import register
from .sqlbase import with_routes

AS_OF = "2024-01-31 00:00:00"
# Monitoring thresholds (metric -> limit).
THRESHOLDS = {"error_rate_pct": 25.0, "avg_value": 55.0, "p_purchase_pct": 22.0}


@register("D1_freshness", f"""
SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts < TIMESTAMP '{AS_OF}') AS recent_rows,
       count(*) AS total_rows,
       CASE WHEN count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts < TIMESTAMP '{AS_OF}') > 0
            THEN 'Healthy' ELSE 'Warning' END AS status
FROM events""")
def d1(spark, sf):
    return D.freshness(table(spark, sf, "events"), "ts", AS_OF)


def _daily_metrics(spark, sf):
    ev = table(spark, sf, "events")
    g = ev.groupBy(F.to_date("ts").alias("day")).agg(
        (F.rint(F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)) * 10000) / 100).alias("error_rate_pct"),
        (F.rint(F.sum(F.rint(F.col("value") * 100).cast("long")) / F.count(F.lit(1))) / 100).alias("avg_value"),
        (F.rint(F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1)) * 10000) / 100).alias("p_purchase_pct"))
    return g.unpivot(["day"], list(THRESHOLDS), "metric", "value")


_THR_SQL = " UNION ALL ".join(f"SELECT '{k}' AS metric, cast({v} AS DOUBLE) AS threshold"
                              for k, v in THRESHOLDS.items())
_DAILY_SQL = f"""
m AS (SELECT cast(ts AS DATE) AS day,
             round_even(count(*) FILTER (WHERE event_type = 'error') / count(*) * 10000, 0) / 100 AS error_rate_pct,
             round_even(sum(cast(round_even(value * 100, 0) AS BIGINT)) / count(*), 0) / 100 AS avg_value,
             round_even(count(*) FILTER (WHERE event_type = 'purchase') / count(*) * 10000, 0) / 100 AS p_purchase_pct
      FROM events GROUP BY 1),
l AS (SELECT day, 'error_rate_pct' AS metric, error_rate_pct AS value FROM m
      UNION ALL SELECT day, 'avg_value', avg_value FROM m
      UNION ALL SELECT day, 'p_purchase_pct', p_purchase_pct FROM m),
t AS ({_THR_SQL}),
iss AS (SELECT day, coalesce(string_agg(CASE WHEN value > threshold THEN metric || ' above ' || cast(threshold AS VARCHAR) END,
                                       '; ' ORDER BY CASE WHEN value > threshold THEN metric || ' above ' || cast(threshold AS VARCHAR) END), '') AS issues,
               CASE WHEN count(*) FILTER (WHERE value > threshold) > 0 THEN 'Warning' ELSE 'Healthy' END AS status
        FROM l JOIN t USING (metric) GROUP BY day)"""


def _issues(spark, sf):
    thr = spark.createDataFrame(list(THRESHOLDS.items()), "metric string, threshold double")
    return D.threshold_issues(_daily_metrics(spark, sf), thr, ["day"])


@register("D2_threshold_check", f"WITH {_DAILY_SQL.strip()} SELECT day, issues, status FROM iss")
def d2(spark, sf):
    return _issues(spark, sf)


@register("D3_health_rollup", f"""
WITH {_DAILY_SQL.strip()},
checks AS (SELECT status FROM iss UNION ALL
           SELECT CASE WHEN count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR
                                              AND ts < TIMESTAMP '{AS_OF}') > 0
                       THEN 'Healthy' ELSE 'Warning' END FROM events)
SELECT count(*) AS checks, count(*) FILTER (WHERE status = 'Error') AS errors,
       count(*) FILTER (WHERE status = 'Warning') AS warnings, count(*) FILTER (WHERE status = 'Healthy') AS healthy,
       CASE WHEN count(*) FILTER (WHERE status = 'Error') > 0 THEN 'Critical'
            WHEN count(*) FILTER (WHERE status = 'Warning') > 0 THEN 'Warning' ELSE 'Healthy' END AS overall
FROM checks""")
def d3(spark, sf):
    checks = _issues(spark, sf).select("status").unionByName(
        D.freshness(table(spark, sf, "events"), "ts", AS_OF).select("status"))
    return D.health_rollup(checks)


@register("D4_pipeline_counters", with_routes("""
SELECT count(*) AS processed, count(total_hours) AS calculated, count(calculated_distance) AS geocoded,
       count(*) FILTER (WHERE efficiency_score IS NULL) AS without_score FROM route_metrics"""))
def d4(spark, sf):
    """Counters of the processing pipeline as one aggregate (the library's
    ``observed`` attaches the same counters to a running pipeline)."""
    f = report_fact(spark, sf)
    return f.agg(F.count(F.lit(1)).alias("processed"), F.count("total_hours").alias("calculated"),
                 F.count("calculated_distance").alias("geocoded"),
                 F.count_if(F.col("efficiency_score").isNull()).cast("long").alias("without_score"))


@register("D6_job_run_log", """
SELECT event_type AS job, count(*) AS runs, count(*) FILTER (WHERE value >= 10) AS successes,
       max(ts) AS last_run, arg_max(value, ts) AS last_result FROM events GROUP BY event_type""")
def d6(spark, sf):
    """Events read as a job-run log: job = event type, result = value,
    success = value of at least 10."""
    runs = table(spark, sf, "events").withColumn("ok", F.col("value") >= 10)
    return D.last_runs(runs, "event_type", "ts", "value", "ok").withColumnRenamed("event_type", "job")
