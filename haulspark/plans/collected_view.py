"""Collected route records: the standardised, all-text record a collector
hands to validation (SURVEY §1.4 canonical record), derived from the routes
view with deterministic defects so every validation rule fires somewhere:

* line 6: route_id missing;  line 5: route_id longer than 50 characters
* line 4: total_miles '-5';  line 3: total_miles '9000'
* line 2: status upper-cased (valid, case ignored);  line 1 & 'scheduled': 'lost'
* route_date / revenue / email / phone use the view's raw text spellings
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .routes_view import routes

COLLECTED_COLUMNS = ("record_key", "route_id", "route_date", "driver_name", "customer_name",
                     "total_miles", "revenue", "email", "phone", "status")


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routes(spark, sf_dir, ("route_key", "line_no", "raw_date", "driver_name", "customer_name",
                               "total_miles", "raw_amount", "raw_email", "raw_phone", "status"))
    ln = F.col("line_no")
    return r.select(
        F.col("route_key").alias("record_key"),
        F.when(ln == 6, F.lit(None).cast("string"))
         .when(ln == 5, F.concat("route_key", F.lit("-" + "x" * 40)))
         .otherwise(F.col("route_key")).alias("route_id"),
        F.col("raw_date").alias("route_date"),
        "driver_name", "customer_name",
        F.when(ln == 4, F.lit("-5")).when(ln == 3, F.lit("9000"))
         .otherwise(F.col("total_miles").cast("string")).alias("total_miles"),
        F.col("raw_amount").alias("revenue"),
        F.col("raw_email").alias("email"),
        F.col("raw_phone").alias("phone"),
        F.when(ln == 2, F.upper("status"))
         .when((ln == 1) & (F.col("status") == "scheduled"), F.lit("lost"))
         .otherwise(F.col("status")).alias("status"))


COLLECTED_SQL = """
collected AS (
  SELECT route_key AS record_key,
    CASE WHEN line_no = 6 THEN NULL WHEN line_no = 5 THEN route_key || '-' || repeat('x', 40)
         ELSE route_key END AS route_id,
    raw_date AS route_date, driver_name, customer_name,
    CASE WHEN line_no = 4 THEN '-5' WHEN line_no = 3 THEN '9000' ELSE cast(total_miles AS VARCHAR) END AS total_miles,
    raw_amount AS revenue, raw_email AS email, raw_phone AS phone,
    CASE WHEN line_no = 2 THEN upper(status) WHEN line_no = 1 AND status = 'scheduled' THEN 'lost'
         ELSE status END AS status
  FROM routes
)"""
