"""The report fact -- routes with drivers, vehicles, customers and both
locations, restricted to an inclusive date range, with all route metrics.

The date range is applied to ``l_shipdate`` before any join, so it becomes a
Parquet ``PushedFilters`` range (and partition pruning on a ``route_date``-
partitioned store).  The fact is meant to be computed once per report bundle
and cached/checkpointed; every section of the bundle is an aggregate over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions.metrics import METRIC_INPUTS, with_route_metrics
from .routes_view import FACT_COLUMNS, routes

# types of the fact's view columns (for the placeholders of unread columns)
_TYPES = {"route_key": "string", "route_date": "date", "driver_id": "bigint", "driver_name": "string",
          "driver_rate": "double", "customer_id": "bigint", "customer_name": "string", "vehicle_id": "bigint",
          "vehicle_info": "string", "vehicle_mpg": "double", "vehicle_capacity": "double",
          "driver_safety": "double", "customer_rating": "double", "status": "string", "load_weight": "double",
          "total_miles": "double", "empty_miles": "double", "fuel_consumed": "double", "revenue": "double",
          "fuel_cost": "double", "toll_cost": "double", "driver_pay": "double", "other_costs": "double",
          "scheduled_start": "timestamp_ntz", "scheduled_end": "timestamp_ntz", "actual_start": "timestamp_ntz",
          "actual_end": "timestamp_ntz", "start_lat": "double", "start_lon": "double", "end_lat": "double",
          "end_lon": "double"}


def view_columns_for(need) -> list[str]:
    """The view columns that the requested fact/metric columns read."""
    cols = set()
    for n in need:
        cols |= METRIC_INPUTS.get(n, {n})
    return [c for c in FACT_COLUMNS if c in cols]


def report_fact(spark: SparkSession, sf_dir: str, date_from: str | None = None,
                date_to: str | None = None, need=None) -> DataFrame:
    """The fact with every metric.  ``need`` names the columns the caller
    reads; only the dimensions those columns depend on are joined (at scale
    each avoided join is a shuffle of the fact avoided).  Columns outside
    ``need`` are typed NULL placeholders, so callers must declare what they
    read -- the oracle tests catch an undeclared read."""
    if need is None:
        return with_route_metrics(routes(spark, sf_dir, FACT_COLUMNS, date_from, date_to))
    cols = view_columns_for(need)
    v = routes(spark, sf_dir, cols, date_from, date_to)
    v = v.withColumns({c: F.lit(None).cast(_TYPES[c]) for c in FACT_COLUMNS if c not in cols})
    return with_route_metrics(v)
