"""Windows, sorts and top-k: W3, W6, T1-T3 (W1/W2/W4/W5/W7 run inside G1,
U1, A26 and V11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import window as W
from ..plans.report_fact import report_fact
from ..plans.routes_view import routes
from .registry import register
from .sqlbase import fsum, r2, with_routes
from .q_reports import A4_SQL_BODY


@register("W3_driver_rank", with_routes(f"""
SELECT name, efficiency, rank() OVER (ORDER BY efficiency DESC) AS rank
FROM ({A4_SQL_BODY.format(extra='', where='')})"""))
def w3(spark, sf):
    """Rank drivers by mean efficiency -- after aggregation (one row per
    driver), never over the fact; the drivers are ranked range by range."""
    d = A.driver_metrics(report_fact(spark, sf, need=A.NEEDS["driver_metrics"]))
    return W.rank_by(d.select("name", "efficiency"), [("efficiency", True)])


@register("W6_percentile_bands", with_routes(f"""
, d AS (SELECT route_date, {r2(fsum('coalesce(revenue, 0)'))} AS revenue FROM routes GROUP BY route_date),
s AS (SELECT min(revenue) AS lo, quantile_disc(revenue, 0.5) AS p50, max(revenue) AS hi FROM d)
SELECT route_date, revenue,
       CASE WHEN revenue < p50 THEN 'low' WHEN revenue = p50 THEN 'mid' ELSE 'high' END AS band,
       CASE WHEN hi > lo THEN round_even((revenue - lo) / (hi - lo) * 10000, 0) / 10000 ELSE 0.0 END AS bar
FROM d, s""".replace("\n, d AS", ", d AS", 1)))
def w6(spark, sf):
    """Colour bands (min / median / max) and data bars of daily revenue."""
    daily = A.revenue_trend(report_fact(spark, sf, need=A.NEEDS["revenue_trend"]))
    return W.percentile_bands(daily, "revenue")


@register("T1_ordered_listing", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def t1(spark, sf):
    """Vehicles listed by make, model (brand, type), then key."""
    from ..sources.tables import table
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type") \
        .orderBy("p_brand", "p_type", "p_partkey")


@register("T2_top5_drivers", with_routes(f"""
SELECT driver_name, {r2(fsum('coalesce(revenue, 0)'))} AS revenue FROM routes GROUP BY driver_name
ORDER BY {fsum('coalesce(revenue, 0)')} DESC, driver_name LIMIT 5"""))
def t2(spark, sf):
    """Top 5 drivers by revenue (top-k is the feature; ties by name)."""
    d = A.driver_totals(report_fact(spark, sf, need=A.NEEDS["driver_totals"]))
    return W.top_k(d.select("driver_name", "revenue"), [F.col("revenue").desc(), "driver_name"], 5)


@register("T3_first_rows_and_remainder", with_routes("""
SELECT label, false AS is_remainder FROM (SELECT route_key AS label FROM routes ORDER BY route_date, route_key LIMIT 20)
UNION ALL
SELECT 'and ' || cast(count(*) - 20 AS VARCHAR) || ' more', true FROM routes HAVING count(*) > 20"""))
def t3(spark, sf):
    """First 20 routes of the listing plus an 'and N more' row."""
    r = routes(spark, sf, ("route_key", "route_date"))
    return W.head_with_remainder(r.withColumnRenamed("route_key", "label"), ["route_date", "label"], 20, "label")
