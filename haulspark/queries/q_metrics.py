"""Per-route metrics over the whole routes view: M1-M17."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.numeric import nz, truthy
from ..plans.report_fact import report_fact
from ..plans.routes_view import routes
from .registry import register
from .sqlbase import r2, with_routes


def _fact(spark, sf):
    return report_fact(spark, sf)


def _hav_sql(a1, o1, a2, o2):
    ra = lambda x: f"({x} * pi() / 180)"
    dlat = f"({ra(a2)} - {ra(a1)})"
    dlon = f"({ra(o2)} - {ra(o1)})"
    a = (f"sin({dlat} / 2) * sin({dlat} / 2) + cos({ra(a1)}) * cos({ra(a2)}) "
         f"* sin({dlon} / 2) * sin({dlon} / 2)")
    return r2(f"asin(sqrt(least(greatest({a}, 0), 1))) * 2 * 3956")


@register("M1_haversine_miles", with_routes(
    f"SELECT route_key, {_hav_sql('start_lat', 'start_lon', 'end_lat', 'end_lon')} AS miles FROM routes"))
def m1(spark, sf):
    r = routes(spark, sf, ("route_key", "start_lat", "start_lon", "end_lat", "end_lon"))
    return r.select("route_key", M.haversine_miles("start_lat", "start_lon", "end_lat", "end_lon").alias("miles"))


@register("M2_ellipsoid_miles")
def m2(spark, sf):
    """No SQL oracle: checked against a reference geodesic within a tolerance."""
    r = routes(spark, sf, ("route_key", "start_lat", "start_lon", "end_lat", "end_lon"))
    return r.select("route_key", M.ellipsoid_miles("start_lat", "start_lon", "end_lat", "end_lon").alias("miles"))


@register("M3_fuel_cost", with_routes(f"""
SELECT route_key, CASE WHEN coalesce(total_miles, 0) <> 0 AND vehicle_mpg <> 0 AND vehicle_mpg > 0
                       THEN {r2('total_miles / vehicle_mpg * 3.5')} ELSE 0.0 END AS fuel_cost FROM routes"""))
def m3(spark, sf):
    r = routes(spark, sf, ("route_key", "total_miles", "vehicle_mpg"))
    return r.select("route_key", M.fuel_cost(nz("total_miles"), "vehicle_mpg").alias("fuel_cost"))


@register("M4_toll_cost", with_routes(f"""
SELECT route_key, CASE WHEN coalesce(total_miles, 0) <> 0 THEN {r2('total_miles * 0.15')} ELSE 0.0 END AS toll_cost
FROM routes"""))
def m4(spark, sf):
    r = routes(spark, sf, ("route_key", "total_miles"))
    return r.select("route_key", M.toll_cost(nz("total_miles")).alias("toll_cost"))


@register("M5_driver_pay", with_routes(f"""
SELECT route_key, {r2('greatest(CASE WHEN total_hours <> 0 AND driver_rate <> 0 THEN total_hours * driver_rate ELSE 0.0 END, '
                      'CASE WHEN total_miles <> 0 THEN total_miles * 0.55 ELSE 0.0 END)')} AS driver_pay
FROM route_metrics"""))
def m5(spark, sf):
    f = _fact(spark, sf)
    return f.select("route_key", M.driver_pay("total_hours", "driver_rate", "total_miles", F.lit(0.55))
                    .alias("driver_pay"))


@register("M6_trip_duration", with_routes(
    "SELECT route_key, total_hours, total_minutes, driving_hours, wait_hours FROM route_metrics"))
def m6(spark, sf):
    return _fact(spark, sf).select("route_key", "total_hours", "total_minutes", "driving_hours", "wait_hours")


_TEXT_HOURS = """(epoch_us(CASE WHEN line_no % 5 = 3 THEN date_trunc('minute', actual_end) WHEN line_no % 5 <> 4 THEN actual_end END)
  - epoch_us(CASE WHEN line_no % 5 = 3 THEN date_trunc('minute', actual_start) ELSE actual_start END)) / cast(3600000000 AS DOUBLE)"""


@register("M6_trip_duration_text", with_routes(f"""
SELECT route_key, coalesce({r2('h')}, 0) AS total_hours, coalesce({r2('m')}, 0) AS total_minutes,
       coalesce({r2('h * 0.8')}, 0) AS driving_hours, coalesce({r2('h * 0.2')}, 0) AS wait_hours
FROM (SELECT route_key, {_TEXT_HOURS} AS h, {_TEXT_HOURS.replace('3600000000', '60000000')} AS m FROM routes)"""))
def m6_text(spark, sf):
    """Times landed as text in four spellings (with Z, with an offset, plain, to the
    minute), and some that are no time."""
    r = routes(spark, sf, ("route_key", "line_no", "actual_start", "actual_end"))

    def text(t):
        utc, k = F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.col("line_no") % 5
        later = F.date_format(F.col(t) + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
        return (F.when(k == 0, F.concat(F.translate(utc, " ", "T"), F.lit("Z"))).when(k == 1, F.concat(later, F.lit("+02:00")))
                .when(k == 2, utc).when(k == 3, F.date_format(t, "yyyy-MM-dd HH:mm")).otherwise(utc if t == "actual_start" else F.lit("soon")))

    return r.select("route_key", text("actual_start").alias("s"), text("actual_end").alias("e")).select(
        "route_key", *[v.alias(n) for n, v in M.trip_duration("s", "e").items()])


@register("M7_average_speed", with_routes("SELECT route_key, average_speed FROM route_metrics"))
def m7(spark, sf):
    return _fact(spark, sf).select("route_key", "average_speed")


@register("M8_efficiency_score", with_routes("SELECT route_key, efficiency_score FROM route_metrics"))
def m8(spark, sf):
    return _fact(spark, sf).select("route_key", "efficiency_score")


@register("M9_profit_margin", with_routes("SELECT route_key, profit, profit_margin FROM route_metrics"))
def m9(spark, sf):
    return _fact(spark, sf).select("route_key", "profit", "profit_margin")


@register("M10_per_mile", with_routes("SELECT route_key, revenue_per_mile, cost_per_mile FROM route_metrics"))
def m10(spark, sf):
    return _fact(spark, sf).select("route_key", "revenue_per_mile", "cost_per_mile")


@register("M11_deadhead_percentage", with_routes("SELECT route_key, deadhead_percentage FROM route_metrics"))
def m11(spark, sf):
    return _fact(spark, sf).select("route_key", "deadhead_percentage")


@register("M12_fuel_efficiency", with_routes("SELECT route_key, fuel_efficiency FROM route_metrics"))
def m12(spark, sf):
    return _fact(spark, sf).select("route_key", "fuel_efficiency")


@register("M13_cost_breakdown", with_routes(f"""
SELECT route_key, {r2('coalesce(fuel_cost, 0)')} AS fuel_cost, {r2('coalesce(toll_cost, 0)')} AS toll_cost,
       {r2('coalesce(driver_pay, 0)')} AS driver_pay, {r2('coalesce(total_miles, 0) * 0.08')} AS maintenance_cost,
       {r2('coalesce(total_miles, 0) * 0.05')} AS insurance_cost, {r2('coalesce(other_costs, 0)')} AS other_costs,
       {r2('coalesce(fuel_cost, 0) + coalesce(toll_cost, 0) + coalesce(total_miles, 0) * 0.08 + coalesce(total_miles, 0) * 0.05')}
         AS total_variable_costs,
       {r2('coalesce(fuel_cost, 0) + coalesce(toll_cost, 0) + coalesce(total_miles, 0) * 0.08 + coalesce(total_miles, 0) * 0.05'
           ' + coalesce(driver_pay, 0) + coalesce(other_costs, 0)')} AS total_costs
FROM routes"""))
def m13(spark, sf):
    """Cost breakdown of the *stored* route costs (fuel, toll, pay, other)."""
    r = routes(spark, sf, ("route_key", "fuel_cost", "toll_cost", "driver_pay", "other_costs", "total_miles"))
    return r.select("route_key", M.cost_breakdown("fuel_cost", "toll_cost", "driver_pay", "other_costs",
                                                  "total_miles").alias("b")).select("route_key", "b.*")


@register("M14_route_metrics", with_routes(
    "SELECT route_key, " + ", ".join(M.METRIC_COLUMNS) + " FROM route_metrics"))
def m14(spark, sf):
    return _fact(spark, sf).select("route_key", *M.METRIC_COLUMNS)


@register("M15_distance_efficiency", with_routes(
    "SELECT route_key, calculated_distance, distance_efficiency FROM route_metrics"))
def m15(spark, sf):
    return _fact(spark, sf).select("route_key", "calculated_distance", "distance_efficiency")


@register("M16_efficiency_metrics", with_routes("""
SELECT route_key,
  CASE WHEN total_miles <> 0 AND fuel_consumed <> 0 THEN total_miles / fuel_consumed END AS mpg,
  CASE WHEN revenue <> 0 AND total_miles <> 0 THEN revenue / total_miles END AS revenue_per_mile,
  CASE WHEN tc <> 0 AND total_miles <> 0 THEN tc / total_miles END AS cost_per_mile,
  CASE WHEN revenue <> 0 AND tc <> 0 THEN (revenue - tc) / revenue * 100 END AS profit_margin,
  CASE WHEN empty_miles <> 0 AND total_miles <> 0 THEN empty_miles / total_miles * 100 END AS deadhead_percentage
FROM (SELECT *, coalesce(fuel_cost, 0) + coalesce(toll_cost, 0) + coalesce(driver_pay, 0)
                + coalesce(other_costs, 0) AS tc FROM routes)"""))
def m16(spark, sf):
    """Unrounded efficiency figures from the stored costs; NULL when an input
    is missing or zero."""
    r = routes(spark, sf, ("route_key", "total_miles", "fuel_consumed", "revenue", "fuel_cost", "toll_cost",
                           "driver_pay", "other_costs", "empty_miles"))
    tc = nz("fuel_cost") + nz("toll_cost") + nz("driver_pay") + nz("other_costs")
    m, rev = F.col("total_miles"), F.col("revenue")
    return r.select(
        "route_key",
        F.when(truthy(m) & truthy("fuel_consumed"), m / F.col("fuel_consumed")).alias("mpg"),
        F.when(truthy(rev) & truthy(m), rev / m).alias("revenue_per_mile"),
        F.when(truthy(tc) & truthy(m), tc / m).alias("cost_per_mile"),
        F.when(truthy(rev) & truthy(tc), (rev - tc) / rev * 100).alias("profit_margin"),
        F.when(truthy("empty_miles") & truthy(m), F.col("empty_miles") / m * 100).alias("deadhead_percentage"))


@register("M17_batch_metrics", with_routes("""
SELECT count(*) AS processed, count(total_hours) AS calculated,
       count(*) - count(total_hours) AS without_times, count(efficiency_score) AS scored
FROM route_metrics"""))
def m17(spark, sf):
    """Batch application: every row keeps its metrics columns (total
    functions, no failing rows); the counters are one aggregate."""
    f = _fact(spark, sf)
    return f.agg(F.count(F.lit(1)).alias("processed"), F.count("total_hours").alias("calculated"),
                 (F.count(F.lit(1)) - F.count("total_hours")).alias("without_times"),
                 F.count("efficiency_score").alias("scored"))
