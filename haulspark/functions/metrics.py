"""Per-route metrics (M1-M17) as Catalyst column expressions.

Every metric is a total function of the row: missing inputs give NULL
("absent") or 0 exactly where the reference's truthiness rules say so, and
nothing raises under ANSI mode.  Rounding is ``round2`` (half-even on the
binary value) so DuckDB can state the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import c, nz, round2, truthy

# Default rates of the route cost model.
EARTH_RADIUS_MILES = 3956.0
FUEL_PRICE = 3.50          # per gallon
TOLL_RATE = 0.15           # per mile
MAINTENANCE_RATE = 0.08    # per mile
INSURANCE_RATE = 0.05      # per mile
DEFAULT_MPG = 8.0
DEFAULT_HOURLY_RATE = 25.0
DRIVING_SHARE = 0.8
WAITING_SHARE = 0.2


def micros(ts) -> Column:
    """Epoch microseconds of a timestamp or timestamp_ntz (session zone UTC)."""
    return F.unix_micros(c(ts).cast("timestamp"))


def hours_between(start, end) -> Column:
    return (micros(end) - micros(start)) / 3.6e9


def minutes_between(start, end) -> Column:
    return (micros(end) - micros(start)) / 6.0e7


def parse_time_text(x) -> Column:
    """A time given as text: ISO (``T`` or a blank, fractions, ``Z`` or an offset; a time
    without one counts as UTC), to the minute, or a date; NULL if it is none of these."""
    x = F.trim(c(x))
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), x.try_cast("timestamp"))


def trip_duration(start, end) -> dict[str, Column]:
    """M6 over text times: total hours and minutes, driving 80 %, waiting 20 %; 0 where
    a time is missing or does not parse."""
    a, b = parse_time_text(start), parse_time_text(end)
    us = F.unix_micros(b) - F.unix_micros(a)
    h, m = us / 3.6e9, us / 6.0e7
    shares = {"total_hours": h, "total_minutes": m, "driving_hours": h * DRIVING_SHARE, "wait_hours": h * WAITING_SHARE}
    return {n: F.coalesce(round2(v), F.lit(0.0)) for n, v in shares.items()}


def radians(x) -> Column:
    return c(x) * math.pi / 180.0


def haversine_raw(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle miles (unrounded), sqrt argument clamped to [0, 1]."""
    p1, p2 = radians(lat1), radians(lat2)
    return haversine_of(p1, radians(lon1), F.cos(p1), p2, radians(lon2), F.cos(p2))


def haversine_of(p1, l1, cos1, p2, l2, cos2) -> Column:
    """The same from both sides' latitude and longitude in radians and cosine of latitude."""
    dlat, dlon = c(p2) - c(p1), c(l2) - c(l1)
    s1, s2 = F.sin(dlat / 2), F.sin(dlon / 2)
    a = s1 * s1 + c(cos1) * c(cos2) * s2 * s2
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return F.asin(F.sqrt(a)) * 2 * EARTH_RADIUS_MILES


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    """M1: rounded haversine miles."""
    return round2(haversine_raw(lat1, lon1, lat2, lon2))


def ellipsoid_miles(lat1, lon1, lat2, lon2) -> Column:
    """M2: Andoyer-Lambert closed-form distance on the WGS-84 ellipsoid, miles.

    A first-order flattening correction of the spherical distance; agrees
    with the iterative geodesic to within metres on continental distances.
    """
    a_km, f = 6378.137, 1 / 298.257223563
    b1 = F.atan((1 - f) * F.tan(radians(lat1)))
    b2 = F.atan((1 - f) * F.tan(radians(lat2)))
    dl = radians(lon2) - radians(lon1)
    cos_s = F.sin(b1) * F.sin(b2) + F.cos(b1) * F.cos(b2) * F.cos(dl)
    sigma = F.acos(F.least(F.greatest(cos_s, F.lit(-1.0)), F.lit(1.0)))
    p = (b1 + b2) / 2
    q = (b2 - b1) / 2
    sin_s = F.sin(sigma)
    x = (sigma - sin_s) * (F.sin(p) * F.cos(q)) ** 2 / (F.cos(sigma / 2) ** 2)
    y = (sigma + sin_s) * (F.cos(p) * F.sin(q)) ** 2 / (F.sin(sigma / 2) ** 2)
    d_km = a_km * (sigma - f / 2 * (x + y))
    d_km = F.when(sigma == 0, F.lit(0.0)).otherwise(d_km)
    return round2(d_km / 1.609344)


def fuel_cost(miles, mpg, price=FUEL_PRICE) -> Column:
    """M3: miles / mpg * price; missing or non-positive input -> 0."""
    m, g = c(miles), c(mpg)
    ok = truthy(m) & truthy(g) & (g > 0)
    return F.when(ok, round2(m / g * price)).otherwise(F.lit(0.0))


def toll_cost(miles, rate=TOLL_RATE) -> Column:
    """M4."""
    m = c(miles)
    return F.when(truthy(m), round2(m * rate)).otherwise(F.lit(0.0))


def driver_pay(hours, hourly_rate, miles=None, mile_rate=None) -> Column:
    """M5: the greater of hours x rate and miles x mile rate (0 if neither)."""
    h, r = c(hours), c(hourly_rate)
    hp = F.when(truthy(h) & truthy(r), h * r).otherwise(F.lit(0.0))
    if miles is None or mile_rate is None:
        mp = F.lit(0.0)
    else:
        m, q = c(miles), c(mile_rate)
        mp = F.when(truthy(m) & truthy(q), m * q).otherwise(F.lit(0.0))
    return round2(F.greatest(hp, mp))


def average_speed(miles, hours) -> Column:
    """M7 (0 when hours is missing or non-positive)."""
    m, h = c(miles), c(hours)
    return F.when(truthy(m) & truthy(h) & (h > 0), round2(m / h)).otherwise(F.lit(0.0))


def efficiency_score(actual_miles, optimal_miles, actual_time, scheduled_time) -> Column:
    """M8: 0.6 x distance score + 0.4 x time score, each capped at 100."""
    am, om, at, st = c(actual_miles), c(optimal_miles), c(actual_time), c(scheduled_time)
    ds = F.least(F.when(am > 0, om / am).otherwise(F.lit(0.0)) * 100, F.lit(100.0))
    ts = F.least(F.when(at > 0, st / at).otherwise(F.lit(0.0)) * 100, F.lit(100.0))
    ok = truthy(am) & truthy(om) & truthy(at) & truthy(st)
    return F.when(ok, round2(ds * 0.6 + ts * 0.4)).otherwise(F.lit(0.0))


def profit_margin(revenue, total_costs) -> Column:
    """M9: percent; revenue missing or <= 0 -> 0."""
    r, t = c(revenue), c(total_costs)
    return F.when(truthy(r) & (r > 0), round2((r - t) / r * 100)).otherwise(F.lit(0.0))


def per_mile(amount, miles) -> Column:
    """Cost or revenue per mile; miles missing or <= 0 -> 0."""
    a, m = c(amount), c(miles)
    return F.when(truthy(m) & (m > 0), round2(a / m)).otherwise(F.lit(0.0))


def deadhead_percentage(empty_miles, total_miles) -> Column:
    """M11."""
    e, m = c(empty_miles), c(total_miles)
    return F.when(truthy(m) & (m > 0), round2(e / m * 100)).otherwise(F.lit(0.0))


def fuel_efficiency(miles, fuel) -> Column:
    """Miles per gallon."""
    m, g = c(miles), c(fuel)
    return F.when(truthy(g) & (g > 0), round2(m / g)).otherwise(F.lit(0.0))


def cost_breakdown(fuel, toll, pay, other, miles) -> Column:
    """Struct of rounded parts; totals from unrounded parts."""
    fuel, toll, pay, other, miles = (nz(x) for x in (fuel, toll, pay, other, miles))
    maint = miles * MAINTENANCE_RATE
    ins = miles * INSURANCE_RATE
    tvc = fuel + toll + maint + ins
    total = tvc + pay + other
    return F.struct(round2(fuel).alias("fuel_cost"), round2(toll).alias("toll_cost"),
                    round2(pay).alias("driver_pay"), round2(maint).alias("maintenance_cost"),
                    round2(ins).alias("insurance_cost"), round2(other).alias("other_costs"),
                    round2(tvc).alias("total_variable_costs"), round2(total).alias("total_costs"))


METRIC_COLUMNS = ("total_hours", "total_minutes", "driving_hours", "wait_hours",
                  "average_speed", "calculated_distance", "distance_efficiency",
                  "est_fuel_cost", "est_toll_cost", "est_driver_pay", "maintenance_cost",
                  "insurance_cost", "total_variable_costs", "total_costs", "profit",
                  "profit_margin", "revenue_per_mile", "cost_per_mile",
                  "deadhead_percentage", "fuel_efficiency", "efficiency_score")


_TIMES = {"actual_start", "actual_end", "scheduled_start", "scheduled_end"}
_COORDS = {"start_lat", "start_lon", "end_lat", "end_lon"}
_COSTS = {"total_miles", "vehicle_mpg", "driver_rate", "other_costs"} | _TIMES
# view columns each metric reads (transitively)
METRIC_INPUTS = {
    "total_hours": _TIMES, "total_minutes": _TIMES, "driving_hours": _TIMES, "wait_hours": _TIMES,
    "average_speed": _TIMES | {"total_miles"},
    "calculated_distance": _COORDS, "distance_efficiency": _COORDS | {"total_miles"},
    "est_fuel_cost": {"total_miles", "vehicle_mpg"}, "est_toll_cost": {"total_miles"},
    "est_driver_pay": _TIMES | {"driver_rate"},
    "maintenance_cost": {"total_miles"}, "insurance_cost": {"total_miles"},
    "total_variable_costs": {"total_miles", "vehicle_mpg"}, "total_costs": _COSTS,
    "profit": _COSTS | {"revenue"}, "profit_margin": _COSTS | {"revenue"},
    "revenue_per_mile": {"revenue", "total_miles"}, "cost_per_mile": _COSTS | {"revenue"},
    "deadhead_percentage": {"total_miles", "empty_miles"},
    "fuel_efficiency": {"total_miles", "fuel_consumed"},
    "efficiency_score": _COORDS | _TIMES | {"total_miles"},
}


def with_route_metrics(df: DataFrame, mpg_col: str | None = "vehicle_mpg",
                       rate_col: str | None = "driver_rate") -> DataFrame:
    """All metrics of a route in one projection.

    Actual times fall back to scheduled ones; the vehicle's mpg defaults to
    8.0 and the driver's hourly rate to 25.0 when absent.  Estimated costs go
    to ``est_*`` columns so stored costs are never overwritten (the stored
    ones are filled only where missing, see P23).
    """
    miles = nz("total_miles")
    rev = nz("revenue")
    start = F.coalesce(F.col("actual_start"), F.col("scheduled_start"))
    end = F.coalesce(F.col("actual_end"), F.col("scheduled_end"))
    h = hours_between(start, end)
    has_t = start.isNotNull() & end.isNotNull()
    th = F.when(has_t, round2(h))
    mpg = F.coalesce(F.col(mpg_col), F.lit(DEFAULT_MPG)) if mpg_col else F.lit(DEFAULT_MPG)
    rate = F.coalesce(F.col(rate_col), F.lit(DEFAULT_HOURLY_RATE)) if rate_col else F.lit(DEFAULT_HOURLY_RATE)
    coords_ok = truthy("start_lat") & truthy("start_lon") & truthy("end_lat") & truthy("end_lon")
    calc = F.when(coords_ok, haversine_miles("start_lat", "start_lon", "end_lat", "end_lon"))
    sched_h = hours_between("scheduled_start", "scheduled_end")

    df = df.withColumns({
        "total_hours": th,
        "total_minutes": F.when(has_t, round2(minutes_between(start, end))),
        "driving_hours": F.when(has_t, round2(h * DRIVING_SHARE)),
        "wait_hours": F.when(has_t, round2(h * WAITING_SHARE)),
        "calculated_distance": calc,
    })
    th, calc = F.col("total_hours"), F.col("calculated_distance")
    df = df.withColumns({
        "average_speed": F.when(truthy(miles) & truthy(th), average_speed(miles, th)),
        "distance_efficiency": F.when(calc.isNotNull() & truthy(miles), round2(calc / miles * 100)),
        "est_fuel_cost": fuel_cost(miles, mpg),
        "est_toll_cost": toll_cost(miles),
        "est_driver_pay": F.when(th.isNotNull(), driver_pay(th, rate)).otherwise(F.lit(0.0)),
    })
    cb = cost_breakdown("est_fuel_cost", "est_toll_cost", "est_driver_pay", "other_costs", miles)
    df = df.withColumn("_cb", cb).withColumns({
        "maintenance_cost": F.col("_cb.maintenance_cost"),
        "insurance_cost": F.col("_cb.insurance_cost"),
        "total_variable_costs": F.col("_cb.total_variable_costs"),
        "total_costs": F.col("_cb.total_costs"),
    }).drop("_cb")
    tc = F.col("total_costs")
    return df.withColumns({
        "profit": F.when(truthy(rev), round2(rev - tc)),
        "profit_margin": F.when(truthy(rev), profit_margin(rev, tc)),
        "revenue_per_mile": F.when(truthy(rev) & truthy(miles), per_mile(rev, miles)),
        "cost_per_mile": F.when(truthy(rev) & truthy(miles), per_mile(tc, miles)),
        "deadhead_percentage": F.when(truthy(miles), deadhead_percentage(nz("empty_miles"), miles)),
        "fuel_efficiency": F.when(truthy(miles) & truthy("fuel_consumed"),
                                  fuel_efficiency(miles, "fuel_consumed")),
        "efficiency_score": F.when(truthy(calc) & truthy(miles) & truthy(sched_h) & truthy(th),
                                   efficiency_score(miles, calc, th, sched_h)),
    })
