"""Report fact, aggregations and bundles: J1, A1-A21, A25-A34, R4-R8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..plans import bundle as B
from ..plans.report_fact import report_fact
from ..sources.tables import TABLES, table
from .registry import ORACLE, register
from .sqlbase import fsum, r2, with_routes

# Report periods (inclusive dates) used by the registered report queries.
QUARTER = ("1997-01-01", "1997-03-31")
DAY = ("1997-06-02", "1997-06-02")
WEEK = ("1997-06-02", "1997-06-08")
MONTH = ("1997-06-01", "1997-06-30")
YEAR = ("1996-01-01", "1996-12-31")
EMPTY = ("1990-01-01", "1990-01-31")


def _fact(spark, sf, period=None, need=None):
    if period is None:
        return report_fact(spark, sf, need=need)
    return report_fact(spark, sf, *period, need=need)


def _where(period) -> str:
    return f"WHERE route_date BETWEEN DATE '{period[0]}' AND DATE '{period[1]}'"


def nz(x):
    return f"coalesce({x}, 0)"


# ---------------------------------------------------------------- J1
J1_COLS = ["route_key", "route_date", "driver_name", "vehicle_info", "customer_name", "status",
           "scheduled_start", "total_miles", "revenue", "total_hours", "average_speed",
           "calculated_distance", "total_costs", "profit", "profit_margin", "efficiency_score"]


@register("J1_report_fact", with_routes(
    f"SELECT {', '.join(J1_COLS)} FROM route_metrics {_where(QUARTER)}"))
def j1_report_fact(spark, sf):
    return _fact(spark, sf, QUARTER).select(*J1_COLS)


# ---------------------------------------------------------------- A1
@register("A1_driver_performance", with_routes(f"""
SELECT driver_name, total_routes, {r2('m')} AS total_miles, {r2('r')} AS total_revenue,
       {r2('c')} AS total_costs, {r2('e / total_routes')} AS average_efficiency,
       {r2('v / total_routes')} AS average_speed,
       {r2('ot / total_routes * 100')} AS on_time_percentage,
       {r2('CASE WHEN m > 0 THEN r / m ELSE 0.0 END')} AS revenue_per_mile,
       {r2('CASE WHEN m > 0 THEN c / m ELSE 0.0 END')} AS cost_per_mile,
       CASE WHEN r > 0 THEN {r2('(r - c) / r * 100')} ELSE 0.0 END AS profit_margin
FROM (SELECT driver_name, count(*) AS total_routes, {fsum(nz('total_miles'))} AS m,
             {fsum(nz('revenue'))} AS r, {fsum(nz('total_costs'))} AS c,
             {fsum(nz('efficiency_score'))} AS e, {fsum(nz('average_speed'))} AS v,
             count(*) FILTER (WHERE coalesce(efficiency_score, 0) >= 80) AS ot
      FROM route_metrics GROUP BY driver_name)"""))
def a1(spark, sf):
    return A.driver_performance(_fact(spark, sf, need=A.NEEDS["driver_performance"]))


# ---------------------------------------------------------------- A2
@register("A2_vehicle_utilization", with_routes(f"""
SELECT vehicle_id, total_routes, {r2('m')} AS total_miles,
       {r2('CASE WHEN cap * total_routes > 0 THEN w / (cap * total_routes) ELSE 0.0 END * 100')} AS utilization_percentage,
       {r2('CASE WHEN f <> 0 THEN m / f ELSE 0.0 END')} AS average_mpg,
       {r2('f')} AS total_fuel_consumed
FROM (SELECT vehicle_id, count(*) AS total_routes, {fsum(nz('total_miles'))} AS m,
             {fsum(nz('load_weight'))} AS w, {fsum(nz('fuel_consumed'))} AS f,
             coalesce(max(vehicle_capacity), 40000.0) AS cap
      FROM route_metrics GROUP BY vehicle_id)"""))
def a2(spark, sf):
    return A.vehicle_utilization(_fact(spark, sf, need=A.NEEDS["vehicle_utilization"]))


# ---------------------------------------------------------------- A3
A3_SQL_BODY = f"""
SELECT CASE WHEN n = 0 THEN 'no_data' ELSE 'ok' END AS status, n AS total_routes,
       {r2('m')} AS total_miles, {r2('r')} AS total_revenue, {r2('c')} AS total_costs,
       {r2('CASE WHEN n > 0 THEN m / n ELSE 0.0 END')} AS average_miles_per_route,
       {r2('CASE WHEN n > 0 THEN r / n ELSE 0.0 END')} AS average_revenue_per_route,
       {r2('r - c')} AS total_profit,
       {r2('CASE WHEN r > 0 THEN (r - c) / r ELSE 0.0 END * 100')} AS profit_margin
FROM (SELECT count(*) AS n, {fsum(nz('total_miles'))} AS m, {fsum(nz('revenue'))} AS r,
             {fsum(nz('total_costs'))} AS c FROM route_metrics {{where}})"""


@register("A3_period_summary", with_routes(A3_SQL_BODY.format(where="")))
def a3(spark, sf):
    return A.period_summary(_fact(spark, sf, need=A.NEEDS["period_summary"]))


# ---------------------------------------------------------------- A4 / A5
A4_SQL_BODY = f"""
SELECT name, route_count, {r2('m')} AS total_miles, {r2('r')} AS revenue,
       {r2('coalesce(e, 0.0)')} AS efficiency, {r2('coalesce(v, 0.0)')} AS avg_speed {{extra}}
FROM (SELECT coalesce(driver_name, 'Unknown') AS name, count(*) AS route_count,
             {fsum(nz('total_miles'))} AS m, {fsum(nz('revenue'))} AS r,
             {fsum("CASE WHEN efficiency_score <> 0 THEN efficiency_score END")}
               / count(CASE WHEN efficiency_score <> 0 THEN 1 END) AS e,
             {fsum("CASE WHEN average_speed <> 0 THEN average_speed END")}
               / count(CASE WHEN average_speed <> 0 THEN 1 END) AS v
      FROM route_metrics {{where}} GROUP BY 1)"""


@register("A4_driver_metrics", with_routes(A4_SQL_BODY.format(extra="", where="")))
def a4(spark, sf):
    return A.driver_metrics(_fact(spark, sf, need=A.NEEDS["driver_metrics"]))


@register("A5_driver_rating", with_routes(A4_SQL_BODY.format(
    extra=", " + r2("(coalesce(e, 0.0) + coalesce(v, 0.0) / 10) / 2") + " AS rating", where="")))
def a5(spark, sf):
    return A.driver_rating(_fact(spark, sf, need=A.NEEDS["driver_rating"]))


# ---------------------------------------------------------------- A6 / A7 / A29
@register("A6_vehicle_metrics", with_routes(f"""
SELECT vehicle AS vehicle_info, route_count, {r2('m')} AS total_miles, {r2('f')} AS fuel_used,
       {r2('mc')} AS maintenance_cost, {r2('CASE WHEN f > 0 THEN m / f ELSE 0.0 END')} AS mpg,
       {r2('CASE WHEN m > 0 THEN mc / m ELSE 0.0 END')} AS cost_per_mile
FROM (SELECT coalesce(vehicle_info, 'Unknown') AS vehicle, count(*) AS route_count,
             {fsum(nz('total_miles'))} AS m, {fsum(nz('fuel_consumed'))} AS f,
             {fsum(nz('maintenance_cost'))} AS mc
      FROM route_metrics GROUP BY 1)"""))
def a6(spark, sf):
    return A.vehicle_metrics(_fact(spark, sf, need=A.NEEDS["vehicle_metrics"]))


@register("A7_vehicle_load", with_routes(f"""
SELECT vehicle_id, route_count, {r2('m')} AS total_miles, {r2('f')} AS fuel_used,
       {r2('CASE WHEN f > 0 THEN m / f ELSE 0.0 END')} AS mpg,
       {r2('CASE WHEN cap > 0 THEN w / cap ELSE 0.0 END * 100')} AS utilization
FROM (SELECT vehicle_id, count(*) AS route_count, {fsum(nz('total_miles'))} AS m,
             {fsum(nz('fuel_consumed'))} AS f, {fsum(nz('load_weight'))} AS w,
             {fsum('coalesce(vehicle_capacity, 40000.0)')} AS cap
      FROM route_metrics GROUP BY vehicle_id)"""))
def a7(spark, sf):
    return A.vehicle_load(_fact(spark, sf, need=A.NEEDS["vehicle_load"]))


@register("A29_vehicle_performance", with_routes(f"""
SELECT vehicle_id, route_count, {r2('m')} AS total_miles, {r2('f')} AS fuel_used,
       {r2('CASE WHEN f > 0 THEN m / f ELSE 0.0 END')} AS mpg,
       {r2('CASE WHEN cap > 0 THEN w / cap ELSE 0.0 END * 100')} AS utilization,
       {r2('mc')} AS maintenance_cost, {r2('CASE WHEN m > 0 THEN tc / m ELSE 0.0 END')} AS cost_per_mile
FROM (SELECT vehicle_id, count(*) AS route_count, {fsum(nz('total_miles'))} AS m,
             {fsum(nz('fuel_consumed'))} AS f, {fsum(nz('load_weight'))} AS w,
             {fsum('coalesce(vehicle_capacity, 40000.0)')} AS cap,
             {fsum(nz('maintenance_cost'))} AS mc, {fsum(nz('total_costs'))} AS tc
      FROM route_metrics GROUP BY vehicle_id)"""))
def a29(spark, sf):
    return A.vehicle_performance(_fact(spark, sf, need=A.NEEDS["vehicle_performance"]))


# ---------------------------------------------------------------- A8 / A28 / A34
@register("A8_customer_metrics", with_routes(f"""
SELECT cust AS customer_name, route_count, {r2('r')} AS revenue, {r2('m')} AS total_miles,
       {r2('CASE WHEN route_count > 0 THEN r / route_count ELSE 0.0 END')} AS avg_revenue_per_route,
       {r2('CASE WHEN m > 0 THEN r / m ELSE 0.0 END')} AS revenue_per_mile
FROM (SELECT coalesce(customer_name, 'Unknown') AS cust, count(*) AS route_count,
             {fsum(nz('revenue'))} AS r, {fsum(nz('total_miles'))} AS m
      FROM route_metrics GROUP BY 1)"""))
def a8(spark, sf):
    return A.customer_metrics(_fact(spark, sf, need=A.NEEDS["customer_metrics"]))


@register("A28_customer_profitability", with_routes(f"""
SELECT cust AS customer_name, route_count, {r2('r')} AS revenue, {r2('tc')} AS costs,
       {r2('r - tc')} AS profit, {r2('CASE WHEN r > 0 THEN (r - tc) / r ELSE 0.0 END * 100')} AS margin,
       {r2('CASE WHEN route_count > 0 THEN r / route_count ELSE 0.0 END')} AS revenue_per_route,
       {r2('r - tc')} AS lifetime_value
FROM (SELECT coalesce(customer_name, 'Unknown') AS cust, count(*) AS route_count,
             {fsum(nz('revenue'))} AS r, {fsum(nz('total_costs'))} AS tc
      FROM route_metrics GROUP BY 1)"""))
def a28(spark, sf):
    return A.customer_profitability(_fact(spark, sf, need=A.NEEDS["customer_profitability"]))


@register("A34_weekly_customer_table", with_routes(f"""
SELECT customer_id, customer_name, routes, {r2('r')} AS revenue, {r2('r / routes')} AS revenue_per_route,
       {r2('m')} AS miles, {r2('r - c')} AS profit, rating
FROM (SELECT customer_id, customer_name, count(*) AS routes, {fsum(nz('revenue'))} AS r,
             {fsum(nz('total_miles'))} AS m, {fsum(nz('total_costs'))} AS c,
             max(customer_rating) AS rating
      FROM route_metrics {_where(WEEK)} AND customer_id IS NOT NULL GROUP BY 1, 2)"""))
def a34(spark, sf):
    return A.weekly_customer_table(_fact(spark, sf, WEEK, need=A.NEEDS["weekly_customer_table"]))


# ---------------------------------------------------------------- A9
@register("A9_financial_summary", with_routes(f"""
SELECT {r2('r')} AS total_revenue, {r2('f')} AS fuel_costs, {r2('p')} AS driver_pay,
       {r2('o')} AS other_costs, {r2('m')} AS total_miles, {r2('f + p + o')} AS total_costs,
       {r2('r - (f + p + o)')} AS gross_profit,
       {r2('CASE WHEN r > 0 THEN (r - (f + p + o)) / r ELSE 0.0 END * 100')} AS profit_margin,
       {r2('CASE WHEN m > 0 THEN r / m ELSE 0.0 END')} AS revenue_per_mile,
       {r2('CASE WHEN m > 0 THEN (f + p + o) / m ELSE 0.0 END')} AS cost_per_mile,
       {r2('f + p + o + t')} AS total_costs_with_tolls
FROM (SELECT {fsum(nz('revenue'))} AS r, {fsum(nz('fuel_cost'))} AS f, {fsum(nz('driver_pay'))} AS p,
             {fsum(nz('other_costs'))} AS o, {fsum(nz('toll_cost'))} AS t,
             {fsum(nz('total_miles'))} AS m FROM route_metrics)"""))
def a9(spark, sf):
    return A.financial_summary(_fact(spark, sf, need=A.NEEDS["financial_summary"]))


# ---------------------------------------------------------------- A10 / A11 / A16 / A17 / A32
A10_SQL = f"""
SELECT route_date, routes, {r2('m')} AS miles, {r2('r')} AS revenue, {r2('c')} AS costs,
       {r2('r - c')} AS profit
FROM (SELECT route_date, count(*) AS routes, {fsum(nz('total_miles'))} AS m,
             {fsum(nz('revenue'))} AS r,
             {fsum(nz('fuel_cost') + ' + ' + nz('driver_pay') + ' + ' + nz('other_costs'))} AS c
      FROM route_metrics GROUP BY route_date)"""


@register("A10_daily_rollup", with_routes(A10_SQL))
def a10(spark, sf):
    return A.daily_rollup(_fact(spark, sf, need=A.NEEDS["daily_rollup"]))


@register("A11_revenue_trend", with_routes(
    f"SELECT route_date, {r2(fsum(nz('revenue')))} AS revenue FROM route_metrics GROUP BY route_date"))
def a11(spark, sf):
    return A.revenue_trend(_fact(spark, sf, need=A.NEEDS["revenue_trend"]))


@register("A16_monthly_comparison", with_routes(f"""
SELECT month, {r2('r')} AS revenue, {r2('c')} AS costs, {r2('r - c')} AS profit
FROM (SELECT cast(date_trunc('month', route_date) AS DATE) AS month, {fsum(nz('revenue'))} AS r,
             {fsum(nz('total_costs'))} AS c FROM route_metrics GROUP BY 1)"""))
def a16(spark, sf):
    return A.monthly_comparison(_fact(spark, sf, need=A.NEEDS["monthly_comparison"]))


@register("A17_summary_rows", with_routes(f"""
, d AS ({A10_SQL})
SELECT 'detail' AS row_kind, route_date, miles, revenue, costs, profit FROM d
UNION ALL
SELECT 'SUM', NULL, {r2(fsum('miles'))}, {r2(fsum('revenue'))}, {r2(fsum('costs'))}, {r2(fsum('profit'))} FROM d
UNION ALL
SELECT 'AVERAGE', NULL, {r2(fsum('miles') + ' / count(miles)')}, {r2(fsum('revenue') + ' / count(revenue)')},
       {r2(fsum('costs') + ' / count(costs)')}, {r2(fsum('profit') + ' / count(profit)')} FROM d""".replace(
    "\n, d AS", ", d AS", 1)))
def a17(spark, sf):
    return A.with_summary_rows(A.daily_rollup(_fact(spark, sf, need=A.NEEDS["daily_rollup"])),
                               ["miles", "revenue", "costs", "profit"], "route_date")


@register("A32_weekly_overview", with_routes(f"""
, g AS (SELECT route_date, count(*) AS routes, {fsum(nz('total_miles'))} AS m, {fsum(nz('revenue'))} AS r,
              {fsum(nz('total_costs'))} AS c,
              {fsum('fuel_efficiency')} / count(fuel_efficiency) AS mpg
       FROM route_metrics GROUP BY GROUPING SETS ((route_date), ()))
SELECT CASE WHEN grouping_row THEN 'total' ELSE 'detail' END AS row_kind, route_date, routes,
       {r2('m')} AS miles, {r2('r')} AS revenue, {r2('c')} AS costs, {r2('r - c')} AS profit,
       {r2('CASE WHEN r > 0 THEN (r - c) / r ELSE 0.0 END * 100')} AS profit_margin, {r2('mpg')} AS avg_mpg
FROM (SELECT *, route_date IS NULL AS grouping_row FROM g)"""))
def a32(spark, sf):
    return A.weekly_overview(_fact(spark, sf, need=A.NEEDS["weekly_overview"]))


# ---------------------------------------------------------------- A12 / A13 / A14 / A15
@register("A12_cost_breakdown", with_routes(f"""
, t AS (SELECT {fsum(nz('fuel_cost'))} AS fuel, {fsum(nz('toll_cost'))} AS tolls,
              {fsum(nz('driver_pay'))} AS driver_pay, {fsum(nz('total_miles') + ' * 0.08')} AS maintenance,
              {fsum(nz('total_miles') + ' * 0.05')} AS insurance, {fsum(nz('other_costs'))} AS other
       FROM route_metrics),
l AS (SELECT 'fuel' AS category, fuel AS amount FROM t UNION ALL SELECT 'tolls', tolls FROM t
      UNION ALL SELECT 'driver_pay', driver_pay FROM t UNION ALL SELECT 'maintenance', maintenance FROM t
      UNION ALL SELECT 'insurance', insurance FROM t UNION ALL SELECT 'other', other FROM t),
s AS (SELECT fuel + tolls + driver_pay + maintenance + insurance + other AS total FROM t)
SELECT category, {r2('amount')} AS amount, {r2('amount / total * 100')} AS share_pct
FROM l, s WHERE amount > 0"""))
def a12(spark, sf):
    return A.cost_breakdown_categories(_fact(spark, sf, need=A.NEEDS["cost_breakdown_categories"]))


@register("A13_status_distribution", with_routes(
    "SELECT status, count(*) AS route_count FROM route_metrics GROUP BY status"))
def a13(spark, sf):
    return A.status_distribution(_fact(spark, sf, need=A.NEEDS["status_distribution"]))


@register("A14_driver_totals", with_routes(
    f"SELECT driver_name, {r2(fsum(nz('revenue')))} AS revenue, {r2(fsum(nz('total_miles')))} AS miles "
    "FROM route_metrics GROUP BY driver_name"))
def a14d(spark, sf):
    return A.driver_totals(_fact(spark, sf, need=A.NEEDS["driver_totals"]))


@register("A14_vehicle_mpg", with_routes(f"""
SELECT vehicle_info, {r2('CASE WHEN f > 0 THEN m / f ELSE 0.0 END')} AS mpg
FROM (SELECT vehicle_info, {fsum(nz('total_miles'))} AS m, {fsum(nz('fuel_consumed'))} AS f
      FROM route_metrics GROUP BY vehicle_info)"""))
def a14v(spark, sf):
    return A.vehicle_mpg(_fact(spark, sf, need=A.NEEDS["vehicle_mpg"]))


@register("A15_revenue_trend_line", with_routes("""
, p AS (SELECT * FROM route_metrics WHERE efficiency_score IS NOT NULL AND revenue IS NOT NULL),
l AS (SELECT regr_slope(revenue, efficiency_score) AS slope,
             regr_intercept(revenue, efficiency_score) AS intercept FROM p)
SELECT route_key, efficiency_score, round(slope, 6) AS slope, round(intercept, 4) AS intercept,
       round_even((slope * efficiency_score + intercept) * 100, 0) / 100 AS fitted_revenue
FROM p, l"""))
def a15(spark, sf):
    return A.revenue_efficiency_trend(_fact(spark, sf, need=A.NEEDS["revenue_efficiency_trend"]))


# ---------------------------------------------------------------- A18 / A19 / A20
# KPI and formula specs of the monthly template.
MONTHLY_KPIS = [
    {"name": "total_routes", "type": "count"},
    {"name": "total_revenue", "type": "sum", "field": "revenue"},
    {"name": "total_miles", "type": "sum", "field": "total_miles"},
    {"name": "total_costs", "type": "sum", "field": "total_costs"},
    {"name": "avg_efficiency", "type": "average", "field": "efficiency_score"},
    {"name": "avg_speed", "type": "average", "field": "average_speed"},
    {"name": "first_day", "type": "direct", "field": "route_date"},
]
MONTHLY_FORMULAS = {
    "profit_margin_pct": "try_divide(total_revenue - total_costs, total_revenue) * 100",
    "revenue_per_route": "try_divide(total_revenue, total_routes)",
    "cost_per_mile": "try_divide(total_costs, total_miles)",
}

A18_SQL = f"""
SELECT count(*) AS total_routes, {r2(fsum(nz('revenue')))} AS total_revenue,
       {r2(fsum(nz('total_miles')))} AS total_miles, {r2(fsum(nz('total_costs')))} AS total_costs,
       {r2('coalesce(' + fsum('efficiency_score') + ' / count(efficiency_score), 0.0)')} AS avg_efficiency,
       {r2('coalesce(' + fsum('average_speed') + ' / count(average_speed), 0.0)')} AS avg_speed,
       min(route_date) AS first_day
FROM route_metrics {_where(MONTH)}"""


@register("A18_kpi_metrics", with_routes(A18_SQL))
def a18(spark, sf):
    return A.kpis(_fact(spark, sf, MONTH, need=A.NEEDS["kpis"]), MONTHLY_KPIS)


@register("A19_formula_kpis", with_routes(f"""
SELECT *, {r2('(total_revenue - total_costs) / nullif(total_revenue, 0) * 100')} AS profit_margin_pct,
       {r2('total_revenue / nullif(total_routes, 0)')} AS revenue_per_route,
       {r2('total_costs / nullif(total_miles, 0)')} AS cost_per_mile
FROM ({A18_SQL})"""))
def a19(spark, sf):
    return A.formula_kpis(A.kpis(_fact(spark, sf, MONTH, need=A.NEEDS["kpis"]), MONTHLY_KPIS), MONTHLY_FORMULAS)


# The same over the whole fact.
A18_ALL_SQL = A18_SQL.replace(_where(MONTH), "")


@register("A18_kpi_metrics_all", with_routes(A18_ALL_SQL))
def a18_all(spark, sf):
    return A.kpis(_fact(spark, sf, need=A.NEEDS["kpis"]), MONTHLY_KPIS)


@register("A19_formula_kpis_all", with_routes(f"""
SELECT *, {r2('(total_revenue - total_costs) / nullif(total_revenue, 0) * 100')} AS profit_margin_pct,
       {r2('total_revenue / nullif(total_routes, 0)')} AS revenue_per_route,
       {r2('total_costs / nullif(total_miles, 0)')} AS cost_per_mile
FROM ({A18_ALL_SQL})"""))
def a19_all(spark, sf):
    return A.formula_kpis(A.kpis(_fact(spark, sf, need=A.NEEDS["kpis"]), MONTHLY_KPIS), MONTHLY_FORMULAS)


@register("A20_per_route_averages", with_routes(f"""
SELECT total_routes, {r2('total_revenue / greatest(total_routes, 1)')} AS revenue_per_route,
       {r2('total_miles / greatest(total_routes, 1)')} AS miles_per_route,
       {r2('total_costs / greatest(total_routes, 1)')} AS costs_per_route,
       {r2('total_profit / greatest(total_routes, 1)')} AS profit_per_route
FROM ({A3_SQL_BODY.format(where='')})"""))
def a20(spark, sf):
    return A.per_route_averages(A.period_summary(_fact(spark, sf, need=A.NEEDS["period_summary"])))


# ---------------------------------------------------------------- A21
@register("A21_table_counts", " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES])
    + " UNION ALL SELECT 'TOTAL', (" + " + ".join(f"(SELECT count(*) FROM {t})" for t in TABLES) + ")")
def a21(spark, sf):
    return A.table_counts({t: table(spark, sf, t) for t in TABLES})


# ---------------------------------------------------------------- A25 / A26 / A27 / A30 / A31 / A33
A25_SQL = f"""
SELECT *, rank() OVER (PARTITION BY month ORDER BY overall_score DESC) AS rank FROM (
SELECT month, name, route_count, {r2('m')} AS total_miles, {r2('r')} AS revenue, {r2('coalesce(e, 0.0)')} AS efficiency,
       {r2('coalesce(v, 0.0)')} AS avg_speed, safety_score,
       {r2('coalesce((coalesce(e, 0.0) + safety_score) / 2, e, 0.0)')} AS overall_score
FROM (SELECT cast(date_trunc('month', route_date) AS DATE) AS month,
             coalesce(driver_name, 'Unknown') AS name, count(*) AS route_count, max(driver_safety) AS safety_score,
             {fsum(nz('total_miles'))} AS m, {fsum(nz('revenue'))} AS r,
             {fsum("CASE WHEN efficiency_score <> 0 THEN efficiency_score END")}
               / count(CASE WHEN efficiency_score <> 0 THEN 1 END) AS e,
             {fsum("CASE WHEN average_speed <> 0 THEN average_speed END")}
               / count(CASE WHEN average_speed <> 0 THEN 1 END) AS v
      FROM route_metrics GROUP BY 1, 2))"""


@register("A25_monthly_driver_ranking", with_routes(A25_SQL))
def a25(spark, sf):
    return A.monthly_driver_ranking(_fact(spark, sf, need=A.NEEDS["monthly_driver_ranking"]))


_LEDGER_UNION = " UNION ALL ".join(
    f"SELECT route_key, route_date, '{c}' AS category, {c} AS amount FROM route_metrics"
    for c in A.LEDGER_CATEGORIES)


@register("A31_financial_ledger", with_routes(f"""
SELECT route_key, route_date AS transaction_date,
       CASE WHEN category = 'revenue' THEN 'income' ELSE 'expense' END AS record_type,
       category, {r2('amount')} AS amount
FROM ({_LEDGER_UNION}) WHERE amount IS NOT NULL AND amount <> 0"""))
def a31(spark, sf):
    return A.financial_ledger(_fact(spark, sf, need=A.NEEDS["financial_ledger"]))


@register("A26_financial_analysis", with_routes(f"""
, g AS (SELECT category, cast(date_trunc('month', route_date) AS DATE) AS month,
              {fsum(nz('amount'))} AS cur FROM ({_LEDGER_UNION}) GROUP BY 1, 2),
w AS (SELECT *, lag(cur) OVER (PARTITION BY category ORDER BY month) AS prev,
             sum(cast(round_even(cur * 10000, 0) AS BIGINT)) OVER (
               PARTITION BY category, year(month) ORDER BY month
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / cast(10000 AS DOUBLE) AS ytd
      FROM g)
SELECT category, month, {r2('cur')} AS current_amount, {r2('prev')} AS previous_amount,
       {r2('cur - prev')} AS change, {r2('(cur - prev) / nullif(prev, 0) * 100')} AS pct_change,
       {r2('ytd')} AS year_to_date FROM w"""))
def a26(spark, sf):
    return A.financial_analysis(_fact(spark, sf, need=A.NEEDS["financial_analysis"]))


@register("A27_month_over_month", with_routes(f"""
, g AS (SELECT cast(date_trunc('month', route_date) AS DATE) AS month, {fsum(nz('revenue'))} AS r,
              count(*) AS routes, {fsum('efficiency_score')} / count(efficiency_score) AS e
       FROM route_metrics GROUP BY 1),
w AS (SELECT *, lag(r) OVER (ORDER BY month) AS pr, lag(routes) OVER (ORDER BY month) AS pn,
             lag(e) OVER (ORDER BY month) AS pe FROM g)
SELECT month, {r2('r')} AS revenue, routes, {r2('e')} AS avg_efficiency,
       {r2('(r - pr) / nullif(pr, 0) * 100')} AS revenue_growth,
       {r2('(routes - pn) / nullif(pn, 0) * 100')} AS routes_growth,
       {r2('(e - pe) / nullif(pe, 0) * 100')} AS efficiency_growth FROM w"""))
def a27(spark, sf):
    return A.month_over_month(_fact(spark, sf, need=A.NEEDS["month_over_month"]))


_TARGETS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS metric, {v} AS target"
                                  for k, v in A.OPERATIONAL_TARGETS.items())


@register("A30_operational_vs_target", with_routes(f"""
, g AS (SELECT cast(date_trunc('month', route_date) AS DATE) AS month,
        {r2('count(*) FILTER (WHERE coalesce(efficiency_score, 0) >= 80) / count(*) * 100')} AS on_time_percentage,
        {r2('coalesce(' + fsum('efficiency_score') + ' / count(efficiency_score), 0.0)')} AS average_efficiency,
        {r2('coalesce(' + fsum('deadhead_percentage') + ' / count(deadhead_percentage), 0.0)')} AS deadhead_percentage,
        {r2('coalesce(' + fsum('average_speed') + ' / count(average_speed), 0.0)')} AS average_speed
       FROM route_metrics GROUP BY 1),
l AS (SELECT month, 'on_time_percentage' AS metric, on_time_percentage AS actual FROM g
      UNION ALL SELECT month, 'average_efficiency', average_efficiency FROM g
      UNION ALL SELECT month, 'deadhead_percentage', deadhead_percentage FROM g
      UNION ALL SELECT month, 'average_speed', average_speed FROM g),
t AS ({_TARGETS_SQL}),
w AS (SELECT l.*, t.target, lag(actual) OVER (PARTITION BY l.metric ORDER BY month) AS prev
      FROM l LEFT JOIN t ON l.metric = t.metric)
SELECT month, metric, actual, cast(target AS DOUBLE) AS target, {r2('actual - target')} AS variance,
       {r2('actual / nullif(target, 0) * 100')} AS pct_of_target,
       CASE WHEN prev IS NULL THEN 'flat' WHEN actual > prev THEN 'up' WHEN actual < prev THEN 'down'
            ELSE 'flat' END AS trend FROM w"""))
def a30(spark, sf):
    targets = spark.createDataFrame([(k, float(v)) for k, v in A.OPERATIONAL_TARGETS.items()],
                                    "metric string, target double")
    return A.operational_vs_target(_fact(spark, sf, need=A.NEEDS["operational_vs_target"]), targets)


@register("A33_weekly_driver_table", with_routes(f"""
SELECT driver_id, driver_name, routes, {r2('m')} AS miles, {r2('r')} AS revenue,
       {r2('coalesce(v, 0.0)')} AS avg_speed, {r2('coalesce(e, 0.0)')} AS efficiency,
       {r2('ot / routes * 100')} AS on_time_percentage, safety_score
FROM (SELECT driver_id, driver_name, count(*) AS routes, {fsum(nz('total_miles'))} AS m,
             {fsum(nz('revenue'))} AS r,
             {fsum("CASE WHEN average_speed <> 0 THEN average_speed END")}
               / count(CASE WHEN average_speed <> 0 THEN 1 END) AS v,
             {fsum("CASE WHEN efficiency_score <> 0 THEN efficiency_score END")}
               / count(CASE WHEN efficiency_score <> 0 THEN 1 END) AS e,
             count(*) FILTER (WHERE coalesce(efficiency_score, 0) >= 80) AS ot,
             max(driver_safety) AS safety_score
      FROM route_metrics {_where(WEEK)} GROUP BY 1, 2)"""))
def a33(spark, sf):
    return A.weekly_driver_table(_fact(spark, sf, WEEK, need=A.NEEDS["weekly_driver_table"]))


# ---------------------------------------------------------------- R4-R8 bundles
def _body(name: str) -> str:
    """A registered oracle without the views in front of it, as one query."""
    text = ORACLE[name].removeprefix(with_routes("")).strip()
    return "WITH " + text[1:] if text.startswith(",") else text


def _long_sql(section: str, query: str, keys: list[str], metrics: list[str], where: str) -> str:
    body = query.replace("FROM route_metrics", f"FROM (SELECT * FROM route_metrics {where})")
    key = f"concat_ws('|', {', '.join(f'cast({k} AS VARCHAR)' for k in keys)})" if keys else "''"
    names = ", ".join(f"'{m}'" for m in metrics)
    values = ", ".join(f"cast({m} AS DOUBLE)" for m in metrics)
    return f"SELECT '{section}' AS section, {key} AS key, unnest([{names}]) AS metric, unnest([{values}]) AS value FROM ({body})"


_ROUTES_SECTION = (f"SELECT route_key, {r2(nz('total_miles'))} AS total_miles, {r2(nz('revenue'))} AS revenue, "
                   f"{r2(nz('total_costs'))} AS total_costs FROM route_metrics")


def _bundle_sql(sections, period) -> str:
    where = _where(period) if period else ""
    trend = "CASE trend WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END"
    operational = _body("A30_operational_vs_target")
    made = {
        "summary": (A3_SQL_BODY.format(where=""), [], ["total_routes", "total_miles", "total_revenue", "total_costs",
                    "average_miles_per_route", "average_revenue_per_route", "total_profit", "profit_margin"]),
        "drivers": (A4_SQL_BODY.format(extra="", where=""), ["name"], ["route_count", "total_miles", "revenue", "efficiency", "avg_speed"]),
        "vehicles": (_body("A6_vehicle_metrics"), ["vehicle_info"], ["route_count", "total_miles", "fuel_used", "maintenance_cost", "mpg",
                     "cost_per_mile"]),
        "customers": (_body("A8_customer_metrics"), ["customer_name"], ["route_count", "revenue", "total_miles", "avg_revenue_per_route",
                      "revenue_per_mile"]),
        "routes": (_ROUTES_SECTION, ["route_key"], ["total_miles", "revenue", "total_costs"]),
        "daily": (A10_SQL, ["route_date"], ["routes", "miles", "revenue", "costs", "profit"]),
        "overview": (_body("A32_weekly_overview"), ["row_kind", "route_date"], ["routes", "miles", "revenue", "costs", "profit",
                     "profit_margin", "avg_mpg"]),
        "driver_rankings": (A25_SQL, ["month", "name"], ["route_count", "total_miles", "revenue", "efficiency", "avg_speed", "safety_score",
                            "overall_score", "rank"]),
        "financial_analysis": (_body("A26_financial_analysis"), ["category", "month"], ["current_amount", "previous_amount", "change",
                               "pct_change", "year_to_date"]),
        "month_over_month": (_body("A27_month_over_month"), ["month"], ["revenue", "routes", "avg_efficiency", "revenue_growth",
                             "routes_growth", "efficiency_growth"]),
        "customer_profitability": (_body("A28_customer_profitability"), ["customer_name"], ["route_count", "revenue", "costs", "profit",
                                   "margin", "revenue_per_route", "lifetime_value"]),
        "vehicle_performance": (_body("A29_vehicle_performance"), ["vehicle_id"], ["route_count", "total_miles", "fuel_used", "mpg",
                                "utilization", "maintenance_cost", "cost_per_mile"]),
        "operational": (f"SELECT * REPLACE ({trend} AS trend) FROM ({operational})", ["month", "metric"], ["actual", "target", "variance",
                        "pct_of_target", "trend"]),
    }
    status = ("SELECT CASE WHEN count(*) > 0 THEN 'success' ELSE 'no_data' END AS status, count(*) AS routes_count, "
              f"coalesce({r2(fsum(nz('revenue')))}, 0) AS total_revenue, coalesce({r2(fsum(nz('total_miles')))}, 0) AS total_miles "
              "FROM route_metrics")
    parts = [_long_sql("status", status, ["status"], ["routes_count", "total_revenue", "total_miles"], where)]
    parts += [_long_sql(s, *made[s], where) for s in sections]
    return with_routes("\nUNION ALL ".join(parts))


def _bundle(spark, sf, sections, period):
    targets = spark.createDataFrame([(k, float(v)) for k, v in A.OPERATIONAL_TARGETS.items()], "metric string, target double")
    return B.report_bundle(_fact(spark, sf, period, need=B.NEED), sections, targets)


@register("R4_daily_report", _bundle_sql(B.DAILY, DAY))
def r4(spark, sf):
    """A day's summary, drivers, vehicles, customers and routes."""
    return _bundle(spark, sf, B.DAILY, DAY)


@register("R5_weekly_report", _bundle_sql(B.WEEKLY, WEEK))
def r5(spark, sf):
    return _bundle(spark, sf, B.WEEKLY, WEEK)


@register("R6_monthly_report", _bundle_sql(B.MONTHLY, MONTH))
def r6(spark, sf):
    return _bundle(spark, sf, B.MONTHLY, MONTH)


@register("R7_custom_period_report", _bundle_sql(B.CUSTOM, YEAR))
def r7(spark, sf):
    return _bundle(spark, sf, B.CUSTOM, YEAR)


@register("R7_whole_period_report", _bundle_sql(B.MONTHLY, None))
def r7_all(spark, sf):
    """All sections over the whole fact."""
    return _bundle(spark, sf, B.MONTHLY, None)


@register("R8_empty_period", with_routes(A3_SQL_BODY.format(where=_where(EMPTY))))
def r8(spark, sf):
    return A.period_summary(_fact(spark, sf, EMPTY, need=A.NEEDS["period_summary"]))


def flagship(spark, sf):
    """entry(): the monthly summary row of the report bundle."""
    return A.period_summary(_fact(spark, sf, MONTH, need=A.NEEDS["period_summary"]))
