"""Report aggregations (A1-A34) over the report fact.

All sums are exact (``fixed_sum``) so partial aggregates can be combined in
any order across executors; every aggregate is algebraic, so Spark plans a
partial (map-side) HashAggregate before the shuffle and a hot key -- an
'Unknown' driver holding a third of the rows -- reaches the reducer as one
row per map task.  Rankings and period-over-period windows run only after
aggregation, on (entity x period) rows, never on the fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import count_if, div, fixed_avg, fixed_sum, nz, round2, truthy
from .rows import keep_rows
from .window import rank_by, written

UNKNOWN = "Unknown"
DEFAULT_CAPACITY = 40000.0

_DRV = ["driver_name", "total_miles", "revenue", "efficiency_score", "average_speed"]
_LEDGER = ["route_key", "route_date", "revenue", "fuel_cost", "toll_cost", "driver_pay", "other_costs"]
# Fact columns each aggregation reads (report_fact(need=...) joins only the
# dimensions behind them).
NEEDS = {
    "driver_performance": _DRV + ["total_costs"],
    "driver_metrics": _DRV, "driver_rating": _DRV, "monthly_driver_ranking": _DRV + ["route_date", "driver_safety"],
    "vehicle_utilization": ["vehicle_id", "total_miles", "load_weight", "fuel_consumed", "vehicle_capacity"],
    "vehicle_metrics": ["vehicle_info", "total_miles", "fuel_consumed", "maintenance_cost"],
    "vehicle_load": ["vehicle_id", "total_miles", "fuel_consumed", "load_weight", "vehicle_capacity"],
    "vehicle_performance": ["vehicle_id", "total_miles", "fuel_consumed", "load_weight", "vehicle_capacity",
                            "maintenance_cost", "total_costs"],
    "period_summary": ["total_miles", "revenue", "total_costs"],
    "customer_metrics": ["customer_name", "revenue", "total_miles"],
    "customer_profitability": ["customer_name", "revenue", "total_costs"],
    "weekly_customer_table": ["customer_id", "customer_name", "revenue", "total_miles", "total_costs",
                              "customer_rating"],
    "financial_summary": ["revenue", "fuel_cost", "driver_pay", "other_costs", "toll_cost", "total_miles"],
    "daily_rollup": ["route_date", "total_miles", "revenue", "fuel_cost", "driver_pay", "other_costs"],
    "revenue_trend": ["route_date", "revenue"],
    "monthly_comparison": ["route_date", "revenue", "total_costs"],
    "weekly_overview": ["route_date", "total_miles", "revenue", "total_costs", "fuel_efficiency"],
    "cost_breakdown_categories": ["fuel_cost", "toll_cost", "driver_pay", "total_miles", "other_costs"],
    "status_distribution": ["status"],
    "driver_totals": ["driver_name", "revenue", "total_miles"],
    "vehicle_mpg": ["vehicle_info", "total_miles", "fuel_consumed"],
    "revenue_efficiency_trend": ["route_key", "efficiency_score", "revenue"],
    "kpis": ["revenue", "total_miles", "total_costs", "efficiency_score", "average_speed", "route_date"],
    "financial_ledger": _LEDGER, "financial_analysis": _LEDGER,
    "month_over_month": ["route_date", "revenue", "efficiency_score"],
    "operational_vs_target": ["route_date", "efficiency_score", "deadhead_percentage", "average_speed"],
    "weekly_driver_table": ["driver_id", "driver_name", "total_miles", "revenue", "average_speed",
                            "efficiency_score", "driver_safety"],
}


def _s(x) -> Column:
    return fixed_sum(nz(x))


def _ratio(a: Column, b: Column) -> Column:
    """a / b when b > 0 else 0 (the reference's guarded division)."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def month_of(d) -> Column:
    return F.trunc(F.col(d) if isinstance(d, str) else d, "month")


# --- A1 / A4 / A5: drivers ---------------------------------------------------

def driver_performance(fact: DataFrame) -> DataFrame:
    """A1: totals, mean efficiency and speed (NULL as 0), on-time share."""
    g = fact.groupBy(F.col("driver_name")).agg(
        F.count(F.lit(1)).alias("total_routes"),
        _s("total_miles").alias("m"), _s("revenue").alias("r"), _s("total_costs").alias("c"),
        fixed_sum(nz("efficiency_score")).alias("e"), fixed_sum(nz("average_speed")).alias("v"),
        count_if(nz("efficiency_score") >= 80).alias("ot"))
    n = F.col("total_routes")
    return g.select(
        "driver_name", "total_routes",
        round2("m").alias("total_miles"), round2("r").alias("total_revenue"),
        round2("c").alias("total_costs"),
        round2(F.col("e") / n).alias("average_efficiency"),
        round2(F.col("v") / n).alias("average_speed"),
        round2(F.col("ot") / n * 100).alias("on_time_percentage"),
        round2(_ratio(F.col("r"), F.col("m"))).alias("revenue_per_mile"),
        round2(_ratio(F.col("c"), F.col("m"))).alias("cost_per_mile"),
        F.when(F.col("r") > 0, round2((F.col("r") - F.col("c")) / F.col("r") * 100))
         .otherwise(F.lit(0.0)).alias("profit_margin"))


def _driver_base(fact: DataFrame, keys: list, *more: Column) -> DataFrame:
    return fact.groupBy(*keys).agg(
        *more,
        F.count(F.lit(1)).alias("route_count"),
        _s("total_miles").alias("m"), _s("revenue").alias("r"),
        fixed_avg(F.when(truthy("efficiency_score"), F.col("efficiency_score"))).alias("e"),
        fixed_avg(F.when(truthy("average_speed"), F.col("average_speed"))).alias("v"))


def driver_metrics(fact: DataFrame) -> DataFrame:
    """A4: per driver name; means over non-zero scores and speeds only."""
    f = fact.withColumn("name", F.coalesce("driver_name", F.lit(UNKNOWN)))
    return driver_metrics_of(_driver_base(f, ["name"]))


def driver_metrics_of(g: DataFrame) -> DataFrame:
    """A4 from its sums ``name, route_count, m, r, e, v``."""
    return g.select(
        "name", "route_count", round2("m").alias("total_miles"), round2("r").alias("revenue"),
        round2(F.coalesce("e", F.lit(0.0))).alias("efficiency"),
        round2(F.coalesce("v", F.lit(0.0))).alias("avg_speed"))


def driver_rating(fact: DataFrame) -> DataFrame:
    """A5: A4 plus rating = (efficiency + speed / 10) / 2."""
    f = fact.withColumn("name", F.coalesce("driver_name", F.lit(UNKNOWN)))
    e, v = F.coalesce("e", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    return _driver_base(f, ["name"]).select(
        "name", "route_count", round2("m").alias("total_miles"), round2("r").alias("revenue"),
        round2(e).alias("efficiency"), round2(v).alias("avg_speed"),
        round2((e + v / 10) / 2).alias("rating"))


# --- A2 / A6 / A7 / A29: vehicles -----------------------------------------------

def vehicle_utilization(fact: DataFrame) -> DataFrame:
    """A2: load over capacity x routes, miles over fuel, per vehicle id."""
    g = fact.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("total_routes"), _s("total_miles").alias("m"),
        _s("load_weight").alias("w"), _s("fuel_consumed").alias("f"),
        F.coalesce(F.max("vehicle_capacity"), F.lit(DEFAULT_CAPACITY)).alias("cap"))
    return g.select(
        "vehicle_id", "total_routes", round2("m").alias("total_miles"),
        round2(_ratio(F.col("w"), F.col("cap") * F.col("total_routes")) * 100).alias("utilization_percentage"),
        round2(F.when(F.col("f") != 0, F.col("m") / F.col("f")).otherwise(F.lit(0.0))).alias("average_mpg"),
        round2("f").alias("total_fuel_consumed"))


def vehicle_metrics(fact: DataFrame) -> DataFrame:
    """Per vehicle description: miles, fuel, maintenance, mpg, cost per mile."""
    g = fact.withColumn("vehicle", F.coalesce("vehicle_info", F.lit(UNKNOWN))).groupBy("vehicle").agg(
        F.count(F.lit(1)).alias("route_count"), _s("total_miles").alias("m"),
        _s("fuel_consumed").alias("f"), _s("maintenance_cost").alias("mc"))
    return vehicle_metrics_of(g)


def vehicle_metrics_of(g: DataFrame) -> DataFrame:
    """A6 from its sums ``vehicle, route_count, m, f, mc``."""
    return g.select(
        F.col("vehicle").alias("vehicle_info"), "route_count", round2("m").alias("total_miles"),
        round2("f").alias("fuel_used"), round2("mc").alias("maintenance_cost"),
        round2(_ratio(F.col("m"), F.col("f"))).alias("mpg"),
        round2(_ratio(F.col("mc"), F.col("m"))).alias("cost_per_mile"))


def vehicle_load(fact: DataFrame) -> DataFrame:
    """Load utilisation with a default capacity of 40000 per route."""
    g = fact.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("route_count"), _s("total_miles").alias("m"),
        _s("fuel_consumed").alias("f"), _s("load_weight").alias("w"),
        fixed_sum(F.coalesce("vehicle_capacity", F.lit(DEFAULT_CAPACITY))).alias("cap"))
    return g.select(
        "vehicle_id", "route_count", round2("m").alias("total_miles"), round2("f").alias("fuel_used"),
        round2(_ratio(F.col("m"), F.col("f"))).alias("mpg"),
        round2(_ratio(F.col("w"), F.col("cap")) * 100).alias("utilization"))


def vehicle_performance(fact: DataFrame) -> DataFrame:
    """Miles, fuel, mpg, utilisation, maintenance, cost per mile."""
    g = fact.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("route_count"), _s("total_miles").alias("m"),
        _s("fuel_consumed").alias("f"), _s("load_weight").alias("w"),
        fixed_sum(F.coalesce("vehicle_capacity", F.lit(DEFAULT_CAPACITY))).alias("cap"),
        _s("maintenance_cost").alias("mc"), _s("total_costs").alias("tc"))
    return vehicle_performance_of(g)


def vehicle_performance_of(g: DataFrame) -> DataFrame:
    """A29 from its sums ``vehicle_id, route_count, m, f, w, cap, mc, tc``."""
    return g.select(
        "vehicle_id", "route_count", round2("m").alias("total_miles"), round2("f").alias("fuel_used"),
        round2(_ratio(F.col("m"), F.col("f"))).alias("mpg"),
        round2(_ratio(F.col("w"), F.col("cap")) * 100).alias("utilization"),
        round2("mc").alias("maintenance_cost"),
        round2(_ratio(F.col("tc"), F.col("m"))).alias("cost_per_mile"))


# --- A3 / A9 / A20: period summaries --------------------------------------------

def period_summary(fact: DataFrame) -> DataFrame:
    """A3 (+R8): one row; ``status`` is 'no_data' for an empty period."""
    g = fact.agg(F.count(F.lit(1)).alias("total_routes"), _s("total_miles").alias("m"),
                 _s("revenue").alias("r"), _s("total_costs").alias("c"))
    return period_summary_of(g)


def period_summary_of(g: DataFrame) -> DataFrame:
    """A3 from its sums ``total_routes, m, r, c``."""
    n = F.col("total_routes")
    return g.select(
        F.when(n == 0, F.lit("no_data")).otherwise(F.lit("ok")).alias("status"),
        "total_routes", round2("m").alias("total_miles"), round2("r").alias("total_revenue"),
        round2("c").alias("total_costs"),
        round2(_ratio(F.col("m"), n)).alias("average_miles_per_route"),
        round2(_ratio(F.col("r"), n)).alias("average_revenue_per_route"),
        round2(F.col("r") - F.col("c")).alias("total_profit"),
        round2(_ratio(F.col("r") - F.col("c"), F.col("r")) * 100).alias("profit_margin"))


def financial_summary(fact: DataFrame) -> DataFrame:
    """Stored costs; tolls are not in total_costs (kept for parity),
    ``total_costs_with_tolls`` is the toll-inclusive figure."""
    g = fact.agg(_s("revenue").alias("r"), _s("fuel_cost").alias("f"), _s("driver_pay").alias("p"),
                 _s("other_costs").alias("o"), _s("toll_cost").alias("t"), _s("total_miles").alias("m"))
    tc = F.col("f") + F.col("p") + F.col("o")
    return g.select(
        round2("r").alias("total_revenue"), round2("f").alias("fuel_costs"),
        round2("p").alias("driver_pay"), round2("o").alias("other_costs"),
        round2("m").alias("total_miles"), round2(tc).alias("total_costs"),
        round2(F.col("r") - tc).alias("gross_profit"),
        round2(_ratio(F.col("r") - tc, F.col("r")) * 100).alias("profit_margin"),
        round2(_ratio(F.col("r"), F.col("m"))).alias("revenue_per_mile"),
        round2(_ratio(tc, F.col("m"))).alias("cost_per_mile"),
        round2(tc + F.col("t")).alias("total_costs_with_tolls"))


def per_route_averages(summary: DataFrame) -> DataFrame:
    """Averages per route from an A3 summary row (divisor at least 1)."""
    n = F.greatest(F.col("total_routes"), F.lit(1))
    return summary.select(
        "total_routes",
        round2(F.col("total_revenue") / n).alias("revenue_per_route"),
        round2(F.col("total_miles") / n).alias("miles_per_route"),
        round2(F.col("total_costs") / n).alias("costs_per_route"),
        round2(F.col("total_profit") / n).alias("profit_per_route"))


# --- A8 / A28 / A34: customers ------------------------------------------------

def customer_metrics(fact: DataFrame) -> DataFrame:
    """A8."""
    g = fact.withColumn("c", F.coalesce("customer_name", F.lit(UNKNOWN))).groupBy("c").agg(
        F.count(F.lit(1)).alias("route_count"), _s("revenue").alias("r"), _s("total_miles").alias("m"))
    return customer_metrics_of(g)


def customer_metrics_of(g: DataFrame) -> DataFrame:
    """A8 from its sums ``c, route_count, r, m``."""
    return g.select(
        F.col("c").alias("customer_name"), "route_count", round2("r").alias("revenue"),
        round2("m").alias("total_miles"),
        round2(_ratio(F.col("r"), F.col("route_count"))).alias("avg_revenue_per_route"),
        round2(_ratio(F.col("r"), F.col("m"))).alias("revenue_per_mile"))


def customer_profitability(fact: DataFrame) -> DataFrame:
    """Lifetime value = total profit of the customer up to the fact's end."""
    g = fact.withColumn("c", F.coalesce("customer_name", F.lit(UNKNOWN))).groupBy("c").agg(
        F.count(F.lit(1)).alias("route_count"), _s("revenue").alias("r"), _s("total_costs").alias("tc"))
    return customer_profitability_of(g)


def customer_profitability_of(g: DataFrame) -> DataFrame:
    """A28 from its sums ``c, route_count, r, tc``."""
    p = F.col("r") - F.col("tc")
    return g.select(
        F.col("c").alias("customer_name"), "route_count", round2("r").alias("revenue"),
        round2("tc").alias("costs"), round2(p).alias("profit"),
        round2(_ratio(p, F.col("r")) * 100).alias("margin"),
        round2(_ratio(F.col("r"), F.col("route_count"))).alias("revenue_per_route"),
        round2(p).alias("lifetime_value"))


# --- A10 / A11 / A16 / A32: time rollups ---------------------------------------

def daily_rollup(fact: DataFrame) -> DataFrame:
    """A10: costs = fuel + pay + other (stored, no tolls), profit per date."""
    g = fact.groupBy("route_date").agg(
        F.count(F.lit(1)).alias("routes"), _s("total_miles").alias("m"), _s("revenue").alias("r"),
        fixed_sum(nz("fuel_cost") + nz("driver_pay") + nz("other_costs")).alias("c"))
    return daily_rollup_of(g)


def daily_rollup_of(g: DataFrame) -> DataFrame:
    """A10 from its sums ``route_date, routes, m, r, c``."""
    return g.select("route_date", "routes", round2("m").alias("miles"), round2("r").alias("revenue"),
                    round2("c").alias("costs"), round2(F.col("r") - F.col("c")).alias("profit"))


def revenue_trend(fact: DataFrame) -> DataFrame:
    """A11."""
    return fact.groupBy("route_date").agg(round2(_s("revenue")).alias("revenue"))


def monthly_comparison(fact: DataFrame) -> DataFrame:
    """Revenue, costs (M14 totals), profit per calendar month."""
    g = fact.groupBy(month_of("route_date").alias("month")).agg(
        _s("revenue").alias("r"), _s("total_costs").alias("c"))
    return g.select("month", round2("r").alias("revenue"), round2("c").alias("costs"),
                    round2(F.col("r") - F.col("c")).alias("profit"))


def weekly_overview(fact: DataFrame) -> DataFrame:
    """Per day with profit margin and mean mpg, plus a TOTAL row (A17), both
    from one pass over the fact (grouping sets)."""
    g = fact.groupingSets([["route_date"], []], "route_date").agg(
        F.grouping("route_date").alias("g"), F.count(F.lit(1)).alias("routes"), _s("total_miles").alias("m"),
        _s("revenue").alias("r"), _s("total_costs").alias("c"), fixed_avg(F.col("fuel_efficiency")).alias("mpg"))
    return weekly_overview_of(g)


def weekly_overview_of(g: DataFrame) -> DataFrame:
    """A32 from its sums ``g (1 for the total), route_date, routes, m, r, c, mpg``."""
    return g.select(
        F.when(F.col("g") == 1, "total").otherwise("detail").alias("row_kind"), "route_date", "routes",
        round2("m").alias("miles"), round2("r").alias("revenue"), round2("c").alias("costs"),
        round2(F.col("r") - F.col("c")).alias("profit"),
        round2(_ratio(F.col("r") - F.col("c"), F.col("r")) * 100).alias("profit_margin"),
        round2("mpg").alias("avg_mpg"))


# --- A12 / A13 / A14 / A15: chart inputs ---------------------------------------

COST_CATEGORIES = ("fuel", "tolls", "driver_pay", "maintenance", "insurance", "other")


def cost_breakdown_categories(fact: DataFrame) -> DataFrame:
    """Category totals (maintenance and insurance estimated per mile),
    zero categories dropped, share of the total in percent."""
    g = fact.agg(_s("fuel_cost").alias("fuel"), _s("toll_cost").alias("tolls"),
                 _s("driver_pay").alias("driver_pay"),
                 fixed_sum(nz("total_miles") * 0.08).alias("maintenance"),
                 fixed_sum(nz("total_miles") * 0.05).alias("insurance"),
                 _s("other_costs").alias("other"))
    long = g.unpivot([], list(COST_CATEGORIES), "category", "amount").filter(F.col("amount") > 0)
    total = g.select(sum((F.col(x) * F.lit(1.0) for x in COST_CATEGORIES), F.lit(0.0)).alias("t"))
    t = total.scalar()
    return long.select("category", round2("amount").alias("amount"),
                       round2(F.col("amount") / t * 100).alias("share_pct"))


def status_distribution(fact: DataFrame) -> DataFrame:
    """A13."""
    return fact.groupBy("status").agg(F.count(F.lit(1)).alias("route_count"))


def driver_totals(fact: DataFrame) -> DataFrame:
    """A14 (drivers): revenue and miles per driver."""
    return fact.groupBy("driver_name").agg(round2(_s("revenue")).alias("revenue"),
                                           round2(_s("total_miles")).alias("miles"))


def vehicle_mpg(fact: DataFrame) -> DataFrame:
    """A14 (vehicles): Σ miles / Σ fuel per vehicle description."""
    g = fact.groupBy("vehicle_info").agg(_s("total_miles").alias("m"), _s("fuel_consumed").alias("f"))
    return g.select("vehicle_info", round2(_ratio(F.col("m"), F.col("f"))).alias("mpg"))


def revenue_efficiency_trend(fact: DataFrame) -> DataFrame:
    """Least-squares line of revenue on efficiency score and the fitted
    value of every route.  The line is a scalar subquery (one aggregate job,
    inlined as a literal) -- no join back to the fact."""
    pts = keep_rows(fact, F.col("efficiency_score").isNotNull() & F.col("revenue").isNotNull())
    line = pts.agg(F.struct(F.regr_slope("revenue", "efficiency_score").alias("slope"),
                            F.regr_intercept("revenue", "efficiency_score").alias("intercept")).alias("l"))
    fit = line.select("l").scalar()
    slope, icpt = fit["slope"], fit["intercept"]
    return pts.select("route_key", F.col("efficiency_score"),
                      F.round(slope, 6).alias("slope"), F.round(icpt, 4).alias("intercept"),
                      round2(slope * F.col("efficiency_score") + icpt).alias("fitted_revenue"))


# --- A17 / A18 / A19: template aggregates -------------------------------------

def with_summary_rows(detail: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Detail rows (one for each ``key``) plus SUM and AVERAGE rows of
    ``columns``, from one pass (grouping sets)."""
    g = detail.groupingSets([[key], []], key).agg(
        F.grouping(key).alias("_g"), *[F.any_value(c).alias(f"_d_{c}") for c in columns],
        *[fixed_sum(F.col(c)).alias(f"_s_{c}") for c in columns], *[F.count(c).alias(f"_n_{c}") for c in columns])

    def row(kind: str, value) -> Column:
        return F.struct(F.lit(kind).alias("row_kind"), *[value(c).alias(c) for c in columns])

    total = F.array(row("SUM", lambda c: round2(f"_s_{c}")), row("AVERAGE", lambda c: round2(div(F.col(f"_s_{c}"), F.col(f"_n_{c}")))))
    kinds = F.when(F.col("_g") == 1, total).otherwise(F.array(row("detail", lambda c: F.col(f"_d_{c}"))))
    return g.select(key, F.inline(kinds)).select("row_kind", key, *columns)


def kpis(fact: DataFrame, spec: list[dict]) -> DataFrame:
    """Metric spec ``{name, type: count|sum|average|direct, field}`` -> one row.

    ``direct`` takes the first value of a column that is constant over the fact
    (e.g. the report date); count counts non-NULL values of ``field`` or rows.
    """
    exprs = []
    for m in spec:
        t, f = m["type"], m.get("field")
        if t == "count":
            e = F.count(F.col(f) if f else F.lit(1))
        elif t == "sum":
            e = round2(fixed_sum(nz(f)))
        elif t == "average":
            e = round2(F.coalesce(fixed_avg(F.col(f)), F.lit(0.0)))
        elif t == "direct":
            e = F.min(F.col(f))
        else:
            raise ValueError(f"unknown metric type {t}")
        exprs.append(e.alias(m["name"]))
    return fact.agg(*exprs)


def formula_kpis(kpi_row: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Calculated KPIs, each a Spark SQL expression over the A18 row.

    Formulas divide with ``try_divide`` so a zero denominator yields NULL
    (the template's intent) instead of raising under ANSI mode.
    """
    return kpi_row.withColumns({n: round2(F.expr(t)) for n, t in formulas.items()})


# --- A21 / A22 / A23 / A24: counts and summaries -------------------------------

def table_counts(named: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table and the total (one union of counts)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    total = out.agg(F.sum("row_count").cast("long").alias("row_count")).select(
        F.lit("TOTAL").alias("table_name"), "row_count")
    return out.unionByName(total)


def error_messages(errors: DataFrame, type_col: str = "error_type", msg_col: str = "message") -> DataFrame:
    """A24, the messages: each message of each type with its count."""
    return errors.groupBy(type_col, msg_col).agg(F.count(F.lit(1)).alias("message_count"))


def error_summary(errors: DataFrame, type_col: str = "error_type",
                  msg_col: str = "message") -> DataFrame:
    """Count, distinct messages and the least message per error type, and the
    most common type (ties: the first by name).  The messages themselves are rows of
    :func:`error_messages`: a type with millions of them is never one list."""
    per_type = written(errors.groupBy(type_col).agg(
        F.count(F.lit(1)).alias("error_count"),
        F.count_distinct(msg_col).alias("distinct_messages"),
        F.min(msg_col).alias("example_message")), "error-types")
    top = per_type.agg(F.min_by(type_col, F.struct(-F.col("error_count"), F.col(type_col)))).scalar()
    return per_type.withColumn("is_most_common", F.col(type_col).eqNullSafe(top))


# --- A25 / A26 / A27 / A30 / A33: monthly & weekly templates ---------------------

def monthly_driver_ranking(fact: DataFrame) -> DataFrame:
    """Per month and driver: routes, miles, revenue, efficiency, safety and
    overall score (mean of efficiency and safety; efficiency alone where no safety
    score is known); rank by overall score within the month (W3)."""
    f = fact.withColumn("month", month_of("route_date")).withColumn(
        "name", F.coalesce("driver_name", F.lit(UNKNOWN)))
    return monthly_driver_ranking_of(_driver_base(f, ["month", "name"], F.max("driver_safety").alias("safety_score")))


def monthly_driver_ranking_of(g: DataFrame) -> DataFrame:
    """A25 from its sums ``month, name, route_count, m, r, e, v, safety_score``."""
    e = F.coalesce("e", F.lit(0.0))
    scored = g.select(
        "month", "name", "route_count", round2("m").alias("total_miles"), round2("r").alias("revenue"),
        round2(e).alias("efficiency"), round2(F.coalesce("v", F.lit(0.0))).alias("avg_speed"), "safety_score",
        round2(F.coalesce((e + F.col("safety_score")) / 2, e)).alias("overall_score"))
    return rank_by(scored, [("overall_score", True)], within=["month"])


LEDGER_CATEGORIES = ("revenue", "fuel_cost", "toll_cost", "driver_pay", "other_costs")


def financial_ledger(fact: DataFrame) -> DataFrame:
    """One row per route and money category; zero and NULL amounts dropped."""
    return (fact.select("route_key", "route_date", *LEDGER_CATEGORIES)
            .unpivot(["route_key", "route_date"], list(LEDGER_CATEGORIES), "category", "amount")
            .filter(F.col("amount").isNotNull() & (F.col("amount") != 0))
            .select("route_key", F.col("route_date").alias("transaction_date"),
                    F.when(F.col("category") == "revenue", F.lit("income"))
                     .otherwise(F.lit("expense")).alias("record_type"),
                    "category", round2("amount").alias("amount")))


def financial_analysis(fact: DataFrame) -> DataFrame:
    """Per money category and month: current, previous month, change,
    % change, year to date (W4 lag, W5 running sum)."""
    long = (fact.select(month_of("route_date").alias("month"), *LEDGER_CATEGORIES)
            .unpivot(["month"], list(LEDGER_CATEGORIES), "category", "amount"))
    g = long.groupBy("category", "month").agg(_s("amount").alias("cur"))
    return financial_analysis_of(g)


def financial_analysis_of(g: DataFrame) -> DataFrame:
    """A26 from the sums ``category, month, cur``."""
    w = Window.partitionBy("category").orderBy("month")
    wy = (Window.partitionBy("category", F.year("month")).orderBy("month")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prev = F.lag("cur").over(w)
    return g.select(
        "category", "month", round2("cur").alias("current_amount"),
        round2(prev).alias("previous_amount"), round2(F.col("cur") - prev).alias("change"),
        round2(div(F.col("cur") - prev, prev) * 100).alias("pct_change"),
        round2(F.sum(F.rint(F.col("cur") * 10000.0).cast("long")).over(wy) / 10000.0)
        .alias("year_to_date"))


def month_over_month(fact: DataFrame) -> DataFrame:
    """Monthly revenue, routes, mean efficiency and their growth in %."""
    g = fact.groupBy(month_of("route_date").alias("month")).agg(
        _s("revenue").alias("r"), F.count(F.lit(1)).alias("routes"),
        fixed_avg(F.col("efficiency_score")).alias("e"))
    return month_over_month_of(g)


def month_over_month_of(g: DataFrame) -> DataFrame:
    """A27 from the sums ``month, r, routes, e``."""
    w = Window.orderBy("month")  # months only: a few hundred rows at any scale
    pr, pn, pe = F.lag("r").over(w), F.lag("routes").over(w), F.lag("e").over(w)
    return g.select(
        "month", round2("r").alias("revenue"), "routes", round2("e").alias("avg_efficiency"),
        round2(div(F.col("r") - pr, pr) * 100).alias("revenue_growth"),
        round2(div(F.col("routes") - pn, pn) * 100).alias("routes_growth"),
        round2(div(F.col("e") - pe, pe) * 100).alias("efficiency_growth"))


# Monthly operational targets.
OPERATIONAL_TARGETS = {
    "on_time_percentage": 95.0,
    "average_efficiency": 85.0,
    "deadhead_percentage": 15.0,
    "average_speed": 50.0,
}


def operational_vs_target(fact: DataFrame, targets: DataFrame) -> DataFrame:
    """Monthly metric rows joined to a target table (metric, target):
    variance, % of target, trend = sign of the change against last month."""
    g = fact.groupBy(month_of("route_date").alias("month")).agg(
        round2(count_if(nz("efficiency_score") >= 80) / F.count(F.lit(1)) * 100).alias("on_time_percentage"),
        round2(F.coalesce(fixed_avg(F.col("efficiency_score")), F.lit(0.0))).alias("average_efficiency"),
        round2(F.coalesce(fixed_avg(F.col("deadhead_percentage")), F.lit(0.0))).alias("deadhead_percentage"),
        round2(F.coalesce(fixed_avg(F.col("average_speed")), F.lit(0.0))).alias("average_speed"))
    return operational_vs_target_of(g, targets)


def operational_vs_target_of(g: DataFrame, targets: DataFrame) -> DataFrame:
    """A30 from the monthly metrics."""
    long = g.unpivot(["month"], list(OPERATIONAL_TARGETS), "metric", "actual")
    w = Window.partitionBy("metric").orderBy("month")
    prev = F.lag("actual").over(w)
    j = long.join(targets, "metric", "left")
    return j.select(
        "month", "metric", "actual", "target",
        round2(F.col("actual") - F.col("target")).alias("variance"),
        round2(div(F.col("actual"), F.col("target")) * 100).alias("pct_of_target"),
        F.when(prev.isNull(), F.lit("flat")).when(F.col("actual") > prev, F.lit("up"))
         .when(F.col("actual") < prev, F.lit("down")).otherwise(F.lit("flat")).alias("trend"))


def weekly_driver_table(fact: DataFrame) -> DataFrame:
    """Routes, miles, revenue, speed, efficiency, on-time %, safety score."""
    g = fact.groupBy("driver_id", "driver_name").agg(
        F.count(F.lit(1)).alias("routes"), _s("total_miles").alias("m"), _s("revenue").alias("r"),
        fixed_avg(F.when(truthy("average_speed"), F.col("average_speed"))).alias("v"),
        fixed_avg(F.when(truthy("efficiency_score"), F.col("efficiency_score"))).alias("e"),
        count_if(nz("efficiency_score") >= 80).alias("ot"), F.max("driver_safety").alias("safety_score"))
    return g.select(
        "driver_id", "driver_name", "routes", round2("m").alias("miles"), round2("r").alias("revenue"),
        round2(F.coalesce("v", F.lit(0.0))).alias("avg_speed"),
        round2(F.coalesce("e", F.lit(0.0))).alias("efficiency"),
        round2(F.col("ot") / F.col("routes") * 100).alias("on_time_percentage"), "safety_score")


def weekly_customer_table(fact: DataFrame) -> DataFrame:
    """Routes, revenue, revenue per route, miles, profit, rating."""
    g = fact.filter(F.col("customer_id").isNotNull()).groupBy("customer_id", "customer_name").agg(
        F.count(F.lit(1)).alias("routes"), _s("revenue").alias("r"), _s("total_miles").alias("m"),
        _s("total_costs").alias("c"), F.max("customer_rating").alias("rating"))
    return g.select(
        "customer_id", "customer_name", "routes", round2("r").alias("revenue"),
        round2(F.col("r") / F.col("routes")).alias("revenue_per_route"), round2("m").alias("miles"),
        round2(F.col("r") - F.col("c")).alias("profit"), "rating")
