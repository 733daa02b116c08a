"""Whole report bundles in long form, from one scan of the fact.

All sections are aggregates of the same period by different keys.  A route gives one
narrow row for each kind of group (its key and the few amounts that its sections read, in
shared slots), so one aggregation with partial sums gives the sums of every section;
they are written once to the shared folder, a row for each driver, vehicle, customer,
day and month.  The sections' formulas, windows and ranks then run on those rows, each
in the form (section, key, metric, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fixed_avg, fixed_sum, nz, round2, truthy
from ..operators import aggregate as A
from ..operators.window import written

KEYS = ("name", "vehicle", "vehicle_id", "cust", "route_date", "month", "route_key")
# Sections of each kind of report.
DAILY = ("summary", "drivers", "vehicles", "customers", "routes")
WEEKLY = ("summary", "drivers", "vehicles", "customers", "daily", "overview")
MONTHLY = (*WEEKLY, "driver_rankings", "financial_analysis", "month_over_month", "customer_profitability",
           "vehicle_performance", "operational")
CUSTOM = ("summary", "drivers", "vehicles", "customers")
# Groups: the keys, and the amounts that their sections read (means first).
GROUPS = {"": ((), ("mean_fuel_efficiency", "m", "r", "c")),
          "name": (("name",), ("e", "v", "m", "r")),
          "vehicle": (("vehicle",), ("f", "m", "mc")),
          "vehicle_id": (("vehicle_id",), ("f", "m", "mc", "w", "cap", "c")),
          "cust": (("cust",), ("m", "r", "c")),
          "route_date": (("route_date",), ("mean_fuel_efficiency", "m", "r", "c", "stored")),
          "month": (("month",), ("mean_efficiency_score", "mean_average_speed", "mean_deadhead_percentage", "r", "on_time")),
          "ledger": (("month",), tuple(f"sum_{c}" for c in A.LEDGER_CATEGORIES)),
          "month+name": (("month", "name"), ("e", "v", "m", "r")),
          "route_key": (("route_key",), ("m", "r", "c"))}
# The group that a section reads; the overview reads the whole period besides.
OF = {"summary": "", "drivers": "name", "vehicles": "vehicle", "customers": "cust", "routes": "route_key",
      "daily": "route_date", "overview": "route_date", "driver_rankings": "month+name", "financial_analysis": "ledger",
      "month_over_month": "month", "customer_profitability": "cust", "vehicle_performance": "vehicle_id", "operational": "month"}
NEED = sorted({c for n in ("driver_performance", "monthly_driver_ranking", "vehicle_performance", "vehicle_metrics", "period_summary",
                           "customer_metrics", "daily_rollup", "weekly_overview", "financial_ledger", "operational_vs_target")
               for c in A.NEEDS[n]})


def bundle_sums(fact: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """The sums of all sections' groups: ``of`` (the group's kind), the key columns, the sums; written."""
    groups = list(dict.fromkeys(["", *(OF[s] for s in sections)]))
    used = [k for k in KEYS if any(k in GROUPS[g][0] for g in groups)]
    unknown = F.lit(A.UNKNOWN)

    def nonzero(c: str) -> Column:
        return F.when(truthy(c), F.col(c))

    means = {"e": nonzero("efficiency_score"), "v": nonzero("average_speed"), **{
        f"mean_{c}": F.col(c) for c in ("efficiency_score", "average_speed", "deadhead_percentage", "fuel_efficiency")}}
    sums = {"m": nz("total_miles"), "r": nz("revenue"), "c": nz("total_costs"), "f": nz("fuel_consumed"), "mc": nz("maintenance_cost"),
            "w": nz("load_weight"), "cap": F.coalesce("vehicle_capacity", F.lit(A.DEFAULT_CAPACITY)),
            "stored": nz("fuel_cost") + nz("driver_pay") + nz("other_costs"),
            "on_time": F.when(nz("efficiency_score") >= 80, 1.0).otherwise(0.0), **{f"sum_{c}": nz(c) for c in A.LEDGER_CATEGORIES}}
    f = fact.select(
        F.coalesce("driver_name", unknown).alias("name"), F.coalesce("vehicle_info", unknown).alias("vehicle"),
        F.coalesce("customer_name", unknown).alias("cust"), A.month_of("route_date").alias("month"), "route_date", "vehicle_id",
        "route_key", "driver_safety", *[v.cast("double").alias(f"_{k}") for k, v in {**means, **sums}.items()])
    # one column for all keys of a type, one slot for each amount of a group
    places = {"word": ("name", "vehicle", "cust", "route_key"), "day": ("route_date", "month"), "number": ("vehicle_id",)}
    types = {"word": "string", "day": "date", "number": "bigint"}
    slots = range(max(len(GROUPS[g][1]) for g in groups))
    counted = range(max(sum(a in means for a in GROUPS[g][1]) for g in groups))

    def row(i: int, g: str) -> Column:
        keys, amounts = GROUPS[g]
        at = {p: next((F.col(k) for k in keys if k in names), F.lit(None)).cast(types[p]).alias(p) for p, names in places.items()}
        safety = F.col("driver_safety") if g == "month+name" else F.lit(None)
        return F.struct(F.lit(i).alias("g"), *at.values(), safety.cast("double").alias("safety"), *[
            (F.col(f"_{amounts[k]}") if k < len(amounts) else F.lit(None).cast("double")).alias(f"s{k}") for k in slots])

    rows = f.select(F.inline(F.array(*[row(i, g) for i, g in enumerate(groups)])))
    total = rows.groupBy("g", *places).agg(
        F.count(F.lit(1)).alias("n"), F.max("safety").alias("safety_score"), *[fixed_sum(f"s{k}").alias(f"s{k}") for k in slots],
        *[fixed_avg(f"s{k}").alias(f"a{k}") for k in counted])

    def picked(found: dict) -> Column:
        """The column of each kind of group that has it, else null."""
        return F.coalesce(*[F.when(F.col("g") == i, F.col(c)) for i, c in found.items()])

    out = {k: picked({i: p for i, g in enumerate(groups) if k in GROUPS[g][0] for p, names in places.items() if k in names}) for k in used}
    for a in {a: None for g in groups for a in GROUPS[g][1]}:
        out[a] = picked({i: f"{'a' if a in means else 's'}{GROUPS[g][1].index(a)}" for i, g in enumerate(groups) if a in GROUPS[g][1]})
    of = F.element_at(F.array(*[F.lit(g) for g in groups]), F.col("g") + 1)
    return written(total.select(of.alias("of"), "n", "safety_score", *[c.alias(k) for k, c in out.items()]), "bundle")


def _long(section: str, df: DataFrame, *keys: str) -> DataFrame:
    """(section, key, metric, value): a row for each column of ``df`` besides the keys."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns if c not in keys])
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.inline(cells))


def _sections(sums: DataFrame, targets: DataFrame) -> dict:
    """Each section from the sums, when it is asked for."""

    def rows(section: str) -> DataFrame:
        return sums.filter(F.col("of") == OF[section])

    def renamed(section: str, *cols: str, **names: str) -> DataFrame:
        return rows(section).select(*cols, *[F.col(b).alias(a) for a, b in names.items()])

    def operational() -> DataFrame:
        def mean(c: str) -> Column:
            return round2(F.coalesce(f"mean_{c}", F.lit(0.0)))

        g = rows("operational").select("month", round2(F.col("on_time") / F.col("n") * 100).alias("on_time_percentage"),
                                       mean("efficiency_score").alias("average_efficiency"),
                                       mean("deadhead_percentage").alias("deadhead_percentage"), mean("average_speed").alias("average_speed"))
        trend = F.when(F.col("trend") == "up", 1).when(F.col("trend") == "down", -1).otherwise(0)
        return A.operational_vs_target_of(g, targets).withColumn("trend", trend)

    def ledger() -> DataFrame:
        named = rows("financial_analysis").select("month", *[F.col(f"sum_{c}").alias(c) for c in A.LEDGER_CATEGORIES])
        return A.financial_analysis_of(named.unpivot(["month"], list(A.LEDGER_CATEGORIES), "category", "cur"))

    def overview() -> DataFrame:
        both = sums.filter(F.col("of").isin("", "route_date"))
        g = both.select(F.when(F.col("of") == "", 1).otherwise(0).alias("g"), "route_date", F.col("n").alias("routes"), "m", "r", "c",
                        F.col("mean_fuel_efficiency").alias("mpg"))
        return A.weekly_overview_of(g)

    return {
        "summary": lambda: _long("summary", A.period_summary_of(renamed("summary", "m", "r", "c", total_routes="n")).drop("status")),
        "drivers": lambda: _long("drivers", A.driver_metrics_of(renamed("drivers", "name", "m", "r", "e", "v", route_count="n")), "name"),
        "vehicles": lambda: _long("vehicles", A.vehicle_metrics_of(renamed("vehicles", "vehicle", "m", "f", "mc", route_count="n")),
                                  "vehicle_info"),
        "customers": lambda: _long("customers", A.customer_metrics_of(renamed("customers", "r", "m", c="cust", route_count="n")),
                                   "customer_name"),
        "routes": lambda: _long("routes", rows("routes").select("route_key", round2("m").alias("total_miles"), round2("r").alias("revenue"),
                                                                round2("c").alias("total_costs")), "route_key"),
        "daily": lambda: _long("daily", A.daily_rollup_of(renamed("daily", "route_date", "m", "r", routes="n", c="stored")), "route_date"),
        "overview": lambda: _long("overview", overview(), "row_kind", "route_date"),
        "driver_rankings": lambda: _long("driver_rankings", A.monthly_driver_ranking_of(
            renamed("driver_rankings", "month", "name", "m", "r", "e", "v", "safety_score", route_count="n")), "month", "name"),
        "financial_analysis": lambda: _long("financial_analysis", ledger(), "category", "month"),
        "month_over_month": lambda: _long("month_over_month", A.month_over_month_of(
            renamed("month_over_month", "month", "r", routes="n", e="mean_efficiency_score")), "month"),
        "customer_profitability": lambda: _long("customer_profitability", A.customer_profitability_of(
            renamed("customer_profitability", "r", c="cust", tc="c", route_count="n")), "customer_name"),
        "vehicle_performance": lambda: _long("vehicle_performance", A.vehicle_performance_of(
            renamed("vehicle_performance", "vehicle_id", "m", "f", "w", "cap", "mc", tc="c", route_count="n")), "vehicle_id"),
        "operational": lambda: _long("operational", operational(), "month", "metric"),
    }


def report_bundle(fact: DataFrame, sections: tuple[str, ...], targets: DataFrame) -> DataFrame:
    """The sections of a report over the fact of its period, and its outcome: section
    ``status`` with key ``success``, or ``no_data`` for an empty period (which has no
    other section), and the routes, revenue and miles."""
    sums = bundle_sums(fact, sections)
    whole = sums.filter("of = ''").agg(*[F.coalesce(F.sum(a), F.lit(0)).alias(b) for a, b in (
        ("n", "routes_count"), ("r", "total_revenue"), ("m", "total_miles"))])
    status = F.when(F.col("routes_count") > 0, "success").otherwise("no_data")
    out = _long("status", whole.select(status.alias("status"), "routes_count", round2("total_revenue").alias("total_revenue"),
                                       round2("total_miles").alias("total_miles")), "status")
    made = _sections(sums, targets)
    for s in sections:
        out = out.unionByName(made[s]())
    return out
