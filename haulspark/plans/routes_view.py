"""The routes fact: a trucking-route view over the driver's star schema.

One route per lineitem.  Supplier = driver, customer = customer, part =
vehicle/load, the nation key gives coordinates.  Every dimension is joined
with a LEFT join on its unique key, so a dimension nobody asked for can be
left out without changing the row set -- :func:`routes` joins only the
dimensions the requested columns need (Catalyst cannot drop those joins by
itself because it does not know the keys are unique).

Scale notes: lineitem is the fact; orders, customer, part and supplier grow
with it, so none of them gets a broadcast hint -- Catalyst's size check
(``autoBroadcastJoinThreshold``) and AQE pick broadcast or sort-merge per join
at run time.  Customers are joined to the orders, not to their lines, so that the lines are
shuffled once less; suppliers, the fewest, last: while they are small enough for a
broadcast, their names are never shuffled with the lines.
Coordinates come from the nation *key* by formula, so no nation
join is needed at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

# Fixed values of the view definition (shared with the DuckDB oracle text).
LOAD_TYPE_SPELLING = {
    "ECONOMY": "General",
    "LARGE": "OVERSIZED",
    "PROMO": "fragile",
    "SMALL": "Refrigerated",
    "STANDARD": "Hazardous",
}  # MEDIUM (and anything else) -> 'medium', which is not a load type
STATE_SPELLING = ["il", "new york", " Texas ", "DC"]
CITY_SPELLING = ["chicago", "NEW YORK", "san antonio", None]


def _mins(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0))


def _pick(key: Column, options: list) -> Column:
    e = None
    for i, o in enumerate(options):
        v = o if isinstance(o, Column) else F.lit(o).cast("string")
        e = F.when(key == i, v) if e is None else e.when(key == i, v)
    return e


def _ship():
    return F.col("l_shipdate")


def _sched_start():
    return _ship() + F.make_dt_interval(F.lit(0), F.lit(8), F.lit(0), F.lit(0))


def _sched_end():
    return _sched_start() + _mins(F.col("l_quantity") * 30)


def _miles():
    return F.col("l_quantity") * 20.0


def _fuel():
    return F.when(F.col("l_quantity") != 13,
                  F.col("l_quantity") * 20.0 / (F.col("p_size") % 6 + 5))


def _k():
    return F.col("o_custkey")


def _phone():
    d = F.lpad((_k() % 10_000_000).cast("string"), 7, "0")
    a, b = F.substring(d, 1, 3), F.substring(d, 4, 4)
    return _pick(_k() % 4, [F.concat(F.lit("555-"), a, F.lit("-"), b),
                            F.concat(F.lit("(555) "), a, F.lit("-"), b),
                            F.concat(F.lit("1555"), d),
                            F.concat(F.lit("555"), F.substring(d, 1, 4))])


def _email():
    ks = _k().cast("string")
    return _pick(_k() % 4, [F.concat(F.lit(" Customer"), ks, F.lit("@Example.COM ")),
                            F.concat(F.lit("c."), ks, F.lit("@mail.example.org")),
                            F.concat(F.lit("user"), ks, F.lit("@domain")),
                            F.concat(F.lit("invalid-email-"), ks)])


def _zip():
    z = F.lpad((_k() % 100_000).cast("string"), 5, "0")
    return _pick(_k() % 4, [z,
                            F.concat(z, F.lit("-"), F.lpad((_k() % 10_000).cast("string"), 4, "0")),
                            F.concat(F.substring(z, 1, 3), F.lit(" "), F.substring(z, 4, 2)),
                            F.substring(z, 1, 4)])


def _address():
    ks = _k().cast("string")
    return _pick(_k() % 4, [F.concat(F.lit("  "), ks, F.lit("  north MAIN street ")),
                            F.concat(ks, F.lit(" 5th avenue")),
                            F.concat(ks, F.lit(" west lake boulevard")),
                            F.lit("")])


def _amount():
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    dollars, cc = F.floor(cents / 100).cast("long"), cents % 100
    c2 = F.lpad(cc.cast("string"), 2, "0")
    return _pick(F.col("l_linenumber") % 4, [
        F.concat(F.lit("$"), dollars.cast("string"), F.lit("."), c2),
        F.concat(F.floor(dollars / 1000).cast("long").cast("string"), F.lit(","),
                 F.lpad((dollars % 1000).cast("string"), 3, "0"), F.lit("."), c2),
        F.concat(F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("%")),
        F.lit("n/a")])


def _date_text():
    s = _ship()
    return _pick(F.col("l_linenumber") % 4, [
        F.date_format(s, "yyyy-MM-dd"),
        F.date_format(s, "MM/dd/yyyy HH:mm"),
        F.date_format(s, "yyyy/M/d"),
        F.date_format(s, "dd/MM/yyyy")])


def _load_type_raw():
    e = None
    for k, v in LOAD_TYPE_SPELLING.items():
        e = F.when(F.col("p_type") == k, v) if e is None else e.when(F.col("p_type") == k, v)
    return e.otherwise("medium")


def _status():
    ls, os_, rf = F.col("l_linestatus"), F.col("o_orderstatus"), F.col("l_returnflag")
    return (F.when((ls == "F") & (os_ == "F"), "completed")
            .when(ls == "F", "in_progress")
            .when(rf == "R", "cancelled")
            .when(rf == "A", "delayed")
            .otherwise("scheduled"))


# column -> (expression factory, dimensions it needs)
COLUMNS: dict[str, tuple] = {
    "route_key": (lambda: F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                      F.date_format("l_shipdate", "yyyyMMdd")), ()),
    "order_key": (lambda: F.col("l_orderkey"), ()),
    "line_no": (lambda: F.col("l_linenumber"), ()),
    "route_date": (lambda: _ship().cast("date"), ()),
    "driver_id": (lambda: F.col("l_suppkey"), ()),
    "driver_name": (lambda: F.col("s_name"), ("supplier",)),
    "driver_rate": (lambda: (F.col("l_suppkey") % 10 + 20).cast("double"), ()),
    "customer_id": (lambda: F.when(F.col("l_linenumber") != 7, F.col("o_custkey")), ("orders",)),
    "customer_name": (lambda: F.when(F.col("l_linenumber") != 7, F.col("c_name")), ("orders", "customer")),
    "vehicle_id": (lambda: F.col("l_partkey") % 100, ()),
    "vehicle_info": (lambda: F.concat_ws(" ", "p_brand", "p_type"), ("part",)),
    "vehicle_mpg": (lambda: (F.col("p_size") % 6 + 5).cast("double"), ("part",)),
    "vehicle_capacity": (lambda: F.when(F.col("l_partkey") % 5 != 0,
                                        (F.col("l_partkey") % 20 * 1000 + 30000).cast("double")), ()),
    "driver_safety": (lambda: (F.col("l_suppkey") % 40 + 60).cast("double"), ()),
    "customer_rating": (lambda: F.when(F.col("l_linenumber") != 7,
                                       (F.col("o_custkey") % 5 + 1).cast("double")), ("orders",)),
    "status": (_status, ("orders",)),
    "load_type_raw": (_load_type_raw, ("part",)),
    "load_weight": (lambda: F.col("p_size") * 800.0, ("part",)),
    "total_miles": (_miles, ()),
    "empty_miles": (lambda: _miles() * F.col("l_discount"), ()),
    "fuel_consumed": (_fuel, ("part",)),
    "revenue": (lambda: F.col("l_extendedprice") * (1 - F.col("l_discount")), ()),
    "fuel_cost": (lambda: _fuel() * 3.5, ("part",)),
    "toll_cost": (lambda: _miles() * F.col("l_tax"), ()),
    "driver_pay": (lambda: _miles() * 0.55, ()),
    "other_costs": (lambda: F.col("l_linenumber") * 10.0, ()),
    "scheduled_start": (_sched_start, ()),
    "scheduled_end": (_sched_end, ()),
    "actual_start": (lambda: _sched_start() + _mins(F.col("l_linenumber") * 5), ()),
    "actual_end": (lambda: _sched_end() + _mins((F.col("l_partkey") % 7 - 2) * 15), ()),
    "start_lat": (lambda: (F.col("s_nationkey") + 25).cast("double"), ("supplier",)),
    "start_lon": (lambda: (F.col("s_nationkey") * 2 - 120).cast("double"), ("supplier",)),
    "start_nation": (lambda: F.col("s_nationkey"), ("supplier",)),
    "end_nation": (lambda: F.col("c_nationkey"), ("orders", "customer")),
    "end_lat": (lambda: (F.col("c_nationkey") + 25).cast("double"), ("orders", "customer")),
    "end_lon": (lambda: (F.col("c_nationkey") * 2 - 120).cast("double"), ("orders", "customer")),
    "raw_phone": (_phone, ("orders",)),
    "raw_email": (_email, ("orders",)),
    "raw_zip": (_zip, ("orders",)),
    "raw_state": (lambda: _pick(_k() % 4, STATE_SPELLING), ("orders",)),
    "raw_city": (lambda: _pick(_k() % 4, CITY_SPELLING), ("orders",)),
    "raw_address": (_address, ("orders",)),
    "raw_amount": (_amount, ()),
    "raw_date": (_date_text, ()),
}

ALL_COLUMNS = tuple(COLUMNS)

# The columns of the report fact (J1 and every report aggregate).
FACT_COLUMNS = ("route_key", "route_date", "driver_id", "driver_name", "driver_rate",
                "customer_id", "customer_name", "vehicle_id", "vehicle_info", "vehicle_mpg",
                "vehicle_capacity", "driver_safety", "customer_rating", "status", "load_weight", "total_miles", "empty_miles",
                "fuel_consumed", "revenue", "fuel_cost", "toll_cost", "driver_pay",
                "other_costs", "scheduled_start", "scheduled_end", "actual_start",
                "actual_end", "start_lat", "start_lon", "end_lat", "end_lon")


def routes(spark: SparkSession, sf_dir: str, columns=ALL_COLUMNS,
           date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The routes view with only the joins ``columns`` need.

    ``date_from``/``date_to`` (inclusive dates) filter the fact before any
    join; the predicate reaches the lineitem Parquet scan as a pushed filter.
    """
    dims = set()
    for c in columns:
        dims.update(COLUMNS[c][1])
    if "customer" in dims:
        dims.add("orders")
    li = table(spark, sf_dir, "lineitem")
    if date_from is not None:
        li = li.filter(F.col("l_shipdate") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        li = li.filter(F.col("l_shipdate") < F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp_ntz"))
    df = li
    if "part" in dims:
        p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
        df = df.join(p, df.l_partkey == p.p_partkey, "left")
    if "orders" in dims:
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        if "customer" in dims:
            cu = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
            o = o.join(cu, o.o_custkey == cu.c_custkey, "left")
        df = df.join(o, df.l_orderkey == o.o_orderkey, "left")
    if "supplier" in dims:
        s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        df = df.join(s, df.l_suppkey == s.s_suppkey, "left")
    return df.select(*[COLUMNS[c][0]().alias(c) for c in columns])
