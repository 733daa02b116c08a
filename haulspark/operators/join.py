"""Lookups, snapshots and routing joins.

Plain Parquet has no MERGE, so updates (J8-J10) are snapshot-in /
snapshot-out: a left join of the change set onto the snapshot, written as a
new version by the caller.  Geocoding (J7) resolves each *distinct* address
once, keeps the answer for later runs and joins it back, so the lookup side only
ever sees new addresses, never the fact.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fixed_sum


def semi_lookup(dim: DataFrame, ids: DataFrame, dim_key: str, id_key: str) -> DataFrame:
    """J4 (batched): dimension rows whose key is in an id list."""
    return dim.join(ids.select(F.col(id_key).alias(dim_key)), dim_key, "left_semi")


def apply_status_changes(snapshot: DataFrame, changes: DataFrame, key: str, as_of: str) -> DataFrame:
    """J8 + J10: new status where a change exists, ``changed`` flag, and
    ``updated_at`` stamped with ``as_of`` on changed rows only."""
    ch = changes.select(key, F.col("status").alias("_new"))
    j = snapshot.join(ch, key, "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("status"))
    return j.select(key, F.coalesce("_new", "status").alias("status"), changed.alias("changed"),
                    F.when(changed, F.lit(as_of).cast("timestamp_ntz")).alias("updated_at"))


def completion_totals(old: DataFrame, new: DataFrame, drivers: DataFrame) -> DataFrame:
    """Routes that turn 'completed' add their miles and one route to the
    driver's running totals (the trigger, as a batch job)."""
    o = old.select("route_key", F.col("status").alias("old_status"))
    n = new.select("route_key", F.col("status").alias("new_status"), "driver_id", "total_miles")
    t = (n.join(o, "route_key")
         .filter((F.col("new_status") == "completed") & ~F.col("old_status").eqNullSafe(F.lit("completed")))
         .groupBy("driver_id").agg(fixed_sum(F.coalesce("total_miles", F.lit(0.0))).alias("add_miles"),
                                   F.count(F.lit(1)).alias("add_routes")))
    return (drivers.join(t, "driver_id", "left")
            .select("driver_id", (F.col("total_miles") + F.coalesce("add_miles", F.lit(0.0))).alias("total_miles"),
                    (F.col("total_routes") + F.coalesce("add_routes", F.lit(0))).alias("total_routes")))


def geocode(points: DataFrame, gazetteer: DataFrame, city: str = "city", state: str = "state") -> DataFrame:
    """One resolution per distinct (city, state); most specific match
    first (city + state), then city alone; misses stay NULL.  Of several
    gazetteer rows for one key the least counts, so points never multiply."""
    keys = points.select(city, state).distinct()
    g2 = (gazetteer.groupBy(F.col("city").alias(city), F.col("state").alias(state))
          .agg(F.min(F.struct("latitude", "longitude")).alias("_p2")))
    g1 = (gazetteer.groupBy(F.col("city").alias(city))
          .agg(F.min(F.struct("state", "latitude", "longitude")).alias("_p1")))
    res = (keys.join(g2, [city, state], "left").join(g1, city, "left")
           .select(F.col(city).alias("_city"), F.col(state).alias("_state"),
                   F.coalesce("_p2.latitude", "_p1.latitude").alias("latitude"),
                   F.coalesce("_p2.longitude", "_p1.longitude").alias("longitude")))
    same = points[city].eqNullSafe(res["_city"]) & points[state].eqNullSafe(res["_state"])
    return points.join(res, same, "left").drop("_city", "_state")


# Levels of a gazetteer, the surest first.
FULL, ZIP, CITY_STATE = 1, 2, 3
ADDRESS = ("address", "city", "state", "zip_code")


def full_address(parts: tuple[str, ...] = ADDRESS) -> Column:
    """The address as one text, parts that are there joined by commas; NULL
    without a street address (which the geocoder needs)."""
    street = F.col(parts[0])
    shown = F.concat_ws(", ", *[F.when(F.col(p) != "", F.col(p)) for p in parts])
    return F.when(F.coalesce(street, F.lit("")) != "", shown)


def located(points: DataFrame, known: DataFrame, address: Column) -> DataFrame:
    """``points`` with the other columns of ``known`` (one row for each
    ``full_address``).  Rows without an address have no match; they join on a number
    of their own as well, so that they do not all go to one task."""
    own = [F.col(f"`{c}`") for c in points.columns]
    asked = points.withColumn("_asked", address)
    asked = asked.withColumn("_spread", F.when(F.col("_asked").isNull(), F.xxhash64(*own)).otherwise(F.xxhash64("_asked")))
    found = known.withColumnRenamed("full_address", "_known").withColumn("_known_spread", F.xxhash64("_known"))
    same = (F.col("_asked") == F.col("_known")) & (F.col("_spread") == F.col("_known_spread"))
    return asked.join(found, same, "left").drop("_asked", "_spread", "_known", "_known_spread")


def match_addresses(addresses: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Distinct addresses (``full_address`` and its parts) -> full_address, level,
    latitude, longitude of the surest gazetteer row (``level, key, latitude,
    longitude``; of equal ones the least); addresses without a match are left out.

    Every address asks for its keys of all levels in one join, and one aggregate
    takes the surest answer."""
    ask = F.array(F.struct(F.lit(FULL).alias("level"), F.col("full_address").alias("key")),
                  F.struct(F.lit(ZIP).alias("level"), F.nullif("zip_code", F.lit("")).alias("key")),
                  F.struct(F.lit(CITY_STATE).alias("level"),
                           F.lower(F.concat_ws(", ", F.nullif("city", F.lit("")), F.nullif("state", F.lit("")))).alias("key")))
    asked = addresses.select("full_address", F.inline(ask)).filter(F.col("key").isNotNull())
    answers = gazetteer.select("level", "key", F.struct("level", "latitude", "longitude").alias("answer"))
    best = asked.join(answers, ["level", "key"]).groupBy("full_address").agg(F.min("answer").alias("answer"))
    return best.select("full_address", "answer.level", "answer.latitude", "answer.longitude")


def geocode_kept(points: DataFrame, gazetteer: DataFrame, store, table: str = "geocodes") -> DataFrame:
    """``points`` with latitude, longitude and level.  Resolved addresses are kept
    in ``store``: only addresses that it lacks are matched, and their matches
    appended (misses are asked again the next time, when the gazetteer may know
    them); points without a street address stay without a position."""
    asked = points.withColumn("full_address", full_address())
    distinct = asked.filter(F.col("full_address").isNotNull()).dropDuplicates(["full_address"]).select("full_address", *ADDRESS)
    if store.version(table)[2]:
        distinct = distinct.join(store.read(table).select("full_address"), "full_address", "left_anti")
    store.append(table, match_addresses(distinct, gazetteer), ("full_address",))
    if not store.version(table)[2]:
        return asked.select(*points.columns, *[F.lit(None).cast(t).alias(c) for c, t in (
            ("level", "int"), ("latitude", "double"), ("longitude", "double"))])
    known = store.read(table).select("full_address", "level", "latitude", "longitude")
    return located(points, known, full_address())


def recipients(alerts: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """Alert -> enabled rule -> groups -> distinct member addresses;
    'Healthy' alerts notify nobody."""
    a = alerts.filter(F.col("status") != "Healthy")
    r = rules.filter("enabled").select("alert_type", F.explode("groups").alias("group_name"))
    return (a.join(r, "alert_type").join(members, "group_name")
            .select("alert_id", "email").distinct())


SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")  # least first
_CONDITION = re.compile(r"\s*(\w+)\s*(>=|<=|!=|==|=|>|<)\s*(.+?)\s*$")


def condition(text: str) -> Column:
    """``field operator value`` of a notification rule as a column: severities compare
    by rank, numbers as numbers, the rest as text; a missing field does not fit."""
    m = _CONDITION.match(text)
    if not m:
        raise ValueError(f"condition not understood: {text!r}")
    name, op, value = m.groups()
    left, right = F.col(name).cast("string"), F.lit(value)
    if value.upper() in SEVERITIES:
        rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.upper(left))
        left, right = F.when(rank > 0, rank), F.lit(SEVERITIES.index(value.upper()) + 1)
    elif re.fullmatch(r"[+-]?\d+(\.\d+)?", value):
        left, right = F.col(name).try_cast("double"), F.lit(float(value))
    fits = {">=": left >= right, "<=": left <= right, "!=": left != right, "==": left == right, "=": left == right,
            ">": left > right, "<": left < right}[op]
    return F.coalesce(fits, F.lit(False))


def route_alerts(alerts: DataFrame, rules: dict[str, dict], members: DataFrame) -> DataFrame:
    """J11 with the rules of a notification configuration: an alert of an enabled
    rule's type that meets all of its conditions goes to the members of its groups,
    each address once.  The rules are compiled into one projection."""
    groups = None
    for name, rule in rules.items():
        if not rule.get("enabled", False):
            continue
        fits = F.col("alert_type") == name
        for text in rule.get("conditions", []):
            fits = fits & condition(text)
        to = F.array(*[F.lit(g) for g in rule["recipients"]])
        groups = F.when(fits, to) if groups is None else groups.when(fits, to)
    if groups is None:
        groups = F.lit(None).cast("array<string>")
    asked = alerts.select("alert_id", F.explode(groups).alias("group_name"))
    return asked.join(members, "group_name").select("alert_id", "email").distinct()
