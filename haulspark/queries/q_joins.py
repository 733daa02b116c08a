"""Joins and lookups: J4-J13, G5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import join as J
from ..operators import validate as V
from ..plans.collected_view import COLLECTED_SQL, collected
from ..plans.report_fact import report_fact
from ..plans.routes_view import routes
from ..session import scratch_path
from ..sources import store as ST
from ..sources.tables import table
from .q_validate import _errs, _findings_sql
from .registry import register
from .sqlbase import fsum, r2, with_routes

AS_OF = "2024-01-31 00:00:00"
YEAR = ("1996-01-01", "1996-12-31")


@register("J4_point_lookup", """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def j4(spark, sf):
    """Batched point lookup: customers of urgent orders (semi join)."""
    ids = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    cust = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return J.semi_lookup(cust, ids, "c_custkey", "o_custkey")


def _busiest_driver(r):
    g = r.groupBy("driver_id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.min_by("driver_id", F.struct(-F.col("n"), F.col("driver_id")))).scalar()


_BUSIEST_SQL = "(SELECT driver_id FROM routes GROUP BY driver_id ORDER BY count(*) DESC, driver_id LIMIT 1)"


@register("J5_driver_routes", with_routes(f"""
SELECT route_key, route_date, revenue FROM routes
WHERE driver_id = {_BUSIEST_SQL} AND route_date BETWEEN DATE '{YEAR[0]}' AND DATE '{YEAR[1]}'"""))
def j5(spark, sf):
    """Routes of a driver (here: the busiest one) in a date range, by date."""
    r = routes(spark, sf, ("route_key", "route_date", "revenue", "driver_id"))
    d = _busiest_driver(r)
    return (r.filter((F.col("driver_id") == d) & F.col("route_date").between(YEAR[0], YEAR[1]))
            .orderBy("route_date", "route_key").select("route_key", "route_date", "revenue"))


@register("J6_route_financials", with_routes(f"""
SELECT l.route_key, l.category, {r2('l.amount')} AS amount FROM (
  SELECT route_key, 'revenue' AS category, revenue AS amount FROM routes UNION ALL
  SELECT route_key, 'fuel_cost', fuel_cost FROM routes UNION ALL
  SELECT route_key, 'toll_cost', toll_cost FROM routes UNION ALL
  SELECT route_key, 'driver_pay', driver_pay FROM routes UNION ALL
  SELECT route_key, 'other_costs', other_costs FROM routes) l
WHERE l.amount IS NOT NULL AND l.amount <> 0
  AND l.route_key IN (SELECT route_key FROM routes WHERE driver_id = {_BUSIEST_SQL})"""))
def j6(spark, sf):
    """Financial records of routes (those of the busiest driver)."""
    f = report_fact(spark, sf)
    d = _busiest_driver(f)
    ledger = A.financial_ledger(f)
    mine = f.filter(F.col("driver_id") == d).select("route_key")
    return ledger.join(mine, "route_key", "left_semi").select("route_key", "category", "amount")


GAZ_SQL = """
gaz AS (SELECT n_name AS city, r_name AS state, n_nationkey + cast(25.5 AS DOUBLE) AS latitude, n_nationkey * 2 - cast(119.5 AS DOUBLE) AS longitude
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'MIDDLE EAST')"""


def gazetteer(spark, sf):
    """City + state gazetteer from nation x region; one region left out so
    lookups can miss."""
    n, rg = table(spark, sf, "nation"), table(spark, sf, "region")
    return (n.join(rg, n.n_regionkey == rg.r_regionkey).filter(F.col("r_name") != "MIDDLE EAST")
            .select(F.col("n_name").alias("city"), F.col("r_name").alias("state"),
                    (F.col("n_nationkey") + 25.5).alias("latitude"),
                    (F.col("n_nationkey") * 2 - 119.5).alias("longitude")))


def _points(spark, sf):
    r = routes(spark, sf, ("route_key", "end_nation"))
    n, rg = table(spark, sf, "nation"), table(spark, sf, "region")
    # nation and region are fixed-size (25 / 5 rows by the schema's definition)
    nr = F.broadcast(n.join(rg, n.n_regionkey == rg.r_regionkey)
                     .select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state")))
    return r.join(nr, r.end_nation == nr.n_nationkey, "left").select("route_key", "city", "state")


_POINTS_SQL = """
pts AS (SELECT route_key, n_name AS city, r_name AS state FROM routes
        LEFT JOIN nation ON end_nation = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


@register("J7_geocode_lookup", with_routes(f"""
, {GAZ_SQL.strip()}, {_POINTS_SQL.strip()}
SELECT p.route_key, p.city, p.state, coalesce(g2.latitude, g1.lat) AS latitude,
       coalesce(g2.longitude, g1.lon) AS longitude
FROM pts p LEFT JOIN gaz g2 ON p.city = g2.city AND p.state = g2.state
LEFT JOIN (SELECT city, arg_min(latitude, state) AS lat, arg_min(longitude, state) AS lon FROM gaz GROUP BY city) g1
  ON p.city = g1.city"""))
def j7(spark, sf):
    return J.geocode(_points(spark, sf), gazetteer(spark, sf))


# Gazetteer of three levels over the addresses of the routes; parts of it are left
# out, so that addresses fall through to the next level or miss.
_FULL_SQL = "concat_ws(', ', nullif(address, ''), nullif(city, ''), nullif(state, ''), nullif(zip_code, ''))"
LEVELS_SQL = f"""
adr AS (SELECT route_key, raw_address AS address, n_name AS city, r_name AS state, raw_zip AS zip_code
        FROM routes LEFT JOIN nation ON end_nation = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
asked AS (SELECT *, CASE WHEN coalesce(address, '') <> '' THEN {_FULL_SQL} END AS full_address FROM adr),
level1 AS (SELECT DISTINCT full_address AS key, length(full_address) / cast(4 AS DOUBLE) AS latitude,
                  -length(address) / cast(2 AS DOUBLE) AS longitude FROM asked WHERE length(address) % 3 = 0),
level2 AS (SELECT DISTINCT zip_code AS key, length(zip_code) + ascii(zip_code) / cast(2 AS DOUBLE) AS latitude, cast(-100 AS DOUBLE) AS longitude
           FROM asked WHERE coalesce(zip_code, '') <> '' AND ascii(zip_code) % 2 = 0),
level3 AS (SELECT lower(city || ', ' || state) AS key, min(latitude) AS latitude, min(longitude) AS longitude FROM gaz GROUP BY 1)"""
_GEOCODED_SQL = f"""
, {GAZ_SQL.strip()}, {LEVELS_SQL.strip()},
geocoded AS (
  SELECT a.route_key, CASE WHEN l1.key IS NOT NULL THEN 1 WHEN l2.key IS NOT NULL THEN 2 WHEN l3.key IS NOT NULL THEN 3 END AS level,
         CASE WHEN l1.key IS NOT NULL THEN l1.latitude WHEN l2.key IS NOT NULL THEN l2.latitude ELSE l3.latitude END AS latitude,
         CASE WHEN l1.key IS NOT NULL THEN l1.longitude WHEN l2.key IS NOT NULL THEN l2.longitude ELSE l3.longitude END AS longitude
  FROM asked a LEFT JOIN level1 l1 ON a.full_address = l1.key
  LEFT JOIN level2 l2 ON a.full_address IS NOT NULL AND a.zip_code = l2.key
  LEFT JOIN level3 l3 ON a.full_address IS NOT NULL AND lower(concat_ws(', ', nullif(a.city, ''), nullif(a.state, ''))) = l3.key)"""


def addresses(spark, sf, *more):
    """Routes with the address they go to."""
    r = routes(spark, sf, ("route_key", "end_nation", "raw_address", "raw_zip", *more))
    n, rg = table(spark, sf, "nation"), table(spark, sf, "region")
    nr = n.join(rg, n.n_regionkey == rg.r_regionkey, "left").select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state"))
    return r.join(nr, r.end_nation == nr.n_nationkey, "left").select(
        "route_key", F.col("raw_address").alias("address"), "city", "state", F.col("raw_zip").alias("zip_code"), *more)


def gazetteer_levels(spark, sf):
    """(level, key, latitude, longitude): full addresses, ZIP codes, cities with their states."""
    a = addresses(spark, sf).withColumn("full_address", J.full_address())
    level1 = a.filter(F.length("address") % 3 == 0).select(
        F.lit(J.FULL).alias("level"), F.col("full_address").alias("key"), (F.length("full_address") / 4.0).alias("latitude"),
        (-F.length("address") / 2.0).alias("longitude")).filter("key IS NOT NULL").distinct()
    level2 = a.filter((F.coalesce("zip_code", F.lit("")) != "") & (F.ascii("zip_code") % 2 == 0)).select(
        F.lit(J.ZIP).alias("level"), F.col("zip_code").alias("key"), (F.length("zip_code") + F.ascii("zip_code") / 2.0).alias("latitude"),
        F.lit(-100.0).alias("longitude")).distinct()
    level3 = gazetteer(spark, sf).select(F.lit(J.CITY_STATE).alias("level"), F.lower(F.concat_ws(", ", "city", "state")).alias("key"),
                                         "latitude", "longitude")
    return level1.unionByName(level2).unionByName(level3)


@register("J7_geocode_kept", with_routes(_GEOCODED_SQL + "\nSELECT * FROM geocoded"))
def j7_kept(spark, sf):
    """Addresses resolved in two runs over a kept table of resolved ones: the second
    resolves only what the first has not."""
    store = ST.Store(spark, scratch_path(spark, "j7-geocodes"))
    a, g = addresses(spark, sf, "line_no"), gazetteer_levels(spark, sf)
    J.geocode_kept(a.filter("line_no <= 3"), g, store)
    return J.geocode_kept(a, g, store).select("route_key", "level", "latitude", "longitude")


@register("G5_geocode_statistics", with_routes(f"""
, {GAZ_SQL.strip()}, {_POINTS_SQL.strip()}
SELECT count(*) AS total, count(coalesce(g2.latitude, g1.lat)) AS resolved,
       count(*) - count(coalesce(g2.latitude, g1.lat)) AS unresolved
FROM pts p LEFT JOIN gaz g2 ON p.city = g2.city AND p.state = g2.state
LEFT JOIN (SELECT city, arg_min(latitude, state) AS lat FROM gaz GROUP BY city) g1 ON p.city = g1.city"""))
def g5(spark, sf):
    g = J.geocode(_points(spark, sf), gazetteer(spark, sf))
    return g.agg(F.count(F.lit(1)).alias("total"), F.count("latitude").alias("resolved"),
                 (F.count(F.lit(1)) - F.count("latitude")).alias("unresolved"))


def _changes(r):
    return r.filter(F.col("status") == "delayed").select("route_key", F.lit("in_progress").alias("status"))


@register("J8_status_update", with_routes("""
SELECT route_key, CASE WHEN status = 'delayed' THEN 'in_progress' ELSE status END AS status,
       status = 'delayed' AS changed FROM routes"""))
def j8(spark, sf):
    """Change set: every delayed route resumes (-> in_progress)."""
    r = routes(spark, sf, ("route_key", "status"))
    return J.apply_status_changes(r, _changes(r), "route_key", AS_OF).select("route_key", "status", "changed")


@register("J10_stamp_updated_at", with_routes(f"""
SELECT route_key, CASE WHEN status = 'delayed' THEN TIMESTAMP '{AS_OF}' END AS updated_at FROM routes"""))
def j10(spark, sf):
    r = routes(spark, sf, ("route_key", "status"))
    return J.apply_status_changes(r, _changes(r), "route_key", AS_OF).select("route_key", "updated_at")


@register("J9_completion_driver_totals", with_routes(f"""
, base AS (SELECT driver_id, {fsum("CASE WHEN status = 'completed' THEN total_miles ELSE 0 END")} AS total_miles,
                  count(*) FILTER (WHERE status = 'completed') AS total_routes FROM routes GROUP BY driver_id),
add AS (SELECT driver_id, sum(total_miles) AS add_miles, count(*) AS add_routes FROM routes
        WHERE status = 'in_progress' GROUP BY driver_id)
SELECT b.driver_id, {r2('b.total_miles + coalesce(a.add_miles, 0)')} AS total_miles,
       b.total_routes + coalesce(a.add_routes, 0) AS total_routes
FROM base b LEFT JOIN add a ON b.driver_id = a.driver_id""".replace("\n, base AS", ", base AS", 1)))
def j9(spark, sf):
    """Second snapshot: in-progress routes complete; drivers' completed miles
    and route counts grow by the transitions only."""
    old = routes(spark, sf, ("route_key", "status", "driver_id", "total_miles"))
    new = old.withColumn("status", F.when(F.col("status") == "in_progress", "completed").otherwise(F.col("status")))
    drivers = old.groupBy("driver_id").agg(
        F.sum(F.when(F.col("status") == "completed", F.col("total_miles")).otherwise(0.0)).alias("total_miles"),
        F.count_if(F.col("status") == "completed").cast("long").alias("total_routes"))
    out = J.completion_totals(old, new, drivers)
    return out.select("driver_id", (F.rint(F.col("total_miles") * 100) / 100).alias("total_miles"), "total_routes")


# Notification rules and groups.
ALERT_RULES = [("error_rate", ["operations", "administrators"], True),
               ("low_activity", ["operations"], False)]
GROUP_MEMBERS = [("operations", "ops@example.com"), ("operations", "dispatch@example.com"),
                 ("administrators", "admin@example.com"), ("administrators", "ops@example.com")]
ERROR_SHARE_LIMIT = 0.2


@register("J11_alert_recipients", f"""
WITH days AS (SELECT cast(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') / count(*) AS share
              FROM events GROUP BY 1),
alerts AS (SELECT cast(day AS VARCHAR) AS alert_id, 'error_rate' AS alert_type,
                  CASE WHEN share > {ERROR_SHARE_LIMIT} THEN 'Warning' ELSE 'Healthy' END AS status FROM days),
members(group_name, email) AS (VALUES {', '.join(f"('{g}', '{e}')" for g, e in GROUP_MEMBERS)})
SELECT DISTINCT a.alert_id, m.email FROM alerts a
JOIN members m ON m.group_name IN ('operations', 'administrators')
WHERE a.status <> 'Healthy' AND a.alert_type = 'error_rate'""")
def j11(spark, sf):
    """Daily error-share alerts routed to the members of the rule's groups."""
    ev = table(spark, sf, "events")
    days = ev.groupBy(F.to_date("ts").alias("day")).agg(
        (F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("share"))
    alerts = days.select(F.col("day").cast("string").alias("alert_id"), F.lit("error_rate").alias("alert_type"),
                         F.when(F.col("share") > ERROR_SHARE_LIMIT, "Warning").otherwise("Healthy").alias("status"))
    rules = spark.createDataFrame(ALERT_RULES, "alert_type string, groups array<string>, enabled boolean")
    members = spark.createDataFrame(GROUP_MEMBERS, "group_name string, email string")
    return J.recipients(alerts, rules, members)


# A notification configuration.
NOTIFICATION_RULES = {
    "report_generated": {"enabled": True, "recipients": ["reports", "admins"], "conditions": []},
    "error_occurred": {"enabled": True, "recipients": ["admins"], "conditions": ["severity >= WARNING"]},
    "system_health_check": {"enabled": True, "recipients": ["admins"], "conditions": ["health_status != Healthy"]},
    "data_collection_failed": {"enabled": False, "recipients": ["admins", "operators"], "conditions": []},
}
_ALERTS = """SELECT event_id AS alert_id, CASE event_type WHEN 'error' THEN 'error_occurred' WHEN 'click' THEN 'system_health_check'
    WHEN 'view' THEN 'data_collection_failed' WHEN 'signup' THEN 'report_generated' ELSE 'unknown' END AS alert_type,
  CASE event_id % 5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'warning' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'CRITICAL' END AS severity,
  CASE event_id % 3 WHEN 0 THEN 'Healthy' WHEN 1 THEN 'Critical' END AS health_status FROM {events}"""


@register("J11_rule_conditions", f"""
WITH a AS ({_ALERTS.format(events='events')}),
m(grp, email) AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'admins' WHEN 1 THEN 'operators' ELSE 'reports' END, 'user' || (c_custkey % 7) || '@example.com' FROM customer)
SELECT DISTINCT alert_id, email FROM a JOIN m ON
  (alert_type = 'report_generated' AND grp IN ('reports', 'admins'))
  OR (alert_type = 'error_occurred' AND upper(severity) IN ('WARNING', 'ERROR', 'CRITICAL') AND grp = 'admins')
  OR (alert_type = 'system_health_check' AND health_status <> 'Healthy' AND grp = 'admins')""")
def j11_conditions(spark, sf):
    """Alerts of the event stream by rules with conditions; the customers' contacts are the groups' members."""
    alerts = spark.sql(_ALERTS.format(events="{events}"), events=table(spark, sf, "events"))
    k = F.col("c_custkey")
    members = table(spark, sf, "customer").select(
        F.when(k % 3 == 0, "admins").when(k % 3 == 1, "operators").otherwise("reports").alias("group_name"),
        F.concat(F.lit("user"), (k % 7).cast("string"), F.lit("@example.com")).alias("email")).distinct()
    return J.route_alerts(alerts, NOTIFICATION_RULES, members)


_LOOKUPS = (("customers", "customer", "c_custkey", "c_name"), ("drivers", "supplier", "s_suppkey", "s_name"), ("vehicles", "part", "p_partkey", "p_name"),
            ("routes", "orders", "o_orderkey", "o_orderstatus"), ("locations", "nation", "n_nationkey", "n_name"))


@register("J4_point_lookups", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, cast({k} AS BIGINT) AS id, {v} AS name FROM {t} WHERE {k} IN (SELECT user_id FROM events WHERE event_type = 'error')"
    for n, t, k, v in _LOOKUPS))
def j4_tables(spark, sf):
    """Rows of five tables by a list of ids (the users with errors)."""
    ids = table(spark, sf, "events").filter("event_type = 'error'").select("user_id").distinct()
    out = None
    for n, t, k, v in _LOOKUPS:
        rows = J.semi_lookup(table(spark, sf, t), ids, k, "user_id").select(F.lit(n).alias("table_name"), F.col(k).cast("long").alias("id"), F.col(v).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("J12_active_vehicles", "SELECT p_partkey AS vehicle_id, p_brand AS make, p_type AS model FROM part WHERE p_size > 10")
def j12_vehicles(spark, sf):
    """Active vehicles (in use: size above 10), by make and model."""
    return table(spark, sf, "part").filter("p_size > 10").select(
        F.col("p_partkey").alias("vehicle_id"), F.col("p_brand").alias("make"), F.col("p_type").alias("model")).orderBy("make", "model", "vehicle_id")


@register("J12_all_customers", "SELECT c_custkey AS customer_id, c_name AS name FROM customer")
def j12_customers(spark, sf):
    """All customers, by name."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name")).orderBy("name")


@register("J12_active_drivers", "SELECT s_suppkey AS driver_id, s_name AS name FROM supplier WHERE s_acctbal > 0")
def j12(spark, sf):
    """Active drivers (positive account balance), ordered by name."""
    s = table(spark, sf, "supplier")
    return s.filter(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("driver_id"),
                                                   F.col("s_name").alias("name")).orderBy("name")


R = V.ROUTE_RULES


@register("J13_unprocessed_records", with_routes(f"""
, {COLLECTED_SQL.strip()}, fl AS ({_findings_sql(R)})
SELECT c.record_key, c.route_date FROM collected c
WHERE c.record_key NOT IN (SELECT record_key FROM fl WHERE {_errs(R)} = 0)"""))
def j13(spark, sf):
    """Raw records not yet processed: collected minus the valid (stored) ones."""
    raw = collected(spark, sf)
    processed, _ = V.split_valid(V.with_findings(raw, R))
    return raw.join(processed.select("record_key"), "record_key", "left_anti").select("record_key", "route_date")
