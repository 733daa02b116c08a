"""End-to-end jobs and extension surface: R1-R3, A23, S10, E4, E5."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import join as J
from ..operators import standardize as P
from ..plans import jobs as JB
from ..plans.report_fact import report_fact
from ..plans.routes_view import routes
from ..session import scratch_path
from ..sources import collector as SC
from ..sources import files as S
from ..sources import store as ST
from ..sources.tables import table
from ..streaming import polling as X
from .q_entity import ORDER
from .q_functions import _C6_FORMATS, _STATE_VALUES, _abbrev_sql, _coalesce_parse, _title_sql
from .q_reports import A18_ALL_SQL, A18_SQL, MONTH, MONTHLY_FORMULAS, MONTHLY_KPIS
from .q_sources import _landed_csv
from .q_standardize import (raw_nested, API_FEED_SQL, EMAIL_FEED_SQL, FILE_FEED_SQL, api_feed, email_feed, file_feed,
                            s_float, s_iso)
from .registry import register
from .sqlbase import METRICS_CTE, r2, with_routes

AS_OF = "2024-01-31 00:00:00"

PAGE_RECORDS = 50
API_SCHEMA = "trip_id string, dispatch_date string, driver_id string, shipper string, total_distance string, total_pay string, load_status string"


def _paged(batches):
    """Records -> pages of :data:`PAGE_RECORDS` records in the order they come."""
    held = []
    for b in batches:
        held += b.column(0).to_pylist()
        whole = len(held) // PAGE_RECORDS * PAGE_RECORDS
        if whole:
            yield pa.RecordBatch.from_pydict({"records": [",".join(held[i:i + PAGE_RECORDS]) for i in range(0, whole, PAGE_RECORDS)]})
            held = held[whole:]
    if held:
        yield pa.RecordBatch.from_pydict({"records": [",".join(held)]})


def _land_pages(feed, path):
    """What the API handed out: pages of records, one payload a line (a page's
    records follow each other in a partition, so none is shuffled)."""
    page = feed.select(F.to_json(F.struct(*feed.columns)).alias("record")).mapInArrow(_paged, "records string")
    page.select(F.concat(F.lit('{"status": "ok", "result": {"data": ['), "records", F.lit("]}}")).alias("value")).write.text(path)


def _pages(reader, path):
    return reader.format("payload_pages").schema(API_SCHEMA).option("records", "result.data").load(path)


def api_pages(spark, sf):
    """The API feed as landed pages, read by the data source ``payload_pages``."""
    SC.register_sources(spark)
    d = scratch_path(spark, "api-pages")
    _land_pages(api_feed(spark, sf), f"{d}/{SC.landing_name(0)}")
    return _pages(spark.read, d)


JB.register_collector("landing_files", file_feed, P.FILE_ALIASES, "file")
JB.register_collector("tms_api", api_pages, P.API_ALIASES, "api")
JB.register_collector("dispatch_inbox", email_feed, P.EMAIL_ALIASES, "email")

_STD_SQL = f"""
, {FILE_FEED_SQL.strip()}, {API_FEED_SQL.strip()}, {EMAIL_FEED_SQL.strip()},
std AS (
  SELECT 'file' AS source, "Route ID" AS route_id, {s_iso('"Date"')} AS route_date,
         {s_float('"Miles"')} AS total_miles, {s_float('"Revenue"')} AS revenue FROM file_feed
  UNION ALL SELECT 'api', trip_id, {s_iso('dispatch_date')}, {s_float('total_distance')}, {s_float('total_pay')}
  FROM api_feed
  UNION ALL SELECT 'email', job_id, {s_iso('pickup_date')}, {s_float('miles')}, NULL FROM email_feed),
fl AS (SELECT source,
         (CASE WHEN route_id IS NULL OR trim(route_id) = '' THEN 1 ELSE 0 END)
         + (CASE WHEN route_date IS NULL OR trim(route_date) = '' THEN 1 ELSE 0 END) AS e,
         (CASE WHEN total_miles IS NOT NULL AND total_miles <= 0 THEN 1 ELSE 0 END)
         + (CASE WHEN revenue IS NOT NULL AND revenue <= 0 THEN 1 ELSE 0 END) AS w
       FROM std)"""


@register("R1_collect_all", with_routes(_STD_SQL + """
SELECT source, count(*) AS records, count(*) FILTER (WHERE e = 0) AS valid_records, cast(sum(e) AS BIGINT) AS errors,
       cast(sum(w) AS BIGINT) AS warnings,
       CASE WHEN count(*) FILTER (WHERE e = 0) > 0 THEN 'ok' ELSE 'failed' END AS status
FROM fl GROUP BY source"""))
def r1_collect(spark, sf):
    """All registered collectors -> standardise -> union -> validate; the
    per-source outcome."""
    return JB.collection_summary(JB.collect_all(spark, sf, AS_OF))


@register("A23_collection_summary", with_routes(_STD_SQL + """
, per AS (SELECT source, count(*) FILTER (WHERE e = 0) AS valid_records, count(*) AS records,
                sum(e) AS errors, sum(w) AS warnings FROM fl GROUP BY source)
SELECT count(*) AS sources, count(*) FILTER (WHERE valid_records > 0) AS ok_sources,
       count(*) FILTER (WHERE valid_records = 0) AS failed_sources, cast(sum(records) AS BIGINT) AS records,
       cast(sum(errors) AS BIGINT) AS errors, cast(sum(warnings) AS BIGINT) AS warnings FROM per"""))
def a23(spark, sf):
    per = JB.collection_summary(JB.collect_all(spark, sf, AS_OF))
    return per.agg(F.count(F.lit(1)).alias("sources"),
                   F.count_if(F.col("status") == "ok").cast("long").alias("ok_sources"),
                   F.count_if(F.col("status") == "failed").cast("long").alias("failed_sources"),
                   F.sum("records").cast("long").alias("records"), F.sum("errors").cast("long").alias("errors"),
                   F.sum("warnings").cast("long").alias("warnings"))


@register("E5_pluggable_collectors", with_routes(_STD_SQL + """
SELECT source, count(*) AS records FROM std GROUP BY source"""))
def e5(spark, sf):
    """Collectors are functions returning DataFrames, registered by name; the
    job runs whatever is registered, the API's through a Python data source."""
    return JB.collect_all(spark, sf, AS_OF).groupBy("source").agg(F.count(F.lit(1)).alias("records"))


@register("E5_streaming_collector", with_routes(_STD_SQL + """
SELECT route_id, route_date, total_miles, revenue FROM std WHERE source = 'api'"""))
def e5_stream(spark, sf):
    """The API's pages land before each of two polls; the data source's stream
    reader takes the new ones, which are standardised in the stream."""
    SC.register_sources(spark)
    p = X.Poller(spark, "e5-pages")
    feed = api_feed(spark, sf)
    for k in range(2):
        _land_pages(feed.filter(F.pmod(F.xxhash64("trip_id"), F.lit(2)) == k), f"{p.landing}/{SC.landing_name(k)}")
        p.poll(P.standardize(_pages(spark.readStream, p.landing), P.API_ALIASES, "api", "tms_api", AS_OF)
               .select("route_id", "route_date", "total_miles", "revenue"))
    return p.result()


# ---------------------------------------------------------------- R2
def _phone(x):
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return (f"CASE WHEN length({d}) = 10 THEN '(' || substr({d}, 1, 3) || ') ' || substr({d}, 4, 3) || '-' || substr({d}, 7, 4) "
            f"WHEN length({d}) = 11 AND substr({d}, 1, 1) = '1' THEN '(' || substr({d}, 2, 3) || ') ' || substr({d}, 5, 3) || '-' || substr({d}, 8, 4) END")


def _email(x):
    return f"CASE WHEN regexp_full_match(lower(trim({x})), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') THEN lower(trim({x})) END"


def _zip(x):
    return f"CASE WHEN regexp_full_match(replace(trim({x}), ' ', ''), '[0-9]{{5}}(-[0-9]{{4}})?') THEN replace(trim({x}), ' ', '') END"


def _name(x):
    return f"CASE WHEN trim({x}) <> '' THEN {_title_sql(f'trim({x})')} END"


def _address(x):
    return f"CASE WHEN trim({x}) <> '' THEN " + _abbrev_sql(_title_sql(f"regexp_replace(trim({x}), '\\s+', ' ', 'g')")) + " END"


def _key(*parts):
    return " || chr(31) || ".join(f"lower(coalesce({p}, ''))" if fold else f"coalesce({p}, '')" for p, fold in parts)


_LOC_KEY = lambda e: _key((f"{e}_address", 1), (f"{e}_city", 1), (f"{e}_state", 1), (f"{e}_zip", 0))
_FULL = lambda e: (f"CASE WHEN coalesce({e}_address, '') <> '' THEN concat_ws(', ', nullif({e}_address, ''), nullif({e}_city, ''), "  # noqa: E731
                   f"nullif({e}_state, ''), nullif({e}_zip, '')) END")
_GEO = lambda e: f"""  # noqa: E731
  LEFT JOIN zips z{e} ON {_FULL(e)} IS NOT NULL AND k.{e}_zip = z{e}.zip
  LEFT JOIN cities c{e} ON {_FULL(e)} IS NOT NULL AND lower(concat_ws(', ', nullif(k.{e}_city, ''), nullif(k.{e}_state, ''))) = c{e}.key""".replace("  # noqa: E731", "")
_AT = lambda e, c: f"CASE WHEN z{e}.zip IS NOT NULL THEN z{e}.{c} ELSE c{e}.{c} END"
PROCESSED_SQL = f"""
, st(k, code) AS (VALUES {_STATE_VALUES}),
cleaned AS (
  SELECT route_key, order_key, line_no, {_coalesce_parse('raw_date', _C6_FORMATS)} AS route_date,
    {_address("cast(driver_id AS VARCHAR) || ' Depot Rd'")} AS s_address, 'Hub City' AS s_city, 'IL' AS s_state,
    {_zip("lpad(cast(driver_id AS VARCHAR), 5, '0')")} AS s_zip,
    {_address('raw_address')} AS e_address, {_name('raw_city')} AS e_city, st.code AS e_state, {_zip('raw_zip')} AS e_zip,
    {_name('driver_name')} AS d_name, 'DL-' || lpad(cast(driver_id AS VARCHAR), 6, '0') AS d_license,
    {_name('customer_name')} AS c_name, {_phone('raw_phone')} AS c_phone, {_email('raw_email')} AS c_email,
    'TRK-' || cast(vehicle_id AS VARCHAR) AS v_plate,
    total_miles, empty_miles, fuel_consumed, revenue, other_costs, scheduled_start, scheduled_end, actual_start, actual_end
  FROM routes LEFT JOIN st ON upper(trim(raw_state)) = st.k),
kept AS (
  SELECT * FROM cleaned WHERE route_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY route_date, coalesce(d_license, ''),
    concat_ws('|', coalesce(s_address, ''), coalesce(s_city, ''), coalesce(s_state, ''), coalesce(s_zip, '')),
    concat_ws('|', coalesce(e_address, ''), coalesce(e_city, ''), coalesce(e_state, ''), coalesce(e_zip, ''))
    ORDER BY order_key, line_no, route_key) = 1),
zips AS (SELECT DISTINCT e_zip AS zip, 25 + cast(substr(e_zip, 1, 2) AS INTEGER) / cast(10 AS DOUBLE) AS lat,
                -80 - cast(substr(e_zip, 4, 2) AS INTEGER) / cast(10 AS DOUBLE) AS lon FROM cleaned WHERE ascii(e_zip) % 2 = 0),
cities(key, lat, lon) AS (VALUES ('hub city, il', cast(41.9 AS DOUBLE), cast(-87.6 AS DOUBLE)), ('chicago, il', 41.8, -87.7)),
located AS (
  SELECT k.*, cast(NULL AS DOUBLE) AS vehicle_mpg, cast(NULL AS DOUBLE) AS driver_rate,
         {_AT('s', 'lat')} AS start_lat, {_AT('s', 'lon')} AS start_lon, {_AT('e', 'lat')} AS end_lat, {_AT('e', 'lon')} AS end_lon
  FROM kept k {_GEO('s')} {_GEO('e')}),
{re.sub(r"[ ]rm([0-9])", r" pm\1", re.sub(r"^rm([0-9])", r"pm\1", METRICS_CTE.strip(), flags=re.M)).replace("FROM routes r", "FROM located r").replace("route_metrics AS", "processed AS")},
locs AS (SELECT k, row_number() OVER (ORDER BY k) AS id FROM (
  SELECT {_LOC_KEY('s')} AS k FROM kept UNION SELECT {_LOC_KEY('e')} FROM kept WHERE coalesce(e_address, '') <> '' OR coalesce(e_city, '') <> ''
    OR coalesce(e_state, '') <> '' OR coalesce(e_zip, '') <> '')),
custs AS (SELECT k, row_number() OVER (ORDER BY k) AS id FROM (SELECT DISTINCT {_key(('c_name', 1), ('c_phone', 0), ('c_email', 0))} AS k
  FROM kept WHERE coalesce(trim(c_name), '') <> '')),
drvs AS (SELECT k, row_number() OVER (ORDER BY k) AS id FROM (SELECT DISTINCT {_key(('d_name', 1), ('d_license', 0), ("''", 0))} AS k
  FROM kept WHERE coalesce(trim(d_name), '') <> '')),
vehs AS (SELECT k, row_number() OVER (ORDER BY k) AS id FROM (SELECT DISTINCT {_key(('v_plate', 1), ("''", 1))} AS k FROM kept WHERE coalesce(v_plate, '') <> ''))
SELECT p.route_key, p.route_date, p.start_lat, p.start_lon, p.end_lat, p.end_lon, p.total_hours, p.calculated_distance, p.total_costs, p.profit,
       p.efficiency_score, c.id AS customer_id, d.id AS driver_id, v.id AS vehicle_id, ls.id AS start_location_id, le.id AS end_location_id
FROM processed p LEFT JOIN custs c ON c.k = {_key(('p.c_name', 1), ('p.c_phone', 0), ('p.c_email', 0))}
LEFT JOIN drvs d ON d.k = {_key(('p.d_name', 1), ('p.d_license', 0), ("''", 0))} LEFT JOIN vehs v ON v.k = {_key(('p.v_plate', 1), ("''", 1))}
LEFT JOIN locs ls ON ls.k = {_LOC_KEY('p.s').replace('p.s_', 'p.s_')} LEFT JOIN locs le ON le.k = {_LOC_KEY('p.e')}"""


def _process_gazetteer(raw):
    """ZIP codes (some left out) and two cities."""
    z = P.clean_nested_record(raw).select(F.col("end_location.zip_code").alias("zip")).filter(F.ascii("zip") % 2 == 0).distinct()
    zips = z.select(F.lit(J.ZIP).alias("level"), F.col("zip").alias("key"), (25 + F.substring("zip", 1, 2).cast("int") / 10.0).alias("latitude"),
                    (-80 - F.substring("zip", 4, 2).cast("int") / 10.0).alias("longitude"))
    cities = F.array(*[F.struct(F.lit(J.CITY_STATE).alias("level"), F.lit(k).alias("key"), F.lit(a).alias("latitude"), F.lit(o).alias("longitude"))
                       for k, a, o in (("hub city, il", 41.9, -87.6), ("chicago, il", 41.8, -87.7))])
    return zips.unionByName(raw.sparkSession.range(1).select(F.inline(cities)))


PROCESSED = ["route_key", "route_date", "start_lat", "start_lon", "end_lat", "end_lon", "total_hours", "calculated_distance", "total_costs",
             "profit", "efficiency_score", "customer_id", "driver_id", "vehicle_id", "start_location_id", "end_location_id"]


@register("R2_process_routes", with_routes(PROCESSED_SQL))
def r2_process(spark, sf):
    """The whole job over raw nested routes; the stored routes with metrics and ids."""
    raw = raw_nested(spark, sf)
    store = ST.Store(spark, scratch_path(spark, "r2-store"))
    JB.process_routes(spark, raw, _process_gazetteer(raw), store, ORDER)
    return store.read("routes").select(*PROCESSED)


@register("R3_process_flat_file", with_routes("""
SELECT count(*) AS records, count(DISTINCT route_key) AS unique_routes,
       count(*) FILTER (WHERE customer_name IS NOT NULL) AS with_customer,
       count(*) FILTER (WHERE route_date IS NOT NULL) AS with_date FROM routes"""))
def r3_flat(spark, sf):
    """A flat landed CSV becomes nested records (R3), then deduplicated."""
    d = scratch_path(spark, "r3-csv")
    _landed_csv(spark, sf).write.option("header", True).csv(d)
    flat = S.read_csv_text(spark, d).withColumnsRenamed(
        {"Route ID": "route_id", "Date": "route_date", "Driver": "driver_name", "Customer": "customer_name"})
    nested = JB.flat_to_nested(flat)
    from ..operators import entity as U
    kept = U.first_per_key(nested, ["route_id"], ["route_id"])
    return kept.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("route_id").alias("unique_routes"),
                    F.count("customer.name").alias("with_customer"), F.count("route_date").alias("with_date"))


@register("S10_message_scan", """
SELECT conv_id * 1000 + turn AS email_id, 'Update ' || cast(turn AS VARCHAR) || ' from ' || role AS subject
FROM conversations
WHERE DATE '2024-01-01' + CAST(conv_id % 28 AS INTEGER) >= DATE '2024-01-10'
  AND position('assistant@' IN lower(role || '@example.com')) > 0
  AND (position('update 1' IN lower('Update ' || cast(turn AS VARCHAR) || ' from ' || role)) > 0
       OR position('update 3' IN lower('Update ' || cast(turn AS VARCHAR) || ' from ' || role)) > 0)
  AND turn % 2 <> 0""")
def s10(spark, sf):
    """A landed message table (from conversations) scanned with the mailbox
    predicates: since a date, sender in a list, subject containing any of a
    list (case-insensitive), unread only."""
    c = table(spark, sf, "conversations")
    msgs = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("email_id"),
                    F.concat(F.lit("Update "), F.col("turn").cast("string"), F.lit(" from "), F.col("role")).alias("subject"),
                    F.concat(F.col("role"), F.lit("@example.com")).alias("sender"),
                    F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 28).cast("int")).alias("date"),
                    (F.col("turn") % 2 == 0).alias("seen"), F.col("text").alias("body"))
    return S.scan_messages(msgs, since="2024-01-10", senders=["assistant@"], subjects=["update 1", "update 3"]) \
        .select("email_id", "subject")


TEMPLATE = {"kpis": MONTHLY_KPIS, "formulas": MONTHLY_FORMULAS}


@register("E4_report_template", with_routes(f"""
SELECT *, {r2('(total_revenue - total_costs) / nullif(total_revenue, 0) * 100')} AS profit_margin_pct,
       {r2('total_revenue / nullif(total_routes, 0)')} AS revenue_per_route,
       {r2('total_costs / nullif(total_miles, 0)')} AS cost_per_mile
FROM ({A18_SQL})"""))
def e4(spark, sf):
    """A report template given as a spec, compiled to DataFrames."""
    return JB.compile_template(report_fact(spark, sf, *MONTH), TEMPLATE)["kpis"]


@register("E4_report_template_all", with_routes(f"""
SELECT *, {r2('(total_revenue - total_costs) / nullif(total_revenue, 0) * 100')} AS profit_margin_pct,
       {r2('total_revenue / nullif(total_routes, 0)')} AS revenue_per_route,
       {r2('total_costs / nullif(total_miles, 0)')} AS cost_per_mile
FROM ({A18_ALL_SQL})"""))
def e4_all(spark, sf):
    """The same template over the whole fact."""
    return JB.compile_template(report_fact(spark, sf), TEMPLATE)["kpis"]
