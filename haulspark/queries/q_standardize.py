"""Record standardisation: P1-P23, E3, E4 over landed-record shapes derived
from the routes view (file, API and message feeds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import standardize as P
from ..plans.report_fact import report_fact
from ..plans.routes_view import routes
from ..sources.tables import table
from .registry import register
from .sqlbase import r2, with_routes

AS_OF = "2024-01-31 00:00:00"
_NUM = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"
_DATE_FMTS = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S",
              "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f"]


def s_float(x):
    return f"CASE WHEN regexp_full_match(trim({x}), '{_NUM}') THEN cast(trim({x}) AS DOUBLE) END"


def s_iso(x):
    return "strftime(coalesce(" + ", ".join(f"try_strptime({x}, '{f}')" for f in _DATE_FMTS) + "), '%Y-%m-%dT%H:%M:%S')"


def s_text(x):
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '') END"


# ---------------------------------------------------------------- landed shapes
def file_feed(spark, sf):
    r = routes(spark, sf, ("route_key", "raw_date", "driver_name", "vehicle_id", "customer_name",
                           "total_miles", "raw_amount", "status"))
    return r.select(F.col("route_key").alias("Route ID"), F.col("raw_date").alias("Date"),
                    F.concat(F.lit("  "), F.col("driver_name"), F.lit("  ")).alias("Driver"),
                    F.col("vehicle_id").cast("string").alias("Truck"), F.col("customer_name").alias("Customer"),
                    F.col("total_miles").cast("string").alias("Miles"), F.col("raw_amount").alias("Revenue"),
                    F.col("status").alias("Status"))


FILE_FEED_SQL = """
file_feed AS (SELECT route_key AS "Route ID", raw_date AS "Date", '  ' || driver_name || '  ' AS "Driver",
                     cast(vehicle_id AS VARCHAR) AS "Truck", customer_name AS "Customer",
                     cast(total_miles AS VARCHAR) AS "Miles", raw_amount AS "Revenue", status AS "Status"
              FROM routes)"""


def api_feed(spark, sf):
    r = routes(spark, sf, ("route_key", "route_date", "driver_id", "customer_name", "total_miles", "revenue",
                           "status"))
    return r.select(F.col("route_key").alias("trip_id"), F.col("route_date").cast("string").alias("dispatch_date"),
                    F.col("driver_id").cast("string").alias("driver_id"), F.col("customer_name").alias("shipper"),
                    F.col("total_miles").cast("string").alias("total_distance"),
                    F.col("revenue").cast("string").alias("total_pay"), F.col("status").alias("load_status"))


API_FEED_SQL = """
api_feed AS (SELECT route_key AS trip_id, cast(route_date AS VARCHAR) AS dispatch_date,
                    cast(driver_id AS VARCHAR) AS driver_id, customer_name AS shipper,
                    cast(total_miles AS VARCHAR) AS total_distance, cast(revenue AS VARCHAR) AS total_pay,
                    status AS load_status FROM routes)"""


def email_feed(spark, sf):
    r = routes(spark, sf, ("route_key", "raw_date", "driver_name", "customer_name", "total_miles", "route_date"))
    return r.select(F.col("route_key").alias("job_id"),
                    F.concat(F.lit("Mon, "), F.col("route_date").cast("string")).alias("date"),
                    F.col("raw_date").alias("pickup_date"), F.col("driver_name").alias("driver"),
                    F.col("customer_name").alias("shipper"),
                    F.format_number("total_miles", 1).alias("miles"),
                    F.concat(F.lit("Route "), F.col("route_key")).alias("subject"),
                    F.lit("dispatch@example.com").alias("sender"))


EMAIL_FEED_SQL = """
email_feed AS (SELECT route_key AS job_id, 'Mon, ' || cast(route_date AS VARCHAR) AS date,
                      raw_date AS pickup_date, driver_name AS driver, customer_name AS shipper,
                      format('{:,.1f}', total_miles) AS miles, 'Route ' || route_key AS subject,
                      'dispatch@example.com' AS sender FROM routes)"""


def _w(cte: str, body: str) -> str:
    return with_routes(", " + cte.strip() + "\n" + body)


# ---------------------------------------------------------------- P1-P4
def messy(spark, sf):
    r = routes(spark, sf, ("route_key", "route_date", "driver_name", "total_miles", "revenue", "status"))
    return r.select(F.concat(F.lit(" "), F.col("route_key"), F.lit(" ")).alias(" Route ID "),
                    F.col("route_date").cast("string").alias("Trip-Date"),
                    F.col("driver_name").alias("DRIVER NAME"), F.col("total_miles").alias("Miles"),
                    F.col("revenue").alias("Rate"), F.concat(F.col("status"), F.lit(" ")).alias("Status"))


@register("P1_normalize_columns", with_routes("""
SELECT trim(' ' || route_key || ' ') AS route_id, trim(cast(route_date AS VARCHAR)) AS trip_date,
       trim(driver_name) AS driver_name, total_miles AS miles, revenue AS rate, trim(status || ' ') AS status
FROM routes"""))
def p1(spark, sf):
    return P.normalize_columns(messy(spark, sf))


P2_MAPPING = {"trip_date": "route_date", "miles": "total_miles", "rate": "revenue"}


@register("P2_column_mapping", with_routes("""
SELECT route_key AS route_id, cast(route_date AS VARCHAR) AS route_date, driver_name, total_miles, revenue, status
FROM routes"""))
def p2(spark, sf):
    return P.apply_mapping(P.normalize_columns(messy(spark, sf)), P2_MAPPING)


@register("P3_required_columns", with_routes("""
SELECT route_key AS route_id, cast(route_date AS VARCHAR) AS route_date, total_miles FROM routes"""))
def p3(spark, sf):
    """The schema check runs on the mapped columns, before any job."""
    df = P.require_columns(P.apply_mapping(P.normalize_columns(messy(spark, sf)), P2_MAPPING),
                           ["route_id", "route_date", "total_miles"])
    return df.select("route_id", "route_date", "total_miles")


@register("P4_required_field_errors", with_routes("""
SELECT route_key AS record_key,
       concat_ws('; ', CASE WHEN customer_name IS NULL OR trim(customer_name) = '' THEN 'Missing required field: customer_name' END,
                       CASE WHEN fuel_consumed IS NULL THEN 'Missing required field: fuel_consumed' END) AS errors,
       NOT (customer_name IS NULL OR fuel_consumed IS NULL) AS is_valid
FROM routes"""))
def p4(spark, sf):
    r = routes(spark, sf, ("route_key", "customer_name", "fuel_consumed"))
    e = P.required_errors(r, ["customer_name", "fuel_consumed"])
    return e.select(F.col("route_key").alias("record_key"), F.array_join("errors", "; ").alias("errors"), "is_valid")


# ---------------------------------------------------------------- P5-P7, P12
STD_COLS = ["route_id", "route_date", "driver_name", "customer_name", "total_miles", "revenue", "status"]


@register("P5_file_aliases", _w(FILE_FEED_SQL, f"""
SELECT "Route ID" AS route_id, {s_iso('"Date"')} AS route_date, {s_text('"Driver"')} AS driver_name,
       {s_text('"Customer"')} AS customer_name, {s_float('"Miles"')} AS total_miles,
       {s_float('"Revenue"')} AS revenue, "Status" AS status FROM file_feed"""))
def p5(spark, sf):
    return P.standardize(file_feed(spark, sf), P.FILE_ALIASES, "file", "landing", AS_OF).select(*STD_COLS)


@register("P6_api_aliases", _w(API_FEED_SQL, f"""
SELECT trip_id AS route_id, {s_iso('dispatch_date')} AS route_date, driver_id AS driver_name,
       {s_text('shipper')} AS customer_name, {s_float('total_distance')} AS total_miles,
       {s_float('total_pay')} AS revenue, load_status AS status FROM api_feed"""))
def p6(spark, sf):
    return P.standardize(api_feed(spark, sf), P.API_ALIASES, "api", "tms", AS_OF).select(*STD_COLS)


@register("P7_email_aliases", _w(EMAIL_FEED_SQL, f"""
SELECT job_id AS route_id, {s_iso('pickup_date')} AS route_date, {s_text('driver')} AS driver_name,
       {s_text('shipper')} AS customer_name, {s_float('miles')} AS total_miles,
       date AS email_date, subject AS email_subject, sender AS email_sender FROM email_feed"""))
def p7(spark, sf):
    """Message records: the header date stays metadata (email_date); miles
    written with a thousands comma do not convert (NULL), as in the source."""
    s = P.standardize(email_feed(spark, sf), P.EMAIL_ALIASES, "email", "inbox", AS_OF, P.EMAIL_METADATA)
    return s.select("route_id", "route_date", "driver_name", "customer_name", "total_miles",
                    "email_date", "email_subject", "email_sender")


@register("P12_provenance", _w(FILE_FEED_SQL, f"""
SELECT 'file' AS source, 'landing' AS source_name, TIMESTAMP '{AS_OF}' AS collected_at,
       "Route ID" AS route_id, json_object('Route ID', "Route ID", 'Date', "Date", 'Driver', "Driver",
         'Truck', "Truck", 'Customer', "Customer", 'Miles', "Miles", 'Revenue', "Revenue", 'Status', "Status")::VARCHAR
         AS raw_data
FROM file_feed"""))
def p12(spark, sf):
    s = P.standardize(file_feed(spark, sf), P.FILE_ALIASES, "file", "landing", AS_OF)
    return s.select("source", "source_name", "collected_at", "route_id", "raw_data")


# ---------------------------------------------------------------- P8-P11, P13
@register("P8_manual_record", with_routes(f"""
SELECT 'manual_entry' AS source, 'desk' AS source_name, TIMESTAMP '{AS_OF}' AS collected_at,
       json_object('route_id', route_key, 'route_date', raw_date, 'driver_name', '  ' || driver_name || '  jr ',
                   'revenue', raw_amount, 'status', status)::VARCHAR AS raw_data,
       route_key AS route_id, coalesce({s_iso('raw_date')}, raw_date) AS route_date, driver_name || ' jr' AS driver_name,
       {s_float('raw_amount')} AS revenue, status, cast(NULL AS VARCHAR) AS notes FROM routes"""))
def p8(spark, sf):
    r = routes(spark, sf, ("route_key", "raw_date", "driver_name", "raw_amount", "status"))
    m = P.manual_record(r.select(F.col("route_key").alias("route_id"), F.col("raw_date").alias("route_date"),
                                 F.concat(F.lit("  "), "driver_name", F.lit("  jr ")).alias("driver_name"),
                                 F.col("raw_amount").alias("revenue"), "status"), "desk", AS_OF)
    return m.select("source", "source_name", "collected_at", "raw_data", "route_id", "route_date", "driver_name",
                    "revenue", "status", "notes")


@register("P9_manual_clean", with_routes(f"""
SELECT 'manual_entry' AS source, TIMESTAMP '{AS_OF}' AS entry_timestamp, route_key AS route_id,
       {s_iso('raw_date')} AS route_date, driver_name || ' jr' AS driver_name, {s_float('raw_amount')} AS revenue,
       total_miles, line_no, CASE WHEN customer_name IS NOT NULL THEN 'for ' || customer_name END AS notes
FROM routes"""))
def p9(spark, sf):
    """Manual records: names normalised, values typed, text folded."""
    r = routes(spark, sf, ("route_key", "raw_date", "driver_name", "raw_amount", "total_miles", "line_no",
                           "customer_name"))
    return P.manual_clean(r.select(
        F.concat(F.col("route_key"), F.lit(" ")).alias("Route-ID"), F.col("raw_date").alias("Route Date"),
        F.concat("driver_name", F.lit("   jr")).alias("Driver Name"), F.col("raw_amount").alias(" Revenue"),
        F.col("total_miles").alias("Total Miles"), F.col("line_no").alias("Line No"),
        F.concat(F.lit("for  "), "customer_name").alias("Notes")), AS_OF)


@register("P10_manual_type_checks", with_routes(f"""
SELECT route_key, concat_ws('; ',
  CASE WHEN line_no IN (2, 5) THEN 'Record ' || line_no || ': Route ID must be a string' END,
  CASE WHEN line_no IN (1, 4) AND raw_date IS NOT NULL AND {s_iso('raw_date')} IS NULL
       THEN 'Record ' || line_no || ': Invalid date format for route_date' END,
  CASE WHEN line_no = 7 THEN 'Record ' || line_no || ': Revenue must be numeric' END,
  CASE WHEN line_no = 7 THEN 'Record ' || line_no || ': Load weight must be numeric' END) AS errors
FROM routes"""))
def p10(spark, sf):
    """Manual-entry JSON by line number: a date spelling (1, 4), a numeric route
    id (2, 5), miles as text, which passes (3, 6), an object and a list in place of
    numbers (7)."""
    r = routes(spark, sf, ("route_key", "line_no", "raw_date", "driver_id"))
    key, n = F.col("route_key").alias("route_id"), F.col("line_no")
    doc = (F.when(n.isin(1, 4), F.to_json(F.struct(key, F.col("raw_date").alias("route_date"))))
           .when(n.isin(2, 5), F.to_json(F.struct(F.col("driver_id").alias("route_id"))))
           .when(n == 7, F.to_json(F.struct(key, F.struct(F.col("driver_id").alias("amount")).alias("revenue"),
                                            F.array(F.col("driver_id")).alias("load_weight"))))
           .otherwise(F.to_json(F.struct(key, F.lit("12.5").alias("total_miles")))))
    parsed = r.select("route_key", "line_no", F.parse_json(doc).alias("doc"))
    return parsed.select("route_key", F.array_join(P.manual_type_errors(F.col("doc"), n), "; ").alias("errors"))


# What the landed records of P11 lack, by line number (field -> condition).
_P11_GAPS = {"vehicle_id": "line_no = 1", "driver_id": "line_no = 2", "driver_name": "line_no = 3",
             "start_time": "line_no = 4", "delivery_date": "line_no = 5", "date": "line_no = 6",
             "sender": "line_no % 2 = 0", "revenue": "line_no = 7", "route_date": "line_no = 1"}


@register("P11_required_sets", with_routes("""
SELECT count(*) AS records,
       count(*) FILTER (WHERE line_no = 6) AS generic_api_missing,
       count(*) FILTER (WHERE line_no IN (1, 2, 4)) AS eld_missing,
       count(*) FILTER (WHERE line_no IN (5, 7)) AS tms_missing,
       count(*) FILTER (WHERE line_no IN (1, 3)) AS dispatch_missing,
       count(*) FILTER (WHERE line_no = 6) AS file_missing,
       count(*) FILTER (WHERE line_no % 2 = 0) AS email_missing,
       count(*) FILTER (WHERE line_no = 1) AS manual_missing
FROM routes"""))
def p11(spark, sf):
    """Every source kind's required set on records with gaps: a field that is
    blank in every other gap, NULL in the rest."""
    r = routes(spark, sf, ("route_key", "line_no", "vehicle_id", "driver_id", "driver_name", "total_miles", "revenue",
                           "route_date", "scheduled_start"))
    key, day = F.col("route_key"), F.col("route_date").cast("string")
    fields = {"route_id": key, "load_id": key, "trip_id": key, "date": day, "pickup_date": day, "delivery_date": day,
              "route_date": day, "start_time": F.col("scheduled_start").cast("string"), "total_miles": F.col("total_miles"),
              "vehicle_id": F.col("vehicle_id").cast("string"), "driver_id": F.col("driver_id").cast("string"),
              "driver_name": F.col("driver_name"), "revenue": F.col("revenue").cast("string"),
              "subject": F.concat(F.lit("Route "), key), "sender": F.lit("dispatch@example.com")}
    for k, (f, gap) in enumerate(_P11_GAPS.items()):
        fields[f] = F.when(F.expr(gap), F.lit(" " if k % 2 else None).cast("string")).otherwise(fields[f])
    e = r.select(*[v.alias(f) for f, v in fields.items()])
    for kind, required in P.REQUIRED_FIELDS.items():
        e = P.required_errors(e, required, f"{kind}_errors")
    return e.agg(F.count(F.lit(1)).alias("records"), *[
        F.count_if(F.size(f"{kind}_errors") > 0).cast("long").alias(f"{kind}_missing") for kind in P.REQUIRED_FIELDS])


@register("P13_batch_standardize", _w(FILE_FEED_SQL + "," + API_FEED_SQL.strip() + "," + EMAIL_FEED_SQL.strip(), f"""
, s AS (SELECT 'file' AS source, "Route ID" AS route_id, {s_iso('"Date"')} AS route_date FROM file_feed
        UNION ALL SELECT 'api', trip_id, {s_iso('dispatch_date')} FROM api_feed
        UNION ALL SELECT 'email', job_id, {s_iso('pickup_date')} FROM email_feed)
SELECT source, count(*) AS records, count(*) FILTER (WHERE route_id IS NOT NULL AND route_date IS NOT NULL) AS valid_records,
       count(*) FILTER (WHERE NOT (route_id IS NOT NULL AND route_date IS NOT NULL)) AS error_records,
       CASE WHEN count(*) = 0 THEN 'NO_DATA'
            WHEN count(*) FILTER (WHERE NOT (route_id IS NOT NULL AND route_date IS NOT NULL)) = 0 THEN 'SUCCESS'
            WHEN count(*) FILTER (WHERE route_id IS NOT NULL AND route_date IS NOT NULL) = 0 THEN 'FAILED'
            ELSE 'PARTIAL' END AS outcome
FROM s GROUP BY source""".replace("\n, s AS", ", s AS", 1)))
def p13(spark, sf):
    """Clean -> check -> standardise per feed; outcome code per batch."""
    feeds = [P.standardize(file_feed(spark, sf), P.FILE_ALIASES, "file", "landing", AS_OF),
             P.standardize(api_feed(spark, sf), P.API_ALIASES, "api", "tms", AS_OF),
             P.standardize(email_feed(spark, sf), P.EMAIL_ALIASES, "email", "inbox", AS_OF, P.EMAIL_METADATA)]
    allf = feeds[0].select("source", "route_id", "route_date")
    for f in feeds[1:]:
        allf = allf.unionByName(f.select("source", "route_id", "route_date"))
    valid = F.col("route_id").isNotNull() & F.col("route_date").isNotNull()
    return P.batch_outcome(allf, valid, ["source"])


# ---------------------------------------------------------------- P14-P17
@register("P14_legacy_mapping", """
SELECT o_orderkey AS route_id, o_orderdate AS route_date, o_totalprice AS revenue FROM orders""")
def p14(spark, sf):
    """A legacy order table mapped {current: legacy}; unmapped columns drop."""
    return P.legacy_mapping(table(spark, sf, "orders"),
                            {"route_id": "o_orderkey", "route_date": "o_orderdate", "revenue": "o_totalprice"})


@register("P15_location_subfields", with_routes("""
SELECT route_key, CASE WHEN line_no % 3 = 2 THEN 'x ' || raw_address ELSE raw_address END AS address,
       raw_city AS city, raw_state AS state, raw_zip AS zip_code,
       CASE WHEN line_no % 3 = 0 THEN end_lat ELSE end_lat + 1 END AS latitude,
       CASE WHEN line_no % 3 = 2 THEN end_lon + 1 ELSE end_lon END AS longitude FROM routes"""))
def p15(spark, sf):
    """Every alias occurs, and where two have a value the first must win."""
    r = routes(spark, sf, ("route_key", "line_no", "raw_address", "raw_city", "raw_state", "raw_zip", "end_lat", "end_lon"))

    def only(k, c):
        return F.when(F.col("line_no") % 3 == k, F.col(c))

    loc = {"addr": F.when(F.col("line_no") % 3 != 1, F.concat(F.lit("x "), "raw_address")),
           "street_address": only(1, "raw_address"), "street": only(0, "raw_address"),
           "municipality": F.when(F.col("line_no") % 3 != 0, F.col("raw_city")), "city": only(0, "raw_city"),
           "region": only(2, "raw_state"), "province": only(1, "raw_state"), "state": only(0, "raw_state"),
           "zipcode": only(2, "raw_zip"), "postal_code": only(1, "raw_zip"), "zip": only(0, "raw_zip"),
           "latitude": F.col("end_lat") + 1, "lat": only(0, "end_lat"),
           "lng": F.col("end_lon") + 1, "longitude": only(1, "end_lon"), "lon": only(0, "end_lon")}
    s = r.select("route_key", F.struct(*[v.alias(k) for k, v in loc.items()]).alias("loc"))
    return P.alias_struct_fields(s, "loc").select("route_key", "loc.address", "loc.city", "loc.state", "loc.zip_code",
                                                  "loc.latitude", "loc.longitude")


_C6 = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y",
       "%m-%d-%Y %H:%M:%S", "%m-%d-%Y %H:%M", "%m-%d-%Y", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y/%m/%d"]


def _c6(x):
    return "coalesce(" + ", ".join(f"try_strptime({x}, '{f}')" for f in _C6) + ")"


def _c8(x):
    y = f"regexp_replace(trim({x}), '[,$%]', '', 'g')"
    return f"CASE WHEN regexp_full_match({y}, '{_NUM}') THEN cast({y} AS DOUBLE) END"


@register("P16_type_normalization", with_routes(f"""
SELECT {_c6('raw_date')} AS pickup_date, {_c8('raw_amount')} AS pay_rate, {_c8('raw_amount')} AS fuel_consumed,
       trim(raw_amount) AS fuel_score, end_lat AS latitude, line_no, trim(' ' || route_key) AS reference
FROM routes"""))
def p16(spark, sf):
    """``fuel_score`` holds no keyword and stays text; ``line_no`` keeps its type."""
    r = routes(spark, sf, ("route_key", "line_no", "raw_date", "raw_amount", "end_lat"))
    return P.normalize_types(r.select(
        F.col("raw_date").alias("pickup_date"), F.col("raw_amount").alias("pay_rate"),
        F.col("raw_amount").alias("fuel_consumed"), F.concat("raw_amount", F.lit(" ")).alias("fuel_score"),
        F.col("end_lat").alias("latitude"), "line_no", F.concat(F.lit(" "), F.col("route_key")).alias("reference")))


@register("P17_clean_flat_table", with_routes(f"""
SELECT route_key,
  CASE WHEN length(regexp_replace(raw_phone, '[^0-9]', '', 'g')) = 10
         THEN '(' || substr(regexp_replace(raw_phone, '[^0-9]', '', 'g'), 1, 3) || ') '
              || substr(regexp_replace(raw_phone, '[^0-9]', '', 'g'), 4, 3) || '-'
              || substr(regexp_replace(raw_phone, '[^0-9]', '', 'g'), 7, 4)
       WHEN length(regexp_replace(raw_phone, '[^0-9]', '', 'g')) = 11 AND regexp_replace(raw_phone, '[^0-9]', '', 'g') LIKE '1%'
         THEN '(' || substr(regexp_replace(raw_phone, '[^0-9]', '', 'g'), 2, 3) || ') '
              || substr(regexp_replace(raw_phone, '[^0-9]', '', 'g'), 5, 3) || '-'
              || substr(regexp_replace(raw_phone, '[^0-9]', '', 'g'), 8, 4) END AS contact_phone,
  CASE WHEN regexp_full_match(replace(trim(raw_zip), ' ', ''), '[0-9]{{5}}(-[0-9]{{4}})?')
       THEN replace(trim(raw_zip), ' ', '') END AS zip_code,
  {_c6('raw_date')} AS ship_date, {_c8('raw_amount')} AS fuel_cost
FROM routes"""))
def p17(spark, sf):
    r = routes(spark, sf, ("route_key", "raw_phone", "raw_zip", "raw_date", "raw_amount"))
    return P.clean_flat_table(r.select("route_key", F.col("raw_phone").alias("contact_phone"),
                                       F.col("raw_zip").alias("zip_code"), F.col("raw_date").alias("ship_date"),
                                       F.col("raw_amount").alias("fuel_cost")))


# ---------------------------------------------------------------- P18-P23
def raw_nested(spark, sf):
    """The whole nested route record, landed as text."""
    from .q_entity import nested_routes
    numbers = [c for c in P.NESTED_NUMBERS if c not in ("load_value", "average_speed", "fuel_cost")]
    times = {f"{c}_time": c for c in ("scheduled_start", "actual_start", "scheduled_end", "actual_end")}
    need = (*numbers, *times.values(), "raw_date", "raw_amount", "load_type_raw", "status")
    more = [*[F.col(c).cast("string").alias(c) for c in numbers],
            F.col("raw_amount").alias("fuel_cost"), F.col("raw_amount").alias("load_value"),
            (F.col("total_miles") / 8.0).cast("string").alias("average_speed"),
            *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(t) for t, c in times.items()],
            F.col("raw_date"), F.concat(F.lit(" "), "load_type_raw").alias("load_type"),
            F.when(F.col("load_type_raw") == "fragile", F.lit(" handle with care ")).alias("special_requirements"),
            F.concat("status", F.lit(" ")).alias("status"), F.lit("").alias("notes")]
    return nested_routes(spark, sf, need, more).withColumn("route_date", F.col("raw_date")).drop("raw_date")


@register("P18_clean_nested_record")
def p18(spark, sf):
    """The whole nested record cleaned field by field (C1-C8 on members); its cleaned
    fields are oracle-checked one by one in C1-C11 and together in R2."""
    return P.clean_nested_record(raw_nested(spark, sf)).drop("order_key", "line_no")



@register("P19_enum_parse", with_routes("""
SELECT route_key, CASE WHEN lower(trim(load_type_raw)) IN ('general', 'refrigerated', 'hazardous', 'oversized', 'fragile')
                       THEN lower(trim(load_type_raw)) ELSE 'general' END AS load_type,
       CASE WHEN lower(trim(status)) IN ('scheduled', 'in_progress', 'completed', 'cancelled', 'delayed')
            THEN lower(trim(status)) ELSE 'scheduled' END AS status
FROM routes"""))
def p19(spark, sf):
    r = routes(spark, sf, ("route_key", "load_type_raw", "status"))
    return r.select("route_key", P.enum_or_default("load_type_raw", P.LOAD_TYPES, "general").alias("load_type"),
                    P.enum_or_default("status", P.ROUTE_STATUSES, "scheduled").alias("status"))


# The route record (P20), in order.
ROUTE_FIELDS = ["route_date", "load_weight", "load_type", "load_value", "special_requirements",
                "scheduled_start_time", "actual_start_time", "scheduled_end_time", "actual_end_time", "total_miles",
                "empty_miles", "fuel_consumed", "average_speed", "revenue", "fuel_cost", "toll_cost", "driver_pay",
                "other_costs", "status", "notes"]


@register("P20_route_projection", with_routes("""
SELECT route_key, route_date, load_weight, CASE WHEN lower(trim(load_type_raw)) IN
         ('general', 'refrigerated', 'hazardous', 'oversized', 'fragile') THEN lower(trim(load_type_raw))
         ELSE 'general' END AS load_type,
       CASE WHEN line_no % 2 = 0 THEN revenue END AS load_value,
       CASE WHEN load_type_raw = 'fragile' THEN 'handle with care' ELSE '' END AS special_requirements,
       scheduled_start AS scheduled_start_time, actual_start AS actual_start_time, scheduled_end AS scheduled_end_time,
       actual_end AS actual_end_time, total_miles, empty_miles, fuel_consumed,
       CASE WHEN line_no % 3 = 0 THEN total_miles / 8.0 END AS average_speed, revenue, fuel_cost, toll_cost, driver_pay,
       other_costs, status, '' AS notes FROM routes"""))
def p20(spark, sf):
    """Cleaned records -> route records; some lack a value, all lack notes."""
    r = routes(spark, sf, ("route_key", "line_no", "route_date", "load_weight", "load_type_raw", "scheduled_start",
                           "actual_start", "scheduled_end", "actual_end", "total_miles", "empty_miles", "fuel_consumed",
                           "revenue", "fuel_cost", "toll_cost", "driver_pay", "other_costs", "status"))
    n = F.col("line_no")
    landed = r.withColumns({
        "load_type": F.col("load_type_raw"), "load_value": F.when(n % 2 == 0, F.col("revenue")),
        "special_requirements": F.when(F.col("load_type_raw") == "fragile", F.lit("handle with care")),
        "average_speed": F.when(n % 3 == 0, F.col("total_miles") / 8.0)}).withColumnsRenamed({
            "scheduled_start": "scheduled_start_time", "actual_start": "actual_start_time",
            "scheduled_end": "scheduled_end_time", "actual_end": "actual_end_time"})
    return P.route_projection(landed, ["route_key", *ROUTE_FIELDS])


# A report template table spec (field, display name), in column order.
DRIVER_TABLE_SPEC = [("route_date", "Date"), ("driver_name", "Driver"), ("customer_name", "Customer"),
                     ("total_miles", "Miles"), ("notes", "Notes")]


@register("P21_report_data_table", with_routes("""
SELECT coalesce(cast(route_date AS VARCHAR), '') AS "Date", coalesce(driver_name, '') AS "Driver",
       coalesce(customer_name, '') AS "Customer", coalesce(cast(total_miles AS VARCHAR), '') AS "Miles", '' AS "Notes"
FROM routes"""))
def p21(spark, sf):
    r = routes(spark, sf, ("route_date", "driver_name", "customer_name", "total_miles"))
    return P.report_table(r, DRIVER_TABLE_SPEC)


DAY = ("1997-06-02", "1997-06-02")


@register("P22_daily_route_summary", with_routes(f"""
SELECT route_key, driver_name, vehicle_info, customer_name, total_miles, revenue, total_costs, status
FROM route_metrics WHERE route_date = DATE '{DAY[0]}'"""))
def p22(spark, sf):
    f = report_fact(spark, sf, *DAY)
    return f.select("route_key", "driver_name", "vehicle_info", "customer_name", "total_miles", "revenue",
                    "total_costs", "status")


@register("P23_fill_calculated", with_routes(f"""
SELECT route_key,
  CASE WHEN coalesce(fuel_cost, 0) = 0 THEN est_fuel_cost ELSE fuel_cost END AS fuel_cost,
  CASE WHEN coalesce(toll_cost, 0) = 0 THEN est_toll_cost ELSE toll_cost END AS toll_cost,
  CASE WHEN coalesce(driver_pay, 0) = 0 THEN est_driver_pay ELSE driver_pay END AS driver_pay
FROM route_metrics"""))
def p23(spark, sf):
    f = report_fact(spark, sf)
    out = P.fill_missing(f, {"fuel_cost": "est_fuel_cost", "toll_cost": "est_toll_cost",
                             "driver_pay": "est_driver_pay"})
    return out.select("route_key", "fuel_cost", "toll_cost", "driver_pay")


# ---------------------------------------------------------------- E3: declarative extraction/alias config
E3_CONFIG = {"mapping": {"Route ID": "route_id", "Date": "route_date", "Miles": "total_miles"},
             "required": ["route_id", "route_date"]}


@register("E3_declarative_config", _w(FILE_FEED_SQL, """
SELECT "Route ID" AS route_id, "Date" AS route_date, "Miles" AS total_miles, "Driver", "Truck", "Customer",
       "Revenue", "Status" FROM file_feed"""))
def e3(spark, sf):
    """A collector configured by a dict (mapping + required columns)."""
    df = P.apply_mapping(file_feed(spark, sf), E3_CONFIG["mapping"])
    return P.require_columns(df, E3_CONFIG["required"])


# A message collector's patterns.
E3_PATTERNS = {"route_id": r"Route\s*ID:\s*([A-Z0-9]+)", "pickup_date": r"Pickup\s*Date:\s*([0-9\/\-]+)",
               "driver_name": r"Driver:\s*([A-Za-z\s]+)", "total_miles": r"Miles:\s*([0-9,\.]+)"}
E3_MESSAGES = {"type": "email", "parsing_patterns": {"route_info": {"type": "key_value", "patterns": E3_PATTERNS}},
               "required_columns": ["route_id"]}
_E3_BODY = """CASE line_no % 4 WHEN 0 THEN 'nothing to see' WHEN 1 THEN 'Miles: ' || cast(line_no AS VARCHAR) || ',5'
  ELSE 'Route ID: A' || cast(order_key AS VARCHAR) || chr(10) || 'pickup date: ' || strftime(route_date, '%m/%d/%Y') || chr(10)
       || 'Driver:  Ann  of' || chr(10) || ' Ames ' || cast(line_no AS VARCHAR) END"""


@register("E3_extraction_rules", with_routes(f"""
SELECT route_key, {', '.join(f"nullif(trim(regexp_replace(regexp_extract(body, '(?im){p}', 1), '\\s+', ' ', 'g')), '') AS {n}" for n, p in E3_PATTERNS.items())}
FROM (SELECT route_key, line_no, {_E3_BODY} AS body FROM routes) WHERE line_no % 4 <> 0"""))
def e3_messages(spark, sf):
    """Fields pulled out of message bodies by the patterns of a collector's configuration."""
    r = routes(spark, sf, ("route_key", "order_key", "line_no", "route_date"))
    k, line = F.col("line_no") % 4, F.col("line_no").cast("string")
    body = (F.when(k == 0, F.lit("nothing to see")).when(k == 1, F.concat(F.lit("Miles: "), line, F.lit(",5"))).otherwise(F.concat(
        F.lit("Route ID: A"), F.col("order_key").cast("string"), F.lit("\npickup date: "), F.date_format("route_date", "MM/dd/yyyy"),
        F.lit("\nDriver:  Ann  of\n Ames "), line)))
    return P.collect_by_config(r.select("route_key", body.alias("body")), E3_MESSAGES).drop("body")
