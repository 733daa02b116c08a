"""Sources and sinks: S1-S15.  Each query lands data derived from the given
tables in its own folder under the shared checkpoint folder (the "drop
folder" of a collector), then reads it back through the engine's readers."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions.clean import to_number
from ..operators import aggregate as A
from ..operators import entity as U
from ..operators import validate as V
from ..operators.window import written
from ..plans.collected_view import COLLECTED_SQL, collected
from ..plans.report_fact import report_fact
from ..plans.routes_view import routes
from ..session import scratch_path
from ..sources import files as S
from ..sources import sinks as K
from ..sources import store as ST
from ..sources.tables import table
from .q_entity import NESTED_SQL as _NESTED_SQL
from .registry import register
from .sqlbase import with_routes

# landed file columns -> standard names
CSV_MAPPING = {"Route ID": "route_id", "Date": "route_date", "Driver": "driver_name",
               "Customer": "customer_name", "Miles": "total_miles", "Revenue": "revenue"}


def _landed_csv(spark, sf):
    r = routes(spark, sf, ("route_key", "route_date", "driver_name", "customer_name", "total_miles",
                           "revenue", "fuel_consumed", "line_no"))
    return r.select(
        F.col("route_key").alias("Route ID"), F.col("route_date").cast("string").alias("Date"),
        F.when(F.col("line_no") == 7, F.lit("NULL")).otherwise(F.col("driver_name")).alias("Driver"),
        F.coalesce(F.col("customer_name"), F.lit("n/a")).alias("Customer"),
        F.when(F.col("fuel_consumed").isNull(), F.lit("N/A"))
         .otherwise(F.concat(F.lit("$"), F.col("total_miles").cast("string"))).alias("Miles"),
        F.col("revenue").cast("string").alias("Revenue"),
        F.lit("unmapped").alias("Notes"))


@register("S1_csv_scan", with_routes("""
SELECT route_key AS route_id, cast(route_date AS VARCHAR) AS route_date,
       CASE WHEN line_no = 7 THEN NULL ELSE driver_name END AS driver_name, customer_name,
       CASE WHEN fuel_consumed IS NULL THEN NULL ELSE total_miles END AS total_miles, revenue, 'unmapped' AS notes
FROM routes"""))
def s1(spark, sf):
    """Routes landed as CSV with spelled-out nulls ('NULL', 'N/A', 'n/a'),
    read back as text, mapped (P2), unmapped columns kept, numbers parsed."""
    d = scratch_path(spark, "s1-csv")
    _landed_csv(spark, sf).write.option("header", True).csv(d)
    raw = S.read_csv_text(spark, d).withColumnsRenamed(CSV_MAPPING)
    return raw.select("route_id", "route_date", "driver_name", "customer_name",
                      to_number("total_miles").alias("total_miles"), to_number("revenue").alias("revenue"),
                      F.col("Notes").alias("notes"))


@register("S2_encoding_fallback", "SELECT event_id, 'Café ' || event_type || ' – naïve' AS label FROM events")
def s2(spark, sf):
    """Half the landed files are Latin-1 (those of clicks and views), half
    UTF-8; the fallback reader decodes both."""
    d = scratch_path(spark, "s2-csv")
    ev = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("Café "), F.col("event_type"), F.lit(" – naïve")).alias("label"), "event_type")
    latin = ev.filter(F.col("event_type").isin("click", "view"))
    utf = ev.filter(~F.col("event_type").isin("click", "view"))
    # the en dash is not in Latin-1: those files carry a plain hyphen instead
    latin.select("event_id", F.regexp_replace("label", "–", "-").alias("label")) \
        .write.option("header", True).option("encoding", "ISO-8859-1").csv(os.path.join(d, "latin"))
    utf.select("event_id", "label").write.option("header", True).csv(os.path.join(d, "utf8"))
    out = S.read_csv_any_encoding(spark, d)
    return out.select(F.col("event_id").cast("long").alias("event_id"),
                      F.regexp_replace("label", " - naïve$", " – naïve").alias("label"))


def _route_json(r):
    rec = F.to_json(F.struct("route_key", "revenue", "total_miles"))
    return rec


@register("S3_json_polymorphic", with_routes("SELECT route_key, revenue, total_miles FROM routes"))
def s3(spark, sf):
    """Landed JSON documents with the three root shapes: a bare array, an
    object holding 'data', and a single record object."""
    d = scratch_path(spark, "s3-json")
    r = routes(spark, sf, ("route_key", "revenue", "total_miles", "line_no"))
    rec = _route_json(r)
    doc = (F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("["), rec, F.lit("]")))
           .when(F.col("line_no") % 3 == 1, F.concat(F.lit('{"data": ['), rec, F.lit("]}")))
           .otherwise(rec))
    r.select(doc.alias("value")).write.text(d)
    j = S.read_json_documents(spark, d, whole_file=False)
    return j.select(*_RECORD_FIELDS())


def _RECORD_FIELDS():
    return [S.field(F.col("record"), "route_key").alias("route_key"), S.field(F.col("record"), "revenue", "double").alias("revenue"),
            S.field(F.col("record"), "total_miles", "double").alias("total_miles")]


@register("S3_json_rejects", with_routes("""
SELECT route_key, revenue, total_miles, NULL AS reason FROM routes WHERE line_no NOT IN (4, 5)
UNION ALL SELECT NULL, NULL, NULL, CASE line_no WHEN 4 THEN 'Document is not valid JSON' ELSE 'Unsupported JSON structure' END
FROM routes WHERE line_no IN (4, 5)"""))
def s3_rejects(spark, sf):
    """Documents cut short and documents that are one number go to the reject sink
    with their reason, in the pass that reads the good ones."""
    d, root = scratch_path(spark, "s3-mixed"), scratch_path(spark, "s3-landed")
    r = routes(spark, sf, ("route_key", "revenue", "total_miles", "line_no"))
    rec = _route_json(r)
    doc = F.when(F.col("line_no") == 4, F.concat(F.lit('{"data": ['), rec)).when(F.col("line_no") == 5, F.lit("42")).otherwise(rec)
    r.select(doc.alias("value")).write.text(d)
    good, bad = S.split_rejects(S.read_json_documents(spark, d, whole_file=False), root, "2024-01-31", _RECORD_FIELDS())
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select(
        *[F.lit(None).cast(t).alias(c) for c, t in good.dtypes], F.col("reasons")[0].alias("reason")))


@register("S9_reject_lines", with_routes("""
SELECT route_key, status, NULL AS reason FROM routes WHERE line_no <> 6
UNION ALL SELECT NULL, NULL, 'Line does not fit the columns' FROM routes WHERE line_no = 6"""))
def s9_lines(spark, sf):
    """CSV lines with a value too many go to the reject sink."""
    d, root = scratch_path(spark, "s9-csv"), scratch_path(spark, "s9-landed")
    r = routes(spark, sf, ("route_key", "status", "line_no"))
    line = F.concat_ws(",", "route_key", "status", F.when(F.col("line_no") == 6, F.lit("one,more")))
    r.select(line.alias("value")).write.text(d)
    good, bad = S.split_rejects(S.read_csv_with_rejects(spark, d, ["route_key", "status"]), root, "2024-01-31",
                                [F.col("route_key"), F.col("status")])
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select(
        F.lit(None).cast("string").alias("route_key"), F.lit(None).cast("string").alias("status"), F.col("reasons")[0].alias("reason")))


@register("S4_manual_entry", with_routes("""
SELECT route_key, revenue, CASE WHEN line_no % 4 = 0 THEN 'dispatcher-' || cast(driver_id AS VARCHAR) END AS entered_by
FROM routes"""))
def s4(spark, sf):
    """Manual-entry documents: {"metadata", "routes": [...]}, {"data": [...]},
    a single record, or a bare array; metadata is carried to every record."""
    d = scratch_path(spark, "s4-manual")
    r = routes(spark, sf, ("route_key", "revenue", "line_no", "driver_id"))
    rec = F.to_json(F.struct("route_key", "revenue"))
    meta = F.to_json(F.struct(F.concat(F.lit("dispatcher-"), F.col("driver_id").cast("string")).alias("entered_by")))
    k = F.col("line_no") % 4
    doc = (F.when(k == 0, F.concat(F.lit('{"metadata": '), meta, F.lit(', "routes": ['), rec, F.lit("]}")))
           .when(k == 1, F.concat(F.lit('{"data": ['), rec, F.lit("]}")))
           .when(k == 2, rec).otherwise(F.concat(F.lit("["), rec, F.lit("]"))))
    r.select(doc.alias("value")).write.text(d)
    j = S.read_json_documents(spark, d, whole_file=False, keys=S.MANUAL_RECORD_KEYS)
    return j.select(S.field(F.col("record"), "route_key").alias("route_key"),
                    S.field(F.col("record"), "revenue", "double").alias("revenue"),
                    F.try_variant_get("doc", "$.metadata.entered_by", "string").alias("entered_by"))


@register("S5_payload_path", """
SELECT event_id, cast(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type IN ('click', 'view')""")
def s5(spark, sf):
    """API payloads: clicks carry an array under result.items, views a single
    object there, other events no such path (-> no rows)."""
    ev = table(spark, sf, "events")
    payload = (F.when(F.col("event_type") == "click", F.concat(F.lit('{"result": {"items": ['), F.col("props"), F.lit("]}}")))
               .when(F.col("event_type") == "view", F.concat(F.lit('{"result": {"items": '), F.col("props"), F.lit("}}")))
               .otherwise(F.lit('{"status": "ok"}')))
    p = ev.select("event_id", F.parse_json(payload).alias("doc"))
    return p.select("event_id", F.explode(S.records_at_path(F.col("doc"), "result.items")).alias("item")) \
        .select("event_id", F.try_variant_get("item", "$.k", "int").alias("k"))


AS_OF = "2024-01-31"


@register("S6_incremental_window", f"""
SELECT event_id, ts FROM events WHERE ts >= cast(DATE '{AS_OF}' - INTERVAL 7 DAY AS TIMESTAMP)""")
def s6(spark, sf):
    return S.since(table(spark, sf, "events"), "ts", AS_OF, 7).select("event_id", "ts")


@register("S7_file_discovery", "SELECT event_type, count(*) > 0 AS found FROM events GROUP BY event_type")
def s7(spark, sf):
    """Landed files (one folder per event type, plus temp files) discovered by
    pattern and age: every event type's folder yields its csv files."""
    d = scratch_path(spark, "s7-landing")
    ev = table(spark, sf, "events")
    ev.write.partitionBy("event_type").option("header", True).csv(d)
    ev.select(F.col("event_id").cast("string")).write.text(os.path.join(d, "_tmp_ignore"))
    found = S.discover_files(spark, d, "*.csv", "2000-01-01T00:00:00")
    return (found.select(F.regexp_extract("path", r"event_type=([^/]+)/", 1).alias("event_type"))
            .groupBy("event_type").agg((F.count(F.lit(1)) > 0).alias("found")))


S8_BUCKETS = 16


@register("S8_content_hash_dedupe", f"""
SELECT event_type, count(DISTINCT event_id % {S8_BUCKETS}) AS kept_files, count(DISTINCT event_id % {S8_BUCKETS}) AS skipped_copies,
       count(*) AS events FROM events GROUP BY event_type""")
def s8(spark, sf):
    """Each event type lands as a few files, twice (a copy in a second folder); one
    file per content survives and is read.  Files are dealt by type and a fixed
    bucket of the id, so both copies hold the same rows in the same order."""
    d = scratch_path(spark, "s8-landing")
    ev = table(spark, sf, "events").select("event_type", "event_id", "value", (F.col("event_id") % S8_BUCKETS).alias("bucket"))
    for copy in ("a", "b"):
        (ev.repartition("event_type", "bucket").sortWithinPartitions("event_type", "bucket", "event_id")
         .write.partitionBy("event_type", "bucket").option("header", True).csv(os.path.join(d, copy)))
    kept = S.new_contents(spark, d, "*.csv").withColumn("event_type", F.regexp_extract("path", r"event_type=([^/]+)/", 1))
    lines = spark.read.text(d, recursiveFileLookup=True, pathGlobFilter="*.csv").select(
        "value", F.col("_metadata.file_path").alias("file")).filter("value NOT LIKE 'event_id%'")
    plain = F.regexp_replace(F.col("path"), "^file:/+", "/")
    rows = lines.groupBy(F.regexp_replace("file", "^file:/+", "/").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return kept.withColumn("file", plain).join(rows, "file").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("kept_files"), F.sum(F.col("copies") - 1).cast("long").alias("skipped_copies"), F.sum("n").alias("events"))


R = V.ROUTE_RULES


@register("S9_reject_sink", with_routes(f"""
, {COLLECTED_SQL.strip()}
SELECT record_key, reasons FROM (
  SELECT record_key, concat_ws('; ',
    CASE WHEN route_id IS NULL OR trim(route_id) = '' THEN 'Route ID is required' END,
    CASE WHEN route_id IS NOT NULL AND (length(route_id) < 1 OR length(route_id) > 50) THEN 'Route ID must be 1-50 characters' END,
    CASE WHEN route_date IS NULL OR trim(route_date) = '' THEN 'Route date is required' END,
    CASE WHEN route_date IS NOT NULL AND (CASE WHEN route_date <> '' THEN coalesce(
      try_strptime(route_date, '%Y-%m-%d'), try_strptime(route_date, '%m/%d/%Y'), try_strptime(route_date, '%d/%m/%Y'),
      try_strptime(route_date, '%Y-%m-%d %H:%M:%S'), try_strptime(route_date, '%m/%d/%Y %H:%M:%S'),
      try_strptime(route_date, '%Y-%m-%dT%H:%M:%S'), try_strptime(route_date, '%Y-%m-%dT%H:%M:%S.%f')) END) IS NULL
      THEN 'Route date must be a valid date' END) AS reasons FROM collected)
WHERE reasons <> ''"""))
def s9(spark, sf):
    """Records with error findings go to the quarantine area (partitioned by
    load date) with their reasons; read back."""
    q = scratch_path(spark, "s9-quarantine")
    f = V.with_findings(collected(spark, sf), R)
    _, bad = V.split_valid(f)
    reasons = F.array_join(F.transform(F.filter("findings", lambda x: x["severity"] == V.ERROR),
                                       lambda x: x["message"]), "; ")
    S.quarantine(bad.select("record_key", "findings"), reasons, q, "2024-01-31")
    return spark.read.parquet(q).select("record_key", "reasons")


def _sep(*parts):
    return " || chr(31) || ".join(parts)


def _txt(c, fold=False):
    t = f"coalesce(cast({c} AS VARCHAR), '')"
    return f"lower({t})" if fold else t


def _entity_keys_sql() -> str:
    """(tbl, k, batch): the natural key of every entity row, and the batch that brings it."""
    b = "CASE WHEN order_key % 3 = 0 THEN 2 ELSE 1 END"
    loc = [_sep(_txt(p + "address", 1), _txt(p + "city", 1), _txt(p + "state", 1), _txt(p + "zip")) for p in ("s_", "e_")]
    parts = [f"SELECT 'locations' AS tbl, {k} AS k, {b} AS batch FROM nested WHERE coalesce({p}address, '') <> '' OR coalesce({p}city, '') <> '' "
             f"OR coalesce({p}state, '') <> '' OR coalesce({p}zip, '') <> ''" for k, p in zip(loc, ("s_", "e_"))]
    parts += [
        f"SELECT 'customers', {_sep(_txt('c_name', 1), _txt('c_phone'), _txt('c_email'))}, {b} FROM nested WHERE coalesce(trim(c_name), '') <> ''",
        f"SELECT 'drivers', {_sep(_txt('d_name', 1), _txt('d_license'), repr(''))}, {b} FROM nested WHERE coalesce(trim(d_name), '') <> ''",
        f"SELECT 'vehicles', {_sep(_txt('v_plate', 1), repr(''))}, {b} FROM nested WHERE coalesce(v_plate, '') <> ''",
        f"SELECT 'routes', route_key, {b} FROM nested"]
    parts += [f"SELECT 'financial_records', route_key || chr(31) || '{c}', {b} FROM routes WHERE {c} IS NOT NULL AND {c} <> 0"
              for c in A.LEDGER_CATEGORIES]
    return " UNION ALL ".join(parts)


def _entity_source(spark, sf):
    """The routes with their amounts, joined and written once for all entities of all batches."""
    from .q_entity import nested_routes
    return written(nested_routes(spark, sf, A.LEDGER_CATEGORIES, A.LEDGER_CATEGORIES), "entity-source")


def _entities(source, batch) -> dict:
    """The six kinds of entities of a batch of routes."""
    from .q_entity import ORDER
    n = money = source.filter(F.when(F.col("order_key") % 3 == 0, 2).otherwise(1) == batch)
    return {
        "locations": U.unique_locations(n, ["start_location", "end_location"], ORDER),
        "customers": U.unique_customers(n.select(*ORDER, "customer.*"), ORDER).select("name", "phone", "email"),
        "drivers": U.unique_drivers(n.select(*ORDER, "driver.*"), ORDER).select("name", "license_number", "phone"),
        "vehicles": U.unique_vehicles(n.select(*ORDER, "vehicle.*"), ORDER).select("license_plate", "vin", "model"),
        "routes": n.select("route_key", "route_date"), "financial_records": A.financial_ledger(money)}


@register("S11_append_with_ids", with_routes(f"""
, {_NESTED_SQL.strip()}, rows AS ({_entity_keys_sql()}),
firsts AS (SELECT tbl, k, min(batch) AS batch FROM rows GROUP BY tbl, k)
SELECT tbl AS table_name, replace(k, chr(31), '|') AS natural_key, row_number() OVER (PARTITION BY tbl ORDER BY batch, k) AS id
FROM firsts"""))
def s11(spark, sf):
    """Two overlapping batches of six kinds of entities appended to the store, each
    new natural key with the next id of its table; all tables read back."""
    store = ST.Store(spark, scratch_path(spark, "s11-store"))
    source = _entity_source(spark, sf)
    for batch in (1, 2):
        ST.store_all(store, _entities(source, batch))
    out = None
    for t in ST.KEYS:
        rows = store.read(t).select(F.lit(t).alias("table_name"), F.translate("natural_key", ST.SEPARATOR, "|").alias("natural_key"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


QUARTER = ("1997-01-01", "1997-03-31")


@register("S12_partitioned_route_store", with_routes(f"""
SELECT strftime(route_date, '%Y-%m') AS route_month, count(*) AS routes FROM routes
WHERE route_date BETWEEN DATE '{QUARTER[0]}' AND DATE '{QUARTER[1]}' GROUP BY 1"""))
def s12(spark, sf):
    """The route store partitioned by month; the read prunes to one quarter's
    partitions (PartitionFilters in the scan)."""
    d = scratch_path(spark, "s12-store")
    K.write_route_store(routes(spark, sf, ("route_key", "route_date", "revenue")), d)
    store = spark.read.parquet(d)
    q = store.filter(F.col("route_month").between(QUARTER[0][:7], QUARTER[1][:7]))
    return q.groupBy("route_month").agg(F.count(F.lit(1)).alias("routes"))


MONTH = ("1997-06-01", "1997-06-30")
_BUNDLE_SQL = with_routes(f"""
, m AS (SELECT * FROM routes WHERE route_date BETWEEN DATE '{MONTH[0]}' AND DATE '{MONTH[1]}'),
sec AS (SELECT 'summary' AS section, cast(1 AS BIGINT) AS rows
        UNION ALL SELECT 'drivers', count(DISTINCT coalesce(driver_name, 'Unknown')) FROM m
        UNION ALL SELECT 'customers', count(DISTINCT coalesce(customer_name, 'Unknown')) FROM m
        UNION ALL SELECT 'routes', count(*) FROM m)""")


_BUNDLE_NEED = sorted({c for n in ("period_summary", "driver_metrics", "customer_metrics") for c in A.NEEDS[n]}
                      | {"route_key", "route_date", "total_costs", "profit"})


def _bundle(spark, sf, period):
    f = written(report_fact(spark, sf, *period).select(*_BUNDLE_NEED), "bundle-fact")
    return {"summary": A.period_summary(f), "drivers": A.driver_metrics(f), "customers": A.customer_metrics(f),
            "routes": f.select("route_key", "route_date", "driver_name", "revenue", "total_costs", "profit")}


def _export(spark, sf, formats, name, period=MONTH):
    """The bundle of a period (inclusive dates; () for the whole fact), exported."""
    root = scratch_path(spark, name)
    return K.export_bundle(_bundle(spark, sf, period), root, formats, name, "2024-01-31T00:00:00",
                           {"date_from": period[0] if period else "", "date_to": period[1] if period else ""}).drop("path")


@register("S13_csv_export", _BUNDLE_SQL + "\nSELECT section, 'csv' AS format, rows, 'ok' AS status FROM sec WHERE rows > 0")
def s13(spark, sf):
    return _export(spark, sf, ["csv"], "s13-export")


@register("S14_json_export", _BUNDLE_SQL + "\nSELECT section, 'json' AS format, rows, 'ok' AS status FROM sec WHERE rows > 0")
def s14(spark, sf):
    return _export(spark, sf, ["json"], "s14-export")


@register("S15_multi_format_export", _BUNDLE_SQL + """
SELECT section, f AS format, rows, 'ok' AS status FROM sec, (VALUES ('csv'), ('json'), ('parquet')) v(f) WHERE rows > 0""")
def s15(spark, sf):
    return _export(spark, sf, ["csv", "json", "parquet"], "s15-export")


_BUNDLE_ALL_SQL = _BUNDLE_SQL.replace(f" WHERE route_date BETWEEN DATE '{MONTH[0]}' AND DATE '{MONTH[1]}'", "")


@register("S13_csv_export_all", _BUNDLE_ALL_SQL + "\nSELECT section, 'csv' AS format, rows, 'ok' AS status FROM sec WHERE rows > 0")
def s13_all(spark, sf):
    return _export(spark, sf, ["csv"], "s13-export-all", ())


@register("S14_json_export_all", _BUNDLE_ALL_SQL + "\nSELECT section, 'json' AS format, rows, 'ok' AS status FROM sec WHERE rows > 0")
def s14_all(spark, sf):
    return _export(spark, sf, ["json"], "s14-export-all", ())


@register("S15_multi_format_export_all", _BUNDLE_ALL_SQL + """
SELECT section, f AS format, rows, 'ok' AS status FROM sec, (VALUES ('csv'), ('json'), ('parquet')) v(f) WHERE rows > 0""")
def s15_all(spark, sf):
    return _export(spark, sf, ["csv", "json", "parquet"], "s15-export-all", ())
