"""End-to-end jobs (R1-R8) and the user extension surface.

* R1 collect: every registered collector's DataFrame -> standardise ->
  union -> one validation projection -> good rows, rejects, summary.
* R2 process: clean -> dedupe -> geocode -> metrics -> entities -> checks -> store.
  What is kept is written to the shared folder before it fans out.
* R3: flat landed rows become nested records first, then R2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import entity as U
from ..operators import join as J
from ..operators import standardize as P
from ..operators import validate as V
from ..functions.metrics import with_route_metrics
from ..operators.window import written
from ..sources import store as ST

# ---------------------------------------------------------------- E5 collectors
COLLECTORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], dict, str]] = {}


def register_collector(name: str, fn: Callable[[SparkSession, str], DataFrame], aliases: dict,
                       source: str) -> None:
    """E5: a collector is any function returning a DataFrame of landed
    records, plus the alias table that standardises them."""
    COLLECTORS[name] = (fn, aliases, source)


# The rule set applied to collected records.
COLLECTION_RULES = [
    {"field": "route_id", "type": "required", "params": {}, "severity": V.ERROR, "message": "Route ID is required"},
    {"field": "route_date", "type": "required", "params": {}, "severity": V.ERROR,
     "message": "Route date is required"},
    {"field": "total_miles", "type": "positive", "params": {}, "severity": V.WARNING,
     "message": "Total miles should be positive"},
    {"field": "revenue", "type": "positive", "params": {}, "severity": V.WARNING,
     "message": "Revenue should be positive"},
]


def collect_all(spark: SparkSession, sf_dir: str, as_of: str,
                rules: list[dict] = COLLECTION_RULES) -> DataFrame:
    """All collectors -> standardised union with findings."""
    parts = []
    for name, (fn, aliases, source) in COLLECTORS.items():
        parts.append(P.standardize(fn(spark, sf_dir), aliases, source, name, as_of))
    allr = U.union_sources(parts)
    return V.with_findings(allr, rules)


def collection_summary(found: DataFrame) -> DataFrame:
    """Per source: records, valid, error and warning findings, status."""
    errs = F.size(F.filter("findings", lambda x: x["severity"] == V.ERROR))
    warns = F.size(F.filter("findings", lambda x: x["severity"] == V.WARNING))
    g = found.groupBy("source").agg(F.count(F.lit(1)).alias("records"),
                                    F.count_if(errs == 0).cast("long").alias("valid_records"),
                                    F.sum(errs).cast("long").alias("errors"),
                                    F.sum(warns).cast("long").alias("warnings"))
    return g.withColumn("status", F.when(F.col("valid_records") > 0, "ok").otherwise("failed"))


# ---------------------------------------------------------------- R2 / R3
LINKS = (("customers", "customer.", "customer_id"), ("drivers", "driver.", "driver_id"), ("vehicles", "vehicle.", "vehicle_id"),
         ("locations", "start_location.", "start_location_id"), ("locations", "end_location.", "end_location_id"))
ENDS = ("start_location", "end_location")
ROW = "_row"  # number of a kept record


def _positions(kept: DataFrame, gazetteer: DataFrame, store: ST.Store) -> DataFrame | None:
    """Where the addresses of both locations are (J7): a record's number as ``_of`` and
    the known positions, written; None if no address is known."""
    ends = [kept.select(ROW, F.lit(s).alias("_end"), *[F.col(f"{s}.{c}").alias(c) for c in J.ADDRESS]) for s in ENDS]
    both = ends[0].unionByName(ends[1])
    J.geocode_kept(both.select(*J.ADDRESS).distinct(), gazetteer, store)
    if not store.version("geocodes")[2]:
        return None
    known = store.read("geocodes").select("full_address", F.struct("latitude", "longitude").alias("_at"))
    asked = both.select(ROW, "_end", J.full_address().alias("full_address")).filter("full_address IS NOT NULL")
    return written(asked.join(known, "full_address").groupBy(F.col(ROW).alias("_of")).agg(
        *[F.max(F.when(F.col("_end") == s, F.col("_at"))).alias(f"_at_{s}") for s in ENDS]), "process-positions")


def _located(kept: DataFrame, found: DataFrame | None) -> DataFrame:
    """Both locations with the coordinates of their addresses, which come back to the records at once."""
    none = F.lit(None).cast("struct<latitude double, longitude double>")
    out = kept.withColumns({f"_at_{s}": none for s in ENDS}) if found is None else \
        kept.join(found, F.col(ROW) == F.col("_of"), "left").drop("_of")
    return out.withColumns({s: F.struct(f"{s}.*", *[F.col(f"_at_{s}.{c}").alias(c) for c in ("latitude", "longitude")]) for s in ENDS}).drop(
        *[f"_at_{s}" for s in ENDS])


def _places(kept: DataFrame, store: ST.Store, order: list[str]) -> DataFrame:
    """The unique locations (U2) with the coordinates of their addresses."""
    places = U.unique_locations(kept, list(ENDS), order)
    if not store.version("geocodes")[2]:
        return places.withColumns({c: F.lit(None).cast("double") for c in ("latitude", "longitude")})
    known = store.read("geocodes").select("full_address", "latitude", "longitude")
    return J.located(places, known, J.full_address())


def _linked(routes: DataFrame, store: ST.Store) -> DataFrame:
    """The routes with the ids of their entities (J3): the natural keys alone are
    joined with the store's tables, a row for each link, and a record's ids come back
    to it at once."""
    ask = F.array(*[F.struct(F.lit(t).alias("_table"), F.lit(i).alias("_link"), ST.natural_key(ST.KEYS[t], of).alias("_key"))
                    for t, of, i in LINKS])
    known = U.union_sources([store.read(t).select(F.lit(t).alias("_table"), F.col("natural_key").alias("_key"), F.col("id").alias("_id"))
                             for t in dict.fromkeys(t for t, _, _ in LINKS)])
    ids = routes.select(ROW, F.inline(ask)).join(known, ["_table", "_key"]).groupBy(F.col(ROW).alias("_of")).agg(
        *[F.max(F.when(F.col("_link") == i, F.col("_id"))).alias(i) for _, _, i in LINKS])
    return routes.join(ids, F.col(ROW) == F.col("_of"), "left").drop("_of")


def process_routes(spark: SparkSession, nested: DataFrame, gazetteer: DataFrame, store: ST.Store, order: list[str]) -> dict[str, DataFrame]:
    """R2: clean every field (P18), require a date, drop repeated routes (U1), find
    coordinates (J7), compute the metrics (M14), extract the entities (U2-U5), check
    (V17, a failure stops the job before anything is stored) and store them with ids
    (S11).  The source is read once: what is kept is written to the shared folder
    before it fans out.  ``routes`` are linked to the stored entities' ids.  Positions,
    links and the routes' own ids are found by narrow rows of a record's number and come
    back to the records together, so whole records are shuffled twice: by their key
    to drop repeated ones, and by their number."""
    cleaned = P.clean_nested_record(nested).filter(F.col("route_date").isNotNull())
    kept = written(U.first_per_key(cleaned, U.route_key(), order).withColumn(ROW, F.monotonically_increasing_id()), "process-kept")
    found = _positions(kept, gazetteer, store)
    locations = written(_places(kept, store, order), "process-locations")
    checks = V.post_transform_checks(kept, locations)
    if not checks.first()["passed"]:
        raise ValueError("Data validation failed")
    added = ST.store_all(store, {
        "locations": locations, "customers": U.unique_customers(kept.select(*order, "customer.*"), order).drop(*order),
        "drivers": U.unique_drivers(kept.select(*order, "driver.*"), order).drop(*order),
        "vehicles": U.unique_vehicles(kept.select(*order, "vehicle.*"), order).drop(*order)})
    located = _located(_linked(kept, store), found)
    flat = located.withColumns({
        **{f"{e}_{c[:3]}": F.col(f"{e}_location.{c}") for e in ("start", "end") for c in ("latitude", "longitude")},
        **{t: F.col(f"{t}_time") for t in ("scheduled_start", "scheduled_end", "actual_start", "actual_end")}}).drop("average_speed")
    routes, ids = with_route_metrics(flat, mpg_col=None, rate_col=None), [i for _, _, i in LINKS]
    added["routes"] = store.append_wide("routes", routes.select(*[c for c in routes.columns if c not in ids], *ids), kept, ROW)
    return {**added, "checks": checks}


def flat_to_nested(flat: DataFrame) -> DataFrame:
    """A flat landed table becomes nested route records (locations,
    driver, customer as structs) so the nested pipeline applies."""
    def s(*pairs):
        return F.struct(*[(F.col(src) if src in flat.columns else F.lit(None).cast("string")).alias(dst)
                          for dst, src in pairs])
    return flat.select(
        "*",
        s(("address", "origin_address"), ("city", "origin_city"), ("state", "origin_state"),
          ("zip_code", "origin_zip")).alias("start_location"),
        s(("address", "destination_address"), ("city", "destination_city"), ("state", "destination_state"),
          ("zip_code", "destination_zip")).alias("end_location"),
        s(("name", "driver_name"), ("phone", "driver_phone"), ("email", "driver_email")).alias("driver"),
        s(("name", "customer_name"), ("phone", "customer_phone"), ("email", "customer_email")).alias("customer"))


# ---------------------------------------------------------------- E4 (R4-R7: bundle.py)
def compile_template(fact: DataFrame, template: dict) -> dict[str, DataFrame]:
    """A report template (data table spec, summary rows, KPIs and
    formula KPIs) compiled to DataFrames."""
    out = {}
    if "table" in template:
        out["table"] = P.report_table(fact, template["table"])
    if "kpis" in template:
        k = A.kpis(fact, template["kpis"])
        out["kpis"] = A.formula_kpis(k, template.get("formulas", {}))
    if "summary_rows" in template:
        key, cols = template["summary_rows"]
        out["summary_rows"] = A.with_summary_rows(A.daily_rollup(fact), cols, key)
    return out
