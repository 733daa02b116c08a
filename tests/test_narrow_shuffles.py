"""What is shuffled and written: exports, appends to the store, links of routes, lookups."""

import datetime

from pyspark.sql import functions as F

from sf import SF_SMALL

from haulspark.operators import join as J
from haulspark.operators import window as W
from haulspark.plans import bundle as B
from haulspark.plans import jobs as JB
from haulspark.plans.report_fact import report_fact
from haulspark.plans.routes_view import routes
from haulspark.session import scratch_path
from haulspark.sources import sinks as K
from haulspark.sources import store as ST


def test_text_exports_are_compressed_and_whole(spark):
    rows = spark.range(500).selectExpr("id", "repeat('x', 20) t")
    got = K.export_bundle({"a": rows}, scratch_path(spark, "t-gz"), ["csv", "json"], "daily")
    paths = {r.format: r.path for r in got.collect()}
    assert all(f.endswith(".gz") for p in paths.values() for f in spark.read.text(p).inputFiles())
    assert spark.read.option("header", True).csv(paths["csv"]).count() == spark.read.json(paths["json"]).select("record.id").distinct().count() == 500
    plain = K.export_bundle({"a": rows}, scratch_path(spark, "t-plain"), ["json"], compression="none").first().path
    assert not any(f.endswith(".gz") for f in spark.read.text(plain).inputFiles())


def test_an_append_shuffles_its_rows_once(spark, monkeypatch):
    plans, written = [], W.written
    monkeypatch.setattr(W, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    store = ST.Store(spark, scratch_path(spark, "t-once"))
    for rows in ([("a",), ("b",), ("a",), (None,)], [("c",), ("b",), ("c",), ("0",)]):
        store.append("routes", spark.createDataFrame(rows, "route_key string"))
    assert len(plans) == 2 and all(p.count("Exchange") == 1 for p in plans)
    assert {r.natural_key: r.id for r in store.read("routes").collect()} == {"": 1, "a": 2, "b": 3, "0": 4, "c": 5}


def test_rows_without_an_address_are_spread(spark):
    points = spark.range(4000).selectExpr("id", "if(id % 2 = 0, null, concat('a', id % 7)) address")
    known = spark.createDataFrame([("a1", 1.0), ("a2", 2.0)], "full_address string, latitude double")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = J.located(points, known, F.col("address")).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(rows) == 4000 and all(r.latitude == {"a1": 1.0, "a2": 2.0}.get(r.address) for r in rows)
    assert len({r.part for r in rows if r.address is None}) > 1


def test_links_are_those_of_the_store_and_the_routes_join_once(spark):
    place, person = "named_struct('address', {}, 'city', 'c', 'state', cast(null as string), 'zip_code', '1')", "named_struct('name', {}, 'license_number', 'l', 'phone', cast(null as string), 'email', 'e')"
    routes = spark.range(40).selectExpr(
        f"id as {JB.ROW}", "id % 2 as same", f"{place.format('cast(id % 5 as string)')} start_location", f"{place.format('cast(id % 9 as string)')} end_location",
        f"{person.format('if(id % 4 = 0, null, cast(id % 3 as string))')} customer", f"{person.format('cast(id % 6 as string)')} driver",
        "named_struct('license_plate', cast(id % 8 as string), 'vin', cast(null as string)) vehicle")
    store = ST.Store(spark, scratch_path(spark, "t-links"))
    store.append("locations", routes.select("start_location.*"))
    for t, s in (("customers", "customer"), ("drivers", "driver"), ("vehicles", "vehicle")):
        store.append(t, routes.filter(f"{s} is not null").filter(f"{JB.ROW} < 30 and {JB.ROW} % 4 > 0").select(f"{s}.*"))
    want = routes
    for t, of, i in JB.LINKS:
        want = store.ids(t, want, id_col=i, of=of)
    got = JB._linked(routes, store)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def _exchanges(df):
    """(partitioning, output columns) of every exchange of a plan."""
    plan, found = df._jdf.queryExecution().executedPlan(), []
    todo = [plan.initialPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "ShuffleExchangeExec":
            found.append((p.outputPartitioning().toString(), [p.output().apply(i).name() for i in range(p.output().size())]))
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_a_bundle_shuffles_narrow_rows(spark, monkeypatch):
    """A customer's row holds the amounts that the customers' sections read, not those of all sections."""
    seen = []
    monkeypatch.setattr(B, "written", lambda df, name: seen.append(_exchanges(df)) or W.written(df, name))
    B.bundle_sums(report_fact(spark, SF_SMALL, need=B.NEED), B.MONTHLY)
    assert len(seen[0]) > 0 and max(len(columns) for _, columns in seen[0]) <= 30


def test_a_bundle_keeps_nulls_and_means_of_every_group(spark):
    ddl = ", ".join(f"{c} {'date' if c == 'route_date' else 'string' if c in ('driver_name', 'vehicle_info', 'customer_name', 'route_key') else 'bigint' if c == 'vehicle_id' else 'double'}" for c in B.NEED if c not in ("driver_id", "customer_id"))
    row = {f.split()[0]: None for f in ddl.split(", ")}
    day = datetime.date(1997, 5, 2)
    rows = [row | {"customer_name": "c", "route_date": day, "total_miles": 10.0, "efficiency_score": 0.0, "vehicle_id": 7, "average_speed": 40.0},
            row | {"customer_name": "c", "route_date": day, "total_miles": 5.0, "efficiency_score": 90.0, "driver_safety": 61.0}, row]
    got = {(r.of, r.cust or r.vehicle or r.name or r.route_date or r.month or r.vehicle_id): r
           for r in B.bundle_sums(spark.createDataFrame([tuple(r.values()) for r in rows], ddl), B.MONTHLY).collect() if r.of != "month+name"}
    assert (got["cust", "c"].n, got["cust", "c"].m, got["cust", "Unknown"].n) == (2, 15.0, 1)
    assert (got["name", "Unknown"].e, got["name", "Unknown"].v, got["name", "Unknown"].m) == (90.0, 40.0, 15.0)
    month = got["month", datetime.date(1997, 5, 1)]
    assert (month.mean_efficiency_score, month.on_time, month.n, got["month", None].mean_efficiency_score) == (45.0, 1.0, 2, None)
    assert (got["vehicle_id", 7].cap, got["vehicle_id", None].n, got["", None].n, got["route_date", None].n) == (40000.0, 2, 3, 1)


def test_driver_names_are_not_shuffled_with_the_lines_of_other_joins(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = dict(_exchanges(routes(spark, SF_SMALL, ("route_key", "customer_name", "driver_name", "vehicle_info"))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    lines = {k: c for k, c in moved.items() if "l_partkey" in k or "l_orderkey" in k}
    assert len(lines) == 2 and not any("s_name" in c for c in lines.values())


def test_an_append_writes_its_rows_once_into_the_store(spark, monkeypatch):
    names, written = [], W.written
    for module in (W, ST):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or written(df, name))
    base = scratch_path(spark, "t-part")
    store = ST.Store(spark, base)
    ST.store_all(store, {"routes": spark.createDataFrame([("b", 1), ("a", 2)], "route_key string, v int")})
    assert len(names) == 1 and names[0].startswith(base)
    assert {r.route_key: (r.id, r.v) for r in store.read("routes").collect()} == {"a": (1, 2), "b": (2, 1)}


def test_whole_records_are_not_sorted_for_their_ids(spark, monkeypatch):
    """Wide rows get the ids that a plain append gives them; only their numbers and keys are sorted by ranges."""
    seen, written = [], W.written
    monkeypatch.setattr(W, "written", lambda df, name: seen.extend(_exchanges(df)) or written(df, name))
    wide, plain = (ST.Store(spark, scratch_path(spark, f"t-{n}")) for n in ("wide", "plain"))
    for k in (0, 7):
        rows = spark.range(k, k + 20).selectExpr("id AS _row", "concat('r', id % 13) AS route_key", "if(id % 13 = 12, null, 'x') AS payload")
        plain.append("routes", rows.drop("_row"))
        seen.clear()
        added = wide.append_wide("routes", rows, rows.select("_row", "route_key"), "_row")
        assert seen and not any("payload" in columns for _, columns in seen)
        assert added.columns == ["id", "natural_key", "route_key", "payload"]
    assert sorted(map(str, wide.read("routes").collect())) == sorted(map(str, plain.read("routes").collect()))
    assert wide.version("routes")[:2] == plain.version("routes")[:2] == (1, 13)
