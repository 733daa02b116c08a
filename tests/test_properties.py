"""Invariants: dedupe idempotent, valid + invalid = input, unions preserve counts."""

from pyspark.sql import functions as F

from sf import SF_SMALL

from haulspark.operators import entity as U
from haulspark.operators import validate as V
from haulspark.operators.window import chunk_ids, percentile_bands
from haulspark.plans.collected_view import collected
from haulspark.plans.routes_view import routes


def test_dedupe_idempotent(spark):
    r = routes(spark, SF_SMALL, ("route_key", "order_key", "line_no"))
    order = ["order_key", "line_no", "route_key"]
    once = U.first_per_key(r, ["order_key", "line_no"], order)
    twice = U.first_per_key(once, ["order_key", "line_no"], order)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert once.count() == r.select("order_key", "line_no").distinct().count()


def test_valid_plus_invalid_is_input(spark):
    df = V.with_findings(collected(spark, SF_SMALL))
    good, bad = V.split_valid(df)
    assert good.count() + bad.count() == df.count()


def test_union_preserves_counts(spark):
    r = routes(spark, SF_SMALL, ("route_key", "revenue", "driver_name"))
    a, b = r.select("route_key", "revenue"), r.select("route_key", "driver_name")
    assert U.union_sources([a, b]).count() == 2 * r.count()


def test_chunks_are_contiguous(spark):
    r = routes(spark, SF_SMALL, ("route_key",))
    ch = chunk_ids(r, ["route_key"], 100)
    sizes = [row["n"] for row in ch.groupBy("chunk_id").agg(F.count("*").alias("n")).orderBy("chunk_id").collect()]
    assert all(s == 100 for s in sizes[:-1]) and sum(sizes) == r.count()


def test_percentile_bands(spark):
    df = spark.range(1, 102).select(F.col("id").cast("double").alias("x"))
    out = {r["x"]: (r["band"], r["bar"]) for r in percentile_bands(df, "x").collect()}
    assert out[51.0][0] == "mid" and out[1.0] == ("low", 0.0) and out[101.0] == ("high", 1.0)


def test_custom_python_validator(spark):
    V.register_validator("odd_len", V.python_validator(lambda v, p: len(str(v)) % 2 == 1))
    df = spark.createDataFrame([("ab",), ("abc",), (None,)], "code string")
    rules = [{"field": "code", "type": "odd_len", "params": {}, "severity": "warning", "message": "even"}]
    out = V.with_findings(df, rules).select("code", F.size("findings").alias("n")).collect()
    assert {r["code"]: r["n"] for r in out} == {"ab": 1, "abc": 0, None: 1}  # the rule sees None


def test_raising_rules_are_findings(spark):
    V.register_validator("late", V.python_validator(lambda v, p: 1 // int(v) >= 0))
    V.register_validator("early", lambda v, p: p["absent"])
    rules = [{"field": "code", "type": t, "params": {}, "severity": "warning", "message": "{value}"}
             for t in ("late", "early")]
    df = spark.createDataFrame([("1",), ("0",)], "code string")
    got = {r["code"]: [(f["rule_type"], f["severity"], f["message"]) for f in r["findings"]]
           for r in V.with_findings(df, rules).collect()}
    early = ("early", "error", "Validator early error: 'absent'")
    assert got["1"] == [early]
    assert got["0"][0][:2] == ("late", "error") and "zero" in got["0"][0][2] and got["0"][1] == early


def test_radius_search_across_antimeridian_and_poles(spark):
    from math import asin, cos, radians, sin, sqrt
    from haulspark.operators.geo import within_radius

    def miles(a, b, c, d):
        a, b, c, d = map(radians, (a, b, c, d))
        return 2 * 3956 * asin(sqrt(min(1, sin((c - a) / 2) ** 2 + cos(a) * cos(c) * sin((d - b) / 2) ** 2)))

    spots = [(lat, lon) for lat in (-90.0, -89.2, -75.5, 0.0, 10.0, 70.3, 85.0, 89.0, 90.0)
             for lon in (-180.0, -179.99, -120.5, -1.0, 0.0, 45.0, 179.99)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spots)], "id long, lat double, lon double")
    for radius in (0.0, 60.0, 300.0, 5000.0):
        got = within_radius(df.withColumnRenamed("id", "point_id"), df.withColumnRenamed("id", "centre_id"), radius)
        want = {(i, j) for i, p in enumerate(spots) for j, q in enumerate(spots) if miles(*p, *q) <= radius}
        rows = [(r["centre_id"], r["point_id"]) for r in got.collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == want, radius


def test_geocode_keeps_the_number_of_points(spark):
    from haulspark.operators.join import geocode
    points = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", "x")], "id int, city string, state string")
    gaz = spark.createDataFrame([("a", "x", 1.0, 2.0), ("a", "x", 0.5, 9.0), ("a", "y", 7.0, 7.0)],
                                "city string, state string, latitude double, longitude double")
    got = {r["id"]: (r["latitude"], r["longitude"]) for r in geocode(points, gaz).collect()}
    assert got == {1: (0.5, 9.0), 2: (0.5, 9.0), 3: (None, None)}


def test_fixed_sum_beyond_bigint(spark):
    from haulspark.functions.numeric import fixed_sum
    from pyspark.sql import functions as F
    got = spark.range(1000).agg(fixed_sum(F.lit(9.0e13)).alias("s")).first()["s"]
    assert got == 9.0e16


def test_radius_search_decides_pairs_at_the_radius_by_their_distance(spark):
    """The sines are taken of near pairs only; pairs that lie on the radius, equal, opposite and polar positions, any radius."""
    import math
    from haulspark.functions.metrics import haversine_raw
    from haulspark.operators import geo as G
    spots = [(40.0, -75.0), (40.0, -75.0), (40.5, -75.0), (40.0, -74.25), (40.25, -75.25), (-40.0, 105.0), (90.0, 0.0), (89.9, 170.0),
             (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (0.0, 179.99), (None, 1.0)]
    points = spark.createDataFrame([(i, a, o) for i, (a, o) in enumerate(spots)], "point_id int, lat double, lon double")
    centres = points.withColumnRenamed("point_id", "centre_id")
    miles = {(r.c, r.p): r.d for r in centres.selectExpr("centre_id c", "lat a", "lon o").crossJoin(points.selectExpr("point_id p", "lat b", "lon q"))
             .filter("a IS NOT NULL AND b IS NOT NULL").select("c", "p", haversine_raw("a", "o", "b", "q").alias("d")).collect()}
    on_the_radius = miles[0, 2]
    for radius in (0.0, 0.01, on_the_radius, math.nextafter(on_the_radius, 0), miles[0, 3], 13000.0):
        got = {(r.centre_id, r.point_id) for r in G.within_radius(points, centres, radius).collect()}
        assert got == {k for k, d in miles.items() if d <= radius}, radius
    plan = G.within_radius(points, centres, 5.0)._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.split("\n") if "Join Inner" in x and "ASIN" in x)
    assert join.index("c_x") < join.index("ASIN")
