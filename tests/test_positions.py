"""Global positions, ranks and stop orders against plain Python."""

import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haulspark.operators import entity as U
from haulspark.operators import geo as G
from haulspark.operators import window as W


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def no_single_task(df) -> bool:
    p = plan(df)
    return "SinglePartition" not in p and "ExistingRDD" not in p


def test_positions_are_those_of_the_sort(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), rnd.randrange(10**6)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    out = W.global_index(df, ["k", F.col("v").desc()], "at")
    assert no_single_task(out)
    got = sorted((r["at"], r["k"], r["v"]) for r in out.collect())
    assert [(k, v) for _, k, v in got] == sorted(rows, key=lambda x: (x[0], -x[1])) and [a for a, _, _ in got] == list(range(3000))
    assert W.global_index(df.filter("false"), ["k"], "at").count() == 0


@pytest.mark.parametrize("within", [[], ["g"]])
def test_ranks_with_a_hot_value(spark, within):
    rnd = random.Random(2)
    rows = [(rnd.choice(["x", "y", None]), 5.0 if i % 3 else rnd.choice([None, float(rnd.randrange(40))]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(5)
    out = W.rank_by(df, [("v", True)], within=within)
    assert no_single_task(out)
    got = {r["i"]: r["rank"] for r in out.collect()}

    def value(v):
        return -math.inf if v is None else v

    want = {i: 1 + sum(1 for h, u, _ in rows if (not within or h == g) and value(u) > value(v)) for g, v, i in rows}
    assert got == want


def test_new_ids_go_on_without_gaps(spark):
    dim = spark.createDataFrame([("a", 7), ("b", 3)], "k string, id long")
    batch = spark.createDataFrame([("c",), ("a",), ("d",), ("c",), (None,)], "k string")
    out = U.find_or_create(dim, batch, "k", "id")
    assert {r["k"]: (r["id"], r["created"]) for r in out.collect()} == {"a": (7, False), "c": (8, True), "d": (9, True)}


def brute_walk(pts, start=None):
    def leg(a, b):
        (la, lo), (lb, lp) = ((math.radians(x) for x in p) for p in (a, b))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
        return float(np.rint(2 * math.asin(math.sqrt(min(max(h, 0.0), 1.0))) * 3956.0 * 100) / 100)

    at = 0 if start is None else min(range(len(pts)), key=lambda i: (leg(start, pts[i]), i))
    order, left, miles = [at], set(range(len(pts))) - {at}, 0.0
    while left:
        nxt = min(left, key=lambda i: (leg(pts[at], pts[i]), i))
        miles += leg(pts[at], pts[nxt])
        at = nxt
        order.append(at)
        left.remove(at)
    return order, sum(leg(pts[i], pts[i + 1]) for i in range(len(pts) - 1)), miles


@pytest.mark.parametrize("n", [1, 2, 7, 48, 49, 300])
@pytest.mark.parametrize("grid", [True, False])
def test_walks_equal_brute_force(n, grid):
    rnd = random.Random(n)
    pts = [(float(rnd.randrange(25, 45)), float(rnd.randrange(-100, -80))) if grid else
           (rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for _ in range(n)]  # the grid has many ties and repeated stops
    for start in (None, (33.3, -91.7)):
        got = G._walk(np.array([p[0] for p in pts]), np.array([p[1] for p in pts]), start)
        want = brute_walk(pts, start)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1]) and got[2] == pytest.approx(want[2])


def test_one_route_of_very_many_stops():
    rng = np.random.default_rng(0)
    n = 100_000
    began = time.time()
    order, original, miles = G._walk(rng.uniform(25, 49, n), rng.uniform(-124, -67, n))
    assert sorted(order) == list(range(n)) and miles < original / 100
    assert time.time() - began < 240


def test_routes_across_batches_and_starts(spark):
    stops = [(r, s, 30.0 + (7 * r + 3 * s) % 11, -90.0 - (5 * s) % 7) for r in range(40) for s in range(r % 6 + 1)]
    df = spark.createDataFrame(stops, "route long, seq long, lat double, lon double").repartition(5)
    starts = spark.createDataFrame([(r, 35.0, -93.0) for r in range(0, 40, 2)], "route long, start_lat double, start_lon double")
    got = {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for x in G.optimize_stop_order(df, starts).collect():
            got.setdefault(x.route, {})[x.visit] = x.seq
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in range(40):
        pts = [(la, lo) for route, _, la, lo in stops if route == r]
        assert [got[r][i] for i in range(len(pts))] == brute_walk(pts, None if r % 2 else (35.0, -93.0))[0]


def test_short_routes_are_walked_together(monkeypatch):
    """No walk of its own for a short route; the same orders and miles as one by one."""
    rnd = random.Random(5)
    rows = [(r, s, float(rnd.randrange(25, 35)), float(rnd.randrange(-100, -90)), *((30.0, -95.0) if r % 3 == 0 else (math.nan, math.nan)))
            for r in range(200) for s in range(r % 9 + 1)]
    b = pd.DataFrame(rows, columns=["route", "seq", "lat", "lon", "start_lat", "start_lon"])
    monkeypatch.setattr(G, "_walk", None)
    monkeypatch.setattr(G, "SHORT_CELLS", 50)
    got = G._nn_frame(b)
    for r, own in got.groupby("route"):
        pts = [(x[2], x[3]) for x in rows if x[0] == r]
        order, original, miles = brute_walk(pts, (30.0, -95.0) if r % 3 == 0 else None)
        assert own["seq"].tolist() == order and own["visit"].tolist() == list(range(len(pts)))
        assert own["original_miles"].iloc[0] == pytest.approx(original) and own["optimized_miles"].iloc[0] == pytest.approx(miles)
    lat, lon = np.array([[x[2] for x in rows[-5:]]]), np.array([[x[3] for x in rows[-5:]]])
    assert G._short_walks(lat, lon, np.full((1, 2), np.nan))[1][0] == brute_walk(list(zip(lat[0], lon[0])))[1]  # to the last bit


def test_pairs_of_one_cell_are_spread(spark, monkeypatch):
    """Many points around one place: every pair once, found by several tasks."""
    monkeypatch.setattr(G, "BLOCK_PAIRS", 100)
    points = spark.range(400).select(F.col("id").alias("point_id"), (30 + F.col("id") % 20 / 20.0).alias("lat"), F.lit(-90.0).alias("lon"))
    points = points.unionByName(spark.createDataFrame([(None, 30.0, -90.0)], "point_id long, lat double, lon double"))
    centres = spark.range(10).select(F.col("id").alias("centre_id"), F.lit(30.0).alias("lat"), F.lit(-90.0).alias("lon"))
    out = G.within_radius(points, centres, 20.0).select("centre_id", "point_id", F.spark_partition_id().alias("task")).collect()
    want = [(c, p) for c in range(10) for p in [*range(400), None] if (0 if p is None else p % 20) / 20 * math.pi / 180 * 3956 <= 20.0]
    assert sorted((r[0], str(r[1])) for r in out) == sorted((c, str(p)) for c, p in want)
    assert len({r["task"] for r in out}) > 4
