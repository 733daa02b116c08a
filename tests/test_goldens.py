"""Golden values (FIXTURES F1-F3) for the column functions and metrics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from haulspark.functions import clean as C
from haulspark.functions import metrics as M


def _one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"x {typ}")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,want", [
    ("555-123-4567", "(555) 123-4567"), ("(555) 123-4567", "(555) 123-4567"),
    ("555.123.4567", "(555) 123-4567"), ("15551234567", "(555) 123-4567"),
    ("invalid", None), ("25551234567", None), ("", None)])
def test_phone(spark, raw, want):
    assert _one(spark, C.clean_phone, raw) == want


@pytest.mark.parametrize("raw,want", [
    ("test@example.com", "test@example.com"), ("TEST@EXAMPLE.COM", "test@example.com"),
    ("invalid-email", None), ("user@domain", None)])
def test_email(spark, raw, want):
    assert _one(spark, C.clean_email, raw) == want


@pytest.mark.parametrize("raw,want", [("60601", "60601"), ("60601-1234", "60601-1234"),
                                      ("606 01", "60601"), ("6060", None)])
def test_zip(spark, raw, want):
    assert _one(spark, C.clean_zip, raw) == want


@pytest.mark.parametrize("raw,want", [("il", "IL"), ("New York", "NY"), ("DC", None), ("Ontario", None)])
def test_state(spark, raw, want):
    assert _one(spark, C.clean_state, raw) == want


@pytest.mark.parametrize("raw,want", [("  123  north MAIN street ", "123 N Main St"),
                                      ("5th avenue", "5Th Ave"), ("   ", None)])
def test_address(spark, raw, want):
    assert _one(spark, C.clean_address, raw) == want


@pytest.mark.parametrize("raw,want", [
    ("2024-1-5", dt.datetime(2024, 1, 5)), ("01/15/2024 08:00", dt.datetime(2024, 1, 15, 8, 0)),
    ("13/01/2024", None), ("2024-01-15T08:00:00", None)])
def test_route_datetime(spark, raw, want):
    assert _one(spark, C.clean_datetime, raw) == want


@pytest.mark.parametrize("raw,want", [
    ("13/01/2024", dt.datetime(2024, 1, 13)), ("05/06/2024", dt.datetime(2024, 5, 6)),
    ("2024-01-15T08:00:00", dt.datetime(2024, 1, 15, 8)), ("2024-01-15 08:00", None)])
def test_collector_date(spark, raw, want):
    assert _one(spark, C.parse_date, raw) == want


@pytest.mark.parametrize("raw,want", [("$1,234.50", 1234.5), ("12%", 12.0), ("abc", None), ("5", 5.0),
                                      ("nan", None), ("1_000", None)])
def test_numeric(spark, raw, want):
    assert _one(spark, C.to_number, raw) == want


def test_idempotent_cleaning(spark):
    for fn, v in [(C.clean_phone, "555.123.4567"), (C.clean_email, " A@B.co "), (C.clean_zip, "606 01"),
                  (C.clean_state, "texas")]:
        once = _one(spark, fn, v)
        assert _one(spark, fn, once) == once


def test_haversine_and_centre(spark):
    df = spark.createDataFrame([(41.8781, -87.6298, 43.0389, -87.9065)], "a double, b double, c double, d double")
    r = df.select(M.haversine_miles("a", "b", "c", "d").alias("m"),
                  M.fuel_cost(F.lit(92.5), F.lit(8.5)).alias("f"),
                  M.profit_margin(F.lit(1250.0), F.lit(850.0)).alias("p")).first()
    assert r["m"] == 81.38 and r["f"] == 38.09 and r["p"] == 32.0


def test_ellipsoid_close_to_geodesic(spark):
    # Chicago -> Milwaukee on WGS-84 is about 81.3 miles; Andoyer-Lambert is within 0.1 %
    df = spark.createDataFrame([(41.8781, -87.6298, 43.0389, -87.9065)], "a double, b double, c double, d double")
    m = df.select(M.ellipsoid_miles("a", "b", "c", "d").alias("m")).first()["m"]
    assert abs(m - 81.3) < 0.3


def test_route_metrics_parity_f1(spark):
    """F1 route #0 with the parity defaults (8.0 mpg, 25.0 per hour)."""
    row = dict(total_miles=92.5, empty_miles=15.0, fuel_consumed=11.0, revenue=1250.0, other_costs=None,
               scheduled_start=dt.datetime(2024, 1, 15, 8, 0), scheduled_end=dt.datetime(2024, 1, 15, 14, 0),
               actual_start=dt.datetime(2024, 1, 15, 8, 15), actual_end=dt.datetime(2024, 1, 15, 14, 30),
               start_lat=None, start_lon=None, end_lat=None, end_lon=None, vehicle_mpg=None, driver_rate=None)
    schema = ("total_miles double, empty_miles double, fuel_consumed double, revenue double, other_costs double, "
              "scheduled_start timestamp_ntz, scheduled_end timestamp_ntz, actual_start timestamp_ntz, "
              "actual_end timestamp_ntz, start_lat double, start_lon double, end_lat double, end_lon double, "
              "vehicle_mpg double, driver_rate double")
    df = spark.createDataFrame([tuple(row.values())], schema)
    m = M.with_route_metrics(df).first().asDict()
    want = dict(total_hours=6.25, total_minutes=375.0, driving_hours=5.0, wait_hours=1.25, average_speed=14.8,
                est_fuel_cost=40.47, est_toll_cost=13.88, est_driver_pay=156.25, maintenance_cost=7.4,
                insurance_cost=4.62, total_variable_costs=66.38, total_costs=222.62, profit=1027.38,
                profit_margin=82.19, revenue_per_mile=13.51, cost_per_mile=2.41, deadhead_percentage=16.22,
                fuel_efficiency=8.41, efficiency_score=None, calculated_distance=None)
    for k, v in want.items():
        assert m[k] == v, k
