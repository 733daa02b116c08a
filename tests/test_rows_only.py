"""Invariant checks for queries without a SQL oracle, and error paths."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sf import SF_SMALL

from haulspark.operators import standardize as P

Q = E.queries()


def test_ellipsoid_query_close_to_haversine(spark):
    df = Q["M2_ellipsoid_miles"](spark, SF_SMALL).join(Q["M1_haversine_miles"](spark, SF_SMALL)
                                                       .withColumnRenamed("miles", "h"), "route_key")
    worst = df.select(F.max(F.abs(F.col("miles") - F.col("h")) / F.greatest(F.col("h"), F.lit(1.0)))).first()[0]
    assert worst < 0.01  # ellipsoid vs sphere differ by well under 1 %


def test_nested_cleaning_rows(spark):
    df = Q["P18_clean_nested_record"](spark, SF_SMALL)
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    bad = df.filter(F.col("customer.phone").isNotNull() & ~F.col("customer.phone").rlike(r"^\(\d{3}\) \d{3}-\d{4}$"))
    assert bad.count() == 0


def test_missing_required_column_fails_before_any_job(spark):
    df = spark.createDataFrame([("a",)], "`Route ID` string")
    with pytest.raises(ValueError, match="missing required columns"):
        P.require_columns(P.apply_mapping(df, {"Route ID": "route_id"}), ["route_id", "route_date"])


def test_name_collision_raises(spark):
    df = spark.createDataFrame([("a", "b")], "`Route ID` string, `route-id` string")
    with pytest.raises(ValueError, match="collide"):
        P.normalize_columns(df)
