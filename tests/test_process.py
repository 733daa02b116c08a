"""R2: the process job over a store that already holds some of the batch."""

import pytest
from pyspark.sql import functions as F

from haulspark.plans import jobs as JB
from haulspark.queries.q_entity import ORDER
from haulspark.queries.q_jobs import _process_gazetteer
from haulspark.queries.q_standardize import raw_nested
from haulspark.session import scratch_path
from haulspark.sources import store as ST
from sf import SF_SMALL


def test_the_same_batch_twice_adds_nothing_and_keeps_ids(spark):
    raw = raw_nested(spark, SF_SMALL).filter("order_key % 60 = 0").checkpoint()
    gaz = _process_gazetteer(raw).checkpoint()
    store = ST.Store(spark, scratch_path(spark, "t-r2"))
    first = JB.process_routes(spark, raw, gaz, store, ORDER)
    n = {t: df.count() for t, df in first.items() if t != "checks"}
    assert all(n.values()) and first["checks"].first()["passed"]
    routes = {r["route_key"]: r.asDict() for r in store.read("routes").select("route_key", *[i for _, _, i in JB.LINKS], "total_costs").collect()}
    assert all(r["vehicle_id"] and r["start_location_id"] for r in routes.values())
    again = JB.process_routes(spark, raw, gaz, store, ORDER)
    assert all(df.count() == 0 for t, df in again.items() if t != "checks")
    assert {t: store.read(t).count() for t in n} == n
    linked = store.read("routes").join(store.read("customers").select(F.col("id").alias("customer_id"), F.col("name").alias("known")), "customer_id")
    assert linked.count() > 0 and linked.filter("NOT customer.name <=> known").count() == 0


def test_a_batch_without_dates_is_not_stored(spark):
    raw = raw_nested(spark, SF_SMALL).filter("order_key % 60 = 0").withColumn("route_date", F.lit("no date"))
    store = ST.Store(spark, scratch_path(spark, "t-r2-none"))
    with pytest.raises(ValueError, match="Data validation failed"):
        JB.process_routes(spark, raw, _process_gazetteer(raw_nested(spark, SF_SMALL)), store, ORDER)
    assert store.version("routes")[2] == [] and store.version("locations")[2] == []
