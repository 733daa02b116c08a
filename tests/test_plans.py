"""Plan-shape checks: pushdown, pruning, no Python in validation, equi joins."""

from sf import SF_SMALL

from haulspark.plans.report_fact import report_fact
from haulspark.plans.collected_view import collected
from haulspark.operators import validate as V
from haulspark.operators import aggregate as A


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_fact_pushes_date_range(spark):
    df = report_fact(spark, SF_SMALL, "1997-01-01", "1997-03-31")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p
    assert "LessThan(l_shipdate" in p


def test_no_round_robin_in_front_of_the_fact(spark):
    assert "RoundRobinPartitioning" not in _plan(report_fact(spark, SF_SMALL))


def test_column_pruning_reaches_scan(spark):
    df = A.status_distribution(report_fact(spark, SF_SMALL))
    p = _plan(df)
    lineitem_scan = [x for x in p.split("\n") if "lineitem" in x and "ReadSchema" in x]
    assert lineitem_scan and "l_comment" not in lineitem_scan[0]


def test_validation_is_one_projection_without_python(spark):
    df = V.with_findings(collected(spark, SF_SMALL))
    p = _plan(df)
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_aggregates_are_partial_before_shuffle(spark):
    p = _plan(A.driver_metrics(report_fact(spark, SF_SMALL)))
    assert p.count("HashAggregate") >= 2


def test_radius_search_is_an_equi_join(spark):
    import __spark_entry__ as E
    df = E.queries()["G4_within_radius"](spark, SF_SMALL)
    p = _plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "cell_lat" in p and ("SortMergeJoin" in p or "BroadcastHashJoin" in p)


def test_summary_joins_only_needed_dimensions(spark):
    import __spark_entry__ as E
    p = _plan(E.queries()["A3_period_summary"](spark, SF_SMALL))
    assert "part.parquet" in p and "orders.parquet" not in p and "customer.parquet" not in p
    assert "supplier.parquet" not in p


def test_filter_on_computed_column_is_not_duplicated(spark):
    import __spark_entry__ as E
    p = _plan(E.queries()["A15_revenue_trend_line"](spark, SF_SMALL))
    # the efficiency score is computed in the projection, not copied into a pushed-down Filter
    assert "Generate" in p


def test_customers_join_the_orders_before_the_lines(spark):
    """Lines are shuffled for suppliers, parts and orders, never for customers."""
    from haulspark.plans.routes_view import routes
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = routes(spark, SF_SMALL, ("route_key", "customer_name", "driver_name", "vehicle_info"))
        assert _plan(df).count("hashpartitioning(l_") == 3 and "hashpartitioning(o_custkey" in _plan(df)
        assert df.count() == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_the_transform_joins_its_tables_once(spark):
    from haulspark.queries import q_entity
    for df in q_entity._transform(spark, SF_SMALL).values():
        assert "lineitem" not in _plan(df) and "Join" not in _plan(df)


def test_pages_are_whole_and_none_is_shuffled(spark, tmp_path):
    import json
    from haulspark.queries import q_jobs
    feed = spark.range(0, 1030, 1, 3).selectExpr("cast(id as string) trip_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        q_jobs._land_pages(feed, str(tmp_path / "pages"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pages = [[r["trip_id"] for r in json.loads(x["value"])["result"]["data"]] for x in spark.read.text(str(tmp_path / "pages")).collect()]
    assert sorted(int(i) for p in pages for i in p) == list(range(1030))
    assert sum(len(p) == 50 for p in pages) == 18 and all(int(p[0]) + i == int(x) for p in pages for i, x in enumerate(p))


def test_first_of_few_shuffles_once_after_a_limit_per_task(spark):
    """The fact is neither shuffled nor joined; the first row by the order, missing numbers last."""
    from haulspark.operators import entity as U
    rows = [(None, 0, "r0", "a"), (3, 1, "r1", "A"), (2, 5, "r2", "a"), (2, 4, "r3", "a"), (2, 4, "r3", "a"), (None, 1, "r4", "b"),
            (9, 9, "r5", None), (9, 9, "r6", "")]
    df = spark.createDataFrame(rows, "order_key long, line_no int, route_key string, name string").repartition(3)
    out = U.first_of_few(df, [U._key_text("name")], ["order_key", "line_no", "route_key"])
    assert sorted(r["route_key"] for r in out.collect()) == ["r3", "r4", "r5"]
    plan = _plan(spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").transform(
        lambda li: U.first_of_few(li, ["l_returnflag"], ["l_orderkey", "l_linenumber"])))
    assert "Join" not in plan and plan.count("Exchange") == 1 and "WindowGroupLimit" in plan
