"""Landed files: encodings, rejects; exports and the route store."""

import json
import os

import pytest
from pyspark.sql import functions as F

from haulspark.session import scratch_path
from haulspark.sources import files as S
from haulspark.sources import sinks as K


def put(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def test_each_file_by_its_own_encoding(spark, tmp_path):
    d = str(tmp_path)
    put(d, "a.csv", "id,name\n1,Zoë\n2,日本\n".encode())
    put(d, "b.csv", "id,name\n3,Zoë\n4,plain\n".encode("latin-1"))
    put(d, "c.csv", "id,name\n5,plain\n6,NULL\n".encode())
    out = S.read_csv_any_encoding(spark, d)
    assert {r.id: r.name for r in out.collect()} == {"1": "Zoë", "2": "日本", "3": "Zoë", "4": "plain", "5": "plain", "6": None}


def test_good_and_rejected_documents_are_all_that_landed(spark, tmp_path):
    docs = ['{"data": [{"a": 1}, {"a": 2}]}', '[{"a": 3}]', '{"a": 4}', '{"data": [', "not json", "7", '"text"', "", "  ", "[]"]
    for i, t in enumerate(docs):
        put(str(tmp_path / "in"), f"{i}.json", t.encode())
    rows = S.read_json_documents(spark, str(tmp_path / "in"))
    good, bad = S.split_rejects(rows, str(tmp_path / "out"), "2024-01-31", [S.field(F.col("record"), "a", "int").alias("a")])
    assert sorted(r.a for r in good.collect()) == [1, 2, 3, 4]
    assert sorted((os.path.basename(r.path), r.document, r.reasons[0]) for r in bad.collect()) == [
        ("3.json", '{"data": [', S.NOT_JSON), ("4.json", "not json", S.NOT_JSON), ("5.json", "7", S.NOT_RECORDS), ("6.json", '"text"', S.NOT_RECORDS)]
    assert str(bad.first().load_date) == "2024-01-31"


def test_lines_with_too_many_or_too_few_values(spark, tmp_path):
    put(str(tmp_path / "in"), "a.csv", b"1,x\n2,y,z\n3\n4,NULL\n")
    good, bad = S.split_rejects(S.read_csv_with_rejects(spark, str(tmp_path / "in"), ["id", "v"]), str(tmp_path / "out"), "2024-01-31",
                                [F.col("id"), F.col("v")])
    assert sorted(tuple(r) for r in good.collect()) == [("1", "x"), ("4", None)]
    assert sorted(r.document for r in bad.collect()) == ["2,y,z", "3"]


def test_a_hot_month_is_split_and_others_stay(spark):
    path = scratch_path(spark, "t-s12")
    old = spark.sql("SELECT DATE '2020-05-01' AS route_date, -1L AS v UNION ALL SELECT DATE '2020-07-01', -2L")
    K.write_route_store(old, path)
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        hot = spark.range(200_000, numPartitions=8).select(F.lit("2020-05-03").cast("date").alias("route_date"), F.rand(1).alias("x"), F.col("id").alias("v"))
        K.write_route_store(hot.select("route_date", "v"), path)
    finally:
        for k in settings:
            spark.conf.unset(k)
    got = {r.route_month: (r.n, r.s) for r in spark.read.parquet(path).groupBy("route_month").agg(F.count("*").alias("n"), F.min("v").alias("s")).collect()}
    assert got == {"2020-05": (200_000, 0), "2020-07": (1, -2)}
    assert len([f for f in os.listdir(os.path.join(path, "route_month=2020-05")) if f.endswith(".parquet")]) > 1


def test_exports_count_while_writing_and_commit_last(spark):
    root = scratch_path(spark, "t-s15")
    sections = {"a": spark.range(5).toDF("x"), "none": spark.range(0).toDF("x")}
    got = K.export_bundle(sections, root, ["csv", "json", "pdf", "parquet"], "daily", "2024-01-31T00:00:00", {"kind": "daily"})
    rows = {(r.section, r.format): (r.rows, r.status) for r in got.collect()}
    assert rows == {("a", "csv"): (5, "ok"), ("a", "json"): (5, "ok"), ("a", "parquet"): (5, "ok"),
                    ("a", "pdf"): (0, "failed: ValueError"), ("none", "pdf"): (0, "failed: ValueError")}
    path = got.filter("section = 'a' AND format = 'json'").first().path
    line = json.loads(spark.read.text(path).first()[0])
    assert (line["report_name"], line["generated_at"], line["metadata"], line["section"]) == ("daily", "2024-01-31T00:00:00", {"kind": "daily"}, "a")
    assert set(line["record"]) == {"x"}


def test_exports_leave_nothing_cached(spark):
    import __spark_entry__ as E
    from sf import SF_SMALL
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    E.queries()["S15_multi_format_export"](spark, SF_SMALL).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


@pytest.mark.parametrize("name", ["R4_daily_report", "R6_monthly_report"])
def test_a_bundle_scans_the_fact_once(spark, name):
    """The sections read the written sums only; the fact's scan is in the job that writes them."""
    import __spark_entry__ as E
    from sf import SF_SMALL
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "bundle-" in plan


def test_an_empty_period_has_an_outcome_only(spark):
    from haulspark.plans import bundle as B
    from haulspark.plans.report_fact import report_fact
    from sf import SF_SMALL
    targets = spark.createDataFrame([("average_speed", 50.0)], "metric string, target double")
    got = B.report_bundle(report_fact(spark, SF_SMALL, "1990-01-01", "1990-01-31", need=B.NEED), B.MONTHLY, targets).collect()
    assert {(r.section, r.key) for r in got} == {("status", "no_data")} and all(r.value == 0 for r in got)
