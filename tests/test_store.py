"""The entity store and first-wins dedupe."""

import pytest
from pyspark.sql import functions as F

from haulspark.operators import entity as U
from haulspark.session import scratch_path
from haulspark.sources import store as ST


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, phone string, email string")


def test_ids_go_on_without_gaps_and_the_same_batch_adds_nothing(spark):
    s = ST.Store(spark, scratch_path(spark, "t-store"))
    first = people(spark, ("b", None, "x"), ("A", "1", None), ("a", "1", ""), ("c", "", ""))
    second = people(spark, ("C", None, None), ("d", "2", "y"), ("a", "1", None))
    assert sorted(r["id"] for r in s.append("customers", first).collect()) == [1, 2, 3]
    assert s.append("customers", first).count() == 0
    assert [(r["name"], r["id"]) for r in s.append("customers", second).collect()] == [("d", 4)]
    assert s.append("customers", second.filter("false")).count() == 0
    assert s.version("customers")[:2] == (2, 4)
    got = {r["natural_key"].split(ST.SEPARATOR)[0]: r["id"] for r in s.read("customers").collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 4}
    linked = s.ids("customers", people(spark, ("D", "2", "y"), ("zz", None, None)), id_col="customer_id").collect()
    assert {r["name"]: r["customer_id"] for r in linked} == {"D": 4, "zz": None}


def test_many_batches_are_merged_and_stay_gapless(spark, monkeypatch):
    monkeypatch.setattr(ST, "COMPACT_EVERY", 2)
    s = ST.Store(spark, scratch_path(spark, "t-store-many"))
    for k in range(5):
        s.append("customers", people(spark, *((f"p{i}", None, None) for i in range(3 * k, 3 * k + 5))))
    assert sorted(r["id"] for r in s.read("customers").collect()) == list(range(1, 18))
    assert len(s.version("customers")[2]) <= 2


def test_an_append_that_fails_leaves_the_table_and_one_of_two_writers_fails(spark, monkeypatch):
    base = scratch_path(spark, "t-store-two")
    a, b = ST.Store(spark, base), ST.Store(spark, base)
    a.append("customers", people(spark, ("a", None, None)))
    commit = ST.Store._commit

    def other_first(self, *args):
        monkeypatch.setattr(ST.Store, "_commit", commit)
        a.append("customers", people(spark, ("b", None, None)))
        commit(self, *args)

    monkeypatch.setattr(ST.Store, "_commit", other_first)
    with pytest.raises(Exception, match="(?i)already exists"):
        b.append("customers", people(spark, ("c", None, None)))
    assert {r["natural_key"][0] for r in a.read("customers").collect()} == {"a", "b"}
    assert b.append("customers", people(spark, ("c", None, None))).first()["id"] == 3


def test_missing_tables_are_an_error(spark):
    with pytest.raises(ValueError, match="no table"):
        ST.Store(spark, scratch_path(spark, "t-store-none")).read("customers")


@pytest.mark.parametrize("first", [U.first_per_key, U.first_of_few])
def test_first_wins_with_missing_parts_and_a_hot_key(spark, first):
    rows = [(i // 2, i % 2, f"r{i:04d}", None if i % 5 == 0 else "", "k" if i % 3 else None, i) for i in range(600)]
    rows += [(0, 0, "r0000a", "", None, -1)]  # a tie in the numbers
    df = spark.createDataFrame(rows, "o long, l int, r string, a string, b string, v long").repartition(4)
    out = first(df, ["a", "b"], ["o", "l", "r"])
    got = {(r["a"] or "", r["b"] or ""): r["v"] for r in out.collect()}
    want = {}
    for o, k, r, a, b, v in sorted(rows, key=lambda x: x[:3]):
        want.setdefault((a or "", b or ""), v)
    assert got == want and out.columns == df.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SinglePartition" not in plan
    assert ("WindowGroupLimit" in plan) if first is U.first_per_key else ("HashAggregate" in plan)


def test_locations_keep_coordinates(spark):
    df = spark.sql("""SELECT 1L AS o, named_struct('address', 'A', 'city', 'c', 'state', 's', 'zip_code', CAST(NULL AS STRING),
        'latitude', 1.5D, 'longitude', 2.5D) AS p, named_struct('address', 'a', 'city', 'C', 'state', 'S', 'zip_code', '',
        'latitude', 9D, 'longitude', 9D) AS q""")
    assert [tuple(r) for r in U.unique_locations(df, ["p", "q"], ["o"]).collect()] == [("A", "c", "s", None, 1.5, 2.5)]
