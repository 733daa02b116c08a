"""The collector data source: ranges, offsets, corrupt pages."""

import json
import os

import pytest

from haulspark.sources import collector as SC
from haulspark.streaming import polling as X


def land(folder, poll, pages):
    d = os.path.join(folder, SC.landing_name(poll))
    os.makedirs(d)
    with open(os.path.join(d, "part-0.txt"), "w") as f:
        f.write("".join(p + "\n" for p in pages))


def page(*ids):
    return json.dumps({"result": {"data": [{"id": str(i), "n": i, "none": None} for i in ids]}})


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_every_page_is_in_one_range(tmp_path, split):
    pages = [page(*range(k, k + 3)) for k in range(0, 30, 3)] + ["", page(99)]
    land(str(tmp_path), 0, pages)
    got = [p for r in SC.ranges(SC.list_files(str(tmp_path)), split) for p in SC.pages(str(tmp_path), r)]
    assert [p.decode().rstrip("\n") for p in got] == [p for p in pages if p]


def test_batch_and_stream_read_the_same_rows(spark, tmp_path):
    SC.register_sources(spark)
    schema = "id string, n string, none string, absent string"
    p = X.Poller(spark, "t-e5", str(tmp_path / "base"))
    seen = []
    for k in range(3):
        land(p.landing, k, [page(*range(100 * k + 10 * i, 100 * k + 10 * i + 10)) for i in range(4)])
        p.poll(spark.readStream.format("payload_pages").schema(schema).option("records", "result.data").option("split_bytes", 100).load(p.landing))
        seen.append(p.result().count())
    assert seen == [40, 80, 120]
    batch = spark.read.format("payload_pages").schema(schema).option("records", "result.data").option("split_bytes", 100).load(p.landing)
    assert batch.rdd.getNumPartitions() > 3
    rows = sorted(tuple(r) for r in batch.collect())
    assert rows == sorted(tuple(r) for r in p.result().collect()) and rows[0] == ("0", "0", None, None)


def test_one_object_is_one_record_and_no_schema_gives_json(spark, tmp_path):
    SC.register_sources(spark)
    land(str(tmp_path), 0, ['{"data": {"id": "a"}}', '{"data": [{"id": "b"}, 5]}'])
    got = sorted(json.dumps(json.loads(r.record)) for r in spark.read.format("payload_pages").load(str(tmp_path)).collect())
    assert got == ["5", '{"id": "a"}', '{"id": "b"}']


def test_pages_that_do_not_parse_are_kept_or_stop_the_read(spark, tmp_path):
    SC.register_sources(spark)
    land(str(tmp_path), 0, [page(1), "{not json", '{"status": "empty"}'])
    read = spark.read.format("payload_pages").option("records", "result.data")
    got = {(r.id, r._corrupt_record) for r in read.schema("id string, _corrupt_record string").load(str(tmp_path)).collect()}
    assert got == {("1", None), (None, "{not json"), (None, '{"status": "empty"}')}
    with pytest.raises(Exception):
        read.schema("id string").load(str(tmp_path)).collect()


def test_empty_folder(spark, tmp_path):
    SC.register_sources(spark)
    assert spark.read.format("payload_pages").schema("id string").load(str(tmp_path / "none")).count() == 0
