"""Polls: files that arrive between runs, replayed batches, late rows, archived files."""

import os

import pytest
from pyspark.sql import functions as F

from haulspark.streaming import polling as X

SCHEMA = "k string, ts timestamp, v double"


def rows(spark, *data):
    return spark.createDataFrame([(k, t, v) for k, t, v in data], "k string, ts string, v double").withColumn(
        "ts", F.col("ts").cast("timestamp"))


def stream(p):
    return X.poll_directory(p.spark, p.landing, SCHEMA, "parquet")


def test_files_that_arrive_between_runs_are_read_once_and_archived(spark):
    p = X.Poller(spark, "t-x1")
    seen = []
    for k in range(3):
        p.land(rows(spark, *((f"{k}-{i}", "2024-01-01 00:00:00", 1.0) for i in range(8))).repartition(4), "csv", header=True)
        s = X.poll_directory(spark, p.landing, SCHEMA, "csv", files_per_batch=2, archive=p.archive, header=True)
        p.poll(s)
        seen.append(p.result().count())
    assert seen == [8, 16, 24]
    batches = [f for f in os.listdir(os.path.join(p.checkpoint, "commits")) if f.isdigit()]
    assert len(batches) >= 6  # two files a batch
    p.poll(X.poll_directory(spark, p.landing, SCHEMA, "csv", files_per_batch=2, archive=p.archive, header=True))
    assert p.result().count() == 24
    archived = [f for _, _, names in os.walk(p.archive) for f in names if f.endswith(".csv")]
    assert archived


def test_too_old_files_are_ignored(spark):
    p = X.Poller(spark, "t-x1-old")
    p.land(rows(spark, ("a", "2024-01-01 00:00:00", 1.0)).coalesce(1))
    for name in os.listdir(p.landing):
        if name.endswith(".parquet"):
            os.utime(os.path.join(p.landing, name), (1, 1))
    p.poll(stream(p))
    p.land(rows(spark, ("b", "2024-01-01 00:00:00", 1.0)).coalesce(1))
    p.poll(stream(p))
    for name in os.listdir(p.landing):
        if name.endswith(".parquet"):
            os.utime(os.path.join(p.landing, name), (1, 1))
    p.land(rows(spark, ("c", "2024-01-01 00:00:00", 1.0)).coalesce(1))
    p.poll(stream(p))
    assert {r.k for r in p.result().collect()} >= {"b", "c"}


def test_repeats_of_earlier_polls_are_dropped_until_the_horizon(spark):
    p = X.Poller(spark, "t-x2")
    polls = [[("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 01:00:00", 2.0), ("b", "2024-01-01 02:00:00", 3.0)],
             [("a", "2024-01-01 05:00:00", 4.0), ("c", "2024-01-03 00:00:00", 5.0)],
             [("a", "2024-01-03 02:00:00", 6.0), ("c", "2024-01-03 03:00:00", 7.0), ("b", "2024-01-01 03:00:00", 8.0)]]
    for data in polls:
        p.land(rows(spark, *data).coalesce(1))
        p.poll(X.dedupe_within_watermark(stream(p), ["k"], "ts", "1 day"))
    got = sorted((r.k, r.v) for r in p.result().collect())
    # a's first poll keeps one of two; its state is gone by the third; the late b is dropped
    assert [k for k, _ in got] == ["a", "a", "b", "c"] and ("a", 6.0) in got and ("b", 3.0) in got and ("c", 5.0) in got


def test_late_rows_are_absent_and_state_is_bounded(spark):
    p = X.Poller(spark, "t-x3")
    polls = [[("a", "2024-01-01 10:05:00", 1.0), ("a", "2024-01-01 10:50:00", 2.0)],
             [("a", "2024-01-02 09:30:00", 4.0)],
             [("a", "2024-01-01 10:59:00", 100.0), ("a", "2024-01-02 08:45:00", 8.0), ("a", "2024-01-05 00:00:00", 16.0)],
             [("a", "2024-01-05 02:00:00", 32.0), ("a", "2024-01-02 09:40:00", 200.0)]]
    for data in polls:
        p.land(rows(spark, *data).coalesce(1))
        p.poll(X.period_totals(stream(p), "ts", "1 day", None, "1 hour", "v"))
    got = {str(r.window_start)[:10]: (r.events, r.total_value) for r in p.result().collect()}
    # 100 is days late, 200 as well once the fifth has begun; 8 is within the hour; the fifth is still open
    assert got == {"2024-01-01": (2, 3.0), "2024-01-02": (2, 12.0)}


def test_sliding_windows_hold_hours_not_rows(spark):
    p = X.Poller(spark, "t-x3s")
    for data in ([("a", f"2024-01-01 03:{m:02d}:00", 1.0) for m in range(60)], [("a", "2024-01-03 12:00:00", 1.0)]):
        p.land(rows(spark, *data).coalesce(1))
        p.poll(X.period_totals(stream(p), "ts", "24 hours", "1 hour", "1 hour", "v"))
    got = {(str(r.window_start), r.events) for r in p.result().filter("window_end <= '2024-01-02 04:00:00'").collect()}
    assert len(got) == 24 and {n for _, n in got} == {60}


class Crash(Exception):
    pass


@pytest.mark.parametrize("compact_every", [1, 8])
def test_a_batch_re_run_after_a_failure_counts_once(spark, compact_every):
    p = X.Poller(spark, "t-x4")
    want = {}
    for k in range(4):
        data = [(f"u{i % 3}", "2024-01-01 00:00:00", float(i + k)) for i in range(7)]
        p.land(rows(spark, *data).coalesce(1))
        for u, _, v in data:
            n, s = want.get(u, (0, 0.0))
            want[u] = (n + 1, s + v)
        failing = []

        def crash(batch_id):
            failing.append(batch_id)
            raise Crash("between increment and commit")

        ok = X.RunningTotals(spark, p.base, "k", "v", compact_every)
        if k in (1, 2):  # increment written, nothing committed: the checkpoint re-runs the batch by its id
            bad = X.RunningTotals(spark, p.base, "k", "v", compact_every, on_written=crash)
            with pytest.raises(Exception, match="between increment and commit"):
                p.poll(stream(p), bad.merge)
            assert failing == [k] and ok.current()[0] == k - 1
        p.poll(stream(p), ok.merge)
        assert ok.current()[0] == k
        if k == 3:  # committed, but the stream does not know: the same batch comes again
            ok.merge(rows(spark, *data), k)
        got = {r.k: (r.events, r.total_value) for r in ok.totals().collect()}
        assert got == want
    assert len(ok.current()[1]) <= compact_every


def test_totals_before_the_first_batch_are_an_error(spark):
    p = X.Poller(spark, "t-x4-none")
    with pytest.raises(ValueError, match="no batch"):
        X.RunningTotals(spark, p.base, "k", "v").totals()
