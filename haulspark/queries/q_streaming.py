"""Streaming: X1-X4 (file polling, cross-poll dedupe, event-time windows,
idempotent foreachBatch totals).  Each query lands the events in several polls,
runs its stream over each from the same checkpoint and returns the sink."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import table
from ..streaming import polling as X
from .registry import register

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
LANDED_SCHEMA = T.StructType([T.StructField(f.name, T.StringType()) for f in EVENTS_SCHEMA.fields])

POLL_DAYS = 8  # days of events that land before a poll
POLLS = 5  # four of them, and one of rows that come late only
LATE_EVERY = 97  # every so many-th event lands one poll late
LATENESS = "1 hour"


def arrivals(spark, sf):
    """Events with the poll before which they land.  Event time is a TIMESTAMP
    (watermarks need it; the session zone is UTC, so wall-clock values stay)."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    poll = F.floor((F.dayofmonth("ts") - 1) / POLL_DAYS) + F.when(F.col("event_id") % LATE_EVERY == 0, 1).otherwise(0)
    return e.withColumn("poll", poll.cast("int"))


# rows as the streams see them: those an earlier poll's watermark closed are gone
ARRIVED_SQL = f"""
arrived AS (
  SELECT *, (day(ts) - 1) // {POLL_DAYS} + CASE WHEN event_id % {LATE_EVERY} = 0 THEN 1 ELSE 0 END AS poll FROM events),
polls AS (SELECT poll, max(ts) AS newest FROM arrived GROUP BY poll),
marks AS (SELECT a.poll, max(b.newest) - INTERVAL {LATENESS} AS mark FROM polls a LEFT JOIN polls b ON b.poll < a.poll GROUP BY a.poll),
in_time AS (
  SELECT date_trunc('hour', ts) AS hour, count(*) AS n, sum(cast(round_even(value * 100, 0) AS BIGINT)) AS cents
  FROM arrived JOIN marks USING (poll)
  WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY 1),
final AS (SELECT max(ts) - INTERVAL {LATENESS} AS mark FROM events)"""


def _poll_all(spark, sf, name, stream_of, polls=POLLS):
    """Land and poll in turn; ``stream_of(poller)`` builds the stream anew each time, as after a restart."""
    p = X.Poller(spark, name)
    landed = arrivals(spark, sf)
    for k in range(polls):
        p.land(landed.filter(F.col("poll") == k).drop("poll"))
        p.poll(stream_of(p))
    return p.result()


def _events_stream(p):
    return X.poll_directory(p.spark, p.landing, EVENTS_SCHEMA, "parquet")


@register("X1_poll_new_files", """
SELECT event_type, count(*) AS events, sum(cast(round_even(value * 100, 0) AS BIGINT)) / 100.0 AS total_value
FROM events GROUP BY event_type""")
def x1(spark, sf):
    """Events are landed as CSV files (the collector's drop folder) before each of
    two polls; every file is read once, in batches of three files, standardised
    (typed), and archived."""
    p = X.Poller(spark, "x1")
    events = table(spark, sf, "events")
    for k in range(2):
        p.land(events.filter(F.col("event_id") % 2 == k).repartition(4), "csv", header=True)
        s = X.poll_directory(spark, p.landing, LANDED_SCHEMA, "csv", files_per_batch=3, archive=p.archive, header=True)
        p.poll(s.select("event_type", F.col("value").cast("double").alias("value")))
    return p.result().groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        (F.sum(F.rint(F.col("value") * 100).cast("long")) / 100.0).alias("total_value"))


@register("X2_dedupe_across_polls", "SELECT DISTINCT user_id, event_type FROM events")
def x2(spark, sf):
    """Repeats of (user, event type) within the 30-day horizon are dropped, also
    those of an earlier poll."""
    return _poll_all(spark, sf, "x2", lambda p: X.dedupe_within_watermark(
        _events_stream(p), ["user_id", "event_type"], "ts", "30 days").select("user_id", "event_type", "ts")) \
        .select("user_id", "event_type")


def _naive(df):
    return df.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                     F.col("window_end").cast("timestamp_ntz").alias("window_end"), "events", "total_value")


@register("X3_daily_window_totals", f"""
WITH {ARRIVED_SQL}
SELECT date_trunc('day', hour) AS window_start, date_trunc('day', hour) + INTERVAL 1 DAY AS window_end,
       cast(sum(n) AS BIGINT) AS events, sum(cents) / 100.0 AS total_value
FROM in_time GROUP BY 1, 2 HAVING date_trunc('day', hour) + INTERVAL 1 DAY <= (SELECT mark FROM final)""")
def x3(spark, sf):
    """Daily totals over five polls, the closed days; rows later than an hour are dropped."""
    return _naive(_poll_all(spark, sf, "x3", lambda p: X.period_totals(
        _events_stream(p), "ts", "1 day", None, LATENESS, "value")))


@register("X3_sliding_24h_activity", f"""
WITH {ARRIVED_SQL}
SELECT hour - to_hours(k) AS window_start, hour - to_hours(k) + INTERVAL 24 HOUR AS window_end,
       cast(sum(n) AS BIGINT) AS events, sum(cents) / 100.0 AS total_value
FROM in_time, range(0, 24) t(k) GROUP BY 1, 2 HAVING hour - to_hours(k) + INTERVAL 24 HOUR <= (SELECT mark FROM final)""")
def x3s(spark, sf):
    """Activity of the last 24 hours, every hour, over five polls."""
    return _naive(_poll_all(spark, sf, "x3s", lambda p: X.period_totals(
        _events_stream(p), "ts", "24 hours", "1 hour", LATENESS, "value")))


@register("X4_foreach_batch_totals", """
SELECT user_id, count(*) AS events, sum(cast(round_even(value * 100, 0) AS BIGINT)) / 100.0 AS total_value
FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def x4(spark, sf):
    """Running totals per user, merged batch by batch.  Totals are kept of completed
    jobs only; a purchase is the event that completes one."""
    p = X.Poller(spark, "x4")
    totals = X.RunningTotals(spark, p.base, "user_id", "value", compact_every=2)
    landed = arrivals(spark, sf)
    for k in range(POLLS):
        p.land(landed.filter(F.col("poll") == k).drop("poll"))
        p.poll(_events_stream(p).filter(F.col("event_type") == "purchase"), totals.merge)
    return totals.totals()
