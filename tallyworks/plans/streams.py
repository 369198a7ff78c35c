"""Queries that run the event log as a stream to its end and read the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.store import shared_dir
from tallyworks.streaming import events as ev

QUERIES, SQL = {}, {}
FILED = ev.EVENTS.replace("ts timestamp", "ts timestamp_ntz")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ev.read_events(spark, f"{sf_dir}/event[s].parquet", FILED, files=None)
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


def _ran(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end into the shared folder. A window is written when the watermark passes it; no row may be late."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    late = ev.run_once(stream, f"{path}/out", f"{path}/checkpoint", mode)
    if late:
        raise RuntimeError(f"{late} rows came after the watermark and were left out")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events
WHERE CAST(ts AS DATE) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) GROUP BY 1, 2""")
def stream_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that are over, a day after the last of their events may come."""
    days = _ran(spark, ev.windowed(_stream(spark, sf_dir), "1 day", keys=("event_type",)))
    return days.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT user_id, event_type, CAST(count(DISTINCT hour) AS BIGINT) AS hours FROM (SELECT user_id, event_type, date_trunc('hour', ts) AS hour FROM events) GROUP BY 1, 2")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first delivery of each user, type and hour, counted."""
    hours = _stream(spark, sf_dir).select("user_id", "event_type", F.date_trunc("hour", "ts").alias("ts"))
    first = _ran(spark, ev.once(hours, ["user_id", "event_type", "ts"], "60 days"))
    return first.groupBy("user_id", "event_type").agg(F.count("*").alias("hours"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
walk AS (SELECT user_id, event_id, k, t AS start, 1 AS used FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.t - w.start >= 86400000000 THEN e.t ELSE w.start END, CASE WHEN e.t - w.start >= 86400000000 THEN 1 ELSE w.used + 1 END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, event_id, used <= 3 AS allowed FROM walk""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events a user in a day that starts with the user's first."""
    return _ran(spark, ev.rate_limited(_stream(spark, sf_dir), "user_id", 86400.0, 3)).select("user_id", "event_id", "allowed")


@query("""
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, run
HAVING max(ts) + INTERVAL 26 HOUR <= (SELECT max(ts) FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are over."""
    return _ran(spark, ev.sessions(_stream(spark, sf_dir), "2 hours")).select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("""
WITH w AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events)
SELECT epoch_us(start) AS start_us, count(*) AS n FROM w GROUP BY start HAVING start + INTERVAL 36 HOUR <= (SELECT max(ts) FROM events)""")
def stream_sliding_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of twelve hours every six, those that are over."""
    return _ran(spark, ev.windowed(_stream(spark, sf_dir), "12 hours", "6 hours")).select(F.unix_micros("start").alias("start_us"), "n")
