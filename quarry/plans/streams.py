"""Event queries in their batch form, which the streaming form must equal once all events are in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as E
from .registry import query, table

_DEBOUNCE = """WITH m AS (SELECT *, ts - lag(ts) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum((gap IS NULL OR gap >= INTERVAL 10 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM m)"""


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df, *columns):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c.endswith(("_ts", "_start", "_end")) else F.col(c) for c in columns])


@query("z03_debounce", f"{_DEBOUNCE} SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM s GROUP BY user_id, burst")
def debounce(spark, sf):
    return _plain(E.debounce(_events(spark, sf), "user_id", quiet="10 minutes"), "user_id", "first_ts", "last_ts", "n_events")


@query("z04_immediate_delete", "SELECT event_id, user_id FROM events WHERE event_type = 'logout'")
def immediate_delete(spark, sf):
    return _events(spark, sf).where("event_type = 'logout'").select("event_id", "user_id")


@query("z_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf):
    return _plain(E.windowed(_events(spark, sf), "event_type"), "window_start", "event_type", "n", "total")


@query("z_sliding", "SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 2) r(k) GROUP BY 1, 2")
def sliding(spark, sf):
    return _plain(E.windowed(_events(spark, sf), "event_type", width="12 hours", slide="6 hours"), "window_start", "event_type", "n", "total")


@query("z_session", f"{_DEBOUNCE} SELECT count(*) AS sessions, max(n) AS longest FROM (SELECT count(*) AS n FROM s GROUP BY user_id, burst)")
def session(spark, sf):
    return E.debounce(_events(spark, sf), "user_id", quiet="10 minutes").agg(F.count(F.lit(1)).alias("sessions"), F.max("n_events").alias("longest"))


@query("z_dedup", "SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY 1, 2")
def dedup(spark, sf):
    return _plain(_events(spark, sf).groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts")), "user_id", "event_type", "first_ts")
