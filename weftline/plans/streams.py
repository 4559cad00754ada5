"""Queries over the events table as a stream; additions to the reference's batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans.codecs import scratch
from weftline.plans.registry import Registry
from weftline.streaming import events as E

R = Registry()
_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _source(spark, sf):
    return E.source(spark, f"{sf}/events.parquet")


@R.query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    found = E.drain(E.tumbling(_source(spark, sf)), scratch(spark), "complete")
    return found.select(F.date_format("start", _FORMAT).alias("start_at"), "event_type", "n", F.round("total", 4).alias("total"))


@R.query("SELECT strftime(time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes', '%Y-%m-%d %H:%M:%S') AS start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def stream_sliding(spark, sf):
    found = E.drain(E.tumbling(_source(spark, sf), "1 hour", "30 minutes"), scratch(spark), "complete")
    return found.select(F.date_format("start", _FORMAT).alias("start_at"), "event_type", "n", F.round("total", 4).alias("total"))


@R.query("""WITH e AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes', true) AS new FROM events),
s AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_at, strftime(max(ts) + INTERVAL '30 minutes', '%Y-%m-%d %H:%M:%S') AS end_at, count(*) AS n FROM s GROUP BY user_id, i""")
def stream_sessions(spark, sf):
    found = E.drain(E.sessions(_source(spark, sf)), scratch(spark), "complete")
    return found.select("user_id", F.date_format("start", _FORMAT).alias("start_at"), F.date_format("end", _FORMAT).alias("end_at"), "n")


@R.query("SELECT user_id, event_id, event_id - lag(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events")
def stream_index_delta(spark, sf):
    return E.drain(E.index_deltas(_source(spark, sf)), scratch(spark), "append")
