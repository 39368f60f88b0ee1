"""Queries of the streaming variants: each runs a stream over a whole table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkgrid.plans.registry import Registry
from talkgrid.streaming import flows as S

R = Registry()


@R.add("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_to_table(S.tumbling(S.stream_table(spark, sf, "events")), "complete")


@R.add(
    """WITH w AS (SELECT event_type, epoch_us(time_bucket(INTERVAL '30 minutes', ts)) - unnest([0, 1]) * 1800000000 AS start_us FROM events)
SELECT start_us, event_type, count(*) AS n FROM w GROUP BY ALL"""
)
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_to_table(S.sliding(S.stream_table(spark, sf, "events")), "complete")


@R.add(
    """WITH o AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE ts IS NOT NULL),
 g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL '30 minutes') AS end_us, count(*) AS n FROM g GROUP BY user_id, g"""
)
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_to_table(S.sessions(S.stream_table(spark, sf, "events")), "complete")


@R.add("SELECT DISTINCT event_id FROM events_timeline WHERE event_id IS NOT NULL")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.stream_table(spark, sf, "events_timeline").select("event_id").filter("event_id IS NOT NULL")
    return S.run_to_table(S.deduplicated(rows, ["event_id"]), "append")


@R.add("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '5 minutes'")
def stream_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_to_table(S.interval_join(S.stream_table(spark, sf, "events"), S.stream_table(spark, sf, "events")), "append")


@R.add(
    """WITH o AS (SELECT event_type, event_id, epoch_us(ts) AS us, value, last_value(CASE WHEN value >= 80 THEN 1 WHEN value <= 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS st FROM events),
 w AS (SELECT *, coalesce(st, 0) AS on_, coalesce(lag(st) OVER (PARTITION BY event_type ORDER BY us, event_id), 0) AS was FROM o),
 r AS (SELECT *, sum(CASE WHEN on_ = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM w WHERE on_ = 1 OR was = 1)
SELECT event_type, min(us) AS start_us, max(us) AS end_us, max(value) AS peak FROM r GROUP BY event_type, run HAVING min(on_) = 0"""
)
def stream_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_to_table(S.stream_hysteresis(S.stream_table(spark, sf, "events"), 80, 20), "append")
