"""Registered streaming queries: the events, read as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.streaming import state, windows


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(spark, sf_dir)


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(spark, sf_dir)


def stream_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_events(spark, sf_dir)


def stream_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.funnels(spark, sf_dir)


def stream_click_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.click_purchases(spark, sf_dir)


def stream_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.distinct_events(spark, sf_dir)


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.sessions(spark, sf_dir)


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_first_events, stream_funnels, stream_click_purchases, stream_distinct_events, stream_sessions)}

#: The last watermark of the stream: what lies behind it is settled.
_SETTLED = "settled AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS until FROM events)"

SQL = {
    "stream_tumbling": """
SELECT date_trunc('day', ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
    "stream_sliding": """
SELECT started, count(*) AS n, count(DISTINCT user_id) AS users FROM (
  SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS started, user_id FROM events, (SELECT unnest([0, 1, 2, 3]) AS k))
GROUP BY started""",
    "stream_first_events": """
SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY user_id, event_type""",
    "stream_funnels": f"""
WITH RECURSIVE {_SETTLED},
seen AS (SELECT user_id, ts, event_type FROM events, settled WHERE ts <= until AND user_id IS NOT NULL),
views AS (SELECT DISTINCT user_id, ts AS started FROM seen WHERE event_type = 'view'),
clicks AS (
  SELECT v.user_id, started, min(ts) AS clicked FROM views v LEFT JOIN seen c
    ON c.user_id = v.user_id AND event_type = 'click' AND ts > started AND ts <= started + INTERVAL 12 HOUR GROUP BY ALL),
buys AS (
  SELECT v.user_id, started, clicked, min(ts) AS purchased FROM clicks v LEFT JOIN seen c
    ON c.user_id = v.user_id AND event_type = 'purchase' AND ts > clicked AND ts <= started + INTERVAL 12 HOUR GROUP BY ALL),
all_funnels AS (SELECT *, coalesce(purchased, started + INTERVAL 12 HOUR) AS ended FROM buys),
chain AS (
  SELECT f.*, min(v.started) AS next FROM all_funnels f LEFT JOIN views v ON v.user_id = f.user_id AND v.started > f.ended GROUP BY ALL),
taken AS (
  SELECT * FROM chain WHERE (user_id, started) IN (SELECT user_id, min(started) FROM views GROUP BY user_id)
  UNION ALL
  SELECT chain.* FROM taken JOIN chain ON chain.user_id = taken.user_id AND chain.started = taken.next)
SELECT user_id, started, clicked, purchased, ended FROM taken, settled WHERE ended <= until""",
    "stream_click_purchases": f"""
WITH {_SETTLED}
SELECT c.event_id AS click_id, c.user_id, c.ts AS clicked, p.event_id AS purchase_id, p.ts AS purchased
FROM settled, events c LEFT JOIN events p
  ON p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR
WHERE c.event_type = 'click' AND c.user_id IS NOT NULL AND (p.event_id IS NOT NULL OR c.ts + INTERVAL 1 HOUR <= until)""",
    "stream_distinct_events": """
SELECT DISTINCT event_id, user_id, event_type, ts FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'error')""",
    "stream_sessions": f"""
WITH {_SETTLED},
marked AS (
  SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS begins FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM marked)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS rows FROM numbered GROUP BY user_id, k
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT until FROM settled)""",
}
