"""Streaming queries over the events table (X rows), compared with batch SQL on closed windows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r8
from ..sources import tables as X
from ..streaming import meters as S
from .registry import query


def events(spark, d):
    return S.read_events(spark, d, "events.parquet", X.table(spark, d, "events").schema)


@query("x01_stream_resample", """WITH m AS (SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM events), w AS (SELECT event_type, date_trunc('hour', ts) AS s, avg(value) AS a, count(*) AS n FROM events GROUP BY 1,2)
SELECT event_type, strftime(s,'%Y-%m-%d %H') AS hour, round(a/0.99991::DOUBLE,8) AS mean, CAST(n AS BIGINT) AS n FROM w, m WHERE s + INTERVAL 1 HOUR <= date_trunc('milliseconds', wm)""")
def x01(spark, d):
    t = S.drain(S.resample(events(spark, d), ["event_type"], "ts", F.col("value"), "1 hour", "2 hours"), "resample")
    return t.select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), r8(F.col("mean") / 0.99991).alias("mean"), "n")


@query("x01_stream_sliding", """WITH m AS (SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM events), e AS (SELECT event_type, value, date_trunc('hour', ts) - to_hours(i) AS s FROM events, (VALUES (0),(1),(2)) v(i)), w AS (SELECT event_type, s, avg(value) AS a, count(*) AS n FROM e GROUP BY 1,2)
SELECT event_type, strftime(s,'%Y-%m-%d %H') AS hour, round(a/0.99991::DOUBLE,8) AS mean, CAST(n AS BIGINT) AS n FROM w, m WHERE s + INTERVAL 3 HOUR <= date_trunc('milliseconds', wm)""")
def x01_sliding(spark, d):
    t = S.drain(S.resample(events(spark, d), ["event_type"], "ts", F.col("value"), "3 hours", "2 hours", "1 hour"), "sliding")
    return t.select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), r8(F.col("mean") / 0.99991).alias("mean"), "n")


@query("x02_stream_dedupe", "SELECT DISTINCT event_id, user_id FROM events")
def x02(spark, d):
    """Every event arrives twice, the second time from a second source."""
    e = events(spark, d).unionByName(events(spark, d))
    return S.drain(S.dedupe(e, ["event_id"], "ts", "2 hours").select("event_id", "user_id"), "dedupe")


@query("x03_stream_sessions", """WITH m AS (SELECT date_trunc('milliseconds', max(ts) - INTERVAL 1 HOUR) AS wm FROM events), a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM a), g AS (SELECT user_id, sid, min(ts) AS s, max(ts) + INTERVAL 12 HOUR AS e, count(*) AS n FROM b GROUP BY 1,2)
SELECT user_id, strftime(s,'%Y-%m-%d %H:%M:%S') AS start, CAST(n AS BIGINT) AS n FROM g, m WHERE e <= wm""")
def x03(spark, d):
    t = S.drain(S.sessions(events(spark, d), ["user_id"], "ts", "12 hours", "1 hour"), "sessions")
    return t.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
