"""Extension: windows and sessions, in the batch form of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.plans.registry import micros, query, read
from turnwise.streaming import events as ev


@query("""SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def windowed_events(spark, d):
    w = ev.windowed(read(spark, d, "events"), "ts", ["event_type"], "1 hour")
    return w.select(micros("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER o < INTERVAL '2 hours' THEN 0 ELSE 1 END AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT epoch_us(min(ts)) AS start, user_id, count(*) AS n FROM g GROUP BY user_id, s""")
def event_sessions(spark, d):
    s = ev.sessions(read(spark, d, "events"), "ts", ["user_id"], "2 hours")
    return s.select(micros("start").alias("start"), "user_id", "n")
