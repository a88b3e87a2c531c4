"""Named queries with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever zone the session has."""
    return F.expr(f"CAST(CAST(CAST({ts} - TIMESTAMP_NTZ '1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(18, 6)) * 1000000 AS BIGINT)")


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns: the type is the clip, the user's last digit the speaker, and value the seconds."""
    start = micros("ts")
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("clip"), (F.col("user_id") % 10).alias("speaker"), F.col("event_id").alias("idx"),
        start.alias("start"), (start + F.round(F.col("value") * 1000).cast("long") * 1000).alias("end"),
    )


TURNS = """t AS (SELECT event_type AS clip, user_id % 10 AS speaker, event_id AS idx, epoch_us(ts) AS s,
  epoch_us(ts) + round(value * 1000)::BIGINT * 1000 AS e FROM events)"""

UNIONS = f"""{TURNS},
u0 AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY clip, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM t),
u1 AS (SELECT *, sum(n) OVER (PARTITION BY clip, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM u0),
u AS (SELECT clip, speaker, min(s) AS s, max(e) AS e, count(*) AS n_merged FROM u1 GROUP BY clip, speaker, g)"""

DEPTH = f"""{UNIONS},
ev AS (SELECT clip, s AS t, 1 AS d FROM u UNION ALL SELECT clip, e, -1 FROM u),
dt AS (SELECT clip, t, sum(d) AS d FROM ev GROUP BY clip, t),
dep AS (SELECT clip, t, lead(t) OVER (PARTITION BY clip ORDER BY t) AS until,
  sum(d) OVER (PARTITION BY clip ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM dt)"""


def joined_timeline(cond: str) -> str:
    return f"""{DEPTH},
k AS (SELECT clip, t, until, CASE WHEN t > max(until) OVER (PARTITION BY clip ORDER BY t, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n
      FROM dep WHERE until IS NOT NULL AND {cond}),
k1 AS (SELECT *, sum(n) OVER (PARTITION BY clip ORDER BY t, until ROWS UNBOUNDED PRECEDING) AS g FROM k),
tl AS (SELECT clip, min(t) AS s, max(until) AS e FROM k1 GROUP BY clip, g)"""


def values(columns: str, rows: list[tuple]) -> str:
    """Rows as SQL, each column cast to the type behind its name."""
    names, types = zip(*(c.split() for c in columns.split(", ")))

    def literal(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    casts = ", ".join(f'"{n}"::{t} AS "{n}"' for n, t in zip(names, types))
    quoted = ", ".join(f'"{n}"' for n in names)
    return f"SELECT {casts} FROM (VALUES {body}) v({quoted})"
