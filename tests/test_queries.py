"""Every query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tests.conftest import SF
from turnwise.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(same(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["interval_overlap_pairs", "self_overlap_count"])
def test_turns_without_length(spark, tmp_path, name):
    """A turn of no length within, at the start, at the end and outside of another of its speaker."""
    values = [(i, f"2024-01-01 00:{m:02}:00", 10 * i + 1, "view", v) for i, (m, v) in enumerate([(1, 300.0), (2, 0.0), (1, 0.0), (6, 0.0), (9, 0.0), (5, 90.0), (2, 0.0)])]
    con = duckdb.connect()
    rows = ", ".join(map(str, values))
    con.sql(f"CREATE TABLE events AS SELECT event_id::BIGINT AS event_id, ts::TIMESTAMP AS ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.sql(ORACLE_SQL[name])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_library_does_without_the_training_data_part():
    """Nothing outside turnwise/llm imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "turnwise"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "turnwise.llm" not in f.read_text(), f
