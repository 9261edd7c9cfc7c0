"""Registered queries against their SQL on the smallest tables, and the driver's entry points."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__
import loomline.plans.families  # noqa: F401
from loomline.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLE_SQL[name])
    theirs = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(theirs)
    columns = sorted(theirs)
    want = sorted(tuple(plain(r[theirs.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) >= set(QUERIES)


def held_against_sql(spark, name, folder, events):
    """The query and its SQL on events of one's own: (user_id, seconds, value)."""
    import pandas as pd

    frame = pd.DataFrame([(n, u, "view", v, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)) for n, (u, s, v) in enumerate(events)], columns=["event_id", "user_id", "event_type", "value", "ts"])
    c = duckdb.connect()
    c.execute(f"copy (select * replace (ts::timestamp as ts) from frame) to '{folder}/events.parquet'")
    c.execute(f"create view events as select * from '{folder}/events.parquet'")
    found = c.execute(ORACLE_SQL[name])
    theirs = [x[0] for x in found.description]
    want = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    return sorted(tuple(plain(r[x]) for x in theirs) for r in QUERIES[name](spark, str(folder)).collect()), want


def test_low_runs_at_values_on_the_threshold(spark, tmp_path):
    """Values of two digits lie on a threshold of three rounded digits, where the last bit of the quantile decides."""
    import random

    r = random.Random(7)
    rows = [(u, 60 * k, round(10.7 + r.random() * 0.05 if r.random() < 0.25 else 15.9 + r.random() * 0.4, 2)) for u in range(4000) for k in range(30 + u % 83)]
    ours, want = held_against_sql(spark, "low_run_boundaries", tmp_path, rows)
    assert ours == want


def test_steady_frames_on_the_limit_are_left_out(spark, tmp_path):
    rows = [(u, 60 * k, 20.0 * (k % 2) * (u + 1) + 5.0) for u in range(3) for k in range(12)]
    ours, want = held_against_sql(spark, "steady_frames", tmp_path, rows)
    assert ours == want and len(want) < len(rows)
