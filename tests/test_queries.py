"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from logloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees_with_sql(name, spark, duck):
    df, rel = catalogue.queries()[name](spark, SF), duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(name, spark):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert catalogue.entry(spark, SF).count() > 0


def test_brute_force_reads_sessions_beyond_a_store(spark, tmp_path):
    """2,010 sessions of one file, more than a store of 2,000: a run that begins past it is found, one that goes on is whole."""
    duck, late = duckdb.connect(), "case when i between 2000 and 2005 then 3 else 0 end"
    duck.sql(f"create view events as select i as event_id, timestamp '2024-01-01' + to_seconds(400 * i) as ts, {late} as user_id, 'error' as event_type, 1.0::double as value, '{{\"k\": 3}}' as props from range(2010) r(i)")
    duck.sql(f"copy events to '{tmp_path}/events.parquet'")
    name = "ssh_bruteforce_clusters"
    got = catalogue.queries()[name](spark, str(tmp_path)).select("file_id", "ip", "n", "first_line", "duration_s", "level")
    want = [("auth-0", "10.0.0.0", 2004, 1, 2009.0, "ERROR"), ("auth-0", "10.0.0.3", 6, 2001, 5.0, "ERROR")]
    assert sorted(tuple(r) for r in got.collect()) == want == sorted(duck.sql(catalogue.oracle_sql()[name]).fetchall())
