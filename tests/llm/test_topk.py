"""Exact top-k search against brute force: random vectors, and every awkward row."""

import math
import random

import duckdb
import numpy as np
import pytest

from logloom.llm import queries, topk

SF = "/root/testdata/sf0.001"


def brute(rows, asked, k):
    """Sorted (query_id, rank, vec_id, score); rows and asked: (vec_id, vector)."""

    def ints(v):
        if v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            return None
        return [math.floor(256 * float(x)) for x in v]

    usable = [(i, w, n) for n, (i, v) in enumerate(rows) if (w := ints(v)) is not None]
    out = []
    for i, w, n in usable:
        if i is not None and asked(i):
            score = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(w, x)))), j is None, j) for j, x, m in usable if m != n]
            out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(sorted(score, key=lambda t: (t[0], t[1], t[2] or 0))[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.fixture(params=["one block", "many blocks"])
def blocks(request, monkeypatch):
    if request.param == "many blocks":
        monkeypatch.setattr(topk, "ROWS", 40)
        monkeypatch.setattr(topk, "GROUP", 3)


def test_random(spark, blocks):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(230)]
    rows += [(1000 + i, rows[7][1]) for i in range(90)]  # one vector under many ids: ties
    rows += [(2000 + i, [float(x) for x in r.normal(size=5)]) for i in range(20)]  # shorter ones
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 5):
        assert got(topk.top_k(df, df.where("vec_id % 25 = 0"), k)) == brute(rows, lambda i: i % 25 == 0, k)


def test_awkward(spark, blocks):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [1.0, -2.0]), (50, [0.0, 0.0]), (1, [0.5, 0.25]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]),
        (5, [inf, 1.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (100, []), (6, [0.1] * 70), (7, [-0.0, 1e-9]), (150, None), (200, [1e-3, -1e-3]),
        (8, [1e15, -1e15]), (250, [1e15, 1e15]), (9, [1e38, 0.0]), (-50, [3.0]), (10, [-1.0, -2.0]),
    ]
    df = spark.createDataFrame([(i, v, "own", 1) for i, v in rows], "vec_id long, embedding array<double>, part string, cls int")
    assert got(topk.top_k(df, df.where("vec_id % 50 = 0"))) == brute(rows, lambda i: i % 50 == 0, 5)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert got(topk.top_k(df, df)) == []
    assert got(topk.top_k(df.limit(0), df)) == [] == got(topk.top_k(df, df.limit(0)))
    two = df.unionByName(spark.createDataFrame([(1, [0.5, 0.5])], "vec_id long, embedding array<float>"))
    assert got(topk.top_k(two, df)) == [(50, 1, 1, 128 * 256 + 128 * 512)]


def test_stops_on_proof():
    r = np.random.default_rng(1)
    v = np.floor(r.normal(size=(4096, 64)) * 32)
    v[5] = v[9] * 3
    block = topk.Block(v, *topk.segments(v), 64)
    found, score, read = block.members(v[9], 5, 9, -np.inf)
    assert 5 in found and read < 64 * topk.SEGMENTS * 0.7 and len(found) <= 4096 // topk.KEEP
    best = np.sort(np.delete(v @ v[9], 9))[-5:]
    assert sorted(score.tolist())[-5:] == best.tolist()


def test_sql(spark):
    duckdb.sql(f"create or replace view embeddings as select * from '{SF}/embeddings.parquet'")
    assert got(queries.op11_topk(spark, SF)) == sorted(duckdb.sql(queries.OP11_SQL).fetchall(), key=str)
