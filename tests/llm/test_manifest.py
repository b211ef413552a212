"""The Merkle manifest against a tree built in lists."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom.llm import manifest, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, idx long, size int, digest string"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        at = i // 3 * 3
        yield level[at:i], level[i + 1 : at + 3]
        i //= 3


def brute(rows):
    by = {}
    for x in rows:
        by.setdefault(x.source, []).append(x)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x.doc_id is not None, x.doc_id or 0, leaf(x, x.text)))
    trees = {s: tree([leaf(x, x.text) for x in by[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, x in enumerate(by[s]):
            around = [*path(trees[s], i), *path(top, k)]
            changed = x.text
            if None not in (x.doc_id, x.text) and zlib.crc32(str(x.doc_id).encode()) % 2 == 0:
                changed = x.text.replace("\n", "")
            now = leaf(x, changed)
            for a, b in around:
                now = h(*a, now, *b)
            root = top[-1][0]
            out.append((x.doc_id, trees[s][0][i], trees[s][-1][0], root, h(*(y for a, b in around for y in a + b)), now, now == root))
    return sorted(out, key=str)


def audited(docs):
    text = F.col("text")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    return sorted((tuple(r) for r in manifest.audited(docs, {"text": changed}).collect()), key=str)


@pytest.mark.parametrize("span", [1, 2, 6])
def test_trees(spark, monkeypatch, span):
    """A hot source, sources of one and of some rows, and stretches so short that several rounds are needed."""
    monkeypatch.setattr(manifest, "SPAN", span)
    r = random.Random(span)
    rows = [(i, f"a\nb {r.random()}", "en", r.choice(["hot"] * 30 + ["x", "é", "z", None]), i, "g", 1, 2, "d") for i in range(400)]
    rows += [(1000 + i, "one\n", None, f"s{i:03}", None, None, None, None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert audited(docs) == brute(docs.collect())


def test_awkward(spark):
    rows = [
        (1, "same\nrow", "en", "s", 1), (1, "same\nrow", "en", "s", 1), (1, "other\nrow", "en", "s", 1), (2, None, None, None, None),
        (None, "a\nb", "en", "s", 3), (None, None, None, None, None), (3, "", "", "", 0), (4, "ü\n" * 100_000, "de", "s", 7),
    ]
    docs = spark.createDataFrame([(*r, "g", 1, 2, "d") for r in rows], SCHEMA)
    assert audited(docs) == brute(docs.collect())
    assert audited(docs.limit(0)) == []
    one = docs.where("doc_id = 4")
    assert audited(one) == brute(one.collect())


def test_sql(spark):
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    got = sorted((tuple(r) for r in queries.op12_manifest(spark, SF).collect()), key=str)
    assert got == sorted(duckdb.sql(queries.OP12_SQL).fetchall(), key=str)
    assert {r[-1] for r in got} == {True, False}
