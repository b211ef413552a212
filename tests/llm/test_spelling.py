"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from logloom.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_of(words):
    """By brute force, but through all words with one letter taken out: near words share such a one or are one."""
    holes = {}
    for w in words:
        for h in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes.setdefault(h, set()).add(w)
    return {w: sorted({v for h in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in holes.get(h, ()) if one_edit(v, w)}) for w in words}


def brute(count, times=5):
    near = near_of(count)
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= times * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out, key=str)


def counted(rows, every=199):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("crowd", [3, 256])
def test_variants(spark, monkeypatch, crowd):
    """Words around few stems, so that segments are crowded; with crowd 3 keys are cut down to single code points."""
    monkeypatch.setattr(spelling, "CROWD", crowd)
    r = random.Random(crowd)
    words = {"aaaaaa": 9, "aaaaaaa": 90, "àaaaaa": 2, "aaaaaé": 700, "z" * 300: 8, "z" * 301: 40}
    for stem in ("aaaaaaaa", "straße", "internationalisation", "abcdefgh", "éèêëàâ"):
        for _ in range(60):
            w = list(stem)
            for _ in range(r.randint(0, 3)):
                at, what = r.randrange(len(w)), r.randrange(3)
                w[at : at + (what > 0)] = r.choice("abé") if what < 2 else ""
            words["".join(w)] = r.choice((5, 6, 25, 30, 125, 700, 5000))
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.variants(rows)) == brute(words)


def test_chain(spark):
    count = {"a" * (6 + i): 5**i for i in range(20)}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    assert got(spelling.variants(df)) == brute(count)


def test_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 50)
    monkeypatch.setattr(spelling, "HELD", 20)
    r = random.Random(4)
    stems = ["Strasse", "STRAßE", "élève", "ÉLÈVES", "abcdef", "Internet", "×÷×÷×÷", "x" * 200]
    rows = [(i if i % 9 else None, " ".join(r.choice(stems) for _ in range(60)) + r.choice(("", "\n", "1abcdefg2"))) for i in range(40)]
    rows += [(1, None), (None, None), (2, ""), (3, "one"), (3, "one"), (4, "12 34")]
    docs = spark.createDataFrame([(i, t, "own", 7) for i, t in rows], "doc_id long, text string, word string, n int")
    for every in (3, 199):
        found = spelling.words(docs, lambda key, every=every: spelling.slipped(key, every))
        assert {x.word: x.n for x in found.collect()} == counted(rows, every)
    assert got(spelling.variants(spelling.words(docs.limit(0)))) == []


def test_whole_table(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op13_spelling(spark, SF)) == brute(counted(rows))


def test_sql(spark):
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    assert got(queries.op13_spelling(spark, SF)) == sorted(duckdb.sql(f"select word, form, root, n, n_near, form_n from ({queries.OP13_SQL})").fetchall(), key=str)
