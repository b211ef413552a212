"""Near copies of the pipeline against brute force on shingles of five words."""

import re
from itertools import combinations

import corpus_pipeline
from logloom.llm import shingles

SF = "/root/testdata/sf0.001"


def brute_survivors(rows):
    """The least doc_id of each component that Jaccard similarities of 0.8 or more link."""
    sets = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        n = min(5, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else {()})
    root = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            root = [root[a] if r == root[b] else r for r in root]
    return {min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in root}


def test_near_copies_of_similarity_0_8_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == brute_survivors(rows)
    assert {145, 177} <= {i for i, _ in rows} - kept  # 7 and 11 bits of their fingerprints differ from the copies'


def test_groups_over_a_block(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 4)
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(5, 95, 3)] + [(200 + k, " ".join(base[::-1][: 100 - k])) for k in range(0, 60, 3)] + [(400, None), (401, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in shingles.one_of_each(docs).collect()} == brute_survivors(rows)
