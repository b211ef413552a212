"""Every operator and stage on columns named like those that operators add, on long texts, and across the borders of parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import common, decontaminate, langid, licenses, lm, mixing, quality, rules, simhash, substrings, warc
from logloom.llm.common import stored

from .test_operators import brute_spans

NAMES = (
    "h i k c p z s g n fp node key root roots best stay rows no more draw base copies taken target source_size size part use w at slots line item_id lang_pred score text_ held_out kept own llr host path "
    "h_n h_s number id component_id fingerprint variant u v m x keys shingles carry spans digest refers_to first again url license coverage y quality toxic range kind fit tune cell times twin closer many"
).split()


@pytest.fixture(scope="module")
def clashing(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(400)]
    long = " ".join(r.choice(words) for _ in range(200_000))  # over two parts of half a megabyte
    rows = [(1, long, "en", "s"), (2, long[: 700_000], "en", "s"), (3, "x" * 1_200_000, "de", "t"), (3, "x" * 1_200_000, "de", "t"), (None, None, None, None), (4, "Der Hund und die Katze im Haus", "de", "t"), (5, "", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return stored(docs.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES]), "clashing")


def test_operators(spark, clashing):
    docs, n = clashing, clashing.count()
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "the dog and the cat in a house of ours")], "item_id long, text string")
    assert substrings.removed(docs).count() == n
    assert langid.identified(docs).count() == n
    pages = docs.withColumn("page_id", F.col("doc_id")).withColumn("html", F.col("text"))
    assert warc.round_trip(pages, payload=False).count() == n
    scored = {r.doc_id: r for r in lm.scored(docs).collect()}
    assert scored[1].n_tokens == 200_001 and scored[3].n_tokens == 2
    assert quality.scored(docs, labels).count() == n
    assert {r.doc_id: r.n_words for r in rules.judged(docs).collect()} == {1: 200_000, 2: len(docs.where("doc_id = 2").first().text.split()), 3: 1, None: 0, 4: 7, 5: 0}
    assert mixing.mix(docs).count() == n
    assert licenses.scan(docs).count() == 0
    assert decontaminate.leaks(docs, items.withColumn("w", F.lit("own"))).count() == 0
    assert simhash.classes(docs).count() == n


def test_stages(spark, clashing):
    docs = clashing
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), f"clashing-{name}")
        assert docs.columns[: len(before.columns)] == before.columns
        assert docs.where(F.coalesce("taken", F.lit("own taken")) != "own taken").count() == 0  # own columns stay as they were
    assert docs.columns[-5:] == ["_size", "_source_size", "_target", "_copies", "_taken"]


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    r = random.Random(6)
    text = " ".join("".join(r.choice("abcé") for _ in range(r.choice((1, 3, 9, 80, 200)))) for _ in range(60)).encode()
    whole = common.word_hashes(text)
    for chunk in (16, 64, 100):
        monkeypatch.setattr(common, "_CHUNK", chunk)
        monkeypatch.setattr(common, "_POWERS", [])
        assert np.array_equal(common.word_hashes(text), whole)


def test_substrings_do_not_depend_on_parts(spark, monkeypatch):
    r = random.Random(9)
    part = "".join(r.choice("abcdef") for _ in range(400))
    text = "".join(r.choice("abcdef") for _ in range(900))
    rows = [(1, text[:350] + part + text[350:]), (2, part[30:300] + "q" + text[100:420]), (3, text[700:])]
    a = {k: sorted(zip(*[x.tolist() for x in substrings.contexts(t.encode(), 60, 12)])) for k, t in rows}
    monkeypatch.setattr(substrings, "_PART", 128)
    starts = lambda found: sorted(p + d for _, _, x in found for p, n in [(x >> 24, x & 0xFFF)] for d in range(n))
    for k, t in rows:
        b = list(zip(*[x.tolist() for x in substrings.contexts(t.encode(), 60, 12)]))
        assert starts(a[k]) == starts(b) == list(range(len(t) - 59))
    long = [(k, t * 3) for k, t in rows]
    monkeypatch.undo()
    got = sorted((tuple(x)[:5] for x in substrings.removed(spark.createDataFrame(long, "doc_id long, text string"), 60, 12).collect()), key=str)
    assert got == brute_spans([(k, t.encode()) for k, t in long], 60)
