"""Training-data operators against brute force, on small tables with every awkward row."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm import decontaminate, langid, licenses, lm, mixing, quality, queries, rules, simhash, substrings, suffix, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h int, fp string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names operators use themselves."""
    rows = [
        (1, "The cat sat on the mat and the dog sat on the log by the old house.", "en", "s1", 5, 1, "x"),
        (1, "The cat sat on the mat and the dog sat on the log by the old house.", "en", "s1", 5, 1, "x"),
        (1, "Der Hund und die Katze sind in dem Haus und der Garten ist nicht da.", "de", "s1", 5, 1, "x"),
        (2, "", "en", None, 0, None, None),
        (3, None, None, "s2", None, 2, "y"),
        (None, "Le chat et le chien sont dans la maison et ils ne sont pas contents.", "fr", "s2", 5, 3, None),
        (None, None, None, None, None, None, None),
        (4, "1234 5678 !!", "en", "s3", 5, 4, "z"),
        (5, "word " * 3000 + "é" * 500, "en", "s3", 9, 5, "w"),
        (6, "word " * 3000 + "é" * 500, "fr", "s1", 9, 5, "w"),
        (7, "\t\n \x0b", "de", "s1", 3, 5, "w"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def texts(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]


# Suffix arrays and exact substrings


@pytest.mark.parametrize("letters", [1, 2, 4, 26])
def test_suffix_arrays(letters):
    r = random.Random(letters)
    for _ in range(40):
        some = [bytes(r.randrange(letters) + 97 for _ in range(r.randint(1, 50))) for _ in range(r.randint(1, 9))]
        order, begin = suffix.suffix_arrays([np.frombuffer(s, np.uint8).astype(np.int64) + 2 for s in some])
        for k, s in enumerate(some):
            assert (order[begin[k] : begin[k + 1]] - begin[k]).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_spans(rows, least):
    count = collections.Counter(t[p : p + least] for _, t in rows for p in range(len(t) - least + 1))
    out = []
    for i, t in rows:
        hit = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if count[t[p : p + least]] > 1:
                hit[p : p + least] = b"\1" * least
        spans = sum(1 for j in range(len(t)) if hit[j] and (not j or not hit[j - 1]))
        kept = bytes(x for x, h in zip(t, hit) if not h)
        out.append((i, len(t), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [64, 2, 0])
def test_substrings(spark, awkward, most):
    r = random.Random(most)
    base = ["".join(r.choice("abé ") for _ in range(90)) for _ in range(5)]
    rows = []
    for i in range(40):
        t = list(r.choice(base) + r.choice(base))
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("xyz")
        rows.append((100 + i, "".join(t)[r.randint(0, 30) :]))
    rows += [(None, "a" * 300), (None, "a" * 300), (900, "ab" * 200)]
    df = awkward.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted([tuple(x)[:5] for x in substrings.removed(df, 40, most=most).collect()], key=str)
    assert got == brute_spans(texts(df), 40)


def test_substrings_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted([tuple(x) for x in queries.op1_substrings(spark, SF).collect()], key=str)
    assert got == brute_spans(texts(docs), 200)


def test_without_repeats_keeps_the_columns(awkward):
    out = substrings.without_repeats(awkward, 40)
    assert out.columns == awkward.columns
    left = [tuple(r)[:3] for r in out.collect()]
    assert (3, None, None) in left and (4, "1234 5678 !!", "en") in left
    assert not [x for x in left if x[0] in (5, 6)]  # copies of one another: nothing is left


# Language


def test_language(spark, awkward):
    got = queries.op2_langid(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas(), on="doc_id")
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id] == list(got.held_out)
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.95
    assert got.score.between(0, 1).all()
    rows = [(r.doc_id, r.lang_pred, r.score) for r in langid.identified(awkward).collect()]
    assert len(rows) == awkward.count() and (3, "und", 0.0) in rows and (2, "und", 0.0) in rows and (4, "und", 0.0) in rows
    kept = langid.accepted(awkward)
    assert kept.columns == awkward.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "1", "5", "6", "None"]
    untaught = langid.identified(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_grams_do_not_depend_on_parts(monkeypatch):
    text = "Ein Text mit Umlauten: äöü und mehr " * 20
    whole = sorted(langid.grams(text).tolist())
    monkeypatch.setattr(langid, "_CHARS", 50)
    assert sorted(langid.grams(text).tolist()) == whole


# WARC


def test_warc(spark, awkward):
    pages = awkward.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).drop("payload").collect()]
    want = [((r.html or "").encode(), r.page_id) for r in pages.collect()]
    assert sorted((len(t), hashlib.sha256(t).hexdigest(), str(i)) for t, i in want) == sorted((n, d, str(i)) for i, n, d, _, _ in rows)
    assert [r[3:] for r in rows if r[0] in (5, 6)] in ([("response", None), ("revisit", 5)], [("revisit", 5), ("response", None)])
    assert all(r[3] == "response" for r in rows if r[1] < 100)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_streams_and_damage(tmp_path, spark):
    record = warc._record(7, "http://x/ y", b"<p>" + b"z" * 5000, "d", None)
    members = zlib.compress(record * 3, wbits=31) + zlib.compress(record, wbits=31)

    class Source:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:17], self.data[17:]
            return out

    assert [raw for _, raw in warc._records(warc._inflated(Source(members)))] == [record] * 4
    with pytest.raises(ValueError):
        list(warc._records(warc._inflated(Source(members[:-30]))))
    assert warc.header(record[: record.index(b"\r\n\r\n")])["warc-target-uri"] == "http://x/y"


# Language model


def test_language_model(awkward):
    rows = texts(awkward)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, t.lower().split() + [None]) for i, t in rows]
    count = collections.Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in tokens)
    for sizes in ({}, {"part": 3000, "range_": 2000}):
        got = lm.scored(awkward, **sizes).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert lm.scored(awkward.limit(0)).count() == 0


def test_language_model_beats_its_base_on_held_out_texts(spark):
    r = queries.op4_lm(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def brute_scores(rows):
    """Scores by dictionaries: counts of all training rows, and weights by EM over every token of the slice held out for it."""
    mod = [None if i is None else zlib.crc32(str(i).encode()) % 10 for i, _ in rows]
    texts = [[None] + re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t.decode())) + [0] for _, t in rows]

    def counts(wanted):
        uni, bi, begins = collections.Counter(), collections.Counter(), 0
        for m, t in zip(mod, texts):
            if wanted(m):
                uni.update(t[1:])
                bi.update(zip(t, t[1:]))
                begins += 1
        return uni, bi, begins, sum(uni.values()), len(uni)

    def estimates(t, uni, bi, begins, n, v):
        for a, b in zip(t, t[1:]):
            context = begins if a is None else uni[a]
            yield (min(lm.BUCKETS - 1, 1 + int(math.log2(context))) if context else 0), bi[a, b] / max(context, 1), uni[b] / max(n, 1), 1 / (v + 1)

    fit = counts(lambda m: m not in (0, 1))
    seen = [x for m, t in zip(mod, texts) if m == 1 for x in estimates(t, *fit)]
    weights = np.tile([0.5, 0.4, 0.1], (lm.BUCKETS, 1))
    weights[0] = [0, 0.8, 0.2]
    for _ in range(lm.ROUNDS if seen else 0):
        total = np.tile([0.25, 0.2, 0.05], (lm.BUCKETS, 1))
        total[0, 0] = 0
        for k, *p in seen:
            share = weights[k] * p
            total[k] += share / share.sum()
        weights = total / total.sum(axis=1, keepdims=True)
    every = counts(lambda m: m != 0)
    return [sum(math.log10(weights[k] @ np.array(p)) for k, *p in estimates(t, *every)) for t in texts]


def test_scores_are_those_of_deleted_interpolation(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df, near in ((awkward, 1e-6), (docs, 2e-3)):  # with rows for the EM, its grid costs some
        got = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score for r in lm.scored(df).collect()}
        rows = texts(df)
        want = brute_scores(rows)
        have = sorted(got.values())
        assert len(set(np.round(want, 4))) >= len(have) * 0.9 or len(have) < 12
        for a, b in zip(have, sorted(set(np.round(want, 9)))) if len(have) == len(set(np.round(want, 9))) else []:
            assert abs(a - b) <= near * abs(b) + 1e-9
        by_id = {i: w for (i, _), w in zip(rows, want)}
        for (i, *_), score in got.items():
            if i is not None and sum(j == i for j, _ in rows) == 1:
                assert abs(score - by_id[i]) <= near * abs(by_id[i]) + 1e-9


def test_short_runs_of_numbers_are_stored_plain():
    for n in (0, 1, 3, 31, 32, 1000):
        for kind in (np.uint32, np.uint64):
            x = np.arange(n, dtype=kind) * 977
            assert (lm._unpack(lm._pack(x), kind) == x).all()
    assert len(lm._pack(np.arange(1, 2, dtype=np.uint64))) == 9


def test_mixture_weights_sum_to_one():
    w = lm.fitted([(1 * 64 * 64 + 5, 100.0, 50.0, 1.0), (3 * 64 * 64, 10.0, 0.0, 0.1)], 1e-4)
    assert np.allclose(w.sum(axis=1), 1) and w[1, 0] > 0.9 and w[3, 0] < 0.1 and w[0, 0] == 0


# Quality


def test_quality(spark, awkward):
    got = queries.op5_quality(spark, SF).collect()
    assert len(got) == 200 and all(0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.scored(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(r.kept == (r.score >= 0.5) for r in rows)
    none = quality.scored(awkward, labels.limit(0)).collect()
    assert {round(r.own, 9) for r in none} == {0.5}
    assert quality.scored(awkward.limit(0), labels).count() == 0


def test_sparse_sites_shrink_to_their_prior(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 3 else "bad stuff", "big", "p") for i in range(60)] + [(100, "good words here", "small", "p")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    small = quality.scored(docs, labels).where("doc_id = 100").first()
    assert 0.5 < small.host_rate < 0.8  # nothing but the global rate is known of it


# Rules


def test_rules(spark, awkward):
    import duckdb

    got = {tuple(sorted(r.asDict().items(), key=str)) for r in rules.judged(awkward).collect()}
    documents = awkward.select("doc_id", "text").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    c = duckdb.connect()
    c.register("documents", documents)
    rel = c.sql(queries.OP6_SQL)
    want = {tuple(sorted(zip(rel.columns, r), key=str)) for r in rel.fetchall()}
    assert got == want
    r = rules.judged(spark.createDataFrame([(1, " ".join(f"w{i % 10}" for i in range(30)))], "doc_id long, text string")).first()
    assert (r.n_words, r.n_repeat_words, r.base_failed) == (30, 30, True)
    r = rules.judged(spark.createDataFrame([(1, "a b c d e f g h i a b c d e f g h x")], "doc_id long, text string")).first()
    assert r.n_repeat_words == 16


# Mixing


def check_mix(df):
    rows = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    src = df.select("doc_id", "text", "source").collect()
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == sorted((str(r.doc_id), size(r.text)) for r in src)
    per = collections.Counter()
    for r in src:
        per[r.source] += size(r.text)
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # share by weight, cap, share the rest again
        rest = sum(per.values()) - sum(target.values())
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if rest * weight[s] / w >= 3 * per[s]} if w else set()
        if not full:
            break
        target |= {s: 3 * per[s] for s in full}
        open_ -= full
    target |= {s: rest * weight[s] / w for s in open_}
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == per[r.source]
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in order)
    return rows


def test_mixing(spark, awkward):
    check_mix(awkward)
    check_mix(awkward.limit(0))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = check_mix(docs)
    assert sorted(first) == sorted(check_mix(docs.repartition(3)))
    assert sum(r.taken for r in mixing.mix(docs, block=3).collect()) > 0  # a deep reduction tree
    kept = mixing.mixture(docs).collect()
    assert all(r.copies > 0 for r in kept) and sum(r.taken for r in kept) == sum(r.taken for r in first)


# Licenses


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    words = mit.split()
    docs = [(1, mit), (2, "Intro text. " + mit.replace("furnished", "given").upper() + " Tail."), (3, " ".join(words[:40])), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0.\nmore"), (6, "Licensed under CC BY-NC 4.0.\nmore"), (None, "Released under the MIT License. " * 3), (7, "license " * 50)]
    got = collections.Counter((r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == {(1, "MIT"): 1, (2, "MIT"): 1, (6, "CC-BY-NC-4.0-line"): 2, (None, "MIT-line"): 1}


def test_alignment_is_increasing_and_true():
    r = random.Random(3)
    for _ in range(200):
        a = [b"%d" % r.randrange(12) for _ in range(r.randint(0, 25))]
        b = [b"%d" % r.randrange(12) for _ in range(r.randint(0, 25))]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(licenses.align(a, a)) == len(a)


# Decontamination


def test_decontamination(spark):
    item = "A farmer named Tom has 5 cows and sells 3 of them, then Tom buys 5 more cows for the farm in spring."
    items = spark.createDataFrame([(1, item), (2, "short item of five words"), (3, None), (4, ""), (2, "short item of five words")], "item_id long, text string")
    docs = [
        (1, "Intro here. A farmer named Bob has 7 cows and sells 4 of them, then Bob buys 7 more cows for the farm in spring. End."),
        (2, "A farmer named Bob has 7 cows and sells 4 of them, then Jim buys 9 more cows for the farm in spring."),
        (3, None),
        (4, ""),
        (5, "xx short item of five words yy"),
        (5, "xx short item of five words yy"),
        (None, item),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.reparameterised) for r in decontaminate.leaks(df, items).collect()}
    assert got == {(1, 1, True), (5, 2, False), (None, 1, False)}
    assert sorted(r.doc_id for r in decontaminate.clean(df, items).collect()) == [2, 3, 4]
    assert decontaminate.leaks(df.limit(0), items).count() == 0 and decontaminate.leaks(df, items.limit(0)).count() == 0


def test_verbatim_leaks_are_found(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(i, j) for i, t in docs.items() for j, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontaminate(spark, SF).collect()}
    assert want <= got and len(got - want) <= 1


# SimHash


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2 and find(a) != find(b):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((str(i), f"{fps[k]:016x}", str(least.get(find(k)))) for k, (i, _) in enumerate(rows)))


def test_simhash(spark, awkward):
    for df in (awkward, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.classes(df).collect())
        assert got == brute_components(rows)
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str((r.doc_id, (r.text or "")[:3])) for r in kept.collect()) == sorted(["(1, 'The')", "(1, 'Der')", "(2, '')", "(None, 'Le ')", "(4, '123')", "(5, 'wor')"])
    assert simhash.classes(awkward.limit(0)).count() == 0 and simhash.one_of_each(awkward.limit(0)).count() == 0


def test_chains_of_links(spark):
    from logloom.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_rows_that_differ_in_one_column_are_mixed_apart(spark):
    rows = [(1, "a b c d e f", "s", lang, size) for lang, size in (("en", "v"), ("de", "w"))] + [(2, "x y", "t", "en", "u")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size string")
    kept = mixing.mixture(docs).collect()
    assert {r["size"] for r in kept} <= {"v", "w", "u"}  # the user's own column
    assert len({(r.doc_id, r.lang) for r in kept}) == len(kept)
    assert all(r.taken == r.copies * (6 if r.doc_id == 1 else 2) and r.taken <= 3 * r._size for r in kept)
    assert sum(r.taken for r in kept) == sum(r.taken for r in mixing.mix(docs).collect())


def test_many_repeated_rows_are_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_MANY", 100)
    docs = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") < 4000, "s").alias("source"), F.lit("en").alias("lang"))
    rows = check_mix(docs)
    assert len(rows) == 5000 and len({r.copies for r in rows if r.source == "s"}) == 2


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_sources_come_near_their_targets(spark, sf):
    """Large documents are settled first and the smaller ones make up for them; what is left over is a small one."""
    mixed = mixing.mix(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    per = mixed.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.03 for r in per)
    one = [(i, "w " * n, "s") for i, n in enumerate((9000, 500, 400, 300))] + [(10 + i, "w " * 20, "t") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(one, "doc_id long, text string, source string")).collect()
    for s in "st":  # the largest outweighs the rest of s: they are settled, and it is rounded
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= (9000 if s == "s" else 20)
