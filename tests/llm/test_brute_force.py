"""Operators that SQL can't express against plain Python over small corpora."""

import collections
import itertools
import math
import random
import zlib

from logloom.llm import decontaminate, langid, licenses, quality

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_language_posteriors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = rows_of(docs, "doc_id", "text", "lang")
    count, seen = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None:
            count[lang].update(langid.grams(t).tolist())
            seen[lang] += 1
    size = {lang: sum(c.values()) for lang, c in count.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(docs).collect()}
    for i, t, _ in random.Random(4).sample(rows, 40):
        total = {lang: math.log(seen[lang] / sum(seen.values())) + sum(n * math.log((count[lang][g] + 0.5) / (size[lang] + 0.5 * langid.BUCKETS)) for g, n in collections.Counter(langid.grams(t).tolist()).items()) for lang in seen}
        best = max(sorted(total), key=total.get)
        score = 1 / sum(math.exp(x - total[best]) for x in total.values())
        assert got[i][0] == best and abs(got[i][1] - score) < 1e-3


def strength(groups, mean):
    """Moments of the rates of groups (n, s) around mean(group)."""
    n = sum(g[0] for g in groups)
    means = [mean(g) for g in groups]
    chance_of = sum(g[0] * m * (1 - m) for g, m in zip(groups, means)) / n
    scatter = sum(g[0] * (g[1] / g[0] - m) ** 2 for g, m in zip(groups, means)) / n
    if len(groups) < 2 or not chance_of:
        return 20.0
    between = max(scatter - chance_of * len(groups) / n, 1e-6)
    return min(1000.0, max(1.0, chance_of / between - 1))


def test_site_posteriors(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    site = {i: (s, lang) for i, s, lang in rows_of(docs, "doc_id", "source", "lang")}
    got = quality.scored(docs, labels).collect()
    own = {r.doc_id: r.own for r in got}
    paths, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for i, (s, lang) in site.items():
        paths[s, lang].append(own[i])
        hosts[s].append(own[i])
    whole = sum(own.values()) / len(own)
    m_host = strength([(len(x), sum(x)) for x in hosts.values()], lambda g: whole)
    rate = {s: (sum(x) + m_host * whole) / (len(x) + m_host) for s, x in hosts.items()}
    m_path = strength([(len(x), sum(x), s) for (s, _), x in paths.items()], lambda g: rate[g[2]])
    _, _, prior = quality.train(docs, labels)
    for r in got:
        s, lang = site[r.doc_id]
        host = (sum(hosts[s]) - r.own + m_host * whole) / (len(hosts[s]) - 1 + m_host)
        path = (sum(paths[s, lang]) - r.own + m_path * host) / (len(paths[s, lang]) - 1 + m_path)
        llr = math.log(r.own / (1 - r.own)) - prior if 1e-12 < r.own < 1 - 1e-12 else None
        assert abs(r.host_rate - host) < 1e-9 and abs(r.path_rate - path) < 1e-9
        if llr is not None:
            assert abs(r.score - 1 / (1 + math.exp(-llr - math.log(path / (1 - path))))) < 1e-6


def test_own_evidence_counts_every_word_once(spark):
    strong = [f"bad{k}" for k in range(6)]
    rows = [(k, "plain words " + (strong[k % 6] if k < 60 else f"good{k % 5}"), int(k >= 60)) for k in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    value = lambda w: float(model[0][quality.features(w.encode())[0][0]])
    for n in range(1, 7):
        text = " ".join(strong[:n])
        found = quality.evidence(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, ["doc_id"]).first().llr
        shape = float(model[1][quality.features(text.encode())[1]].sum())
        assert abs(found - shape + quality.DAMPING * math.sqrt(sum(value(w) ** 2 for w in strong[:n]))) < 1e-4


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignments_are_longest_where_words_are_unique():
    r = random.Random(8)
    for _ in range(100):
        words = [b"%d" % k for k in range(r.randint(1, 30))]
        other = r.sample(words, len(words))[: r.randint(0, 30)]
        assert len(licenses.align(words, other)) == longest_common(words, other)
        repeated = [r.choice(words) for _ in range(r.randint(0, 40))]
        assert len(licenses.align(words, repeated)) <= longest_common(words, repeated)


def brute_leaks(docs, items, width=8):
    """Items leaked by documents of plain words and numbers: windows with equal templates, whose numbers map one to one way."""
    number = str.isdigit
    template = lambda ws: [("#" if number(w) else w) for w in ws]
    out = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = text.split(), item.split()
        at = set()
        for line in range(-len(b), len(a)):
            places = [p for p in range(len(b) - width + 1) if 0 <= p + line <= len(a) - width and template(a[p + line : p + line + width]) == template(b[p : p + width])]
            values = collections.defaultdict(set)
            for p in places:
                for k in range(p, p + width):
                    if number(b[k]):
                        values[b[k]].add(a[k + line])
            if all(len(v) == 1 for v in values.values()):
                at |= set(places)
            at |= {p for p in places if a[p + line : p + line + width] == b[p : p + width]} if all(len(v) == 1 for v in values.values()) else set()
        covered = {k for p in at for k in range(p, p + width)}
        if len(covered) >= decontaminate.COVERAGE * len(b):
            out.add((d, i))
    return out


def test_slots_of_random_templates(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfgklmnp") + r.choice("aeiou") for _ in range(3))
    items, docs = [], []
    for i in range(12):
        length = r.randint(16, 30)
        items.append((i, " ".join(str(r.randint(1, 4)) if k % 3 == 1 else word() for k in range(length))))
    for d in range(80):
        words = r.choice(items)[1].split()
        mapping = {w: str(r.randint(1, 60)) for w in set(words) if w.isdigit()}
        words = [mapping.get(w, w) for w in words]
        for _ in range(r.choice((0, 0, 1, 2))):  # breaks a slot or a word
            k = r.randrange(len(words))
            words[k] = str(r.randint(70, 90)) if words[k].isdigit() else word()
        cut = words[r.randint(0, 4) :]
        docs.append((d, " ".join([word() for _ in range(r.randint(0, 9))] + cut + [word() for _ in range(r.randint(0, 9))])))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(df, it).collect()}
    want = brute_leaks(docs, items)
    assert got == want and 20 < len(want) < 80
