"""Quality classification by hierarchical empirical Bayes.

A document's own evidence is a log likelihood ratio: naive Bayes over hashed words plus the shape of its words (symbols,
bars, digits, length). All words count, damped by length: the evidence for and that against enter by their root sums of
squares (times DAMPING), so many weak words neither drown a few strong ones nor the site. It is learned from at most
SAMPLE labelled rows (those with the least hash of their id); good means quality 1 and not toxic.

Site evidence is a hierarchy of posteriors from grouped sums over all documents: the global rate of good documents, each
host's rate shrunk towards it, and each path's rate shrunk towards its host's. How far is learned by moments: a level
whose rates scatter little more than chance shrinks strongly. A document itself is taken out of its site's sums, so it
does not vouch for itself. The result combines the logit of its path's rate with its own evidence.

Grouped sums are combined before the shuffle, so a host with any share of the rows is one row per task; the join back is
an equi-join on (host, path) with one row per site.

A null text is an empty one, with no evidence of its own; null hosts or paths are sites of their own; labels that are
null are not learned from; a null doc_id cannot be labelled. Without labelled rows of both classes nothing is learned and
every score is the prior 0.5. Repeated rows count as often as they occur; of labels of one doc_id the worst counts. Ties of the
sample are broken by doc_id. A long text counts as a whole. Only doc_id, text and the columns that name host and path are
read, so other columns do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored, texts_of, word_hashes

#: Most labelled rows that the classifier is fitted on.
SAMPLE = 50_000
BITS, THRESHOLD = 16, 0.5
#: Signed root of the deviance (standard errors, also where a class has no row) by which a word must stand out.
SIGNIFICANT = 4.5
#: Words of equal evidence that count in full; more of them count as the root of their number.
DAMPING = 2.0
BUCKETS = 1 << BITS
_SHAPES = 8 * 16
_SHARP = np.array(list(b"#*$%&|<>"), np.uint8)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' hashes, and the text's shape: for each of eight ratios, which of 16 bins it falls in."""
    words = (word_hashes(text.lower()) >> np.uint64(64 - BITS)).astype(np.int64)
    raw = np.frombuffer(text, np.uint8)
    n, w = max(1, len(raw)), max(1, len(words))
    count = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, np.int64)
    distinct = len(np.unique(words))
    ratios = (
        count[_SHARP].sum() / w,
        count[ord("|")] / w,
        count[48:58].sum() / n,
        count[65:91].sum() / w,
        (count[ord(".")] + count[ord(",")]) / w,
        count[ord("\n")] / w,
        distinct / w,
        np.log10(w) / 5,
    )
    bins = [min(15, int(16 * min(1.0, float(x)))) for x in ratios]
    return words, np.arange(8) * 16 + np.array(bins)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Log likelihood ratios of word buckets and shapes, and the logit of the rate of good rows, from labelled rows."""
    y = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int").alias("y"))
    y = y.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id").select("text", "y")  # at most `sample` rows of 12 bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS + _SHAPES + 1), np.int64)
        for b in batches:
            for t, y in zip(texts_of(b.column(0)), b.column(1).to_pylist()):
                words, shape = features(t)
                held[y, np.unique(words)] += 1  # in how many texts
                held[y, BUCKETS + shape] += 1
                held[y, -1] += 1
        for y in (0, 1):
            k = np.flatnonzero(held[y])
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), y, np.int32)), pa.array(k), pa.array(held[y, k])], ["y", "k", "n"])

    cells = mapped(rows, count, "y int, k long, n long").groupBy("y", "k").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((2, BUCKETS + _SHAPES + 1))
    n[cells["y"].to_numpy(int), cells["k"].to_numpy(int)] = cells["n"]
    seen = n[:, -1]
    if not seen.all():
        return np.zeros(BUCKETS, np.float32), np.zeros(_SHAPES, np.float32), 0.0
    rate = (n[:, :-1] + 0.5) / (seen[:, None] + 1)
    ratio = np.log(rate[1] / rate[0])
    seen_in = n[:, :BUCKETS]
    # Only buckets whose share of good rows stands out from chance count: with tens of thousands of them, others would add
    # noise. The deviance judges words of one class only as well, and their ratio is shrunk by one row of the base rate.
    base = (seen / seen.sum())[:, None]
    total = seen_in.sum(axis=0)
    deviance = 2 * np.where(seen_in > 0, seen_in * np.log(np.maximum(seen_in, 1) / np.maximum(total * base, 1e-9)), 0).sum(axis=0)
    share = (seen_in + base) / (total + 1)
    words = np.where((deviance > SIGNIFICANT**2) & (total >= 5), np.log(share[1] / share[0]) - np.log(seen[1] / seen[0]), 0)
    return words.astype(np.float32), ratio[BUCKETS:].astype(np.float32), float(np.log(seen[1] / seen[0]))


def evidence(docs: DataFrame, model: tuple, keep: list[str]) -> DataFrame:
    """The columns of keep and llr, the document's own log likelihood ratio."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + 128 float32 cells
    schema = docs.select(*keep).schema.add("llr", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, of_shapes, _ = held.value
        for b in batches:
            llr = []
            for t in texts_of(b.column(len(keep))):
                if not t:
                    llr.append(0.0)
                    continue
                words, shape = features(t)
                x = of_words[np.unique(words)].astype(np.float64)
                told = np.sqrt(np.square(np.maximum(x, 0)).sum()) - np.sqrt(np.square(np.minimum(x, 0)).sum())
                llr.append(float(DAMPING * told + of_shapes[shape].sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(llr, pa.float64())], [*keep, "llr"])

    return mapped(docs.select(*keep, F.col("text").cast("string").alias("_text")), run, schema)


def _strength(rates: DataFrame, mean) -> float:
    """Pseudo-documents of a Beta prior, by moments: rates has n and s (sum of probabilities) per group, mean its prior."""
    r = rates.where("n > 0").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("v"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * mean * (1 - mean)).alias("b")).first()
    if not r.k or r.k < 2 or not r.b:
        return 20.0
    scatter, chance = r.v / r.n, r.b / r.n * r.k / r.n  # mean square of rates around their prior; what sampling alone gives
    between = max(scatter - chance, 1e-6)
    return float(min(1000.0, max(1.0, r.b / r.n / between - 1)))


def scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, own (probability from the text alone), host_rate, path_rate, score and kept for each row of docs.

    host and path name the columns that locate a document; documents have no URL, so their source stands for the host
    and its language section for the path.
    """
    model = train(docs, labels, sample)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    own = evidence(named, model, ["doc_id", "host", "path"])
    prior = model[2]
    own = stored(own.withColumn("own", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("llr") + F.lit(prior)))))), "quality-own")
    paths = stored(own.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("h_n"), F.sum("s").alias("h_s"))
    whole = hosts.agg(F.sum("h_s") / F.sum("h_n")).first()[0]
    whole = min(1 - 1e-6, max(1e-6, 0.5 if whole is None else whole))
    m_host = _strength(hosts.select(F.col("h_n").alias("n"), F.col("h_s").alias("s")), F.lit(whole))
    host_rate = (F.col("h_s") + m_host * F.lit(whole)) / (F.col("h_n") + m_host)
    p, h = paths.alias("p"), hosts.alias("h")
    sites = p.join(h, F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "p.path", "n", "s", "h_n", "h_s")
    m_path = _strength(sites.withColumn("r", host_rate), F.col("r"))
    s = stored(sites, "quality-sites").select(F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "s", "h_n", "h_s")
    out = own.join(s, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    out = out.withColumn("host_rate", (F.col("h_s") - F.col("own") + m_host * F.lit(whole)) / (F.col("h_n") - 1 + m_host))
    out = out.withColumn("path_rate", (F.col("s") - F.col("own") + m_path * F.col("host_rate")) / (F.col("n") - 1 + m_path))
    rate = F.least(F.greatest(F.col("path_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = F.col("llr") + F.log(rate / (1 - rate))
    out = out.withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0)))))
    return out.select("doc_id", "own", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept"))
