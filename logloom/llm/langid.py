"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of the lower-cased text per language over all training rows: each task adds up
dense count vectors in numpy and emits their non-zero cells once, Spark sums them with a combine before the shuffle. The
model is one log-probability matrix of languages x BUCKETS float32 cells; its size is checked before it is broadcast.
Scoring gathers matrix rows for the n-grams of a batch of texts and reduces them per document.

lang_pred is `und` for a null text, a text without a letter, and if nothing could be learned; score is the posterior of
the prediction (0 for `und`). Ties go to the first language in code-point order. Rows with a null lang are not learned
from; a null doc_id counts as a training id; repeated rows count as often as they occur. Long texts are cut into grams part
by part and score as a whole. Columns of the table that are named like the result's do no harm: only those that are kept are
carried, and accepted() gives the columns that it got. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out_col, in_slices, mapped

BITS, ORDERS = 15, 3
BUCKETS = 1 << BITS
#: Largest model that is broadcast, in bytes.
MODEL_LIMIT = 256 << 20
#: Score that a text needs to be accepted.
LEAST = 0.5
_CHARS = 1 << 18
_FOLD, _SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def grams(text: str) -> np.ndarray:
    """Buckets of every 1- to 3-gram of the text."""
    out = []
    for at in range(0, len(text), _CHARS):
        lead = min(at, ORDERS - 1)
        a = np.frombuffer(text[at - lead : at + _CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        g = np.zeros(len(a), np.uint32)
        for k in range(ORDERS):
            g = g[: len(a) - k] * _FOLD + a[k:] + np.uint32(k + 1) if k else a + np.uint32(1)
            new = g[max(0, lead - k) :]  # those that end in this part of the text
            out.append(((new ^ (new >> np.uint32(15))) * _SPREAD) >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model(NamedTuple):
    """langs in code-point order; weights is BUCKETS x langs, prior has a log probability per language."""

    langs: list[str]
    weights: np.ndarray
    prior: np.ndarray


def train(rows: DataFrame, alpha: float = 0.5) -> Model:
    """rows has text and lang (no null). All rows are counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held = seen.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                held[BUCKETS] += 1
                if text:
                    held[:BUCKETS] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, held in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([held.tolist()])], ["lang", "n"])

    most = MODEL_LIMIT // (4 * BUCKETS)
    if rows.select("lang").distinct().limit(most + 1).count() > most:  # before anything of the model is gathered
        raise ValueError(f"over {most} languages make a model of over {MODEL_LIMIT} bytes")
    parts = mapped(rows.select("text", "lang"), count, "lang string, n array<long>")
    cells = parts.select("lang", F.posexplode("n").alias("bucket", "n")).where("n > 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    cells = cells.toPandas()
    langs = sorted(cells["lang"].unique())
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[cells["bucket"], cells["lang"].map({x: k for k, x in enumerate(langs)})] = cells["n"]
    grams_, docs = counts[:BUCKETS], counts[BUCKETS]
    weights = np.log((grams_ + alpha) / (grams_.sum(axis=0) + alpha * BUCKETS)).astype(np.float32)
    return Model(langs, weights, np.log(docs / max(docs.sum(), 1)) if len(langs) else docs)


def _scored(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Best language and its posterior for each text, none of them empty."""
    total = np.zeros((len(texts), len(model.langs)))
    at = 0
    for some in in_slices(texts, _CHARS):
        found = [grams(t) for t in some]
        ends = np.cumsum([len(x) for x in found])
        if ends[-1] > 8 * _CHARS:  # very long texts: counted first, so that no row is gathered twice
            total[at : at + len(some)] = [np.bincount(x, minlength=BUCKETS) @ model.weights.astype(np.float64) for x in found]
        else:
            got = model.weights[np.concatenate(found)]
            total[at : at + len(some)] = np.add.reduceat(got, np.concatenate(([0], ends[:-1])), axis=0, dtype=np.float64)
        at += len(some)
    total += model.prior
    best = total.argmax(axis=1)
    return best, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), as_: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of keep, lang_pred and score (under the names of as_) for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))
    schema = docs.select(*keep).schema.add(as_[0], "string").add(as_[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            known = [k for k, t in enumerate(texts) if m.langs and has_letter(t)]
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if known:
                best, score[known] = _scored(m, [texts[k] for k in known])
                lang[known] = np.array(m.langs, object)[best]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score)], [*keep, *as_])

    return mapped(docs.select(*keep, F.col("text").cast("string").alias(fresh(docs, "_text"))), run, schema)


def identified(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 4 is not 2 and predicts all rows."""
    known = docs.where(~held_out_col(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull())
    return predict(docs, train(known), keep)


def accepted(docs: DataFrame, least: float = LEAST, langs: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs whose language is identified with a score of `least` or more, and is one of langs, if given: texts
    that are `und` go, and so do those that are torn between languages."""
    known = docs.where(~held_out_col(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull())
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = predict(docs, train(known), tuple(docs.columns), (lang, score)).where((F.col(lang) != "und") & (F.col(score) >= least))
    return (found.where(F.col(lang).isin(*langs)) if langs else found).select(*docs.columns)
