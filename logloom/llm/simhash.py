"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text, A-Z lower-cased, is cut into words (runs of characters other than space and U+0009 to U+000D) and shingles of
`width` space-joined words, repeats included; a text of fewer words is one shingle, one without words has fingerprint
zero and is linked like any other. A fingerprint bit is 1 if it is set in over half of the shingles' XXH64 (UTF-8, seed
42).

Two fingerprints that differ in at most 2r bits have a common variant at distance r or less from both: each distinct
fingerprint so emits every variant within r bits of itself, variants are shuffled, and the fingerprints that share a
variant are all within 2r bits of one another by the triangle inequality. Each bucket links its members to its least
member (a bucket holds at most as many distinct fingerprints as a ball has points, 65 for r = 1), the links are verified
by xor and deduplicated, and connected components follow. Copies of a fingerprint are merged before anything is
shuffled, so a group of copies of any size costs one row.

Nulls: a null text is an empty one; a null doc_id is kept as a row, but never names a component unless the whole
component has none. Repeated rows get the same row twice. A bit that exactly half of the shingles have is 0; of rows that tie for
a component's least doc_id the one with the least text hash stays, and of repeated rows one. Long texts are hashed part by
part and count whole. Columns of any name come along unread. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, joined_by, mapped, stored, text_hash, texts_of
from .components import components

WIDTH, RADIUS, SEED = 3, 2, 42
_PART = 1 << 15


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()  # bytes.lower and bytes.split know ASCII only, as wanted
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    width = min(width, len(words))
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, n, _PART):
        part = words[at : at + _PART + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        m = len(part) - width + 1
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:m].tolist(), ends[width - 1 :].tolist())), np.uint64, m)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, h (xxhash64 of the text) and fp, the fingerprint as a signed 64-bit number, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, width) for t in texts_of(b.column(2))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "h", "fp"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), F.col("text").cast("string").alias("text"))
    return mapped(cols, run, "doc_id long, h long, fp long")


def ball(fp: Column, radius: int) -> Column:
    """Every value within radius bits of fp."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return F.transform(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks]), lambda m: fp.bitwiseXOR(m))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps has distinct fp; gives u and v, verified links that connect all fingerprints within radius bits."""
    if radius % 2:
        raise ValueError("the radius must be even to be met in the middle")
    # Distinct fingerprints are few bytes, often one file; their variants are many, so they are dealt out first.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = fps.select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("variant"))
    met = variants.groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = met.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u <> v")
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def _classed(docs: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, h and fp for each row of docs; and fp, n (rows with it), and root, once per fingerprint."""
    marked = stored(fingerprints(docs, width), "simhash")
    fps = stored(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "simhash-distinct")
    roots = stored(components(links(fps.select("fp"), radius)), "simhash-roots")
    return marked, stored(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "simhash-classes")


def classes(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable) for each row of docs.

    Only numbers per fingerprint are grouped by component; rows meet them by fingerprint, with hot ones broadcast.
    """
    marked, fps = _classed(docs, width, radius)
    names = stored(fps.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-least")
    per = joined_by(fps.select("fp", "root", F.col("n").alias("rows")), names, "root", fps.count())
    per = stored(per.select("fp", "component_id", F.col("rows").alias("n")), "simhash-names")
    out = joined_by(marked, per, "fp", marked.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near copies of that similarity of shingles: of each group, one row with its least doc_id
    stays. Balls propose pairs here and, for those too far apart for them, bands; the shingles decide (see shingles.py)."""
    from . import shingles

    return shingles.one_of_each(docs, width, similarity)


def one_of_each(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without near-duplicates: of each component, one row with its least doc_id stays."""
    marked, fps = _classed(docs, width, radius)
    return least_of_each(docs, marked, fps.select("fp", "root"), "fp")


def least_of_each(docs: DataFrame, rows: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Of each root, the one row of docs with its least doc_id. rows has doc_id, h and key for each row of docs; roots has
    key and root, once per key.

    The least row is sought per key and then per root, so no root gathers its rows. A row that doesn't stay is dropped by
    its id and hash, so texts are neither regrouped nor sorted; only rows that repeat both id and text of one that stays
    are numbered.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("best")
    per = stored(rows.groupBy(key).agg(first, F.count(F.lit(1)).alias("n")).join(roots, key).select(key, "root", "best", "n"), "least-keys")
    best = stored(per.groupBy("root").agg(F.min("best").alias("stay"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("n")).where("rows > 1"), "least-roots")
    # Roots with one row are never looked at: it stays.
    crowd = joined_by(per.select(key, "root", F.col("n").alias("rows")), best.select("root", "stay", "n"), "root", per.count())
    crowd = stored(crowd.select(key, F.col("stay.doc_id").alias("stay_id"), F.col("stay.h").alias("stay_h"), F.col("rows").alias("n")), "least-crowds")
    stays = best.select("stay.doc_id", "stay.h")
    gone = joined_by(rows, crowd, key, rows.count()).where(~(F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("h") == F.col("stay_h"))))
    out = stored(gone.select(F.col("doc_id").alias("id"), "h").distinct(), "least-out")
    twice = rows.join(stays.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi")
    twice = stored(twice.groupBy(F.col("doc_id").alias("id"), "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "h"), "least-twice")

    def same(other: DataFrame):
        return docs["doc_id"].cast("long").eqNullSafe(other["id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == other["h"])

    kept = docs.join(out, same(out), "left_anti")
    if twice.isEmpty():
        return kept
    number = fresh(docs, "number")
    again = kept.join(twice, same(twice), "left_semi").withColumn(number, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.lit(1))))
    return kept.join(twice, same(twice), "left_anti").unionByName(again.where(F.col(number) == 1).drop(number))
