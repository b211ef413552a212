"""Near copies by exact similarity of word shingles: SimHash balls and MinHash bands propose pairs, shingle sets decide.

A text, A-Z lower-cased, is the set of its shingles of `width` words (a text of fewer words is one shingle, one without
words has an empty set, which is like another empty one and nothing else). Two texts are near copies if the Jaccard
similarity of their sets is at least `similarity`; near copies of near copies belong together.

Each distinct set has a SimHash fingerprint and emits its ball of variants, as in simhash.py: fingerprints of 2 or fewer
differing bits share one. Balls alone can't do it: texts of similarity 0.8 differ in about 10 of 64 bits, and a ball wide
enough for that has more points than there are texts. So each set also emits one key per band, a hash of ROWS minima of its
hashed shingles under ROWS permutations; sets of similarity s share a key with odds 1 - (1 - s^ROWS)^BANDS, at 0.8 all but
3 in a million. Proposed pairs are verified by the sets themselves, so nothing less similar is linked.

Keys with the same members count once. The sets that share a key are compared in blocks of at most BLOCK, every pair in
some block, by a product of their incidence matrices; a block gives each of its components as links to one member.
Shingles are compared as 64-bit hashes.

Nulls: a null text is an empty one. Copies of a set are merged before anything is shuffled. Ties, repeated rows, long texts
and columns with clashing names are as in simhash.least_of_each and need no care here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mixed, stored, text_hash, texts_of, word_hashes
from .components import components
from .simhash import RADIUS, ball, least_of_each

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Most sets that one task compares at once, and columns of a matrix.
BLOCK, _COLUMNS = 512, 1 << 13
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers and offsets of the permutations.
_TIMES, _PLUS = np.random.default_rng(20240301).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's shingles."""
    words = word_hashes(text.lower())
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _BASE + words[k : k + n]
    return np.unique(mixed(h ^ np.uint64(width)))


def keys(found: np.ndarray) -> np.ndarray:
    """One key per band of a set of shingles; those of different bands differ."""
    if not len(found):
        return np.arange(BANDS, dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 256):  # small enough to stay in cache
        np.minimum(least, (_TIMES[:, None] * found[at : at + 256] + _PLUS[:, None]).min(axis=1), out=least)
    h = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        h = mixed(h * _BASE + row)
    return h


def _node(found: np.ndarray) -> int:
    """The number of a set, signed."""
    return xxhash.xxh64_intdigest(found.tobytes(), 7) - (1 << 63)


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles, signed: a bit is 1 if over half of them have it."""
    ones = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


def marked(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, h (xxhash64 of the text), node (the number of its set), fp and the set's band keys, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, width) for t in texts_of(b.column(2))]
            at = pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32())
            flat = np.concatenate([keys(s) for s in sets]) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([_node(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat.view(np.int64)))], ["doc_id", "h", "node", "fp", "keys"]
            )

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), F.col("text").cast("string").alias("text"))
    return mapped(cols, run, "doc_id long, h long, node long, fp long, keys array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """node and its set, once per task, of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            new = {}
            for t in texts_of(b.column(0)):
                found = shingles(t, width)
                node = _node(found)
                if node not in seen:
                    seen.add(node)
                    new[node] = found.view(np.int64)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.list_(pa.int64()))], ["node", "shingles"])

    return mapped(texts.select("text"), run, "node long, shingles array<long>")


def similar(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Whether each two of the sets (sorted, distinct) have at least that Jaccard similarity."""
    size = np.array([len(s) for s in sets])
    of, column = np.repeat(np.arange(len(sets)), size), np.unique(np.concatenate(sets), return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, _COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + _COLUMNS))
        part = np.zeros((len(sets), min(_COLUMNS, last - at)), np.float32)
        part[of[lo:hi], column[lo:hi] - at] = 1
        common += (part @ part.T).astype(np.int64)
    return common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9


def _links(nodes: list[int], sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    near = similar(sets, similarity)
    left = np.ones(len(nodes), bool)
    for k in range(len(nodes)):
        if not left[k]:
            continue
        left[k] = False
        edge = np.array([k])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & left)
            left[edge] = False
            yield from ((nodes[i], nodes[k]) for i in edge)


def links(docs: DataFrame, rows: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """u and v, links that connect all sets of that similarity which share a key; rows is marked(docs)."""
    balls = F.transform(ball(F.col("fp"), RADIUS // 2), lambda v: F.xxhash64(v))
    keyed = rows.dropDuplicates(["node"]).select("node", F.explode(F.concat("keys", balls)).alias("key"))
    members = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")).where("n > 1")
    crowded = members.groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    shared = stored(keyed.join(crowded.select("key", "n"), "key"), "shingles-shared")
    # One text of each set, before anything is joined: copies are combined where they are read.
    wanted = rows.groupBy("node").agg(F.min("h").alias("h")).join(shared.select("node").distinct(), "node", "left_semi").select("h")
    texts = docs.select(F.col("text").cast("string").alias("text"), text_hash().alias("h")).join(wanted, "h", "left_semi")
    sets = stored(_sets(texts, width).groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles-sets")
    # Parts of half a block, each of which meets every other.
    parts = F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / (BLOCK // 2))).otherwise(1).cast("int")
    dealt = shared.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part")))
    dealt = dealt.select("node", "key", "part", F.explode(others).alias("other")).select("node", "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    blocks = dealt.join(sets, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").select("key", "lo", "hi", "node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            found = list(_links(nodes, sets, similarity))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])

        now, nodes, sets = None, [], []
        for b in batches:
            for k, node, found in zip(zip(*(b.column(c).to_pylist() for c in range(3))), b.column(3).to_pylist(), b.column(4)):
                if k != now:
                    if nodes:
                        yield done()
                    now, nodes, sets = k, [], []
                nodes.append(node)
                sets.append(found.values.to_numpy())
        if nodes:
            yield done()

    return mapped(blocks, run, "u long, v long").distinct()


def one_of_each(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without near copies: of each component, one row with its least doc_id stays."""
    rows = stored(marked(docs, width), "shingles")
    roots = stored(components(links(docs, rows, width, similarity)), "shingles-roots")
    nodes = rows.select("node").distinct()
    return least_of_each(docs, rows.select("doc_id", "h", "node"), nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "node")
