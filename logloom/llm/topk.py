"""Exact top-k by inner product over an impact-ordered index, read a score at a time.

A component x counts as floor(256 * x), so scores are integers. The vectors lie in blocks of some 2**20 components. In a
block each dimension's postings are sorted by value and cut into SEGMENTS runs of equal length; a run has its quantised
impact: the greatest and the least value in it. For a query of weights w, a run's impact is the greatest w * v it can hold,
measured from one deviation below the mean of its dimension's runs, so that a dimension of a large weight is not read to its
end while others have not begun; bounds put that constant back.

Segments are read by descending impact, a band of them at a time. After a band, what a vector has in dimensions not yet
read is at most the impact of the next segment (or that of the dimension's first, if none of it is read), so each vector has
an upper bound. The best bounds are scored exactly, which gives a proven k-th score; vectors whose bound is below it
are out. Reading stops only when few vectors (a KEEP-th of the block) can still be members; those are scored exactly.

Every group of queries meets every block: an equi-join of (block, group), in rows of bounded size. A task that meets further
blocks for a group of queries starts from the k-th score that it has proven before. Each block's members are then ranked.

Vectors that are null or hold null, NaN or infinite components take no part. An empty vector scores 0 with all. Of vectors of
different lengths the shorter counts as filled up with zeros. Rows are told apart by id and vector: rows repeated in
both are counted and are each other's candidates, and as queries give their rows as often. A null id is never a query; as a
candidate it comes after other ids of its score. Scores beyond a long saturate. Ties go to the smaller id. Copies of a
vector under many ids are spread over the blocks by id. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Components of a block; vectors of a block at most; queries that meet a block together.
BLOCK, ROWS, GROUP = 1 << 20, 1 << 14, 256
#: Posting segments of a dimension, the shares of segments read before each test, and when few vectors are left.
SEGMENTS, BANDS, KEEP = 64, (0.2, 0.35, 0.45, 0.55, 0.65, 0.8, 1.0), 16

_ROWS = "cls int, part long, n int, kind string, ids binary, known binary, times binary, vectors binary"
_INDEX = f"{_ROWS}, segments binary, hi binary, lo binary"
_FOUND = "grp string, pos int, query_id long, q_times long, vec_id long, times long, score long"


def _usable(e: Column) -> Column:
    return e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _rows_of(cls: int) -> int:
    return max(1, min(ROWS, BLOCK >> cls))


def _whole(flat: np.ndarray) -> str:
    """The smallest type that holds all of these whole numbers."""
    most = np.abs(flat).max(initial=0)
    return next((k for k, limit in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1)) if most <= limit), "f8")


def _packed(rows: DataFrame, per: dict[int, int], name: str, index: bool) -> tuple[DataFrame, dict[int, int]]:
    """The rows in parts of about per[cls] rows, a row for each part, with posting segments if it is an index; and the
    number of parts of each class (there is one per power of two). Ids of equal vectors are spread over the parts."""
    counts = rows.groupBy("cls").agg(F.count("*").alias("n")).collect()
    parts = {r["cls"]: -(-r["n"] // per[r["cls"]]) for r in counts}
    many = F.element_at(F.create_map(*[F.lit(x) for pair in (parts or {0: 1}).items() for x in pair]), F.col("cls"))

    def pack(key, t):
        cls, number = (k.as_py() for k in key)
        ids, lists, n = t["vec_id"].combine_chunks(), t["embedding"].combine_chunks(), len(t)
        flat = np.floor(np.asarray(lists.flatten(), np.float64) * 256.0)
        size = np.asarray(pa.compute.list_value_length(lists), np.int64)
        v = np.zeros((n, 1 << cls))
        v[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        kind = _whole(v)
        cells = {"ids": np.asarray(pa.compute.fill_null(ids, 0), np.int64), "known": np.asarray(ids.is_valid()).astype(np.uint8),
                 "times": np.asarray(t["times"], np.int64), "vectors": v.astype(kind)}
        if index:
            cells |= dict(zip(("segments", "hi", "lo"), segments(v)))
        head = {"cls": pa.array([cls], pa.int32()), "part": pa.array([number], pa.int64()), "n": pa.array([n], pa.int32()), "kind": [kind]}
        return pa.table(head | {c: pa.array([x.tobytes()], pa.binary()) for c, x in cells.items()})

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), many))
    return stored(dealt.groupBy("cls", "part").applyInArrow(pack, _INDEX if index else _ROWS), name), parts


def segments(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each dimension's positions by descending value, cut into runs of equal length (filled up with the number of
    vectors, which is no position), and each run's greatest and least value."""
    n, dims = vectors.shape
    length = -(-n // SEGMENTS)
    first = np.arange(0, n, length)
    order = np.argsort(-vectors, axis=0, kind="stable").T
    ids = np.full((dims, length * len(first)), n, np.uint16 if n < 65536 else np.int32)
    ids[:, :n] = order
    values = np.take_along_axis(vectors.T, order, 1)
    return ids, values[:, first], values[:, np.minimum(first + length, n) - 1]


def exact(w: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The inner products as long, exactly; those beyond a long saturate."""
    most = float(np.abs(w).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, len(w))
    if most < 2.0**53:
        return (vectors @ w).astype(np.int64)
    a, b = ([[int(x) for x in row] for row in m] for m in (vectors, [w]))
    return np.array([max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(row, b[0])))) for row in a], np.int64)


class Block:
    """A block of the index: its vectors, posting segments and their impacts, in the first `dims` dimensions."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, hi: np.ndarray, lo: np.ndarray, dims: int):
        self.vectors, self.hi, self.lo = np.ascontiguousarray(vectors[:, :dims], np.float64), hi[:dims], lo[:dims]
        self.ids = ids[:dims].reshape(dims * hi.shape[1], -1)

    def members(self, w: np.ndarray, k: int, own: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions of all vectors that can be among the k best and score at least `least`, their scores, and how many
        segments were read. own: the position of a vector that doesn't count, or -1."""
        n, dims = self.vectors.shape
        used = np.flatnonzero(w)
        width = self.hi.shape[1]
        impact = np.where(w[used, None] > 0, w[used, None] * self.hi[used], w[used, None] * self.lo[used])
        slack = 1e-9 * (1 + np.abs(impact).max(1, initial=0).sum())  # of sums of doubles
        usual = impact.mean(1) - impact.std(1)
        impact, base = impact - usual[:, None], usual.sum() + slack
        top = impact.max(1, initial=-np.inf)
        flat = impact.ravel()
        order = np.argsort(-flat, kind="stable")
        row = (used[:, None] * width + np.arange(width)).ravel()[order]
        score, seen = np.zeros(n + 1), np.zeros(n + 1)
        at, alive = 0, np.ones(n, bool)
        if own >= 0:
            alive[own] = False
        for share in BANDS:
            to = int(np.ceil(share * len(order)))
            if to > at:
                ids = self.ids[row[at:to]]
                flat_ids = ids.ravel().astype(np.intp)
                score += np.bincount(flat_ids, np.repeat(flat[order[at:to]], ids.shape[1]), n + 1)
                seen += np.bincount(flat_ids, minlength=n + 1)
                at = to
            ahead = flat[order[at]] if at < len(order) else 0.0
            started = top >= ahead if at < len(order) else np.ones(len(used), bool)
            bound = score[:n] + top[~started].sum() + ahead * (started.sum() - seen[:n]) + base
            best = np.flatnonzero(alive)
            if len(best) > k:
                best = best[np.argpartition(-bound[best], k)[:k]]
                least = max(least, float(np.sort(exact(w, self.vectors[best]))[-k]))
            alive &= bound >= least
            if alive.sum() <= max(k, n // KEEP):
                break
        found = np.flatnonzero(alive)
        return found, exact(w, self.vectors[found]), at


def best_rows(score: np.ndarray, known: np.ndarray, ids: np.ndarray, times: np.ndarray, k: int) -> np.ndarray:
    """Which entries hold the k best rows, ties to smaller ids, each entry counting `times` rows."""
    order = np.lexsort((ids, known == 0, -score))
    before = np.cumsum(times[order]) - times[order]
    return order[before < k]


def _read(t: pa.Table) -> dict:
    row = {c: t[c][0].as_py() for c in t.column_names}
    kinds = {"ids": np.int64, "known": np.uint8, "times": np.int64, "vectors": row["kind"]}
    row |= {c: np.frombuffer(row[c], k) for c, k in kinds.items()}
    return row | {"vectors": row["vectors"].reshape(row["n"], -1)}


def _search(k: int):
    proven: dict = {"grp": None, "least": None}  # of the last group of queries: their k best scores so far in this task

    def search(key, left, right):
        out: list[tuple] = []
        if len(left) and len(right):
            grp, b, q = key[0].as_py(), _read(left), _read(right)
            if proven["grp"] != grp:
                proven.update(grp=grp, least=np.full((q["n"], k), -np.inf))
            out = list(_members(b, q, k, proven["least"]))
        cols = list(zip(*out)) or [()] * 6
        names = ["pos", "query_id", "q_times", "vec_id", "times", "score"]
        kinds = [pa.int32(), *[pa.int64()] * 5]
        return pa.table({"grp": pa.array([key[0].as_py()] * len(out), pa.string())} | {c: pa.array(x, t) for c, x, t in zip(names, cols, kinds)})

    return search


def _members(b: dict, q: dict, k: int, least: np.ndarray) -> Iterator[tuple]:
    """What a block holds that can be among the k best of a group's queries; `least` has their k best scores so far."""
    dims = min(b["vectors"].shape[1], q["vectors"].shape[1])
    hi, lo = (np.frombuffer(b[c], np.float64).reshape(b["vectors"].shape[1], -1) for c in ("hi", "lo"))
    ids = np.frombuffer(b["segments"], np.uint16 if b["n"] < 65536 else np.int32).reshape(len(hi), -1)
    block = Block(b["vectors"], ids, hi, lo, dims)
    where: dict[int, list[int]] = {}
    for p in np.flatnonzero(np.isin(b["ids"], q["ids"]) & (b["known"] == 1)):
        where.setdefault(int(b["ids"][p]), []).append(int(p))
    for p, (query, own_times) in enumerate(zip(q["ids"].tolist(), q["times"].tolist())):
        vector, times = q["vectors"][p], b["times"]
        own = next((x for x in where.get(query, ()) if b["cls"] == q["cls"] and np.array_equal(b["vectors"][x], vector)), -1)
        if own >= 0:
            times = times.copy()
            times[own] -= 1
        found, score, _ = block.members(vector[:dims].astype(np.float64), k, own if own >= 0 and not times[own] else -1, least[p, 0])
        chosen = best_rows(score, b["known"][found], b["ids"][found], times[found], k)
        rows = np.repeat(score[chosen].astype(np.float64), np.minimum(times[found[chosen]], k))
        least[p] = np.sort(np.concatenate((least[p], rows)))[-k:]
        for c in chosen:
            at = found[c]
            yield p, query, own_times, int(b["ids"][at]) if b["known"][at] else None, int(times[at]), int(score[c])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows of vectors with the highest inner products with each row of
    queries, itself left out; both have vec_id and embedding. All, if fewer than k. See above for nulls and repeated rows."""

    def usable(df: DataFrame) -> DataFrame:
        e = F.col(embedding)
        rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("embedding")).where(_usable(e))
        rows = rows.groupBy("vec_id", "embedding").agg(F.count("*").alias("times"))
        return rows.withColumn("cls", F.ceil(F.log2(F.greatest(F.size("embedding"), F.lit(1)).cast("double"))).cast("int"))

    index, parts = _packed(usable(vectors), {c: _rows_of(c) for c in range(32)}, "topk-index", True)
    asked = usable(queries.where(F.col(vec_id).isNotNull()))
    asked, groups = _packed(asked, {c: min(GROUP, _rows_of(c)) for c in range(32)}, "topk-queries", False)

    def numbers(of: dict[int, int]) -> Column:
        """A row for each part of each class, by its name."""

        def names(cls: int, n: int) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat_ws("/", F.lit(cls), i))

        return F.explode(F.concat(F.array().cast("array<string>"), *[names(c, n) for c, n in of.items()]))

    blocks = index.select("*", F.concat_ws("/", "cls", "part").alias("blk"), numbers(groups).alias("grp"))
    asked = asked.select("*", F.concat_ws("/", "cls", "part").alias("grp"), numbers(parts).alias("blk"))
    pairs = blocks.groupBy("grp", "blk").cogroup(asked.groupBy("grp", "blk"))
    found = pairs.applyInArrow(_search(k), _FOUND)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
    best = Window.partitionBy("grp", "pos").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "copy")
    ranked = each.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    return ranked.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("q_times").cast("int")))).select("query_id", "rank", "vec_id", "score")
