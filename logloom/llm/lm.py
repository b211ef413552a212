"""Language-model scoring by deleted interpolation.

P(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1), where the three weights depend on how often the context v
was seen: contexts are put in buckets by the logarithm of their count, and each bucket's weights are learned by
expectation-maximisation. For that a slice of the training rows is held out: the maximum-likelihood estimates come from
the other training rows, the slice's tokens are summed up per bucket over a fixed grid of the ratios of the three
estimates, and EM runs over that grid. The estimates that score texts then come from all training rows.

Tokens are words with A-Z lower-cased (runs of characters other than space and U+0009 to U+000D), then one end; a text's
first context is its begin. V counts distinct training tokens; an unknown word has the one remaining share l0 / (V + 1).
The base score uses add-0.1 counts of single tokens.

Everything the corpus has is counted, as 64-bit hashes of tokens and pairs. Rows are dealt into parts by hash. A part asks
for its distinct tokens and pairs: sorted hashes with its own counts, cut into ranges of the hash. Each range is summed up
over all parts by one task, which answers each part with the totals in the order in which it asked. A token that
every text has so costs one entry per part, and no table of the model is ever broadcast or collected; only the grid,
whose size is fixed, reaches the driver. Parts and ranges hold PART and RANGE bytes of text, whatever the size of the
input. A part asks a range in one row, so there are at most as many rows as parts times ranges, and never more than the
parts have distinct tokens and pairs together, which is linear in the input: with very many ranges a row holds few keys
or one, and is then stored without compression, at some 50 bytes beside the key.

Nulls: a null text is an empty one (its only token is the end); a null doc_id is a training row. Repeated rows count as
often as they occur. A long text is hashed part by part and scored as a whole; ties have no bearing, since all is sums. Only
doc_id and text are read, so other columns do no harm. Without training rows, known tokens are none, V and N are 0 and both scores use those. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held_out_col, mapped, mixed, stored, word_hashes

#: Bytes of text per part and per range of hashes.
PART, RANGE = 24 << 20, 16 << 20
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Context buckets, and the grid of the EM: steps of log2(estimate / uniform), with one more for an estimate of zero.
BUCKETS, STEPS, STEP = 24, 64, 0.5
ROUNDS = 60
_TOKENS, _PAIRS = 0, 1


def _tokens(text: bytes) -> np.ndarray:
    return np.append(word_hashes(text.lower()), END)


def _read(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Tokens of each text, and all tokens and pairs one after another."""
    texts = [_tokens(zstandard.decompress(z.as_py())) for z in table.column("z")]
    flat = np.concatenate(texts)
    before = np.concatenate(([BEGIN], flat[:-1]))
    ends = np.cumsum([len(t) for t in texts])
    before[ends[:-1]] = BEGIN
    return texts, flat, mixed(before * np.uint64(0x9E3779B97F4A7C15) + flat)


#: Numbers of fewer bytes are not compressed: a frame would cost more than it saves.
_PLAIN = 256
_FRAME = zstandard.MAGIC_NUMBER.to_bytes(4, "little")


def _pack(x: np.ndarray) -> bytes:
    """Unsigned numbers by planes of their bytes, so that zero bytes cost nothing; short runs as they are, after a zero byte."""
    if x.nbytes < _PLAIN:
        return b"\0" + x.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpack(z: bytes, kind) -> np.ndarray:
    if z[:4] != _FRAME:
        return np.frombuffer(z, kind, offset=1)
    raw = np.frombuffer(zstandard.decompress(z), np.uint8)
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(wide, -1).T).reshape(-1).view(kind)


_ASK = "kind int, range int, part long, n long, keys binary, fit binary, tune binary"
_ANSWER = "part long, kind int, range int, fit binary, tune binary, n_fit long, n_tune long, v_fit long, v_all long"


def _asked(bits: int):
    def run(table: pa.Table) -> pa.Table:
        texts, flat, pairs = _read(table)
        length = np.array([len(t) for t in texts])
        use = np.repeat(np.array(table.column("use").to_pylist(), np.int8), length)
        rows = []
        for kind, keys in ((_TOKENS, flat), (_PAIRS, pairs)):
            own, place = np.unique(keys, return_inverse=True)
            fit = np.bincount(place[use == 1], minlength=len(own)).astype(np.uint32)
            tune = np.bincount(place[use == 2], minlength=len(own)).astype(np.uint32)
            cuts = np.searchsorted(own, (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64))
            for r, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(own)])):
                if b > a:
                    rows.append((kind, r, table.column("part")[0].as_py(), int(b - a), _pack(np.diff(own[a:b], prepend=np.uint64(0))), _pack(fit[a:b]), _pack(tune[a:b])))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        out = pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["kind", "range", "part", "n", "keys", "fit", "tune"])
        give_back()
        return out

    return run


def _answered(table: pa.Table) -> pa.Table:
    ns = table.column("n").to_pylist()
    keys = np.concatenate([np.cumsum(_unpack(z.as_py(), np.uint64), dtype=np.uint64) for z in table.column("keys")])
    fit, tune = (np.concatenate([_unpack(z.as_py(), np.uint32) for z in table.column(c)]) for c in ("fit", "tune"))
    own, place = np.unique(keys, return_inverse=True)
    fit_all, tune_all = (np.bincount(place, weights=x, minlength=len(own)).astype(np.uint64) for x in (fit, tune))
    kind, range_ = table.column("kind")[0].as_py(), table.column("range")[0].as_py()
    rows, at = [], 0
    for part, n in zip(table.column("part").to_pylist(), ns):
        of = place[at : at + n]
        rows.append((part, kind, range_, _pack(fit_all[of]), _pack(tune_all[of]), 0, 0, 0, 0))
        at += n
    known = int((fit_all > 0).sum()), int((fit_all + tune_all > 0).sum())
    rows.append((-1, kind, range_, None, None, int(fit_all.sum()), int(tune_all.sum()), *known))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["part", "kind", "range", "fit", "tune", "n_fit", "n_tune", "v_fit", "v_all"])


def _estimates(texts: pa.Table, answers: pa.Table, begins: int, n: int, v: int, with_tune: bool):
    """Per token: count of the token and of its context, and the two maximum-likelihood estimates; and all lengths."""
    words, flat, pairs = _read(texts)
    found = {}
    order = np.lexsort((answers.column("range").to_numpy(), answers.column("kind").to_numpy()))
    kinds, fit, tune = answers.column("kind").to_pylist(), answers.column("fit"), answers.column("tune")
    for kind, keys in ((_TOKENS, flat), (_PAIRS, pairs)):
        parts = [k for k in order.tolist() if kinds[k] == kind]
        total = np.concatenate([_unpack(fit[k].as_py(), np.uint64) + (_unpack(tune[k].as_py(), np.uint64) if with_tune else np.uint64(0)) for k in parts])
        _, place = np.unique(keys, return_inverse=True)
        found[kind] = total[place].astype(np.float64)
    length = np.array([len(t) for t in words])
    c = found[_TOKENS]
    context = np.concatenate(([begins], c[:-1]))
    context[np.cumsum(length)[:-1]] = begins
    p2 = found[_PAIRS] / np.maximum(context, 1)
    p1 = c / max(n, 1)
    return c, context, p2, p1, length


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.log2(np.maximum(context, 1)).astype(np.int64)), 0)


def _step(p: np.ndarray, uniform: float) -> np.ndarray:
    """Place on the grid of an estimate: 0 for none."""
    return np.where(p > 0, 1 + np.clip(np.floor(np.log2(np.maximum(p, 1e-300) / uniform) / STEP) + STEPS // 4, 0, STEPS - 2).astype(np.int64), 0)


def fitted(cells: list[tuple[int, float, float, float]], uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket, by EM over cells (cell, tokens, sum of p2, sum of p1)."""
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]  # an unseen context has no estimate of its own
    if not cells:
        return weights
    cell, n, s2, s1 = (np.array(x, float) for x in zip(*cells))
    bucket = cell.astype(np.int64) // (STEPS * STEPS)
    p = np.stack([s2 / n, s1 / n, np.full(len(n), uniform)], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        # A little of the start is added, so that no weight of a sparse bucket becomes zero.
        total = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], axis=1) + 0.5 * np.array([0.5, 0.4, 0.1])
        total[0, 0] = 0.0
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def scored(docs: DataFrame, part: int = PART, range_: int = RANGE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts, bits = max(1, ceil(size / part)), max(0, ceil(log2(max(1, size / range_))))
    mod = F.crc32(F.col("doc_id").cast("string")) % 10
    use = F.when(held_out_col(F.col("doc_id"), 10, 0), 0).when(F.coalesce(mod == 1, F.lit(False)), 2).otherwise(1)  # 2: held out for EM
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), use.cast("int").alias("use"))
    # Copies of one row are dealt by where they are read, so they don't all fall to one part; which part counts a row makes
    # no difference to any sum, and rows are stored with their parts, so a part is the same whenever it is read.
    dealt = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    # Rows held out for EM are in parts of their own, so that the EM reads no others.
    rows = rows.withColumn("part", F.when(F.col("use") == 2, F.lit(parts) + F.pmod(dealt, F.lit(max(1, parts // 9)))).otherwise(F.pmod(dealt, F.lit(parts))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            z = pa.array([pack(x.as_py().encode()) for x in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), z, b.column(2), b.column(3)], ["doc_id", "z", "use", "part"])

    rows = stored(mapped(rows, packed, "doc_id long, z binary, use int, part long"), "lm-rows", "none")
    asked = rows.groupBy("part").applyInArrow(_asked(bits), _ASK)
    answers = stored(asked.groupBy("kind", "range").applyInArrow(_answered, _ANSWER), "lm-counts")
    total = answers.where(f"part = -1 and kind = {_TOKENS}").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_fit", "n_tune", "v_fit", "v_all")]).first()
    n_fit, n_all, v_fit, v_all = total[0], total[0] + total[1], total[2], total[3]
    use_of = docs.groupBy(use.alias("use")).count().collect()  # three rows at most
    begins = {r["use"]: r["count"] for r in use_of}
    fit_begins, all_begins = begins.get(1, 0), begins.get(1, 0) + begins.get(2, 0)
    answers = answers.where("part >= 0").select("part", "kind", "range", "fit", "tune")

    def summed(texts: pa.Table, found: pa.Table) -> pa.Table:
        uniform = 1 / (v_fit + 1)
        _, context, p2, p1, _ = _estimates(texts, found, fit_begins, n_fit, v_fit, False)
        cell = (_bucket(context) * STEPS + _step(p2, uniform)) * STEPS + _step(p1, uniform)
        own, place = np.unique(cell, return_inverse=True)
        return pa.table({"cell": own, "n": np.bincount(place).astype(float), "s2": np.bincount(place, p2), "s1": np.bincount(place, p1)})

    slice_ = rows.where("use = 2").groupBy("part").cogroup(answers.where(F.col("part") >= parts).groupBy("part"))
    grid = slice_.applyInArrow(summed, "cell long, n double, s2 double, s1 double")
    cells = grid.groupBy("cell").agg(F.sum("n"), F.sum("s2"), F.sum("s1")).orderBy("cell").collect()  # BUCKETS * STEPS**2 at most
    weights = fitted([tuple(r) for r in cells], 1 / (v_fit + 1))

    def judged(texts: pa.Table, found: pa.Table) -> pa.Table:
        c, context, p2, p1, length = _estimates(texts, found, all_begins, n_all, v_all, True)
        w = weights[_bucket(context)]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v_all + 1)
        begin = np.cumsum(length) - length
        base = np.log10((c + 0.1) / (n_all + 0.1 * (v_all + 1)))
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "held_out": pa.array(np.array(texts.column("use").to_pylist()) == 0),
                "n_tokens": pa.array(length.astype(np.int64)),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), begin)),
                "train_tokens": pa.array(np.full(len(length), n_all, np.int64)),
                "base_score": pa.array(np.add.reduceat(base, begin)),
                "score": pa.array(np.add.reduceat(np.log10(p), begin)),
            }
        )

    both = rows.groupBy("part").cogroup(answers.groupBy("part"))
    return both.applyInArrow(judged, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
