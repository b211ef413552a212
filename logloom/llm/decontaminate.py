"""Benchmark decontamination by template canonicalisation.

Words (between ASCII white space, without punctuation at their ends, in lower case) become tokens: numbers, names
(capitalised inside a sentence, or a common given name) and units (a unit word after a number) become typed placeholders,
other words stand for themselves. Windows of WIDTH tokens of the benchmark items are hashed and hash-joined with those of
the documents, so a question with other numbers or names still meets its template. Then slots are checked: along one
alignment of a document with an item, each value that fills a slot of the item must always meet the same value in the
document. Alignments that fail are no match. A document leaks an item if the windows of its consistent alignments cover
at least COVERAGE of the item's tokens.

Windows in which few words stand for themselves say little: of an item, those with LITERALS such words are used, or, while
they can't cover COVERAGE of it, those with one fewer, down to one. The first word of an item is hashed in each reading
that it can have inside a document: as itself, a name or a unit. Besides, the words as they are, without placeholders, are
windows of their own, so a verbatim copy is found however many slots it has. An item of fewer than WIDTH tokens is one
window of its own width. Document windows pass a bitmap of fixed size before they are joined; it only
saves work, whatever the number of items, and the join decides. The join with the items' windows is an ordinary equi-join
(broadcast only if the planner finds that side small, else shuffled, with skew split).

Nulls: a null text has no words and neither leaks nor is leaked; null ids are kept as they are. Repeated rows of
documents give their result once, repeated items one row per item id. Ties don't arise: every alignment is judged by itself.
Long texts are windowed whole, a slice of texts at a time. Only ids and texts are read, so other columns do no harm, and
clean() gives the columns that it got. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, mapped, mixed, stored, texts_of

WIDTH, LITERALS, COVERAGE = 8, 4, 0.5
#: Bits of the bitmap that document windows pass.
BITMAP = 1 << 24
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NUMBER = re.compile(rb"[+-]?[$]?\d[\d.,:/%-]*(?:[a-z]{1,3})?")
#: Number words, given names and units that become placeholders.
NUMBER_WORDS = set(b"two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
NAMES = set(b"alice bob carol dave eve john mary james anna peter paul maria tom emma lucas sara david laura marie pierre hans klaus jose juan carlos ana".split())
UNITS = set(b"km m cm mm mile miles kg g mg lb lbs ton tons l ml s ms sec seconds minute minutes min h hour hours day days week weeks year years dollars euros cents percent degrees meters metres kilometers grams liters litres apples".split())
_CAPITAL, _NUM, _UNIT, _END, _NAME = 1, 2, 4, 8, 16
_RAW = np.uint64(0xC2B2AE3D27D4EB4F)
_SLOT = {_NUM: np.uint64(0xA24BAED4963EE407), _UNIT: np.uint64(0x9FB21C651E98DF25), _NAME: np.uint64(0xD1342543DE82EF95)}


class _Words(dict):
    """Word -> number; what is known of each word is in feats."""

    def __init__(self) -> None:
        self.feats: list[tuple[int, int]] = []

    def __missing__(self, word: bytes) -> int:
        import xxhash

        bare = word.strip(_PUNCTUATION)
        if not bare:
            self[word] = -1
            return -1
        low = bare.decode("utf-8", "replace").lower().encode()
        flags = 0
        if low in NUMBER_WORDS or _NUMBER.fullmatch(low):
            flags |= _NUM
        elif low in UNITS:
            flags |= _UNIT
        elif bare[:1].isupper() or (bare[0] > 127 and bare.decode("utf-8", "replace")[:1].isupper()):
            flags |= _CAPITAL
        if low in NAMES and not flags & _NUM:
            flags |= _NAME
        if word.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b":"):
            flags |= _END
        self[word] = n = len(self.feats)
        self.feats.append((xxhash.xxh64_intdigest(low, 7), flags))
        return n


def tokens(texts: list[bytes], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts one after another: code of each token, its own value, whether it is a slot, the text it is in, and flags."""
    each = []
    for t in texts:
        w = t.split()
        k = np.fromiter(map(words.__getitem__, w), np.int64, len(w))
        each.append(k[k >= 0])
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in each])
    if not len(owner):
        e = np.zeros(0, np.uint64)
        return e, e, e.astype(bool), owner, e.astype(np.uint8)
    of = np.concatenate(each)
    value = np.array([x[0] for x in words.feats], np.uint64)[of]
    flags = np.array([x[1] for x in words.feats], np.uint8)[of]
    first = np.diff(owner, prepend=-1) != 0
    after_end = np.concatenate(([True], flags[:-1] & _END > 0)) | first
    number = flags & _NUM > 0
    unit = (flags & _UNIT > 0) & np.concatenate(([False], number[:-1])) & ~first
    name = ((flags & _CAPITAL > 0) & ~after_end | (flags & _NAME > 0)) & ~unit
    code = np.select([number, unit, name], [_SLOT[_NUM], _SLOT[_UNIT], _SLOT[_NAME]], value)
    return code, value, number | unit | name, owner, flags


def windows(code: np.ndarray, slot: np.ndarray, owner: np.ndarray, width: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the usable windows begin and their hashes."""
    n = len(code) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : k + n]
    plain = np.concatenate(([0], np.cumsum(~slot)))
    ok = (owner[:n] == owner[width - 1 :]) & (plain[width:] - plain[:n] >= literals)
    at = np.flatnonzero(ok)
    return at, mixed(h[at] ^ np.uint64(width))


def _telling(at: np.ndarray, plain: np.ndarray, width: int, literals: int, least: float) -> np.ndarray:
    """Which windows of an item are used: those with enough plain words, as many as lets them cover at least `least` tokens."""
    for enough in range(min(literals, width), 1, -1):
        ok = plain >= enough
        if ok.any() and width + np.minimum(np.diff(at[ok]), width).sum() >= least:
            return ok
    return plain >= min(1, literals)


_ROW = "key {0}, h long, n long, at long, w long, raw boolean, slots array<struct<i:int,v:long>>"


def _windowed(rows: DataFrame, key: str, widths: list[int] | None, bitmap, literals: int, coverage: float) -> DataFrame:
    """key, h, n (tokens), at, w (hash), raw (of words without placeholders) and slots of the windows; items (no widths) get
    windows of their own width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        bits = bitmap.value if bitmap is not None else None
        for b in batches:
            base = 0
            for some in in_slices(list(texts_of(b.column(2))), 1 << 21):
                if len(words) > 300_000:
                    words = _Words()
                code, value, slot, owner, flags = tokens(some, words)
                begin = np.searchsorted(owner, np.arange(len(some) + 1))
                out = []

                def add(at: np.ndarray, w: np.ndarray, width: int, raw: bool, slot: np.ndarray = slot) -> None:
                    for p, x in zip(at.tolist(), w.view(np.int64).tolist()):
                        o = owner[p]
                        filled = [{"i": i, "v": int(value[p + i].view(np.int64))} for i in range(width) if slot[p + i]]
                        out.append((base + int(o), int(begin[o + 1] - begin[o]), p - int(begin[o]), x, raw, filled))

                for width in widths or range(1, WIDTH + 1):
                    at, w = windows(code, slot, owner, width, min(1, literals))
                    raw_at, raw = windows(value, slot, owner, width, 0)
                    raw = raw ^ _RAW
                    if bits is not None:
                        for a, x, is_raw in ((at, w, False), (raw_at, raw, True)):
                            k = x & np.uint64(BITMAP - 1)
                            hit = bits[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8) & 1 > 0
                            add(a[hit], x[hit], width, is_raw)
                        continue
                    short = np.minimum(np.diff(begin), WIDTH) == width
                    add(raw_at[short[owner[raw_at]]], raw[short[owner[raw_at]]], width, True)
                    readings = [(code, slot)]
                    head = begin[:-1][short]
                    for flag, kind in ((_CAPITAL, _NAME), (_UNIT, _UNIT)):
                        other = head[(flags[head] & flag > 0) & ~slot[head]]
                        if len(other):
                            readings.append((code.copy(), slot.copy()))
                            readings[-1][0][other], readings[-1][1][other] = _SLOT[kind], True
                    plain = np.concatenate(([0], np.cumsum(~slot)))
                    for k, (a_code, a_slot) in enumerate(readings):
                        at, w = windows(a_code, a_slot, owner, width, min(1, literals))
                        for o in np.flatnonzero(short):
                            own = slice(*np.searchsorted(at, begin[o : o + 2]))
                            p = at[own]
                            use = _telling(p, plain[p + width] - plain[p], width, literals, coverage * (begin[o + 1] - begin[o]))
                            if k:
                                use &= (p == begin[o]) & (a_slot[p] != slot[p])
                            add(p[use], w[own][use], width, False, a_slot)
                for i in range(0, len(out), 50_000):
                    k, n, p, w, raw, s = zip(*out[i : i + 50_000])
                    take = pa.array(k)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(take), b.column(1).take(take), pa.array(n, pa.int64()), pa.array(p, pa.int64()), pa.array(w, pa.int64()), pa.array(raw, pa.bool_()), pa.array(s, pa.list_(pa.struct([("i", pa.int32()), ("v", pa.int64())])))],
                        ["key", "h", "n", "at", "w", "raw", "slots"],
                    )
                base += len(some)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return mapped(rows.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("h"), text.alias("text")), run, _ROW.format("long"))


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, literals: int = LITERALS) -> DataFrame:
    """One row per document and item that it leaks: doc_id, h (xxhash64 of the text), item_id, coverage, n_windows and
    reparameterised (whether a slot is filled otherwise than in the item). docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    known = stored(_windowed(items.where(F.col("text").isNotNull()), "item_id", None, None, literals, coverage), "decon-items")
    widths = sorted(r[0] for r in known.select(F.least("n", F.lit(WIDTH)).cast("int")).distinct().collect())  # 1 to WIDTH
    cells = known.selectExpr(f"pmod(w, {BITMAP}) div 64 as cell", "shiftleft(1L, cast(pmod(w, 64) as int)) as bit")
    cells = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect()  # BITMAP / 64 rows at most
    bits = np.zeros(BITMAP // 64, np.int64)
    if cells:
        bits[[r.cell for r in cells]] = [r.bits for r in cells]
    bitmap = spark.sparkContext.broadcast(bits.view(np.uint8))
    seen = _windowed(docs.where(F.col("text").isNotNull()), "doc_id", widths or [WIDTH], bitmap, literals, coverage)
    d = seen.select(F.col("key").alias("doc_id"), "h", F.col("at").alias("d_at"), "w", F.col("slots").alias("d_slots"))
    i = known.select(F.col("key").alias("item_id"), F.col("h").alias("i_h"), F.col("n").alias("i_n"), F.col("at").alias("i_at"), "w", "raw", F.col("slots").alias("i_slots"))
    met = stored(d.join(i, "w").withColumn("line", F.col("d_at") - F.col("i_at")), "decon-met")
    line = ["doc_id", "h", "item_id", "i_h", "line"]
    # Where the words themselves met, each value met itself, whatever counts as a slot in the document.
    filled = F.when(F.col("raw"), F.col("i_slots")).otherwise(F.col("d_slots"))
    pairs = met.select(*line, F.explode_outer(F.zip_with("i_slots", filled, lambda a, b: F.struct(a["v"].alias("i"), b["v"].alias("d")))).alias("s"))
    values = pairs.groupBy(*line, "s.i").agg(F.min("s.d").alias("least"), F.max("s.d").alias("most"))
    lines = values.groupBy(*line).agg(F.max(F.coalesce(F.col("least") != F.col("most"), F.lit(False))).alias("mixed"), F.max(F.coalesce(F.col("i") != F.col("least"), F.lit(False))).alias("other"))
    good = lines.where("not mixed").select(*[F.col(c).alias(f"_{c}") for c in line], "other")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in line]
    at = met.join(good, same).groupBy("doc_id", "h", "item_id", "i_h").agg(F.first("i_n").alias("n"), F.max("other").alias("reparameterised"), F.sort_array(F.collect_set("i_at")).alias("at"))
    width = F.least("n", F.lit(WIDTH))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("c"), F.lit(-WIDTH).cast("long").alias("last")),
        lambda a, x: F.struct((a["c"] + F.least(width, x - a["last"])).cast("long").alias("c"), x.alias("last")),
        lambda a: a["c"],
    )
    out = at.select("doc_id", "h", "item_id", (covered / F.col("n")).alias("coverage"), F.size("at").alias("n_windows"), "reparameterised")
    return out.where(F.col("coverage") >= coverage)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that leak no item."""
    bad = stored(leaks(docs, items).select(F.col("doc_id").alias("id"), "h").distinct(), "decon-bad")
    h = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["id"]) & (h == bad["h"]), "left_anti")
