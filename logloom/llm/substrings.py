"""Exact substring dedup: removes every byte covered by a string of `least` bytes that also starts anywhere else.

Texts are whole UTF-8 texts; strings never cross documents. Two equal strings of `least` bytes hold the same winning
GRAM-byte gram (the one with the least hash), at the same distance from their start. So suffixes can be dealt into groups
that are ordered apart from one another:

1. Every start p of a document is put to the gram that wins its string. Runs of starts with one winner make a *context*:
   the bytes from the first start to the end of the last start's string. There is one context per 90 bytes or so.
2. Counts only clear: a context whose gram no other context has holds no repeated string. All else is decided by suffix
   arrays (suffix.py, by linear grouping over Lyndon prefixes), which put equal strings side by side, where neighbours
   are compared byte by byte.
3. Contexts of equal content need one comparison: two of their occurrences, the least and the greatest, are *twins* and
   make one text. What their suffix array finds equal holds for all occurrences (equal gram and equal content hash, of 64
   bits each); twins that turn out to differ stop the job.
4. Contexts that are single, but whose gram has others, are cut into *pieces*: the strings whose distance to the winning
   gram lies in one block of BLOCKS[0] distances. All strings of a block share a core, so equal strings are in pieces with
   equal cores. Pieces are cleared by their cores, and equal ones are twins again. The distinct pieces of each core make
   one text, whose suffix array tells which of their strings are repeated.
5. Repeated spans go back to their documents, which are cut and digested.

A core with over MOST distinct pieces would make one task's text too long (a passage in very many documents, each with
other surroundings). Such groups are split: their pieces are cut into the narrower blocks of BLOCKS[1], whose cores are
longer, and at last into single strings, where core and string are one and only twins are left. So no task needs a crowd
together, no occurrence is dropped, and every group, however split, ends in a suffix array. Copies are merged before every
shuffle; keys that are still hot are joined by broadcast (common.joined_by).

Nulls: a null text is an empty one; a null doc_id is a row like any other. Repeated rows are copies of one another, so
texts of `least` bytes or more lose all of their bytes. Very long texts are looked at in parts of _PART bytes that overlap
by a string, so nothing depends on where a part ends. Ties of gram hashes go to the leftmost gram. Columns of the table
with the names of added ones do no harm: only doc_id and text are read, others come along in `carry`. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructType

from .common import dropped, joined_by, mapped, mixed, stored
from .suffix import _ranges, suffix_arrays

LEAST, GRAM, MOST = 200, 24, 64
#: Distances to the gram per block: at first, for crowded cores, and single strings.
BLOCKS = (88, 16, 1)
#: Bytes of a document that are looked at at once, and symbols that go through one call of suffix_arrays.
_PART, _CALL = 1 << 19, 1 << 19
#: Bytes of a symbol where texts that begin alike are compared as a whole.
_WORD = 8
_TABLE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        for k, base in enumerate((0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64))):
            p = np.full(max(n, _PART + 4096), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def _pack(first, off, many):
    """First start, distance from it to the gram, and number of starts, in one number."""
    return (first << 24) | (off << 12) | many


def _unpack(p):
    return p >> 24, (p >> 12) & 0xFFF, p & 0xFFF


def pieces(s: bytes, p: int, block: int, least: int = LEAST) -> Iterator[tuple[int, int, int, bytes]]:
    """Core, content (both hashed), packed starts and bytes of each piece of a context or piece s at p."""
    first, off, many = _unpack(p)
    i = 0
    while i < many:
        j = (off - i) // block  # distances j * block and up
        last = min(many - 1, off - j * block)
        core = s[off - j * block : off - (j + 1) * block + 1 + least]
        part = s[i : last + least]
        n = last - i + 1
        yield _signed(xxhash.xxh64_intdigest(core, j)), _signed(xxhash.xxh64_intdigest(part, (off - i) << 12 | n)), _pack(first + i, off - i, n), part
        i = last + 1


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def contexts(text: bytes, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each context: the hash of its gram, that of its content, and its starts, packed (see _pack)."""
    out = []
    gram = min(gram, least)
    wide = least - gram + 1  # grams of a string
    for at in range(0, max(0, len(text) - least + 1), _PART):
        raw = np.frombuffer(text, np.uint8, min(len(text) - at, _PART + least - 1), at)
        power, inverse = _powers(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * power, out=total[1:])
        n = len(raw) - gram + 1
        h = mixed((total[gram:] - total[:n]) * inverse[:n])
        # The least hash wins, ties go to the leftmost: its top 40 bits, then its place.
        low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
        span = 1
        while span * 2 <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < wide:
            low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        won = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(won, prepend=-1))
        many = np.diff(np.append(first, len(won)))
        end = first + many - 1 + least
        inner = (total[end] - total[first]) * inverse[first]
        shape = (many.astype(np.uint64) << np.uint64(20)) ^ (won[first] - first).astype(np.uint64)
        out.append((h[won[first]], mixed(inner ^ mixed(shape + np.uint64(1))), _pack(first + at, won[first] - first, many)))
    if not out:
        e = np.zeros(0, np.int64)
        return e.view(np.uint64), e.view(np.uint64), e
    return tuple(np.concatenate(x) for x in zip(*out))


def _marked(symbols, order, length, starts, group, least):
    """Which starts of all texts have a string that another start of their group has. order: suffix order, by group."""
    begin = np.cumsum(length) - length
    at = _ranges(begin, starts)
    is_start = np.zeros(len(symbols), bool)
    is_start[at] = True
    owner = np.repeat(np.arange(len(length)), length)
    order = order[is_start[order]]
    out = np.zeros(len(symbols), bool)
    raw = (symbols - 2).astype(np.uint8)
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(group[owner[a]] == group[owner[b]])
    for k in range(0, least, 8):  # eight bytes at a time, and only the pairs that still agree
        step = min(8, least - k)
        for d in range(step):
            same = same[raw[a[same] + k + d] == raw[b[same] + k + d]]
    out[a[same]] = True
    out[b[same]] = True
    return out[at]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _key() -> Column:
    """With the hash of the text, names what a row holds: rows without an id have the spans of a row 0 with the same text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0))


def _packed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, h (of the text) and z, the compressed text: what a shuffle of texts moves; and the columns of carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = pa.array([pack(x.as_py().encode()) if x.is_valid else None for x in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z, *b.columns[3:]], ["doc_id", "h", "z", *(["carry"] if carry else [])])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = [F.struct(*carry).alias("carry")] if carry else []
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col("text").cast("string").alias("z"), *more)
    schema = cols.schema
    schema["z"].dataType = BinaryType()
    return mapped(cols, run, schema)


def _found(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """i, h, k (gram), c and p (packed starts): one row per context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple] = []
            total = 0

            def rows() -> pa.RecordBatch:
                k = np.repeat([x[0] for x in held], [len(x[1]) for x in held]).astype(np.int64)
                g, c, p = (np.concatenate([x[j] for x in held]) for j in (1, 2, 3))
                return pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(k)), b.column(1).take(pa.array(k)), pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(p)], ["i", "h", "k", "c", "p"]
                )

            for k, x in enumerate(b.column(2)):
                t = x.as_py()
                if not t or len(t := t.encode()) < least:
                    continue
                held.append((k, *contexts(t, least, gram)))
                total += len(held[-1][1])
                if total > 200_000:
                    yield rows()
                    held, total = [], 0
            if held:
                yield rows()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cols = docs.select(_key().alias("i"), F.xxhash64(text).alias("h"), text.alias("text"))
    return mapped(cols, run, "i long, h long, k long, c long, p long")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.binary() if n == "s" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


_PIECES = ["i", "h", "k", "c", "p", "times", "s"]
_PIECES_SCHEMA = "i long, h long, k long, c long, p long, times long, s binary"
_SPANS = "i long, h long, p long"


def _sliced(rows: Iterator[tuple], names: list[str], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows, whose last value are bytes, in batches of about limit bytes."""
    held, size = [], 0
    for x in rows:
        held.append(x)
        size += 64 + len(x[-1])
        if size > limit:
            yield _batch(held, names)
            held, size = [], 0
    if held:
        yield _batch(held, names)


def _cut_out(least: int, block: int):
    """Takes rows (i, h, z, needed contexts); gives twins whole (times 0) and the pieces of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, h, z, needs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                    t = zstandard.decompress(z.as_py()) if z.is_valid else b""
                    for x in needs.as_py():
                        first, _, n = _unpack(x["p"])
                        s = t[first : first + n - 1 + least]
                        if x["times"] == 0:
                            yield i, h, x["k"], x["c"], x["p"], 0, s
                            continue
                        for k, c, p, part in pieces(s, x["p"], block, least):
                            yield i, h, k, c, p, x["times"], part

        yield from _sliced(rows(), _PIECES)

    return run


def _cut_again(least: int, block: int):
    """Takes pieces (i, h, p, times, s); gives narrower ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, h, p, times, s in zip(*(b.column(k).to_pylist() for k in range(5))):
                    for k, c, q, part in pieces(s, p, block, least):
                        yield i, h, k, c, q, times, part

        yield from _sliced(rows(), _PIECES)

    return run


def _batches_of(groups: list[list], limit: int = _CALL) -> Iterator[list[list]]:
    """Groups of byte strings (the last value of each member) in lists of about limit bytes, those of like length together."""
    groups.sort(key=lambda g: sum(len(x[-1]) for x in g))
    call, total = [], 0
    for g in groups:
        call.append(g)
        total += sum(len(x[-1]) + 1 for x in g)
        if total >= limit:
            yield call
            call, total = [], 0
    if call:
        yield call


def _flags(call: list[list], starts: np.ndarray, least: int) -> np.ndarray:
    """For the starts of all strings of all groups (the last value of each member): whether its string recurs in its group."""
    texts = [x[-1] for g in call for x in g]
    length = np.array([len(x) + 1 for x in texts])
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 2
    raw[np.cumsum(length) - 1] = 1  # ends a string; bytes are 2 and up
    sizes = np.array([sum(len(x[-1]) + 1 for x in g) for g in call])
    order, _ = suffix_arrays(np.split(raw, np.cumsum(sizes)[:-1]))
    return _marked(raw, order, length, starts, np.repeat(np.arange(len(call)), [len(g) for g in call]), least)


def _equal(call: list[list]) -> bool:
    """Whether the members of each group (byte strings, the last value of each) are all equal.

    Twins begin at the same distance from their gram, so their texts are read as words of _WORD bytes, whose suffix array is
    that much shorter; a whole text equals another exactly if the two are neighbours in suffix order and agree.
    """
    texts = [x[-1] for g in call for x in g]
    size = np.array([-(-len(t) // _WORD) for t in texts])
    words = np.frombuffer(b"".join(t.ljust(n * _WORD, b"\0") for t, n in zip(texts, size.tolist())), np.uint64)
    many = np.array([len(g) for g in call])
    group = np.repeat(np.repeat(np.arange(len(call)), many), size)
    by = np.lexsort((words, group))
    new = np.diff(group[by], prepend=-1) != 0
    step = np.cumsum(new | np.concatenate(([True], words[by][1:] != words[by][:-1])))
    symbols = np.ones(len(words) + len(texts), np.int64)  # 1 ends a text
    begin = np.cumsum(size + 1) - (size + 1)
    at = _ranges(begin, size)
    symbols[at[by]] = step - np.repeat(step[new], np.diff(np.append(np.flatnonzero(new), len(by)))) + 2
    first = np.cumsum(many) - many
    cuts = np.append(begin, len(symbols))[np.cumsum(many)]
    order, _ = suffix_arrays(np.split(symbols, cuts[:-1]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    place = place[begin]
    for a, n in zip(first.tolist(), many.tolist()):
        row = sorted(range(a, a + n), key=place.__getitem__)
        if any(place[y] - place[x] != 1 or texts[x] != texts[y] for x, y in zip(row, row[1:])):
            return False
    return True


def _twins(least: int):
    """Takes (k, c, p, s) sorted by k and c; gives k and c of the contents whose twins are equal."""

    def judged(held: list[list]) -> pa.RecordBatch:
        for call in _batches_of(held, _CALL * _WORD):
            if not _equal(call):
                raise ValueError("two contents have equal hashes")
        return _batch([(g[0][0], g[0][1]) for g in held], ["k", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, size = [], [], 0
        for b in batches:
            for x in zip(*(b.column(i).to_pylist() for i in range(4))):
                if now and x[:2] != now[0][:2]:
                    held.append(now)
                    now = []
                    if size > 8 << 20:
                        yield judged(held)
                        held, size = [], 0
                now.append(x)
                size += len(x[3])
        if now:
            held.append(now)
        if held:
            yield judged(held)

    return run


def _by_suffix_array(least: int):
    """Takes pieces (k, i, h, p, times, s) sorted by core; gives the repeated spans (packed starts) of open ones."""

    def judged(groups: list[list[tuple]]) -> list[tuple]:
        out = []
        for call in _batches_of(groups):
            flat = [x for g in call for x in g]
            starts = np.array([_unpack(x[2])[2] for x in flat])
            flags = _flags(call, starts, least)
            ends = np.cumsum(starts)
            for (i, h, p, times, _), a, b in zip(flat, ends - starts, ends):
                if times == 1 and flags[a:b].any():  # those that occur more often are known to be repeated
                    first = _unpack(p)[0]
                    out += [(i, h, _pack(first + x, 0, y - x)) for x, y in _runs(flags[a:b])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, key, size = [], [], None, 0
        for b in batches:
            for k, *x in zip(*(b.column(i).to_pylist() for i in range(6))):
                if k != key:
                    if len(now) > 1:
                        held.append(now)
                    if size > 8 << 20:
                        if out := judged(held):
                            yield _batch(out, ["i", "h", "p"])
                        held, size = [], 0
                    now, key = [], k
                now.append(x)
                size += len(x[4])
        if len(now) > 1:
            held.append(now)
        if held and (out := judged(held)):
            yield _batch(out, ["i", "h", "p"])

    return run


def _met(rows: DataFrame) -> DataFrame:
    """The rows (k, c, times, ...) that counts don't clear, with twin (whether its content has others, one of which is
    open), closer (whether single contents stand beside others under the key) and many (contents of the key).

    Only keys and numbers are counted; a row with times over 1 stands for rows that are known to be repeated."""
    by_content = stored(rows.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("all"), F.min("times").alias("open")), "spans-contents")
    by_key = by_content.groupBy("k").agg(F.count(F.lit(1)).alias("many"), F.max("all").alias("most"), F.min("all").alias("fewest"))
    by_key = stored(by_key.where("many > 1 or most > 1").select("k", "many", ((F.col("many") > 1) & (F.col("fewest") == 1)).alias("closer"), F.col("many").alias("n")), "spans-keys")
    contents = joined_by(by_content.select("k", "c", F.col("n").alias("rows"), "open"), by_key, "k", by_content.count())
    twin = (F.col("rows") > 1) & (F.col("open") == 1)
    contents = stored(contents.where(twin | F.col("closer")).select("k", "c", F.col("rows").alias("n"), twin.alias("twin"), "closer", "many"), "spans-status")
    return joined_by(rows, contents, ["k", "c"], rows.count())


def _witnesses(met: DataFrame) -> DataFrame:
    """k, c, many, twin, closer, first and last: the least and the greatest (i, h, p) of each content."""
    one = F.struct("i", "h", "p", "times")
    return met.groupBy("k", "c", "many", "twin", "closer").agg(F.min(one).alias("first"), F.max(one).alias("last"), F.sum("times").alias("all"))


def _repeated(met: DataFrame, twins: DataFrame, least: int) -> DataFrame:
    """i, h and p of the open rows whose content the twins' suffix arrays found to be repeated. twins: k, c, p, s."""
    found = mapped(twins.repartition("k", "c").sortWithinPartitions("k", "c"), _twins(least), "k long, c long")
    per = met.where("twin").groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"))
    found = stored(found.join(per, ["k", "c"]), "spans-twins")
    return joined_by(met.where("twin and times = 1").select("i", "h", "p", "k", "c"), found, ["k", "c"], met.count()).select("i", "h", "p")


def spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, most: int = MOST, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """i, h, p: runs of starts (packed) whose strings of `least` bytes also start elsewhere."""
    if not 0 < least < 4096 or blocks[-1] != 1:
        raise ValueError("least is 1 to 4095, and the last block 1")
    blocks = [min(b, (least + 1) // 2) for b in blocks]  # the strings of a block must share a core
    found = stored(_found(docs, least, gram), "spans-found", "zstd")
    met = stored(_met(found.withColumn("times", F.lit(1))), "spans-met", "zstd")
    dropped(found)
    seen = _witnesses(met)
    # Twins are asked for whole (times 0), one occurrence of every content of a key that needs a closer look in pieces.
    asked = F.concat(
        F.when(F.col("twin"), F.array(F.struct("first", F.lit(0).cast("long").alias("times")), F.struct(F.col("last").alias("first"), F.lit(0).cast("long").alias("times")))).otherwise(F.array()),
        F.when(F.col("closer"), F.array(F.struct("first", F.col("all").alias("times")))).otherwise(F.array()),
    )
    needs = seen.select("k", "c", F.explode(asked).alias("x")).groupBy("x.first.i", "x.first.h").agg(F.collect_list(F.struct("k", "c", "x.first.p", "x.times")).alias("needs"))
    texts = _packed(docs).select(_key().alias("i"), "h", "z").groupBy("i", "h").agg(F.first("z").alias("z"))
    cut = stored(mapped(texts.join(needs, ["i", "h"]).select("i", "h", "z", "needs"), _cut_out(least, blocks[0]), _PIECES_SCHEMA), "spans-cut", "zstd")
    out = [_repeated(met, cut.where("times = 0").select("k", "c", "p", "s"), least)]
    cut = cut.where("times > 0")
    for block in (*blocks[1:], None):
        met = stored(_met(cut.drop("s")), "spans-met", "zstd")
        seen = stored(_witnesses(met), "spans-witnesses")
        role = F.concat(F.when(F.col("twin"), F.array(F.struct("first", F.lit(0).alias("role")), F.struct(F.col("last").alias("first"), F.lit(0).alias("role")))).otherwise(F.array()), F.when(F.col("closer"), F.array(F.struct("first", F.lit(1).alias("role")))).otherwise(F.array()))
        wanted = seen.select("k", "c", "many", F.explode(role).alias("x")).select("k", "c", "many", "x.first.i", "x.first.h", "x.first.p", "x.role")
        held = stored(cut.join(wanted, ["k", "c", "i", "h", "p"]).select("i", "h", "k", "c", "p", "times", "s", "many", "role"), "spans-held", "zstd")
        out.append(_repeated(met, held.where("role = 0").select("k", "c", "p", "s"), least))
        few = held.where(F.col("many") <= most) if block else held  # single strings have nothing beside them
        few = few.where("role = 1").select("k", "i", "h", "p", "times", "s")
        out.append(mapped(few.repartition("k").sortWithinPartitions("k"), _by_suffix_array(least), _SPANS))
        if block is None:
            break
        cut = stored(mapped(held.where((F.col("many") > most) & (F.col("role") == 1)).select("i", "h", "p", "times", "s"), _cut_again(least, block), _PIECES_SCHEMA), "spans-cut", "zstd")
    return reduce(DataFrame.unionByName, out)


def _covered(spans_: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start in the spans."""
    first = np.sort(spans_)
    a, n = first >> 24, first & 0xFFF
    end = np.maximum.accumulate(a + n - 1 + least)
    new = np.flatnonzero(np.concatenate(([True], a[1:] > end[:-1])))
    return list(zip(a[new].tolist(), end[np.append(new[1:] - 1, len(a) - 1)].tolist()))


def removed(docs: DataFrame, least: int = LEAST, gram: int = GRAM, most: int = MOST, carry: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of start, end) for each row of docs.

    carry names columns of docs that come along in a struct `carry`. keep_text adds kept, the remaining bytes as text (null for a null text);
    bytes of characters that were cut in two are left out of it.
    """
    at = stored(spans(docs, least, gram, most), "spans")
    per = at.groupBy("i", "h").agg(F.collect_list("p").alias("p"))
    d, s = _packed(docs, carry).withColumn("i", _key()).alias("d"), per.alias("s")
    same = (F.col("d.i") == F.col("s.i")) & (F.col("d.h") == F.col("s.h"))
    joined = d.join(s, same, "left").select("d.doc_id", "d.z", "s.p", *(["d.carry"] if carry else []))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if keep_text else []), *(["carry"] if carry else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for z, p in zip(b.column(1), b.column(2)):
                t = zstandard.decompress(z.as_py()) if z.is_valid else b""
                found = _covered(p.values.to_numpy(zero_copy_only=False), least) if p.is_valid and len(p) else []
                parts, last = [], 0
                for i, j in found:
                    parts.append(t[last:i])
                    last = j
                kept = b"".join([*parts, t[last:]])
                rows.append((len(t), len(t) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), [{"start": i, "end": j} for i, j in found], kept.decode("utf-8", "ignore") if keep_text and z.is_valid else None))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), spans_type, pa.string()][: 6 if keep_text else 5]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds)), *b.columns[3:]], names)

    schema = StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    schema = schema.add("spans", ArrayType(StructType().add("start", "long").add("end", "long")))
    if keep_text:
        schema = schema.add("kept", "string")
    if carry:
        schema = schema.add("carry", docs.select(F.struct(*carry).alias("carry")).schema["carry"].dataType)
    return mapped(joined, run, schema)


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs with repeated strings cut out of text and n_chars (if there is one) set anew; rows of which no
    word is left are dropped, those that had none before stay."""
    others = tuple(c for c in docs.columns if c != "text")
    cut = removed(docs, least, carry=others, keep_text=True)
    left = (F.col("n_removed") == 0) | (F.trim(F.translate("kept", "\t\n\x0b\x0c\r", " ")) != "")
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") == 0, F.col("carry.n_chars")).otherwise(F.length("kept")) if "n_chars" in docs.columns else None}
    kinds = dict(docs.dtypes)
    return cut.where(left).select(*[(new[c] if c in new else F.col("carry").getField(c)).cast(kinds[c]).alias(c) for c in docs.columns])
