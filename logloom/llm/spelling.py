"""Spelling variants: words within one edit of each other, found by an even-partition pigeonhole join.

Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least LEAST code points and OFTEN
occurrences in all texts. Two are near if one inserted, deleted or replaced code point makes one the other. A word's form is
its near word of largest count, ties to the smallest by code points, if that count is at least TIMES its own; its root is
where following forms ends. Counts grow along forms by that factor, so a chain has at most 27 steps.

A word of length L is indexed by its two even segments, [0, L div 2) and [L div 2, L): one edit leaves one of them whole. Words
of length L probe with their own segments, words of length L + 1 with the first in its place and the second shifted by one.
An index entry so names the stretch still open and what is known to be equal around it; its key is a hash of that.
Keys without two words to compare go. Words of one key are compared; a key of over CROWD words is not compared
but cut again: its open stretch is halved, and one half must be equal too. That ends at a stretch of one code point, where
as many words at most meet as there are letters (and their square of longer ones), so no group is compared whole unless it
is small or its words are near each other. Pairs are verified by edit distance, then made unique, as both segments may find one.

Occurrences are counted per document in the tasks that read them, in tables of at most HELD words that are flushed, then by
one shuffle of words and counts. Nulls: a null text has no words; a null id is an empty text where the id is asked for. Empty
texts have none; long texts are read in slices that cut no run; repeated rows count as often; an empty table gives no rows.
Columns other than those named are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, joined_by, mapped, stored

LEAST, OFTEN, TIMES = 6, 5, 5
#: Words of a key that are compared with each other; words that a task counts before it passes them on; code points of a slice.
CROWD, HELD, SLICE = 256, 200_000, 1 << 20

_LETTERS = "a-zÀ-ÿ"
_NO_LETTER = re.compile(f"[^{_LETTERS}]")


def slipped(doc_id: str, every: int = 199) -> Callable[[str], str]:
    """Misspells words by rule: of those whose crc32 after `<doc_id>:` is a multiple of `every`, one letter goes."""
    before = zlib.crc32(f"{doc_id}:".encode())

    def spelt(word: str) -> str:
        h = zlib.crc32(word.encode(), before)
        if h % every:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return spelt


def _counted(respell, least: int):
    run = re.compile(f"[{_LETTERS}]{{{least},}}")

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                spelt = respell(key or "") if respell else None
                text = (text.as_py() or "").encode().lower().decode()  # bytes: A-Z only
                at = 0
                while at < len(text):
                    cut = _NO_LETTER.search(text, at + SLICE) if len(text) > at + SLICE else None
                    to = cut.start() if cut else len(text)
                    for word, n in Counter(run.findall(text, at, to)).items():
                        word = spelt(word) if spelt else word
                        if len(word) >= least:
                            held[word] += n
                    at = to
                    if len(held) >= HELD:
                        yield batch_of(held)
                        held.clear()
        yield batch_of(held)

    return count


def words(docs: DataFrame, respell: Callable | None = None, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """word and n, its occurrences in all texts. respell(id as text) gives a function that words are read through."""
    read = docs.select(F.col(doc_id).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    found = mapped(read, _counted(respell, least), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _entries(rows: DataFrame, cuts: list[Column]) -> DataFrame:
    """Entries (key, word, n, longer, size, a, b): of a word, or of one that is longer by one, the stretch [a, b) of `size` code
    points is open. rows: word, n, longer, size, and what the cuts, structs of a and b, are made of."""
    rows = rows.withColumn("cut", F.explode(F.array(*cuts))).select("word", "n", "longer", "size", "cut.a", "cut.b")
    known = "xxhash64(size, a, b, substring(word, 1, a), substring(word, b + longer + 1, size))"
    return rows.select(F.expr(known).alias("key"), "word", "n", "longer", "size", "a", "b")


def _halves(a: Column, b: Column) -> list[Column]:
    m = F.floor((a + b) / 2).cast("int")
    return [F.struct(m.alias("a"), b.alias("b")), F.struct(a.alias("a"), m.alias("b"))]


def near_pairs(found: DataFrame) -> DataFrame:
    """Each pair of near words once: s, r, s_n, r_n. found: word (distinct) and n."""
    size = F.char_length("word")
    rows = found.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")).withColumn("size", size - F.col("longer"))
    entries = _entries(rows.where("size > 0"), _halves(F.lit(0), F.col("size")))
    pairs = None
    while True:
        held = stored(entries, "spelling-entries")
        per = held.groupBy("key").agg(F.count("*").alias("n"), F.sum(1 - F.col("longer")).alias("whole"), F.max(F.col("b") - F.col("a")).alias("open"))
        per = per.where("whole > 0 and n > 1").select("key", "n", ((F.col("n") > CROWD) & (F.col("open") > 1)).alias("crowd"))
        per = stored(per, "spelling-keys")
        kept = stored(joined_by(held, per, "key", held.count()), "spelling-kept")
        dropped(held)
        dropped(per)
        few = kept.where("not crowd")
        s = few.where("longer = 0").select("key", F.col("word").alias("s"), F.col("n").alias("s_n"))
        r = few.select("key", F.col("word").alias("r"), F.col("n").alias("r_n"), "longer")
        both = s.join(r, "key").where("(longer = 1 or s < r) and levenshtein(s, r, 1) = 1").select("s", "r", "s_n", "r_n")
        both = stored(both.distinct(), "spelling-pairs")
        pairs = both if pairs is None else pairs.unionByName(both)
        crowds = kept.where("crowd")
        if crowds.isEmpty():
            return pairs.distinct()
        entries = _entries(crowds, _halves(F.col("a"), F.col("b")))


def variants(found: DataFrame, times: int = TIMES) -> DataFrame:
    """Per word its form and root, its count n, n_near near words and its form's count form_n. found: word (distinct) and n."""
    found = stored(found, "spelling-words")
    pairs = near_pairs(found)
    c = F.col
    near = pairs.select(c("s").alias("word"), c("s_n").alias("n"), c("r").alias("other"), c("r_n").alias("other_n"))
    near = near.unionByName(pairs.select(c("r").alias("word"), c("r_n").alias("n"), c("s").alias("other"), c("s_n").alias("other_n")))
    alone = found.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    best = F.min(F.when(c("other").isNotNull(), F.struct((-c("other_n")).alias("m"), c("other").alias("word"))))
    judged = alone.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    much = -c("best.m") >= times * c("n")
    judged = stored(judged.select("word", "n", "n_near", F.when(much, c("best.word")).alias("form"), F.when(much, -c("best.m")).alias("form_n")), "spelling-forms")
    roots = stored(judged.where("form is not null").select("word", c("form").alias("root")), "spelling-roots")
    while True:  # a step doubles how far a pointer reaches
        ahead = roots.select(c("word").alias("root"), c("root").alias("further"))
        moved = stored(roots.join(ahead, "root", "left"), "spelling-roots")
        dropped(roots)
        done = moved.where("further is not null").isEmpty()
        roots = moved.select("word", F.coalesce("further", "root").alias("root"))
        roots._logloom_at = moved._logloom_at
        if done:
            break
    out = judged.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
