"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs of characters other than space and U+0009 to U+000D. The measures of a text:

n_words, word_chars (code points in words), n_symbols (characters of `#*$%&|<>`), n_dup_lines (lines between newlines,
with a word, that equal an earlier line), n_repeat_words (words in windows of WINDOW words that the text has twice or
more, first included), n_lines (lines with a word), n_stop (words of STOP_WORDS, in lower case and without the punctuation
in them).

A null text has no words. The base rules fail texts of fewer than 20 words or with over 30 % repeated words; the verdict
also asks that every ratio of RULES lies within its bounds; a ratio on its bound passes. Repeated rows get the same row twice;
an empty table gives an empty result. Long texts are measured whole. Only doc_id and text are read, so other columns do no
harm. Windows are compared by 64-bit hashes; only texts in which a hash recurs sort their windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_col

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages in the corpus.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this at from or an "
    "le la les de des du et en un une que qui dans pour par sur au avec est pas "
    "der die das und von zu mit den ein eine ist nicht als auf sich auch im dem "
    "el los las del que y en un una por con para se al es lo como su"
).split()
#: (name, numerator, denominator, least, most): ratios that a kept text has, None for no bound.
RULES = (
    ("word_length", "word_chars", "n_words", 1.5, 25.0),
    ("symbols", "n_symbols", "n_words", None, 0.10),
    ("dup_lines", "n_dup_lines", "n_lines", None, 0.30),
    ("stop_words", "n_stop", "n_words", 0.02, None),
)


def _let(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by the windows of WINDOW words that occur twice or more."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.zip_with(hashes, F.sequence(F.lit(1), F.size(hashes)), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            at = F.filter(
                F.transform(s, lambda x, k: F.when(((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()
            )
            ordered = F.sort_array(at)
            # Each window adds its words up to where the next one starts.
            return F.aggregate(
                ordered,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.alias("last")),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(pairs, again))

    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(_let(hashes, covered))


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    punctuation = ".,;:!?\"'()"

    def of(words: Column) -> Column:
        return _let(
            lines,
            lambda at: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(at) - F.size(F.array_distinct(at))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).alias("n_repeat_words"),
                F.size(at).cast("long").alias("n_lines"),
                F.size(F.filter(words, lambda w: F.lower(F.translate(w, punctuation, "")).isin(STOP_WORDS))).cast("long").alias("n_stop"),
            ),
        )

    return _let(words_col(text), of)


def verdict(rules=RULES) -> Column:
    """Whether the columns n_words, ... are within the bounds of every rule."""
    tests = []
    for _, a, b, least, most in rules:
        if least is not None:
            tests.append(F.col(a) >= F.lit(float(least)) * F.col(b))
        if most is not None:
            tests.append(F.col(a) <= F.lit(float(most)) * F.col(b))
    return reduce(Column.__and__, tests, F.lit(True))


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for each row of docs, in one projection and without a shuffle."""
    m = docs.select("doc_id", measures(F.col("text").cast("string")).alias("m")).select("doc_id", "m.*")
    m = m.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return m.withColumn("kept", ~F.col("base_failed") & verdict(rules))
