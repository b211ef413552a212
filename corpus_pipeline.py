"""From raw documents to a training mix, in five stages over whole texts.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it keeps is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents; the last adds size, source_size, target, copies and
taken to the documents that the mix takes.

1. language: documents whose language can't be told (no text, no letter in it, or a best score under langid.LEAST) go.
2. near_duplicates: of documents that shingles of five words of similarity 0.8 or more link, the one with the least doc_id
   stays. SimHash balls propose pairs, and bands those that balls can't reach.
3. repeated_passages: every byte of a 200-byte string that also starts elsewhere is cut out; documents of which no word
   is left go.
4. benchmark: documents that leak a benchmark item go.
5. mixture: sources are mixed to their target weights; documents without a copy go.

All stages take null ids, texts, languages and sources, long texts, repeated rows, empty tables and columns with clashing
names; see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import decontaminate, langid, mixing, simhash, substrings
from logloom.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("mixture", mixture),
]

#: SQL expresses neither the components of near copies nor the draws of the mix; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage keeps of the documents in sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
