"""Findings across files: clusters by nearness, duplicates, roll-ups by analyzer and file, the timeline.

A finding has ord (its place in the input), source_file, category, kind, level, signature, count, first_line, timestamp,
sample, root_cause; the order of the input decides ties, so it is part of every aggregate here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import positioned

#: The weight of levels, the levels that a distribution always shows, kinds that are named first.
WEIGHT = {"CRITICAL": 4, "ERROR": 3, "WARN": 2, "INFO": 1}
TOP_KINDS = 5


def weight(level: Column) -> Column:
    out = F.lit(0)
    for name, w in WEIGHT.items():
        out = F.when(level == name, w).otherwise(out)
    return out


def _bucketed(findings: DataFrame, distance: int) -> DataFrame:
    return findings.withColumns({"file_": F.coalesce("source_file", F.lit("unknown")), "category_": F.coalesce("category", F.lit("unknown")), "bucket": F.floor(F.coalesce("first_line", F.lit(0)) / max(1, distance))})


def clustered(findings: DataFrame, distance: int = 300) -> DataFrame:
    """One row per file, category and stretch of `distance` lines: counts add up, the gravest level and the earliest line
    and timestamp stand for all. A finding alone keeps its own words. ord is that of the first member, by which
    cluster_members names the cluster; a row holds no list, so a cluster may be of any size."""
    f = _bucketed(findings, distance)
    first = lambda c: F.min_by(c, "ord").alias(c)
    grave = F.struct(weight(F.col("level")).alias("w"), -F.col("ord"))
    sampled = F.when(F.coalesce("sample", F.lit("")) != "", F.struct(weight(F.col("level")).alias("w"), -F.col("ord")))
    agg = f.groupBy("file_", "category_", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("count").alias("count"),
        F.max_by("level", grave).alias("level"),
        F.min("first_line").alias("first_line"),
        F.min("timestamp").alias("timestamp"),
        F.max(F.struct(sampled.alias("k"), F.col("sample").alias("v"))).alias("s"),
        first("kind"),
        first("signature"),
        first("root_cause"),
        first("ord"),
    )
    named = F.concat(F.initcap(F.translate("category_", "_", " ")), F.lit(" incident ("), F.col("n").cast("string"), F.lit(" variations, "), F.col("count").cast("string"), F.lit(" events)"))
    sample = F.when((F.col("s.k.w") == weight(F.col("level"))) | (F.col("n") == 1), F.col("s.v"))
    return agg.select(
        "ord", F.col("file_").alias("source_file"), F.col("category_").alias("category"), "kind", "level", F.when(F.col("n") == 1, F.col("signature")).otherwise(named).alias("signature"), F.col("count").cast("long").alias("count"), "first_line", "timestamp", sample.alias("sample"), "root_cause", F.col("n").alias("members")
    )


def cluster_members(findings: DataFrame, distance: int = 300) -> DataFrame:
    """cluster (the ord of its first member) and the ord, kind, count, level and sample of each finding in it.

    The stretches' first members are counted and joined back, so a large cluster's rows are never gathered.
    """
    f = _bucketed(findings, distance)
    key = ["file_", "category_", "bucket"]
    first = f.groupBy(*key).agg(F.min("ord").alias("cluster"))
    return f.join(first, key).select("cluster", "ord", "kind", "count", "level", "sample")


def by_signature(findings: DataFrame) -> DataFrame:
    """One row per signature: counts add up, the gravest level stays."""
    return findings.groupBy(F.coalesce("signature", F.lit("unknown")).alias("signature")).agg(F.sum("count").cast("long").alias("count"), F.max_by("level", F.struct(weight(F.col("level")), -F.col("ord"))).alias("level"), F.min("ord").alias("ord"))


def by_root_cause(findings: DataFrame) -> DataFrame:
    """Per root cause its findings' signatures in order; those without one under unknown."""
    key = F.coalesce("root_cause", F.lit("unknown")).alias("root_cause")
    agg = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ord", "signature"))).alias("f"))
    return agg.select("root_cause", "n", F.transform("f", lambda x: x["signature"]).alias("signatures"))


def cause_members(findings: DataFrame) -> DataFrame:
    """root_cause, ord, signature of each finding, for causes with more findings than a row should list; and n, their number."""
    f = findings.select(F.coalesce("root_cause", F.lit("unknown")).alias("root_cause"), "ord", "signature")
    return f.join(f.groupBy("root_cause").agg(F.count(F.lit(1)).alias("n")), "root_cause")


def severities(findings: DataFrame, by: str = "category") -> DataFrame:
    """Per value of `by` the number of findings of each level, zeros included."""
    level = F.coalesce("level", F.lit("INFO"))
    return findings.groupBy(by).agg(*[F.count_if(level == name).alias(name) for name in WEIGHT], F.count(F.lit(1)).alias("finding_count"))


def top_kinds(findings: DataFrame, limit: int = TOP_KINDS) -> DataFrame:
    """category, kind, n, position: the most frequent kinds of each category, first seen first among equals."""
    agg = findings.groupBy("category", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    w = Window.partitionBy("category").orderBy(F.desc("n"), "first")
    return agg.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).drop("first")


def per_file(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, line_count, incident_count, analyzers_active."""
    n = lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("line_count"))
    f = findings.groupBy(F.col("source_file").alias("file_id")).agg(F.count(F.lit(1)).alias("incident_count"), F.sort_array(F.collect_set("category")).alias("analyzers_active"))
    return n.join(f, "file_id", "left").select("file_id", "line_count", F.coalesce("incident_count", F.lit(0)).cast("long").alias("incident_count"), F.coalesce("analyzers_active", F.array().cast("array<string>")).alias("analyzers_active"))


def timeline(findings: DataFrame) -> DataFrame:
    """Findings in time: by timestamp, those without one after; if none has one, by file and line, and the order across
    files is unknown."""
    facts = findings.agg(F.count("timestamp").alias("stamped"), F.count_distinct("source_file").alias("files"))  # one row
    f = findings.crossJoin(F.broadcast(facts))
    order = F.when(F.col("stamped") > 0, F.struct(F.col("timestamp").isNull().alias("a"), F.coalesce("timestamp", F.lit("")).alias("b"), F.lit(0).alias("c"), F.col("ord").alias("d"))).otherwise(
        F.struct(F.lit(False).alias("a"), F.coalesce("source_file", F.lit("")).alias("b"), F.coalesce("first_line", F.lit(0)).alias("c"), F.col("ord").alias("d"))
    )
    known = F.when((F.col("stamped") == 0) & (F.col("files") > 1), "UNKNOWN").otherwise("WITHIN_FILE")
    rows = f.select("source_file", F.col("first_line").alias("sequence"), "category", "kind", "level", "signature", "count", F.coalesce("timestamp", F.lit("UNKNOWN")).alias("timestamp"), known.alias("cross_file_order"), order.alias("order"))
    return rows.orderBy("order")


def numbered_timeline(findings: DataFrame) -> DataFrame:
    """The timeline with position, each row's place from 1, counted by ranges."""
    return positioned(timeline(findings), ["order"], "position")
