"""What a log scan counts per line: levels, vendor and auxiliary codes, notable lines with their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R
from .events import FINDING_RANK, rank

#: How many notable lines of each level are listed, how far back context goes and how much of it counts.
QUOTA = {"FATAL": 200, "CRITICAL": 100, "SEVERE": 100, "ERROR": 5}
LOOK_BACK, CONTEXT = 40, 8
#: Codes whose details are kept, codes and auxiliary codes that are listed, codes that are reported.
CODE_STORE, CODE_LIST, AUX_LIST, CODE_REPORT, EXAMPLE = 2000, 500, 50, 40, 240


def source_level(rec: Column, line: Column) -> Column:
    """The level a line states itself: as a record, else as `level:`."""
    return F.coalesce(rec["level"], R.colon_level(line, rec))


def level_counts(lines: DataFrame, rule_level: Column | None = None) -> DataFrame:
    """file_id, level, n; a line without a level of its own counts under rule_level, a column of lines, if given."""
    rows = R.with_record(lines)
    level = source_level(F.col("rec"), F.col("line"))
    if rule_level is not None:
        # Generated, not projected: what follows would else repeat the rules inside itself.
        rows = rows.withColumn("_rule", F.explode(F.array(F.when(F.col("rec.level").isNull(), rule_level))))
        level = F.coalesce(level, R.normal_level(F.col("_rule")))
    return rows.select("file_id", level.alias("level")).where("level is not null").groupBy("file_id", "level").agg(F.count(F.lit(1)).alias("n"))


def vendor_lines(lines: DataFrame) -> DataFrame:
    """The lines that have a vendor code, with code and family."""
    rows = R.with_record(lines).withColumn("code", R.vendor_code(F.col("rec"))).where("code is not null")
    return rows.withColumn("family", F.substring_index("code", "-", 1)).drop("rec")


def vendor_codes(lines: DataFrame, limit: int = CODE_LIST, store: int = CODE_STORE) -> DataFrame:
    """file_id, code, family, n, first_line, last_line, example, position: the codes of a file by count, then first seen.

    Codes that come after the first `store` distinct ones of a file are counted, but without details.
    """
    line = F.substring(R.strip(F.col("line")), 1, EXAMPLE)
    agg = vendor_lines(lines).groupBy("file_id", "code", "family").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.min_by(line, "line_no").alias("example"))
    seen = Window.partitionBy("file_id").orderBy("first_line")
    agg = agg.withColumn("nth", F.row_number().over(seen))
    for c in ("last_line", "example"):
        agg = agg.withColumn(c, F.when(F.col("nth") <= store, F.col(c)))
    best = Window.partitionBy("file_id").orderBy(F.desc("n"), "first_line")
    agg = agg.withColumn("position", F.row_number().over(best)).where(F.col("position") <= limit)
    return agg.withColumn("first_line", F.when(F.col("nth") <= store, F.col("first_line"))).drop("nth")


def vendor_summary(lines: DataFrame) -> DataFrame:
    """Per file and family: distinct codes and occurrences; exact whatever is listed."""
    return vendor_lines(lines).groupBy("file_id", "family").agg(F.count_distinct("code").alias("codes"), F.count(F.lit(1)).alias("occurrences"))


def aux_counts(lines: DataFrame, limit: int = AUX_LIST) -> DataFrame:
    """file_id, code, n, first_line: auxiliary codes by count, then first seen."""
    rows = lines.select("file_id", "line_no", F.posexplode(R.aux_codes(F.col("line"))).alias("i", "code"))
    agg = rows.groupBy("file_id", "code").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "i")).alias("first"))
    w = Window.partitionBy("file_id").orderBy(F.desc("n"), "first")
    return agg.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).select("file_id", "code", "n", F.col("first.line_no").alias("first_line"), "position")


def notable_lines(lines: DataFrame, pid: Column | None = None, quota: dict[str, int] | None = None) -> DataFrame:
    """The first lines of each file that state an error level, up to the level's quota, with the context of their process.

    pid (a column of lines) names the process of a line; its context is the last CONTEXT of that process' lines among the
    LOOK_BACK lines before and the line itself. Only lines of processes that have a notable line are windowed.
    """
    quota = quota or QUOTA
    level = source_level(F.col("rec"), F.col("line"))
    rows = R.with_record(lines).withColumn("pid", pid if pid is not None else F.lit(None).cast("string")).withColumn("source_level", level).drop("rec")
    limit = F.lit(0)
    for name, n in quota.items():
        limit = F.when(F.col("source_level") == name, n).otherwise(limit)
    found = rows.where(F.col("source_level").isin(*quota))
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("file_id", "source_level").orderBy("line_no"))).where(F.col("nth") <= limit).drop("nth")
    near = rows.where("pid is not null").select("file_id", "pid", F.col("line_no").alias("at"), F.col("line").alias("near"), F.floor(F.col("line_no") / LOOK_BACK).alias("slot"))
    want = found.where("pid is not null").select("file_id", "pid", "line_no", F.explode(F.array(F.floor(F.col("line_no") / LOOK_BACK), F.floor(F.col("line_no") / LOOK_BACK) - 1)).alias("slot"))
    met = want.join(near, ["file_id", "pid", "slot"]).where((F.col("at") <= F.col("line_no")) & (F.col("at") >= F.col("line_no") - LOOK_BACK))
    ctx = met.groupBy("file_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("at", "near"))).alias("c"))
    tail = F.transform(F.slice("c", F.greatest(F.size("c") - (CONTEXT - 1), F.lit(1)), F.lit(CONTEXT)), lambda x: x["near"])
    out = found.join(ctx, ["file_id", "line_no"], "left")
    return out.select("file_id", "line_no", "source_level", "pid", F.col("line").alias("message"), F.coalesce(F.when(F.size("c") > 0, tail), F.array("line")).alias("context"), rank(F.col("source_level"), FINDING_RANK).alias("rank"))
