"""sshd attempts as a stream: bursts of failed logins from one address, with late lines and bounded state.

Lines arrive with an ingestion time, whose year completes the stamp of a line without one. Attempts of one address and
file are sessions of Spark's session windows: a gap of over GAP seconds, or what the watermark has passed, closes one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import syslog_clock, syslog_stamp
from ..operators import ssh


def attempts(lines: DataFrame) -> DataFrame:
    """lines: file_id, line, ingested (timestamp). One row per sshd line with an address and a kind: at, ip, pid, kind."""
    line = F.col("line")
    clock = syslog_clock(syslog_stamp(line)).cast("timestamp")
    # A stamp that would lie over a day ahead of its ingestion is from the year before.
    at = clock + F.make_ym_interval(F.year("ingested") - 2000, F.lit(0))
    at = F.when(at > F.col("ingested") + F.expr("interval 1 day"), clock + F.make_ym_interval(F.year("ingested") - 2001, F.lit(0))).otherwise(at)
    rows = lines.where(F.contains(line, F.lit("sshd["))).select("file_id", at.alias("at"), ssh.ip(line).alias("ip"), ssh.pid(line).alias("pid"), ssh.rule(line)["kind"].alias("kind"))
    return rows.where("at is not null and ip is not null and kind is not null")


def bursts(lines: DataFrame, least: int = ssh.LEAST, gap: int = ssh.GAP, late: str = "10 minutes") -> DataFrame:
    """file_id, ip, from_at, to_at, attempts, level of each closed burst of `least` attempts or more.

    Spark merges attempts that are exactly `gap` seconds apart, as the batch operator does.
    """
    w = attempts(lines).withWatermark("at", late)
    g = w.groupBy("file_id", "ip", F.session_window("at", f"{gap} seconds").alias("w")).agg(F.count(F.lit(1)).alias("attempts"), F.min("at").alias("from_at"), F.max("at").alias("to_at"))
    rapid = F.unix_timestamp("to_at") - F.unix_timestamp("from_at") <= ssh.RAPID
    level = F.when((F.col("attempts") >= 10) | rapid, "ERROR").otherwise("WARN")
    return g.where(F.col("attempts") >= least).select("file_id", "ip", "from_at", "to_at", "attempts", level.alias("level"))
