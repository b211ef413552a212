"""sshd sessions by process, their severity, and brute-force clusters of sessions by address."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timestamps import syslog_clock, syslog_stamp
from .family_rules import SSH_RULES

#: Sessions of a cluster, largest gap inside one, what counts as rapid, sessions and lines that are kept.
LEAST, GAP, RAPID, SESSIONS, SESSION_LINES = 5, 900, 60, 2000, 32
_IP = r"((?:\d{1,3}\.){3}\d{1,3})"
_FAILED = ("failed_password", "failed_none", "auth_failure", "invalid_user", "too_many_failures", "pam_failures", "no_more_methods")


def _first(line: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.when(line.rlike(p), F.regexp_extract(line, p, 1)) for p in patterns])


def rule(line: Column) -> Column:
    """struct(level, category, kind) of the first rule that fits; a "message repeated" line is judged by what it repeats."""
    repeat = r"(?i)message repeated \d+ times:\s*\[(.*)\]\s*$"
    body = F.when(line.rlike(repeat), F.regexp_extract(line, repeat, 1)).otherwise(line)
    out = F.lit(None)
    for pattern, level, category, kind in reversed(SSH_RULES):
        out = F.when(body.rlike(pattern), F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), F.lit(kind).alias("kind"))).otherwise(out)
    return out


def pid(line: Column) -> Column:
    return _first(line, r"\bsshd\[(\d+)\]")


def ip(line: Column) -> Column:
    """The remote address: after from, after closed by or disconnect from, as rhost, in brackets, or anywhere."""
    return _first(line, rf"(?i)\bfrom {_IP}\b", rf"(?i)\b(?:closed by|disconnect from) {_IP}\b", rf"(?i)\brhost={_IP},*(?:\s|$)", rf"\[{_IP}\]", rf"\b{_IP}\b")


def user(line: Column) -> Column:
    return _first(line, r"(?i)invalid user\s+(\S+)", r"(?i)Failed (?:password|none) for (?:invalid user )?(\S+) from", r"(?i)failures? for (\S+)", r"(?i)\buser=(\S+)")


def level_of(kinds: Column) -> Column:
    """The severity of a session by the kinds of its lines."""
    has = lambda *names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    failed, dns = has(*_FAILED), has("reverse_dns_mismatch")
    return (
        F.when(dns & failed, "ERROR")
        .when(has("too_many_failures", "pam_failures", "no_more_methods", "error"), "ERROR")
        .when(dns, "WARN")
        .when(has("fatal"), "ERROR")
        .otherwise("WARN")
    )


def title_of(kinds: Column, ip_: Column, user_: Column) -> Column:
    has = lambda *names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    where = F.coalesce(F.concat(F.lit(" from "), ip_), F.lit(""))
    who = F.coalesce(F.concat(F.lit(" for "), user_), F.lit(""))
    return (
        F.when(has("too_many_failures"), F.concat(F.lit("SSH too many authentication failures"), who, where))
        .when(has("no_more_methods"), F.concat(F.lit("SSH authentication methods exhausted"), who, where))
        .when(has("failed_password", "auth_failure", "invalid_user", "failed_none", "pam_failures"), F.concat(F.lit("SSH authentication failure"), who, where))
        .when(has("reverse_dns_mismatch"), F.concat(F.lit("SSH reverse-DNS mismatch"), where, who))
        .when(has("fatal"), F.concat(F.lit("SSH fatal"), where, who))
        .otherwise(F.concat(F.lit("SSH error"), where))
    )


def sessions(lines: DataFrame, most: int = SESSIONS) -> DataFrame:
    """One row per file and process: file_id, pid, first_line, ip, user, stamp, kinds, category, level, signature, sample,
    kept (whether it is among the first `most` of its file), judged (its place among those of its file that a rule fits: only
    these are rows). Only the first SESSION_LINES lines of a session are gathered.
    """
    line = F.col("line")
    rows = lines.where(F.contains(line, F.lit("sshd["))).select("file_id", "line_no", "line", pid(line).alias("pid")).where("pid is not null")
    rows = rows.withColumns({"ip": ip(line), "user": user(line), "stamp": syslog_stamp(line), "rule": rule(line)})
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("file_id", "pid").orderBy("line_no")))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    agg = rows.withColumns({"kind": F.col("rule.kind"), "category": F.col("rule.category")}).groupBy("file_id", "pid").agg(
        F.min("line_no").alias("first_line"),
        latest("ip"),
        latest("user"),
        latest("stamp"),
        F.sort_array(F.collect_set("kind")).alias("kinds"),
        latest("category"),
        F.array_sort(F.collect_list(F.when(F.col("nth") <= SESSION_LINES, F.struct("line_no", "line")))).alias("ls"),
    )
    agg = agg.withColumn("kept", F.row_number().over(Window.partitionBy("file_id").orderBy("first_line")) <= most)
    texts = F.transform("ls", lambda x: x["line"])
    return agg.where(F.size("kinds") > 0).select("file_id", "pid", "first_line", "ip", "user", "stamp", "kinds", "category", level_of(F.col("kinds")).alias("level"), title_of(F.col("kinds"), F.col("ip"), F.col("user")).alias("signature"), F.array_join(texts, "\n").alias("sample"), texts.alias("lines"), "kept").withColumn("judged", F.row_number().over(Window.partitionBy("file_id").orderBy("first_line")))


def overflow(found: DataFrame) -> DataFrame:
    """file_id, sessions (judged ones among those that are kept), overflow (those beyond) and unique, all of them: exact
    counts, however few sessions are kept."""
    kept, past = F.count_if(F.col("kept")), F.count_if(~F.col("kept"))
    return found.groupBy("file_id").agg(kept.alias("sessions"), past.alias("overflow"), F.count(F.lit(1)).alias("unique"))


def clusters(found: DataFrame, least: int = LEAST, gap: int = GAP, every: bool = False) -> DataFrame:
    """Runs of a file's sessions from one address with no gap of over `gap` seconds, of `least` sessions or more: of the
    sessions that are kept, or of every one.

    Sessions without a clock come last and join the last run. ERROR from ten sessions on, or if the run is rapid. Sessions of
    one slot as wide as a gap are of one run, so a slot is one row before runs are cut, and an address is no one task's.
    """
    s = (found if every else found.where("kept")).where("ip is not null").withColumn("at", F.unix_micros(syslog_clock(F.col("stamp")).cast("timestamp")) / 1e6)
    s = s.withColumn("slot", F.floor(F.col("at") / gap) if gap else F.col("at"))
    s = s.withColumn("nth", F.row_number().over(Window.partitionBy("file_id", "ip", "slot").orderBy("at", "first_line")))
    head = F.when(F.col("nth") <= 8, F.struct("nth", F.array_join(F.slice("lines", 1, 3), "\n").alias("text")))
    s = s.groupBy("file_id", "ip", "slot").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("at", "first_line")).alias("first"),
        F.max("at").alias("to_at"),
        F.array_sort(F.collect_list(head)).alias("heads"),
    )
    s = s.select("*", "first.at", "first.first_line")
    w = Window.partitionBy("file_id", "ip").orderBy(F.col("at").isNull(), "at")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("opens", F.coalesce((F.col("at") - F.last("to_at", ignorenulls=True).over(before) > gap).cast("int"), F.lit(0)))
    s = s.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct(F.col("at").isNull().alias("late"), F.col("at"))
    in_run = Window.partitionBy("file_id", "ip", "run").orderBy(F.col("at").isNull(), "at").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("past", F.coalesce(F.sum("n").over(in_run), F.lit(0)))
    agg = s.groupBy("file_id", "ip", "run").agg(
        F.sum("n").alias("count"),
        F.min_by("first_line", order).alias("first_line"),
        F.min_by("at", order).alias("from_at"),
        F.max_by("to_at", order).alias("to_at"),
        F.array_sort(F.collect_list(F.when(F.col("past") < 8, F.struct("past", "heads")))).alias("heads"),
    )
    heads = F.slice(F.flatten(F.transform("heads", lambda x: x["heads"])), 1, 8)
    duration = F.col("to_at") - F.col("from_at")
    sure = (F.col("count") >= 10) | F.coalesce(duration <= RAPID, F.lit(False))
    text = F.concat(F.when(sure, "SSH brute-force from ").otherwise("Suspected SSH brute-force from "), F.col("ip"), F.lit(" ("), F.col("count").cast("string"), F.lit(" authentication attempts)"))
    return agg.where(F.col("count") >= least).select(
        "file_id", "ip", "count", "first_line", duration.alias("duration_s"), F.when(sure, "ERROR").otherwise("WARN").alias("level"), F.lit("security-auth").alias("category"), F.lit("brute_force").alias("kind"), text.alias("signature"), F.array_join(F.transform(heads, lambda x: x["text"]), "\n").alias("sample")
    )


def incidents(lines: DataFrame) -> DataFrame:
    """Sessions and brute-force runs as incidents of their files."""
    found = sessions(lines)
    one = found.where("kept").select("file_id", F.lit("ssh").alias("family"), F.lit("ssh_session").alias("kind"), "level", "category", F.lit(1).cast("long").alias("count"), "first_line", "signature", "sample")
    run = clusters(found).select("file_id", F.lit("ssh").alias("family"), "kind", "level", "category", "count", "first_line", "signature", "sample")
    return reduce(DataFrame.unionByName, [one, run])
