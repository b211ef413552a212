"""Stamps in log lines: reading them, deciding day or month first per file, and telling time ranges.

A stamp is struct(raw, wall, key, zone): as written, its wall clock, the clock to compare by (UTC where the stamp has an
offset) and the offset's name. All clocks are TIMESTAMP_NTZ: the session's time zone never enters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import DAYS, MONTHS, STAMP, TIME, found, lstrip


def _clock(date: Column, time: Column) -> Column:
    """A clock of a yyyy-MM-dd date and a time of day with `.` or `,` before fractions; null if there is no such."""
    return F.try_to_timestamp(F.concat(date, F.lit(" "), F.regexp_replace(time, ",", "."))).cast("timestamp_ntz")


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int"))


def _month(name: Column) -> Column:
    names = F.array(*[F.lit(x.lower()) for x in MONTHS.split("|")])
    return F.array_position(names, F.lower(F.substring(name, 1, 3)))


def _year(y: Column) -> Column:
    y = y.cast("int")
    return F.when(y >= 100, y).when(y < 70, y + 2000).otherwise(y + 1900)


def tokens(line: Column) -> Column:
    """All stamps of a line as written, in order."""
    return F.regexp_extract_all(line, F.lit(f"(?i)({STAMP})"), 1)


def _slash(token: Column, part: int) -> Column:
    return F.regexp_extract(token, r"^(\d{2})/(\d{2})/(\d{4}|\d{2})[ T](.*)$", part)


IS_SLASH = r"^\d{2}/\d{2}/"


def forced_dayfirst(token: Column) -> Column:
    """True or false if the numbers of a slash date leave one order only, else null."""
    a, b = _slash(token, 1).cast("int"), _slash(token, 2).cast("int")
    return F.when(token.rlike(IS_SLASH), F.when((a > 12) & (b <= 12), True).when((b > 12) & (a <= 12), False))


def _slash_clock(token: Column, dayfirst: Column, known: Column) -> Column:
    a, b, y, t = _slash(token, 1), _slash(token, 2), _year(_slash(token, 3)), _slash(token, 4)
    dmy, mdy = _clock(_date(y, b, a), t), _clock(_date(y, a, b), t)
    an, bn = a.cast("int"), b.cast("int")
    in_dmy, in_mdy = F.coalesce(F.array_contains(known, F.to_date(dmy)), F.lit(False)), F.coalesce(F.array_contains(known, F.to_date(mdy)), F.lit(False))
    return (
        F.when((an < 1) | (bn < 1) | (an > 31) | (bn > 31) | ((an > 12) & (bn > 12)), None)
        .when(an > 12, dmy)
        .when(bn > 12, mdy)
        .when(dayfirst, dmy)
        .when(~dayfirst, mdy)
        .when(in_dmy & ~in_mdy, dmy)
        .when(in_mdy & ~in_dmy, mdy)
    )


def read(token: Column, dayfirst: Column, known: Column) -> Column:
    """struct(raw, wall, key, zone) of one stamp; null if it is no calendar time (no year, or no such day)."""
    iso, zone_re = r"^\d{4}-", r"(?i)(Z|[+-]\d{2}:?\d{2})$"
    zone = F.when(token.rlike(r"^\d{4}-") & token.rlike(zone_re), F.regexp_extract(token, zone_re, 1))
    bare = F.regexp_replace(F.regexp_replace(token, r"(?i)Z$", ""), r"(\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)[+-]\d{2}:?\d{2}$", "$1")
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(zone, r"\D", "")
    minutes = F.when(zone.isNull() | F.upper(zone).isin("Z"), 0).otherwise(sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")))
    label = F.when(zone.isNull(), None).when(minutes == 0, "UTC").otherwise(F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60))
    day_mon = rf"(?i)^(\d{{2}})-({MONTHS})-(\d{{4}})[ T](.*)$"
    oracle = rf"(?i)^(?:(?:{DAYS}) +)?({MONTHS}) +(\d{{1,2}})[ T]({TIME}) +(\d{{4}})$"
    part = F.regexp_extract
    wall = (
        F.when(token.rlike(iso), _clock(F.substring(bare, 1, 10), F.substring(bare, 12, 30)))
        .when(token.rlike(r"^\d{4}/"), _clock(F.translate(F.substring(token, 1, 10), "/", "-"), F.substring(token, 12, 30)))
        .when(token.rlike(day_mon), _clock(_date(part(token, day_mon, 3), _month(part(token, day_mon, 2)), part(token, day_mon, 1)), part(token, day_mon, 4)))
        .when(token.rlike(oracle), _clock(_date(part(token, oracle, 4), _month(part(token, oracle, 1)), part(token, oracle, 2)), part(token, oracle, 3)))
        .when(token.rlike(IS_SLASH), _slash_clock(token, dayfirst, known))
    )
    key = wall - F.make_interval(mins=F.coalesce(minutes, F.lit(0)))
    return F.when(wall.isNotNull(), F.struct(token.alias("raw"), wall.alias("wall"), key.alias("key"), label.alias("zone")))


def policy(lines: DataFrame) -> DataFrame:
    """file_id, dayfirst, known: per file, the order that its slash dates prove and the dates that need no proof."""
    none = F.lit(None).cast("boolean")
    tok = lines.select("file_id", F.explode(tokens(F.col("line"))).alias("t"))
    seen = tok.select("file_id", forced_dayfirst(F.col("t")).alias("f"), F.to_date(read(F.col("t"), none, F.array().cast("array<date>"))["wall"]).alias("d"))
    agg = seen.groupBy("file_id").agg(F.max("f").alias("any_d"), F.min("f").alias("all_d"), F.sort_array(F.collect_set("d")).alias("known"))
    return agg.select("file_id", F.when(F.col("any_d") == F.col("all_d"), F.col("any_d")).alias("dayfirst"), "known")


def stamped(lines: DataFrame) -> DataFrame:
    """lines with ts, the first stamp of the line that is a calendar time under its file's policy."""
    has_slash = lines.where(F.col("line").rlike(r"\d{2}/\d{2}/\d")).select("file_id").distinct()
    pol = policy(lines.join(has_slash, "file_id", "left_semi"))
    ts = F.get(F.filter(F.transform(tokens(F.col("line")), lambda t: read(t, F.col("dayfirst"), F.coalesce("known", F.array().cast("array<date>")))), lambda x: x.isNotNull()), F.lit(0))
    return lines.join(pol, "file_id", "left").withColumn("ts", ts).drop("dayfirst", "known")


def syslog_stamp(line: Column) -> Column:
    """A stamp without a year at the start of a line, as written; one that a year follows is none."""
    s = lstrip(line)
    whole = rf"(?i)^((?:{MONTHS}) +\d{{1,2}}[ T]{TIME})(?! +\d{{4}})"
    return F.when(~s.startswith("["), found(s, whole))


def syslog_clock(stamp: Column) -> Column:
    """A clock in the year 2000 that orders stamps without a year; fractions are dropped."""
    p = rf"(?i)^({MONTHS}) +(\d{{1,2}})[ T](\d\d:\d\d:\d\d)"
    return _clock(_date(F.lit(2000), _month(F.regexp_extract(stamp, p, 1)), F.regexp_extract(stamp, p, 2)), F.regexp_extract(stamp, p, 3))


def display(ts: Column) -> Column:
    """A stamp in ISO form with its offset."""
    return F.concat(F.regexp_replace(F.date_format(ts["wall"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.when(ts["zone"].isNull(), "").when(ts["zone"] == "UTC", "Z").otherwise(ts["zone"]))


def time_range(lines: DataFrame) -> DataFrame:
    """file_id, line_count, timestamped_lines, from_ts, to_ts, year_present, timezone, timezone_note."""
    s = stamped(lines).withColumn("sys", syslog_stamp(F.col("line"))).withColumn("sys_key", syslog_clock(F.col("sys")))
    cal = s.where("ts is not null").groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_cal"),
        F.min_by("ts", F.struct("ts.key", "line_no")).alias("lo"),
        F.max_by("ts", F.struct("ts.key", -F.col("line_no"))).alias("hi"),
        F.collect_set("ts.zone").alias("zones"),
        F.max(F.col("ts.zone").isNull()).alias("bare"),
    )
    sys = s.where("sys_key is not null").groupBy("file_id").agg(F.count(F.lit(1)).alias("n_sys"), F.min_by("sys", F.struct("sys_key", "line_no")).alias("s_lo"), F.max_by("sys", F.struct("sys_key", -F.col("line_no"))).alias("s_hi"))
    out = lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("line_count")).join(cal, "file_id", "left").join(sys, "file_id", "left")
    one = F.size("zones") == 1
    zone = F.when(F.size("zones") == 0, None).when(one & ~F.col("bare"), F.col("zones")[0]).otherwise("mixed")
    note = (
        F.when(F.size("zones") == 0, "timezone not present in source stamps")
        .when(one & ~F.col("bare"), None)
        .when(one, F.concat(F.lit("some stamps use "), F.col("zones")[0], F.lit("; others have no timezone in the source")))
        .otherwise("source stamps use more than one timezone offset")
    )
    cal_ = F.col("n_cal").isNotNull()
    return out.select(
        "file_id",
        "line_count",
        F.coalesce("n_cal", "n_sys", F.lit(0)).cast("long").alias("timestamped_lines"),
        F.when(cal_, display(F.col("lo"))).otherwise(F.col("s_lo")).alias("from_ts"),
        F.when(cal_, display(F.col("hi"))).otherwise(F.col("s_hi")).alias("to_ts"),
        F.when(cal_, True).when(F.col("n_sys").isNotNull(), False).alias("year_present"),
        F.when(cal_, zone).alias("timezone"),
        F.when(cal_, note).when(F.col("n_sys").isNotNull(), "RFC3164 stamps have no year or timezone in the source").alias("timezone_note"),
    )
