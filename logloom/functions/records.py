"""Columns that parse a log line: record prefix, level, vendor and auxiliary codes, titles.

Every function takes and gives Columns of built-in functions. Patterns are fixed values that both this engine and the
logs it reads depend on; (?iu) is what ignoring case means for all of Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stamps, levels, exceptions and codes as logs write them.
TIME = r"[0-2]\d:[0-5]\d:[0-5]\d(?:[.,]\d+)?"
ZONE = r"(?:Z|[+-]\d{2}:?\d{2})?"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DAYS = "Sun|Mon|Tue|Wed|Thu|Fri|Sat"
STAMPS = {
    "iso": rf"\d{{4}}-\d{{2}}-\d{{2}}[T ]{TIME}{ZONE}",
    "ymd_slash": rf"\d{{4}}/\d{{2}}/\d{{2}}[ T]{TIME}",
    "dmy_mon": rf"\d{{2}}-(?:{MONTHS})-\d{{4}}[ T]{TIME}",
    "slash": rf"\d{{2}}/\d{{2}}/(?:\d{{4}}|\d{{2}})[ T]{TIME}",
    "oracle": rf"(?:(?:{DAYS}) +)?(?:{MONTHS}) +\d{{1,2}}[ T]{TIME} +\d{{4}}",
    "syslog": rf"(?:{MONTHS}) +\d{{1,2}}[ T]{TIME}",
}
STAMP = "|".join(STAMPS.values())
LEVELS = "TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|SEVERE|CRITICAL"
ERROR_LEVELS = ("ERROR", "FATAL", "SEVERE", "CRITICAL")
VENDOR = r"([A-Z][A-Z0-9]{1,15}-\d{3,8})\b"
AUX_CODES = (
    r"\b(SQLSTATE\s*[:=]?\s*[0-9A-Z]{5})\b",
    r"\b(HTTP(?:\s+STATUS)?\s*[:=]?\s*[45]\d\d)\b",
    r"\b(error\s*code\s*[:=]\s*[A-Za-z0-9_.-]+)\b",
    r"\b(status\s*code\s*[:=]\s*[45]\d\d)\b",
)
AUX_HINT = r"HTTP|http|SQLSTATE|sqlstate|[Ee]rror code|[Ss]tatus code"
EXCEPTION = r"((?:[A-Za-z_]\w*\.)+[A-Za-z_]\w*(?:Exception|Error|Throwable)|[A-Za-z_]\w*Exception)"
EXCEPTION_HEAD = rf"^{EXCEPTION}(?::\s*(.*))?$"
INLINE_EXCEPTION = r"(?i)Exception:\s*((?:[A-Za-z_]\w*\.)+[A-Za-z_]\w*(?:Exception|Error))(?:\.\s*Message:\s*(.*))?"
STACK_AT = r"(?i)^(?:at |\.\.\.\s*\d+\s+(?:common frames omitted|more)\b)"
MAVEN_ADVISORY = r"(?i)^(?:to see the full stack trace|re-run maven|for more information about the errors|\[help\s+\d+\])"
JUNK_TITLE = r"^[\s\[\](){}:.,;_\-/=*#]+$"

_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}]"


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}+", "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def normal_level(level: Column) -> Column:
    up = F.upper(level)
    return F.when(up == "WARNING", "WARN").when(up == "NOTICE", "INFO").otherwise(up)


def _stamped(s: Column) -> Column:
    """The stamp that a line starts with, null without one; `[stamp ...]` counts up to the bracket."""
    return F.coalesce(found(s, rf"(?i)^(\[(?:{STAMP})[^\]]*\])"), F.when(~s.startswith("["), found(s, rf"(?i)^({STAMP})")))


def with_record(lines: DataFrame) -> DataFrame:
    """lines with rec: struct(level, style, rest, new, head, after), the record prefix of a line.

    level is null without a prefix; new says whether the line begins a new record; styles are bracket, timestamped,
    timestamp_bracket and bare; head is the line without leading space, after what follows a stamp at its start (null
    without one). Each step is a column of its own, so no pattern is worked out twice.
    """
    bracket, level_after = rf"(?i)^\[({LEVELS})\](.*)$", rf"^\s+({LEVELS})\b"
    bracket_after, bare = rf"(?i)^\s*\[({LEVELS}|NOTICE)\](.*)$", r"^(ERROR|FATAL|SEVERE|CRITICAL)(?:[:\s]|$)"
    rows = lines.withColumn("_head", lstrip(F.col("line"))).withColumn("_s", strip(F.col("_head"))).withColumn("_stamp", _stamped(F.col("_head")))
    rows = rows.withColumn("_after", F.substring("_head", F.length("_stamp") + 1, 1 << 30))
    s, after = F.col("_s"), F.col("_after")
    style = (
        F.when(s == "", "blank")
        .when(s.rlike(bracket), "bracket")
        .when(after.rlike(level_after), "timestamped")
        .when(after.rlike(bracket_after), "timestamp_bracket")
        .when(after.isNotNull(), "stamp")
        .when(s.rlike(bare), "bare")
        .otherwise("none")
    )
    rows = rows.withColumn("_style", style)
    of = {
        "bracket": (F.regexp_extract(s, bracket, 1), F.regexp_extract(s, bracket, 2)),
        "timestamped": (F.regexp_extract(after, level_after, 1), F.regexp_replace(after, level_after, "")),
        "timestamp_bracket": (F.regexp_extract(after, bracket_after, 1), F.regexp_extract(after, bracket_after, 2)),
        "bare": (F.regexp_extract(s, bare, 1), F.regexp_replace(s, bare, "")),
    }
    level = rest = F.lit(None).cast("string")
    for name, (l, r) in of.items():
        level, rest = F.when(F.col("_style") == name, l).otherwise(level), F.when(F.col("_style") == name, r).otherwise(rest)
    rows = rows.withColumn("_level", level).withColumn("_rest", rest)
    rec = F.struct(
        normal_level(F.col("_level")).alias("level"),
        F.when(F.col("_level").isNotNull(), F.col("_style")).alias("style"),
        F.col("_rest").alias("rest"),
        (~F.col("_style").isin("blank", "none")).alias("new"),
        F.col("_head").alias("head"),
        F.col("_after").alias("after"),
    )
    # Generated rather than projected: a filter on what follows from rec would else repeat all of this inside itself.
    return rows.withColumn("rec", F.explode(F.array(rec))).drop("_head", "_s", "_stamp", "_after", "_style", "_level", "_rest")


def vendor_code(rec: Column) -> Column:
    """The first PREFIX-NNN code: anywhere in the message of a record or after a stamp, else only at the line's head."""
    where = F.coalesce(F.when(rec["level"].isNotNull(), rec["rest"]), rec["after"])
    return F.when(where.isNotNull(), found(where, rf"\b{VENDOR}")).otherwise(found(rec["head"], rf"^{VENDOR}"))


def aux_codes(line: Column) -> Column:
    """SQLSTATE, HTTP 4xx/5xx, error and status codes as written; the cheap hint comes first."""
    every = F.flatten(F.array(*[F.regexp_extract_all(line, F.lit(f"(?i){p}"), 1) for p in AUX_CODES]))
    return F.when(line.rlike(AUX_HINT), F.transform(every, strip)).otherwise(F.array().cast("array<string>"))


def colon_level(line: Column, rec: Column) -> Column:
    """`level:` anywhere, unless a vendor code leads the record."""
    head = lstrip(F.coalesce(rec["after"], rec["head"]))
    return F.when(~head.rlike(rf"^{VENDOR}"), normal_level(found(line, rf"(?i)\b({LEVELS}):")))


def header_message(line: Column, rec: Column) -> Column:
    """What a record says, without its prefix."""
    rest = strip(rec["rest"])
    return (
        F.when(rec["style"] == "bracket", F.regexp_replace(rest, r"(?i)\s*->\s*\[Help\s+\d+\]\s*$", ""))
        .when((rec["style"] == "timestamped") & F.contains(line, F.lit(" : ")), strip(F.substring_index(line, " : ", -1)))
        .when(rec["style"] == "timestamp_bracket", F.regexp_replace(rest, r"(?i)^\[client [^\]]+\]\s*", ""))
        .when(rec["style"].isNotNull(), rest)
        .otherwise(strip(line))
    )


def one_line(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"{_SPACE}+", " "))


def title(c: Column) -> Column:
    """A text fit to name an incident: two characters or more, not only punctuation, cut at 500; else null."""
    t = one_line(c)
    return F.when((F.length(t) >= 2) & ~t.rlike(JUNK_TITLE), F.substring(t, 1, 500))


def grouping_text(c: Column) -> Column:
    """A message without what varies between repetitions: paths, source lines, clients and child numbers."""
    t = one_line(c)
    for pattern, put in ((r"defined in file \[[^\]]+\]", "defined in file [<path>]"), (r"\([^)]+\.java:\d+\)", "()"), (r"\[client [^\]]+\]", "[client <ip>]"), (r"\bchild \d+\b", "child <id>")):
        t = F.regexp_replace(t, pattern, put)
    return F.substring(t, 1, 500)
