"""Multi-line error events: assembly, exception chains and grouping.

Assembly is a state machine over the lines of a file; here it is two lookups of "the last line before this one that ...".
Both run in chunks of CHUNK lines, whose summaries are looked up across chunks, so one huge file is spread over as many
tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..tables import stored

#: Lines of one chunk; most lines of an event, most characters of its sample.
CHUNK, MOST_LINES, SAMPLE = 1 << 16, 500, 50_000


def last_known(rows: DataFrame, value: str, out: str, here: bool, chunk: int = CHUNK) -> DataFrame:
    """rows (file_id, line_no, ...) with out: the last non-null value before each line, or up to it if here is set."""
    rows = rows.withColumn("_chunk", F.floor((F.col("line_no") - 1) / chunk))
    inner = Window.partitionBy("file_id", "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0 if here else -1)
    ends = rows.groupBy("file_id", "_chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("line_no"))).alias("_end"))
    outer = Window.partitionBy("file_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file_id", "_chunk", F.last("_end", ignorenulls=True).over(outer).alias("_before"))
    rows = rows.withColumn("_in", F.last(value, ignorenulls=True).over(inner))
    return rows.join(ends, ["file_id", "_chunk"]).withColumn(out, F.coalesce("_in", "_before")).drop("_in", "_before", "_chunk")


def is_continuation(line: Column) -> Column:
    s = R.strip(line)
    return (s == "") | s.rlike(r"(?i)^(?:Caused by|Suppressed):\s+.+$") | s.rlike(R.STACK_AT) | s.startswith("at ") | s.rlike(R.EXCEPTION_HEAD) | line.rlike(r"^[ \t]")


def member_lines(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The lines that belong to an error event, with start_line, the line that opens it.

    A line opens an event if its record has an error level, unless it is a build tool's advice (bracket style, nothing or
    a hint after the level) while an event opened in bracket style is still open. Continuations join the open event,
    anything else closes it. After MOST_LINES lines nothing more joins.

    What each line is is worked out once and stored, as the lookups read it several times; of lines that only close events
    no text is kept.
    """
    rows = lines if "rec" in lines.columns else R.with_record(lines)
    level, style = F.col("rec.level"), F.col("rec.style")
    rest = R.strip(F.col("rec.rest"))
    advice = (style == "bracket") & ((rest == "") | rest.rlike(R.MAVEN_ADVISORY))
    kind = (
        F.when(level.isin(*R.ERROR_LEVELS), F.when(advice, "advice").when(style == "bracket", "bracket").otherwise("start"))
        .when(level.isNotNull() | F.col("rec.new"), "break")
        .when(is_continuation(F.col("line")), None)
        .otherwise("break")
    )
    rows = rows.withColumn("_kind", kind)
    kept = {c: F.when(~F.col("_kind").eqNullSafe("break"), F.col(c)).alias(c) for c in ("line", "rec")}
    rows = stored(rows.select(*[kept.get(c, F.col(c)) for c in rows.columns]), "event-lines")
    rows = last_known(rows, "_kind", "_last", False, chunk)
    joins = (F.col("_kind") == "advice") & F.coalesce(F.col("_last").isin("advice", "bracket"), F.lit(False))
    mark = F.when(F.col("_kind").isNotNull() & ~joins, F.struct("line_no", (F.col("_kind") != "break").alias("opens")))
    rows = last_known(rows.withColumn("_mark", mark), "_mark", "_event", True, chunk)
    start = F.col("_event.line_no")
    return rows.where(F.col("_event.opens") & (F.col("line_no") - start < MOST_LINES)).withColumn("start_line", start).drop("_kind", "_last", "_mark", "_event")


def chain(lines: Column) -> Column:
    """struct(top_exception, causes, suppressed, root_cause, exception_chain) of an array of struct(line, rec)."""
    plain = F.transform(F.filter(lines, lambda x: ~x["rec"]), lambda x: F.struct(R.strip(x["line"]).alias("s")))
    plain = F.filter(plain, lambda x: x["s"] != "")
    said = lambda word: F.transform(F.filter(plain, lambda x: x["s"].rlike(rf"(?i)^{word}:\s+.+$")), lambda x: R.strip(F.regexp_extract(x["s"], rf"(?i)^{word}:\s+(.+)$", 1)))
    causes, suppressed = said("Caused by"), said("Suppressed")
    named = lambda s, p: F.concat_ws(": ", F.regexp_extract(s, p, 1), F.nullif(R.strip(F.regexp_extract(s, p, 2)), F.lit("")))
    heads = F.filter(plain, lambda x: ~x["s"].rlike(r"(?i)^(?:Caused by|Suppressed):\s+.+$") & ~x["s"].rlike(R.STACK_AT) & x["s"].rlike(R.EXCEPTION_HEAD))
    inline = F.filter(lines, lambda x: x["rec"] & x["line"].rlike(R.INLINE_EXCEPTION))
    trim = lambda c: F.regexp_replace(c, r"^[: ]+|[: ]+$", "")
    head_of = F.when(F.size(heads) > 0, trim(named(F.get(heads, F.lit(0))["s"], R.EXCEPTION_HEAD)))
    top = F.coalesce(head_of, F.when(F.size(inline) > 0, trim(named(F.get(inline, F.lit(0))["line"], R.INLINE_EXCEPTION))))
    root = F.coalesce(F.try_element_at(causes, F.lit(-1)), top)
    bodies = F.filter(F.concat(F.array(top), causes), lambda b: b.isNotNull())
    classes = F.transform(F.filter(bodies, lambda b: R.strip(b).rlike(R.EXCEPTION_HEAD)), lambda b: F.regexp_extract(R.strip(b), R.EXCEPTION_HEAD, 1))
    return F.struct(top.alias("top_exception"), causes.alias("causes"), suppressed.alias("suppressed"), root.alias("root_cause"), classes.alias("exception_chain"))


def events(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per event: file_id, start_line, level, style, n_lines, sample, signature, key_kind, key, codes, exit_code and
    the exception chain's columns."""
    rec = F.col("rec")
    header = F.when(F.col("line_no") == F.col("start_line"), R.header_message(F.col("line"), rec))
    codes = F.filter(F.concat(F.array(R.vendor_code(rec)), R.aux_codes(F.col("line"))), lambda x: x.isNotNull())
    # A line's parts are taken from it here, so that its text goes through the shuffle once.
    part = F.struct("line_no", "line", rec["level"].isNotNull().alias("rec"), rec["level"].alias("level"), rec["style"].alias("style"), header.alias("header"), codes.alias("codes"))
    ev = member_lines(lines, chunk).groupBy("file_id", "start_line").agg(F.array_sort(F.collect_list(part)).alias("ls"))
    first = F.col("ls")[0]
    java = (F.size("ls") > 1) | first["line"].rlike(R.INLINE_EXCEPTION) | F.contains(first["line"], F.lit("Caused by:"))
    empty = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("top_exception", "string"), ("causes", "array<string>"), ("suppressed", "array<string>"), ("root_cause", "string"), ("exception_chain", "array<string>"))])
    ev = ev.withColumn("c", F.when(java, chain(F.col("ls"))).otherwise(empty))
    ev = ev.withColumn("header", R.title(first["header"]))
    ev = ev.withColumn("sample", F.substring(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), 1, SAMPLE))
    classed = lambda c: F.concat(F.when(R.strip(c).rlike(R.EXCEPTION_HEAD), F.regexp_extract(R.strip(c), R.EXCEPTION_HEAD, 1)).otherwise(""), F.lit(": "), c)

    def named(x: Column) -> Column:
        said = R.grouping_text(x["header"])
        sig = F.when(x["header"].isNotNull(), F.when(x["style"] == "timestamp_bracket", said).otherwise(x["header"]))
        signature = F.coalesce(sig, R.title(x["root"]), R.title(x["top"]), F.lit("Unknown error"))
        return F.struct(signature.alias("signature"), F.coalesce(R.grouping_text(classed(x["root"])), said, F.lit("Unknown error")).alias("key"))

    # Names are worked out in a lambda, which is interpreted: compiled, they are a method too large for Java to optimise.
    root = F.col("c.root_cause")
    told = F.struct("header", first["style"].alias("style"), root.alias("root"), F.col("c.top_exception").alias("top"))
    ev = ev.withColumn("named", F.element_at(F.transform(F.array(told), named), 1))
    return ev.select(
        "file_id",
        "start_line",
        first["level"].alias("level"),
        first["style"].alias("style"),
        F.size("ls").cast("long").alias("n_lines"),
        "sample",
        "named.signature",
        F.when(root.isNotNull(), "root").when(F.col("header").isNotNull(), "msg").otherwise("unk").alias("key_kind"),
        "named.key",
        F.array_distinct(F.flatten(F.transform("ls", lambda x: x["codes"]))).alias("codes"),
        F.expr(r"try_cast(nullif(regexp_extract(sample, '(?i)exit code:\\s*(\\d+)', 1), '') as int)").alias("exit_code"),
        "c.*",
    )


def grouped(ev: DataFrame) -> DataFrame:
    """Events that say the same, per file: count, first line, the first event's level and names, the longest sample, the
    first chain with a root cause, and in how many events each code occurs."""
    key = ["file_id", "key_kind", "key"]
    first = lambda c: F.min_by(c, "start_line").alias(c)
    caused = F.when(F.col("root_cause").isNotNull(), F.col("start_line"))
    main = ev.groupBy(*key).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("start_line").alias("first_line"),
        first("signature"),
        first("level"),
        first("exit_code"),
        F.max_by("sample", F.struct(F.length("sample"), -F.col("start_line"))).alias("sample"),
        *[F.min_by(c, caused).alias(c) for c in ("root_cause", "top_exception", "causes", "exception_chain")],
    )
    codes = ev.select(*key, F.explode("codes").alias("code")).groupBy(*key, "code").agg(F.count(F.lit(1)).alias("n"))
    codes = codes.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("codes"))
    return main.join(codes, key, "left")


#: The order of levels among incidents and among line findings.
INCIDENT_RANK = {"CRITICAL": 0, "FATAL": 1, "SEVERE": 2, "ERROR": 3, "WARN": 4, "WARNING": 4}
FINDING_RANK = {"FATAL": 0, "CRITICAL": 1, "SEVERE": 2, "ERROR": 3}
INCIDENT_LIMIT = 100


def rank(level: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(50)
    for name, r in ranks.items():
        out = F.when(level == name, r).otherwise(out)
    return out


def incidents(groups: DataFrame, families: DataFrame | None = None, limit: int = INCIDENT_LIMIT) -> DataFrame:
    """Event groups and family incidents of each file in order of weight, with position and total (before the limit).

    The total is counted before the limit is applied, and only `limit` rows of a file are ever numbered. Both read the same
    rows, which are stored, so that no event is assembled twice.
    """
    every = groups if families is None else groups.unionByName(families, allowMissingColumns=True)
    if "kind" not in every.columns:
        every = every.withColumn("kind", F.lit(None).cast("string"))
    every = stored(every, "incidents")
    order = [F.when(F.col("kind") == "brute_force", 0).otherwise(1), rank(F.col("level"), INCIDENT_RANK), F.coalesce("first_line", F.lit(0)), F.col("signature")]
    w = Window.partitionBy("file_id").orderBy(*order)
    total = every.groupBy("file_id").agg(F.count(F.lit(1)).alias("total"))
    return every.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).join(total, "file_id")
