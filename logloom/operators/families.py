"""Runs log families over lines: signals per line, one grouped aggregate, findings from thresholds.

A family is data (family_rules), so a new one adds rows and no code. Each line gives the signals it carries, and what
follows works on counts per file, family, signal, entity and number only, which add up from any parts of a file. All
families share one pass over the lines: their rules are applied inside a lambda, which Spark interprets. What they cost is
their patterns; as generated code they are hundreds of branches, more than Java's 64 KB for a method.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored
from .family_rules import FAMILIES, Family, Signal

BUILTIN = tuple(f.name for f in FAMILIES if f.builtin)


def chosen(names: tuple[str, ...] | None = None) -> tuple[Family, ...]:
    """The named families, in the catalogue's order; without names those that run by default."""
    return tuple(f for f in FAMILIES if (f.name in names if names is not None else f.builtin))


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions) if conditions else F.lit(True)


def _words(words: tuple[str, ...], exact: bool = False) -> str:
    """One pattern for any of the words; in lower case unless exact."""
    return "|".join(re.escape(w if exact else w.lower()) for w in words)


def _has(text: Column, words: tuple[str, ...], exact: bool = False) -> Column:
    """Whether any of the words occurs: looked for one by one, which takes a fraction of the time of one pattern for all."""
    return _any([F.contains(text, F.lit(w if exact else w.lower())) for w in words])


def hint(family: Family, line: Column, low: Column | None = None) -> Column:
    """Whether a family looks at a line. low: the line in lower case, given where the test is interpreted; without it, words
    are one pattern, which is little code to compile."""
    tests = [] if not family.hint else [F.lower(line).rlike(_words(family.hint)) if low is None else _has(low, family.hint)]
    return _any(tests + ([line.rlike(family.hint_pattern)] if family.hint_pattern else []))


def _number(line: Column, pattern: str) -> Column:
    """The number in the pattern's last group, null without one."""
    groups = pattern.count("(") - pattern.count("(?") - pattern.count(r"\(")
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, groups).try_cast("double"))


def matches(signal: Signal, line: Column, low: Column | None = None) -> Column:
    low = F.lower(line) if low is None else low
    # What is cheap to look for comes first: the pattern of a whole line is tried only where it can match.
    tests = [F.contains(low, F.lit(w)) for w in signal.also] + [line.rlike(p) for p in signal.also_any]
    if signal.words:
        tests.append(_has(line if signal.exact else low, signal.words, signal.exact))
    if signal.pattern:
        tests.append(line.rlike(signal.pattern))
    if signal.ratio:
        part = lambda g: F.regexp_extract(line, signal.ratio, g).try_cast("long")
        tests += [line.rlike(signal.ratio), part(1) >= part(2)]
    tests += [~line.rlike(p) for p in signal.never]
    if signal.least_value is not None:
        tests.append(_number(line, signal.value) >= signal.least_value)
    if signal.below is not None:
        tests.append(_number(line, signal.value) < signal.below)
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def _entity(signal: Signal, line: Column) -> Column:
    first = [F.when(line.rlike(p), F.regexp_extract(line, p, 1)) for p in signal.entity]
    return F.coalesce(*first, F.lit(signal.default_entity).cast("string"))


_SIGNAL = "array<struct<family:string,signal:string,entity:string,value:double>>"


def _interpreted(value: Column, f) -> Column:
    """f(value), where value is evaluated once and f not compiled."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _told(family: Family, line: Column, low: Column) -> Column:
    """The signals of a family that a line carries; nulls among them."""
    place = {s.name: i for i, s in enumerate(family.signals)}
    fits = F.array(*[matches(s, line, low) for s in family.signals])

    def each(fit: Column) -> Column:
        out = []
        for s in family.signals:
            ok = fit[place[s.name]]
            for other in s.after:
                ok = ok & ~fit[place[other]]
            value = _number(line, s.value) if s.value else F.lit(None).cast("double")
            out.append(F.when(ok, F.struct(F.lit(family.name).alias("family"), F.lit(s.name).alias("signal"), _entity(s, line).alias("entity"), value.alias("value"))))
        return F.array(*out)

    return F.when(hint(family, line, low), _interpreted(fits, each)).otherwise(F.array().cast(_SIGNAL))


def signals(lines: DataFrame, families: tuple[Family, ...], *keep: str) -> DataFrame:
    """file_id, line_no, family, signal, entity, value and the columns to keep: one row per line and signal that it carries."""

    def told(x: Column) -> Column:
        return F.array_compact(F.flatten(F.array(*[_told(f, x["line"], x["low"]) for f in families])))

    one = F.struct(F.col("line").alias("line"), F.lower("line").alias("low"))
    own = ["file_id", "line_no", *keep]
    rows = lines.where("line is not null").select(*own, F.explode(_interpreted(one, told)).alias("s"))
    return rows.select("file_id", "line_no", "s.*", *keep)


def tallied(got: DataFrame) -> DataFrame:
    """file_id, family, signal, entity, value, n, first (line): signals counted. Tallies of parts of a file add up."""
    return got.groupBy("file_id", "family", "signal", "entity", "value").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))


def _p95(tallies: DataFrame, spec: DataFrame, key: list[str]) -> DataFrame:
    """key, entity and p95_value of the findings whose signals carry numbers: what is put in order is distinct numbers, and no
    file's lines come together."""
    values = tallies.where("value is not null")
    values = values.join(F.broadcast(spec), ["family", "signal"]).groupBy(*key, F.when(F.col("per"), F.col("entity")).alias("entity"), "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*key, "entity")
    upto = F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = values.withColumn("upto", upto).withColumn("all", F.sum("n").over(w))
    return placed.where(F.col("upto") > F.floor(F.col("all") * 0.95)).groupBy(*key, "entity").agg(F.min("value").alias("p95_value"))


def findings(lines: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """file_id, family, kind, level, category, count, first_line, entity, entities, top_entities, classes, avg_value, max_value,
    p95_value, signature.

    entities are what the finding affects, sorted; top_entities those with most rows, where the rule asks for them; classes
    the signals that were met; entity is set where a finding stands for one of them alone. Rules read the tallies several
    times, so these are stored and the lines are read once.
    """
    return judged(stored(tallied(signals(lines, chosen(names))), "family-tallies"), names)


def judged(tallies: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """The findings of tallies, which may come in parts: see findings."""
    families = chosen(names)
    per = tallies.groupBy("file_id", "family", "signal", "entity").agg(
        F.sum("n").alias("n"),
        F.min("first").alias("first"),
        F.sum(F.col("value") * F.col("n")).alias("total"),
        F.max("value").alias("most"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("values"),
    )
    specs = [(f.name, x.kind, x.level, x.category, s, i, x.least, x.per, s in x.distinct, x.unless or None, x.suspects, x.title, x.over[0] if x.over else None, x.over[1] if x.over else None, x.top) for f in families for i, x in enumerate(f.findings) for s in x.signals]
    schema = "family string, kind string, level string, category string, signal string, position int, least int, per boolean, distinct boolean, unless string, suspects int, title string, over double, over_signal string, top int"
    spec = tallies.sparkSession.createDataFrame(specs, schema)  # one row per finding and signal of the rule table
    part = per.join(F.broadcast(spec), ["family", "signal"])
    part = part.withColumn("n", F.when(F.col("distinct") & F.col("entity").isNotNull(), F.lit(1)).otherwise(F.col("n")))
    key = ["file_id", "family", "kind", "level", "category", "position", "least", "per", "unless", "suspects", "title", "over", "over_signal"]
    out = part.groupBy(*key, F.when(F.col("per"), F.col("entity")).alias("entity")).agg(
        F.sum("n").alias("count"),
        F.min("first").alias("first_line"),
        F.sum("total").alias("total"),
        F.max("most").alias("max_value"),
        F.sum("values").alias("values"),
        F.sort_array(F.collect_set("signal")).alias("classes"),
        F.sort_array(F.collect_set(F.when((F.col("suspects") == 0) | (F.col("n") >= F.col("suspects")), F.col("entity")))).alias("entities"),
    )
    out = out.where((F.col("count") >= F.col("least")) & (~F.col("per") | F.col("entity").isNotNull()))
    if any(s.value for f in families for s in f.signals):
        p95 = _p95(tallies, spec, key)
        p95 = p95.select(*[F.col(c).alias(f"_{c}") for c in ("file_id", "family", "kind", "position", "entity")], "p95_value")
        out = out.join(p95, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("file_id", "family", "kind", "position", "entity")]), "left")
    else:
        out = out.withColumn("p95_value", F.lit(None).cast("double"))
    if any(x.top for f in families for x in f.findings):
        counted = part.where("top > 0 and entity is not null").groupBy("file_id", "family", "position", "top", "entity").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        place = F.row_number().over(Window.partitionBy("file_id", "family", "position").orderBy(F.desc("n"), "first", "entity"))
        best = counted.withColumn("place", place).where(F.col("place") <= F.col("top")).groupBy("file_id", "family", "position")
        out = out.join(best.agg(F.array_sort(F.collect_list(F.struct("place", "entity"))).alias("best")), ["file_id", "family", "position"], "left")
    else:
        out = out.withColumn("best", F.lit(None).cast("array<struct<place:int,entity:string>>"))
    seen = per.groupBy("file_id", "family", "signal").agg(F.max("most").alias("seen_most"))
    for column in ("unless", "over_signal"):
        s = seen.select("file_id", "family", F.col("signal").alias(column), F.lit(True).alias(f"has_{column}"), F.col("seen_most").alias(f"most_{column}"))
        out = out.join(s, ["file_id", "family", column], "left")
    out = out.where("has_unless is null")
    level = F.when(F.col("most_over_signal") > F.col("over"), "CRITICAL").otherwise(F.col("level"))
    named = F.replace(F.col("title"), F.lit("{entity}"), F.coalesce("entity", F.lit("")))
    return out.select(
        "file_id",
        "family",
        "kind",
        level.alias("level"),
        "category",
        F.col("count").cast("long").alias("count"),
        "first_line",
        "entity",
        "entities",
        F.transform("best", lambda x: x["entity"]).alias("top_entities"),
        "classes",
        F.when(F.col("values") > 0, F.col("total") / F.col("values")).alias("avg_value"),
        "max_value",
        "p95_value",
        F.concat(named, F.lit(" ("), F.col("count").cast("string"), F.lit(")")).alias("signature"),
    )


# What tells that a test begins or ends, its name and how long it took.
TEST_STARTS = r"(?i)(?:test|fixture|setup).*?(?:created|started|initialized)"
TEST_ENDS = r"(?i)(?:test|fixture|teardown|cleanup).*?(?:completed|finished|destroyed)"
TEST_NAME = r"""(?i)(?:test|scenario)[:\s=]*["']?([^"'\s,;]+)"""
TEST_TIME = r"(?i)(?:duration|took|elapsed)[:\s=]*(\d+)\s*(?:ms|s)"


def test_runs(lines: DataFrame) -> DataFrame:
    """file_id, test, line_no, start_line and duration of each test that ends: paired with the latest line, this one included,
    on which a test of that name starts in the file; start_line is null without one. A test without a name is called by its line."""
    line = F.col("line")
    told = lines.where(F.lower("line").rlike("test|fixture|setup|teardown|cleanup")).select("file_id", "line_no", line.rlike(TEST_STARTS).alias("starts"), line.rlike(TEST_ENDS).alias("ends"), F.regexp_extract("line", TEST_NAME, 1).alias("name"), F.regexp_extract("line", TEST_TIME, 1).try_cast("long").alias("duration"))
    told = told.where("starts or ends").withColumn("test", F.when(F.col("name") != "", F.col("name")).otherwise(F.concat(F.lit("test_"), F.col("line_no").cast("string"))))
    w = Window.partitionBy("file_id", "test").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    started = F.last(F.when(F.col("starts"), F.col("line_no")), ignorenulls=True).over(w)
    return told.withColumn("start_line", started).where("ends").select("file_id", "test", "line_no", "start_line", F.coalesce("duration", F.lit(0)).alias("duration"))


def line_rule(line: Column, names: tuple[str, ...] | None = None) -> Column:
    """struct(level, category, kind) of the first family, in order, whose hint and rule fit the line; else null."""
    tries = []
    for f in chosen(names):
        for pattern, level, category, kind in f.rules:
            tries.append(F.when(hint(f, line) & line.rlike(pattern), F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), F.lit(kind).alias("kind"))))
    return F.coalesce(*tries)


def custom(lines: DataFrame, patterns: DataFrame, at_once: int = 50) -> DataFrame:
    """Rules of a user: patterns has name, pattern, level, category, kind, action. A finding per file and rule that hits,
    but for rules whose action is `ignore`.

    Rules are a table that somebody wrote; they become columns, so each line is matched with all rules of a pass and with
    no join. at_once bounds the rules of a pass, as one expression, not their number.
    """
    rules = patterns.where("coalesce(action, 'match') <> 'ignore'").select("name", "pattern", "level", "category", "kind").collect()
    if not rules:
        rules_schema = "name string, level string, category string, kind string"
        hit = lines.select("file_id", "line_no", "line", F.explode(F.array().cast(f"array<struct<{rules_schema.replace(' ', ':').replace(',:', ',')}>>")).alias("r"))
    else:
        text = lambda v: F.lit(v).cast("string")
        passes = []
        for at in range(0, len(rules), at_once):
            tests = [F.when(F.col("line").rlike(r.pattern), F.struct(text(r.name).alias("name"), text(r.level).alias("level"), text(r.category).alias("category"), text(r.kind).alias("kind"))) for r in rules[at : at + at_once]]
            passes.append(lines.select("file_id", "line_no", "line", F.explode(F.array_compact(F.array(*tests))).alias("r")))
        hit = reduce(DataFrame.unionByName, passes)
    return hit.groupBy("file_id", "r.name", "r.level", "r.category", "r.kind").agg(F.count(F.lit(1)).alias("count"), F.min("line_no").alias("first_line"), F.min_by(F.substring("line", 1, 240), "line_no").alias("sample"))
