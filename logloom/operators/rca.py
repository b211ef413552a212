"""Possible root causes: events that no known earlier event explains, and the chains that follow them.

Pattern strengths say how familiar a pair of kinds is; nothing here proves causation. Events carry scope (what is judged
together), ord, ts (timestamp_ntz), analyzer, level, kind.

No event meets all others of its window. What may have caused an event, or what it may cause, is an as-of lookup: per scope,
kind (or analyzer) and time slot as wide as the window, one pass in order of time finds the nearest event of the other side,
those of the neighbouring slot included. Chains are paths along those successors, and pointers that
double their reach give each root the end and the sums of its path in a logarithmic number of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import stored

#: Strengths of pairs of kinds, pairs of analyzers in sequence, and the three windows in seconds.
PATTERNS = {
    ("deadlock", "connection_exhausted"): 0.95,
    ("connection_exhausted", "timeout"): 0.90,
    ("timeout", "service_restart"): 0.85,
    ("connection_exhausted", "http_error"): 0.88,
    ("query_slow", "connection_timeout"): 0.80,
    ("memory_spike", "oom_killed"): 0.92,
    ("cpu_spike", "timeout"): 0.75,
    ("network_latency", "timeout"): 0.80,
    ("circuit_breaker_open", "error_cascade"): 0.90,
    ("service_unavailable", "http_503"): 0.95,
}
SEQUENCES = (("postgresql", "api_performance"), ("postgresql", "nginx"), ("docker", "nginx"), ("docker", "api_performance"))
IMMEDIATE, SHORT, MEDIUM = 5, 30, 300


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def _dictionary(spark: SparkSession) -> DataFrame:
    """Cause and effect by kind or by analyzer, with the longest delay: a fixed table of 14 rows."""
    rows = [("kind", a, b, float(MEDIUM)) for a, b in PATTERNS] + [("analyzer", a, b, float(SHORT)) for a, b in SEQUENCES]
    return spark.createDataFrame(rows, "by string, cause string, effect string, most double")


def _slotted(events: DataFrame) -> DataFrame:
    return events.withColumn("at", _seconds(F.col("ts"))).withColumn("slot", F.floor(F.col("at") / MEDIUM))


#: What a lookup brings of the event that it finds.
_EVENT = ("at", "ord", "analyzer", "kind")


def _sided(e: DataFrame, side: str, *cols: str) -> DataFrame:
    """The columns of e once per dictionary row on whose side it stands, with by, cause, effect and most."""
    each = F.explode(F.array(*[F.struct(F.lit(by).alias("by"), F.col(by).alias(side)) for by in ("kind", "analyzer")]))
    both = e.select(*cols, each.alias("k")).select(*cols, "k.by", f"k.{side}")
    return both.join(F.broadcast(_dictionary(e.sparkSession)), ["by", side])


def _marked(e: DataFrame, side: str, *cols: str) -> DataFrame:
    """The columns of e with by and value, once for each way in which an event can stand on a side of the dictionary."""
    at = 0 if side == "cause" else 1
    values = {"kind": sorted({p[at] for p in PATTERNS}), "analyzer": sorted({p[at] for p in SEQUENCES})}
    ways = [F.when(F.col(by).isin(*known), F.struct(F.lit(by).alias("by"), F.col(by).alias("value"))) for by, known in values.items()]
    return e.select(*cols, F.explode(F.array_compact(F.array(*ways))).alias("w")).select(*cols, "w.by", "w.value")


def _nearest(asks: DataFrame, events: DataFrame, forward: bool) -> DataFrame:
    """asks (scope, slot, by, value, at, tie, most, ...) with `found`, the nearest of events (scope, slot, by, value, at, tie, event)
    that comes before it by (at, tie), or after it if forward, and lies within `most` seconds; asks without one go. An event
    stands in its own slot and in the neighbouring one that may ask for it."""
    slots = F.explode(F.array(F.col("slot"), F.col("slot") + (-1 if forward else 1)))
    both = events.withColumn("slot", slots).withColumn("asks", F.lit(False))
    rows = asks.withColumn("asks", F.lit(True)).unionByName(both, allowMissingColumns=True)
    sort = [F.desc("at"), F.desc("tie")] if forward else [F.asc("at"), F.asc("tie")]
    # Of equal places the one that asks comes first, so it doesn't find itself.
    passed = Window.partitionBy("scope", "slot", "by", "value").orderBy(*sort, F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("found", F.last("event", ignorenulls=True).over(passed)).where("asks").drop("asks", "event")
    return found.where(F.abs(F.col("found.at") - F.col("at")) <= F.col("most"))


def roots(events: DataFrame) -> DataFrame:
    """The grave events that no earlier event explains; if a scope has none, its first event."""
    e = _slotted(events)
    grave = e.where(F.col("level").isin("CRITICAL", "ERROR"))
    causes = _marked(e, "cause", "scope", "slot", "at").select("*", F.lit(1).alias("tie"), F.struct("at").alias("event"))
    asks = _sided(grave, "effect", "scope", "slot", "at", "ord").withColumnRenamed("cause", "value").withColumn("tie", F.lit(0))  # strictly earlier
    caused = _nearest(asks, causes, False).select("scope", "ord").distinct()
    free = events.where(F.col("level").isin("CRITICAL", "ERROR")).join(caused, ["scope", "ord"], "left_anti")
    first = events.groupBy("scope").agg(F.min_by("ord", F.struct("ts", "ord")).alias("ord")).join(free.select("scope").distinct(), "scope", "left_anti")
    return free.unionByName(events.join(first, ["scope", "ord"], "left_semi"))


def successors(events: DataFrame, starts: DataFrame) -> DataFrame:
    """scope, ord, start, x and y (structs of at, ord, analyzer, kind): for each event x the first one after it that it may have
    caused, if any. starts (scope, ord): events that ask once more, with start true, for one of a later time."""
    e = _slotted(events).withColumn("x", F.struct(*_EVENT))
    asks = _sided(e, "cause", "scope", "slot", "at", "ord", "x").withColumnRenamed("effect", "value")
    again = asks.join(starts.select("scope", "ord"), ["scope", "ord"], "left_semi").select("*", F.lit(2**63 - 1).alias("tie"), F.lit(True).alias("start"))
    asks = asks.select("*", F.col("ord").cast("long").alias("tie"), F.lit(False).alias("start")).unionByName(again)
    effects = _marked(e, "effect", "scope", "slot", "at", "ord", "x")
    effects = effects.select("scope", "slot", "by", "value", "at", F.col("ord").cast("long").alias("tie"), F.col("x").alias("event"))
    found = _nearest(asks, effects, True)
    return found.groupBy("scope", "ord", "start").agg(F.first("x").alias("x"), F.min("found").alias("y"))


def _pair_strength(a: Column, b: Column) -> Column:
    out = F.lit(None).cast("double")
    for (cause, effect), s in PATTERNS.items():
        out = F.when((a == cause) & (b == effect), F.lit(s)).otherwise(out)
    return out


def is_causal(cause: Column, effect: Column) -> Column:
    """Whether one event (struct with at, analyzer, kind) might have caused a later one."""
    delta = effect["at"] - cause["at"]
    known = _pair_strength(cause["kind"], effect["kind"]).isNotNull()
    sequence = F.lit(False)
    for a, b in SEQUENCES:
        sequence = sequence | ((cause["analyzer"] == a) & (effect["analyzer"] == b))
    return (delta >= 0) & (delta <= MEDIUM) & (known | (sequence & (delta <= SHORT)))


def strength(cause: Column, effect: Column) -> Column:
    delta = effect["at"] - cause["at"]
    base = F.coalesce(_pair_strength(cause["kind"], effect["kind"]), F.lit(0.5))
    near = F.when(delta <= IMMEDIATE, base * 1.1).when(delta > SHORT, base * 0.8).otherwise(base)
    return F.least(F.lit(1.0), F.when(cause["analyzer"] == effect["analyzer"], near * 1.05).otherwise(near))


def explanation(cause: Column, effect: Column) -> Column:
    delta = effect["at"] - cause["at"]
    known = _pair_strength(cause["kind"], effect["kind"]).isNotNull()
    return (
        F.when(known, F.concat(cause["kind"], F.lit(" → "), effect["kind"], F.lit(" (known pattern)")))
        .when(cause["analyzer"] == effect["analyzer"], F.concat(cause["analyzer"], F.lit(": "), cause["kind"], F.lit(" cascades to "), effect["kind"]))
        .when(delta <= IMMEDIATE, F.concat(cause["kind"], F.lit(" (rapid cascade) → "), effect["kind"], F.lit(" ("), F.format_string("%.1fs", delta), F.lit(")")))
        .otherwise(F.concat(cause["kind"], F.lit(" → "), effect["kind"], F.lit(" ("), F.format_string("%.1fs later", delta), F.lit(")")))
    )


def _ordered(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def _jumps(steps: DataFrame) -> list[DataFrame]:
    """Level k: where 2**k successors from an event lead, and the sum of their strengths and the analyzers on the way; no
    further than a window, as no chain is longer."""
    level = stored(steps, "rca-jumps")
    out = [level]
    while True:
        far = level.select("scope", F.col("ord").alias("to_ord"), F.col("to_ord").alias("far_ord"), F.col("to_at").alias("far_at"), F.col("total").alias("more"), F.col("analyzers").alias("others"))
        both = level.join(far, ["scope", "to_ord"]).where(F.col("far_at") - F.col("at") <= MEDIUM)
        level = stored(both.select("scope", "ord", "at", F.col("far_ord").alias("to_ord"), F.col("far_at").alias("to_at"), (F.col("total") + F.col("more")).alias("total"), _ordered(F.col("analyzers"), F.col("others")).alias("analyzers")), "rca-jumps")
        if level.isEmpty():
            return out
        out.append(level)


def _paths(events: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The roots with the first link of their chains, all links, and the jumps along them."""
    events = stored(events.select("scope", "ord", "ts", "analyzer", "level", "kind"), "rca-events")  # read by every step
    start = stored(roots(events), "rca-roots")
    links = stored(successors(events, start), "rca-links")
    step = links.where("not start").select("scope", "ord", F.col("x.at").alias("at"), F.col("y.ord").alias("to_ord"), F.col("y.at").alias("to_at"), strength(F.col("x"), F.col("y")).alias("total"), F.array("y.analyzer").alias("analyzers"))
    first = links.where("start").select("scope", F.col("ord").alias("root_ord"), "x", "y")
    head = _slotted(start).select("scope", F.col("ord").alias("root_ord"), "at", "analyzer", "level", "kind")
    return head.join(first, ["scope", "root_ord"], "left"), links, _jumps(step)


def chains(events: DataFrame) -> DataFrame:
    """One row per root: incident_id, root's columns, n_links, last_ord, duration_s, analyzers, impact (events), chain_strength.
    Events after the root within the window join if the last that joined may cause them; links() has them one by one."""
    head, _, jumps = _paths(events)
    c = F.col
    some = c("y").isNotNull()
    now = head.select(
        "scope", "root_ord", "at", "analyzer", "level", "kind", F.when(some, 1).otherwise(0).cast("long").alias("n"), F.coalesce("y.ord", "root_ord").alias("last_ord"), F.coalesce("y.at", "at").alias("last_at"),
        F.when(some, strength(c("x"), c("y"))).otherwise(F.lit(0.0)).alias("total"), F.sort_array(F.array_distinct(F.array_compact(F.array("analyzer", "y.analyzer")))).alias("analyzers"))
    going, still = now.where("n > 0"), now.where("n = 0")
    for k in reversed(range(len(jumps))):
        far = jumps[k].select("scope", c("ord").alias("last_ord"), "to_ord", "to_at", c("total").alias("more"), c("analyzers").alias("others"))
        met = going.join(far, ["scope", "last_ord"], "left")
        take = c("to_at").isNotNull() & (c("to_at") - c("at") <= MEDIUM)
        pick = lambda new, old: F.when(take, new).otherwise(c(old)).alias(old)
        going = met.select("scope", "root_ord", "at", "analyzer", "level", "kind", pick(c("n") + 2**k, "n"), pick(c("to_ord"), "last_ord"), pick(c("to_at"), "last_at"), pick(c("total") + c("more"), "total"), pick(_ordered(c("analyzers"), c("others")), "analyzers"))
    return going.unionByName(still).select(
        "scope", _incident(c("analyzer"), c("at")).alias("incident_id"), "root_ord", c("kind").alias("root_kind"), c("analyzer").alias("root_analyzer"), c("level").alias("root_level"),
        c("n").cast("int").alias("n_links"), "last_ord", (c("last_at") - c("at")).alias("duration_s"), "analyzers", (c("n") + 1).alias("impact"), F.when(c("n") > 0, c("total") / c("n")).otherwise(F.lit(0.0)).alias("chain_strength"))


def _incident(analyzer: Column, at: Column) -> Column:
    return F.concat(F.lit("incident_"), analyzer, F.lit("_"), F.floor(at).cast("string"))


def links(events: DataFrame) -> DataFrame:
    """scope, incident_id, root_ord, step (from 1), cause_ord, effect_ord, cause, effect, strength, delta_s, reason: the links of
    each chain. A chain is halved again and again, each half found by its jump, until each row is one link."""
    head, each, jumps = _paths(events)
    c = F.col
    told = lambda a, b: (a["ord"].alias("cause_ord"), b["ord"].alias("effect_ord"), a["kind"].alias("cause"), b["kind"].alias("effect"), strength(a, b).alias("strength"), (b["at"] - a["at"]).alias("delta_s"), explanation(a, b).alias("reason"))
    own = ["scope", "incident_id", "root_ord", "root_at"]
    begin = head.where("y is not null").select("scope", _incident(c("analyzer"), c("at")).alias("incident_id"), "root_ord", c("at").alias("root_at"), "x", "y")
    # Rows of a stretch: from which event, after how many links, and over how many (at most 2**k, cut where the window ends).
    stretch = begin.select(*own, c("y.ord").alias("ord"), F.lit(1).alias("step"))
    for k in reversed(range(len(jumps))):
        far = jumps[k].select("scope", "ord", c("to_ord").alias("next"), "to_at")
        met = stretch.join(far, ["scope", "ord"], "left")
        goes = c("to_at").isNotNull() & (c("to_at") - c("root_at") <= MEDIUM)
        both = F.when(goes, F.array(F.struct("ord", "step"), F.struct(c("next").alias("ord"), (c("step") + 2**k).alias("step")))).otherwise(F.array(F.struct("ord", "step")))
        stretch = met.select(*own, F.explode(both).alias("s")).select(*own, "s.ord", "s.step")
    later = stretch.join(each.where("not start").select("scope", "ord", "x", "y"), ["scope", "ord"]).where(c("y.at") - c("root_at") <= MEDIUM)
    rows = begin.select(*own[:3], F.lit(1).alias("step"), "x", "y").unionByName(later.select(*own[:3], (c("step") + 1).alias("step"), "x", "y"))
    return rows.select(*own[:3], "step", *told(c("x"), c("y")))


def verdict(chains_: DataFrame, sources: DataFrame) -> DataFrame:
    """Per scope: incidents, mean strength, pattern_match_strength and the strongest incident. sources has scope, source."""
    n = sources.groupBy("scope").agg(F.count_distinct("source").alias("sources"))
    agg = chains_.groupBy("scope").agg(F.count(F.lit(1)).alias("incidents"), F.avg("chain_strength").alias("strength"), F.count_if(F.col("n_links") > 1).alias("cascades"), F.count_if(F.size("analyzers") > 1).alias("cross_analyzer"), F.max_by("root_kind", F.struct(F.round("chain_strength", 9), -F.col("root_ord"))).alias("strongest"))
    s = F.col("strength")
    match = F.when((F.col("sources") > 1) & (s > 0.85), "STRONG_PATTERN_MATCH").when((F.col("sources") > 1) & (s > 0.70), "MODERATE_PATTERN_MATCH").otherwise("WEAK")
    return n.join(agg, "scope").select("scope", "sources", "incidents", "strength", "cascades", "cross_analyzer", "strongest", match.alias("pattern_match_strength"))
