"""Queries over findings and causal events rendered from tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as FI
from ..operators import rca
from ..sources.render import log
from ..tables import stored
from .log_sql import q

Q: dict[str, tuple] = {}

#: One expression for both engines: event -> finding.
_COLS = """event_id as ord, 'f' || cast(user_id % 5 as string) as source_file,
  case event_id % 4 when 0 then 'postgresql' when 1 then 'nginx' when 2 then 'docker' else 'api_performance' end as category,
  case k % 10 when 0 then 'deadlock' when 1 then 'connection_exhausted' when 2 then 'timeout' when 3 then 'service_restart' when 4 then 'http_error' when 5 then 'query_slow' when 6 then 'connection_timeout' when 7 then 'memory_spike' when 8 then 'oom_killed' else 'other' end as kind,
  case event_type when 'error' then 'ERROR' when 'purchase' then 'CRITICAL' when 'signup' then 'WARN' else 'INFO' end as level,
  event_type || ' ' || cast(k % 12 as string) as signature, cast(k as bigint) as count, cast(event_id % 4000 as int) as first_line,
  case when event_id % 7 = 0 then null else t end as timestamp, case when k % 3 = 0 then '' else 'sample ' || cast(event_id as string) end as sample,
  case when k % 5 = 0 then null else 'cause ' || cast(k % 4 as string) end as root_cause"""
FINDINGS_SQL = f"""e as (select *, cast(json_extract_string(props, '$.k') as int) as k, strftime(ts, '%Y-%m-%d %H:%M:%S') as t from events), fi as (select {_COLS}, ts from e),
fw as (select *, case level when 'CRITICAL' then 4 when 'ERROR' then 3 when 'WARN' then 2 else 1 end as w from fi)"""


def _findings(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    e = e.withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "t": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")})
    return e.selectExpr(*[x.strip() for x in _split(_COLS)], "ts")


def _split(cols: str) -> list[str]:
    out, depth, held = [], 0, ""
    quoted = False
    for c in cols:
        if c == "'":
            quoted = not quoted
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(held)
                held = ""
                continue
        held += c
    return [*out, held]


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


@query("cluster_by_proximity", f"""with {FINDINGS_SQL}, g as (select source_file, category, first_line // 300 as b, count(*) as members, sum(count)::bigint as n, max(w) as w, min(first_line) as first_line, min(timestamp) as ts, arg_min(kind, ord) as kind, min(ord) as ord,
  arg_min(signature, ord) as sig, arg_max(sample, case when sample <> '' then w * 100000000 - ord end) as smp, max(case when sample <> '' then w end) as sw from fw group by 1, 2, 3)
select ord, source_file, category, kind, case w when 4 then 'CRITICAL' when 3 then 'ERROR' when 2 then 'WARN' else 'INFO' end as level,
  case when members = 1 then sig else case category when 'postgresql' then 'Postgresql' when 'nginx' then 'Nginx' when 'docker' then 'Docker' else 'Api Performance' end || ' incident (' || members || ' variations, ' || n || ' events)' end as signature,
  n, first_line, ts as timestamp, case when sw = w or members = 1 then smp end as sample, members from g""")
def cluster_by_proximity(spark, d):
    c = FI.clustered(_findings(spark, d))
    return c.select("ord", "source_file", "category", "kind", "level", "signature", F.col("count").alias("n"), "first_line", "timestamp", "sample", "members")


@query("cluster_members", f"with {FINDINGS_SQL} select min(ord) over (partition by source_file, category, first_line // 300) as cluster, ord, kind, count as n, level, sample from fw")
def cluster_members(spark, d):
    return FI.cluster_members(_findings(spark, d)).withColumnRenamed("count", "n")


@query("root_cause_members", f"with {FINDINGS_SQL} select coalesce(root_cause, 'unknown') as root_cause, ord, signature, count(*) over (partition by coalesce(root_cause, 'unknown')) as n from fw")
def root_cause_members(spark, d):
    return FI.cause_members(_findings(spark, d))


@query("dedupe_by_signature", f"with {FINDINGS_SQL} select signature, sum(count)::bigint as n, arg_max(level, (w, -ord)) as level, min(ord) as ord from fw group by 1")
def dedupe_by_signature(spark, d):
    return FI.by_signature(_findings(spark, d)).select("signature", F.col("count").alias("n"), "level", "ord")


@query("group_by_root_cause", f"with {FINDINGS_SQL} select coalesce(root_cause, 'unknown') as root_cause, count(*) as n, string_agg(signature, '|' order by ord) as signatures from fw group by 1")
def group_by_root_cause(spark, d):
    return FI.by_root_cause(_findings(spark, d)).select("root_cause", "n", F.array_join("signatures", "|").alias("signatures"))


@query("severity_pivot", f"with {FINDINGS_SQL} select category, " + ", ".join(f"count(*) filter (level = '{x}') as {x}" for x in FI.WEIGHT) + ", count(*) as finding_count from fw group by 1")
def severity_pivot(spark, d):
    return FI.severities(_findings(spark, d))


@query("top_kinds", f"with {FINDINGS_SQL}, g as (select category, kind, count(*) as n, min(ord) as o from fw group by 1, 2) select category, kind, n, cast(row_number() over (partition by category order by n desc, o) as int) as position from g qualify position <= 5")
def top_kinds(spark, d):
    return FI.top_kinds(_findings(spark, d))


@query("per_file_summary", f"with {FINDINGS_SQL} select source_file as file_id, count(*) as line_count, count(*) as incident_count, string_agg(distinct category, ',' order by category) as analyzers_active from fw group by 1")
def per_file_summary(spark, d):
    f = _findings(spark, d)
    return FI.per_file(f, f.select(F.col("source_file").alias("file_id"))).withColumn("analyzers_active", F.array_join("analyzers_active", ","))


@query("multi_file_totals", f"with {FINDINGS_SQL} select count(distinct source_file) as files, count(*) as findings, sum(count)::bigint as events, count(distinct source_file || '/' || category || '/' || (first_line // 300)) as clustered from fw")
def multi_file_totals(spark, d):
    f = _findings(spark, d)
    a = f.agg(F.count_distinct("source_file").alias("files"), F.count(F.lit(1)).alias("findings"), F.sum("count").alias("events"))
    return a.crossJoin(F.broadcast(FI.clustered(f).agg(F.count(F.lit(1)).alias("clustered"))))  # one row each


@query("timeline_sorted", f"with {FINDINGS_SQL} select source_file, first_line as sequence, signature, coalesce(timestamp, 'UNKNOWN') as timestamp, 'WITHIN_FILE' as cross_file_order, ord, cast(row_number() over (order by timestamp is null, timestamp, ord) as int) as position from fw")
def timeline_sorted(spark, d):
    t = FI.numbered_timeline(_findings(spark, d))
    return t.select("source_file", "sequence", "signature", "timestamp", "cross_file_order", F.col("order.d").alias("ord"), F.col("position").cast("int").alias("position"))


@query("timeline_without_stamps", f"with {FINDINGS_SQL} select source_file, first_line as sequence, signature, 'UNKNOWN' as cross_file_order, ord from fw")
def timeline_without_stamps(spark, d):
    f = _findings(spark, d).withColumn("timestamp", F.lit(None).cast("string"))
    return FI.timeline(f).select("source_file", "sequence", "signature", "cross_file_order", F.col("order.d").alias("ord"))


def _events(spark, d):
    return _findings(spark, d).select(F.col("source_file").alias("scope"), "ord", F.date_trunc("second", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"), F.col("category").alias("analyzer"), "level", "kind")


_PAT = "(values " + ", ".join(f"({q(a)}, {q(b)}, {s})" for (a, b), s in rca.PATTERNS.items()) + ") p(cause, effect, s)"
_SEQ = "(values " + ", ".join(f"({q(a)}, {q(b)})" for a, b in rca.SEQUENCES) + ") s(cause, effect)"
_RCA = f"""{FINDINGS_SQL}, ev as (select source_file as scope, ord, epoch(date_trunc('second', ts))::bigint as tm, category as analyzer, level, kind from fw),
pat as (select * from {_PAT}), seq as (select * from {_SEQ}),
caused as (select distinct e.scope, e.ord from ev e join ev o on o.scope = e.scope and o.tm < e.tm and e.tm - o.tm <= 300 where exists (select 1 from pat where cause = o.kind and effect = e.kind) or (e.tm - o.tm <= 30 and exists (select 1 from seq where cause = o.analyzer and effect = e.analyzer))),
roots as (select * from ev where level in ('CRITICAL', 'ERROR') and (scope, ord) not in (select (scope, ord) from caused))"""


@query("rca_roots_antijoin", f"with {_RCA} select scope, ord, kind, analyzer, level from roots")
def rca_roots(spark, d):
    return rca.roots(_events(spark, d)).select("scope", "ord", "kind", "analyzer", "level")


_CHAIN = f"""{_RCA}, pairs as (select a.scope, a.ord as a_ord, b.ord as b_ord, b.tm as b_tm, coalesce((select s from pat where cause = a.kind and effect = b.kind), 0.5) * case when b.tm - a.tm <= 5 then 1.1 when b.tm - a.tm > 30 then 0.8 else 1 end * case when a.analyzer = b.analyzer then 1.05 else 1 end as raw
  from ev a join ev b on a.scope = b.scope and b.tm between a.tm and a.tm + 300 and (b.tm, b.ord) > (a.tm, a.ord) where exists (select 1 from pat where cause = a.kind and effect = b.kind) or (b.tm - a.tm <= 30 and exists (select 1 from seq where cause = a.analyzer and effect = b.analyzer))),
ch as (select scope, ord as root_ord, tm as root_at, ord as last_ord, 0 as n, 0.0::double as total, tm as last_at from roots
  union all select * from (select c.scope, c.root_ord, c.root_at, p.b_ord, c.n + 1, c.total + least(1.0, p.raw)::double, p.b_tm from ch c join pairs p on p.scope = c.scope and p.a_ord = c.last_ord where p.b_tm > c.root_at and p.b_tm - c.root_at <= 300 qualify row_number() over (partition by c.scope, c.root_ord order by p.b_tm, p.b_ord) = 1)),
fin as (select scope, root_ord, max(n)::int as n_links, arg_max(last_ord, n) as last_ord, (max(last_at) - min(root_at))::double as duration_s, arg_max(total, n) as total from ch group by 1, 2)"""


@query("rca_chain", f"with recursive {_CHAIN} select scope, root_ord, n_links, last_ord, duration_s, round(case when n_links > 0 then total / n_links else 0 end, 6) as chain_strength from fin")
def rca_chain(spark, d):
    c = rca.chains(_events(spark, d))
    return c.select("scope", "root_ord", "n_links", "last_ord", "duration_s", F.round("chain_strength", 6).alias("chain_strength"))


@query("rca_verdict", f"""with recursive {_CHAIN}, s as (select count(*) as incidents, avg(case when n_links > 0 then total / n_links else 0 end) as strength, count(*) filter (n_links > 1) as cascades, arg_max(ev.kind, (round(case when n_links > 0 then total / n_links else 0 end, 9), -root_ord)) as strongest from fin join ev on ev.scope = fin.scope and ev.ord = root_ord)
select 'all' as scope, 5::bigint as sources, incidents, round(strength, 6) as strength, cascades, strongest, case when strength > 0.85 then 'STRONG_PATTERN_MATCH' when strength > 0.7 then 'MODERATE_PATTERN_MATCH' else 'WEAK' end as pattern_match_strength from s""")
def rca_verdict(spark, d):
    e = _events(spark, d)
    c = rca.chains(e).withColumn("scope", F.lit("all"))
    v = rca.verdict(c, e.select(F.lit("all").alias("scope"), F.col("scope").alias("source")))
    return v.select("scope", "sources", "incidents", F.round("strength", 6).alias("strength"), "cascades", "strongest", "pattern_match_strength")


@query("rca_explanations", f"""with recursive {_CHAIN}, l as (select c.scope, c.root_ord, p.last_ord as a_ord, c.last_ord as b_ord from ch c join ch p on p.scope = c.scope and p.root_ord = c.root_ord and p.n = c.n - 1 where c.n > 0)
select l.scope, 'incident_' || r.analyzer || '_' || r.tm as incident_id, a.kind as cause, b.kind as effect, round(least(1.0, p.raw)::double, 4) as strength, (b.tm - a.tm)::double as delta_s,
  case when exists (select 1 from pat where cause = a.kind and effect = b.kind) then a.kind || ' → ' || b.kind || ' (known pattern)' when a.analyzer = b.analyzer then a.analyzer || ': ' || a.kind || ' cascades to ' || b.kind
    when b.tm - a.tm <= 5 then a.kind || ' (rapid cascade) → ' || b.kind || ' (' || printf('%.1fs', (b.tm - a.tm)::double) || ')' else a.kind || ' → ' || b.kind || ' (' || printf('%.1fs later', (b.tm - a.tm)::double) || ')' end as reason
from l join ev r on r.scope = l.scope and r.ord = l.root_ord join ev a on a.scope = l.scope and a.ord = l.a_ord join ev b on b.scope = l.scope and b.ord = l.b_ord join pairs p on p.scope = l.scope and p.a_ord = l.a_ord and p.b_ord = l.b_ord""")
def rca_explanations(spark, d):
    c = rca.links(_events(spark, d))
    return c.select("scope", "incident_id", "cause", "effect", F.round("strength", 4).alias("strength"), "delta_s", "reason")


@query("log_incidents", None)
def log_incidents(spark, d):
    """Event groups and the findings of the families that run by default, over the operations log, in order of weight."""
    from ..operators import events as E
    from ..operators import families as FA

    lines = stored(log(spark, d, "ops").select("file_id", "line_no", "line"), "log-lines")
    found = FA.findings(lines).select("file_id", "kind", "level", "category", "count", "first_line", "signature")
    return E.incidents(E.grouped(E.events(lines)).drop("codes", "causes", "exception_chain"), found)
