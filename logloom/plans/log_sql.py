"""SQL of the log queries for the checking engine, written apart from the operators that it checks."""

from __future__ import annotations

from ..functions import records as R
from ..operators.family_rules import FAMILIES, SSH_RULES, Family, Signal
from ..sources.render import log_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_B = rf"(?i)^\[({R.LEVELS})\](.*)$"
_A = rf"^\s+({R.LEVELS})\b"
_AB = rf"(?i)^\s*\[({R.LEVELS}|NOTICE)\](.*)$"
_BARE = r"^(ERROR|FATAL|SEVERE|CRITICAL)(?:[:\s]|$)"


def rec_sql(name: str) -> str:
    """Common table expressions e, lines and rec (line, s, ls, stamp, after, style, level, rest, is_new) of a log."""
    norm = "case upper({0}) when 'WARNING' then 'WARN' when 'NOTICE' then 'INFO' else upper({0}) end"
    x = lambda c, p, g: f"regexp_extract({c}, {q(p)}, {g})"
    m = lambda c, p: f"regexp_matches({c}, {q(p)})"
    return f"""{log_sql(name)},
a as (select *, regexp_replace(line, '^\\s+', '') as ls, regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', '') as s from lines),
b as (select *, case when {m("ls", rf"(?i)^[[](?:{R.STAMP})[^]]*[]]")} then {x("ls", rf"(?i)^([[](?:{R.STAMP})[^]]*[]])", 1)}
  when ls not like '[%' and {m("ls", rf"(?i)^(?:{R.STAMP})")} then {x("ls", rf"(?i)^({R.STAMP})", 1)} end as stamp from a),
c as (select *, substr(ls, length(stamp) + 1) as after from b),
d as (select *, case when s = '' then 'blank' when {m("s", _B)} then 'bracket' when stamp is not null and {m("after", _A)} then 'timestamped'
  when stamp is not null and {m("after", _AB)} then 'timestamp_bracket' when stamp is not null then 'stamp' when {m("s", _BARE)} then 'bare' else 'none' end as st from c),
rec as (select file_id, line_no, line, s, ls, stamp, after, case when st in ('bracket', 'timestamped', 'timestamp_bracket', 'bare') then st end as style, st not in ('blank', 'none') as is_new,
  case st when 'bracket' then {norm.format(x("s", _B, 1))} when 'timestamped' then {norm.format(x("after", _A, 1))} when 'timestamp_bracket' then {norm.format(x("after", _AB, 1))} when 'bare' then {norm.format(x("s", _BARE, 1))} end as level,
  case st when 'bracket' then {x("s", _B, 2)} when 'timestamped' then regexp_replace(after, {q(_A)}, '') when 'timestamp_bracket' then {x("after", _AB, 2)} when 'bare' then regexp_replace(s, {q(_BARE)}, '') end as rest from d)"""


LEVEL = f"""case when level is not null then level when not regexp_matches(regexp_replace(coalesce(after, ls), '^\\s+', ''), {q("^" + R.VENDOR)}) and regexp_matches(line, {q(rf"(?i)\b({R.LEVELS}):")})
  then case upper(regexp_extract(line, {q(rf"(?i)\b({R.LEVELS}):")}, 1)) when 'WARNING' then 'WARN' else upper(regexp_extract(line, {q(rf"(?i)\b({R.LEVELS}):")}, 1)) end end"""
_V, _VH = rf"\b{R.VENDOR}", rf"^{R.VENDOR}"
CODE = f"""nullif(case when level is not null then regexp_extract(rest, {q(_V)}, 1) when stamp is not null then regexp_extract(after, {q(_V)}, 1) else regexp_extract(ls, {q(_VH)}, 1) end, '')"""
AUX = "list_concat(" + ", ".join(f"regexp_extract_all(line, {q('(?i)' + p)}, 1)" for p in R.AUX_CODES) + ")"

#: Error events of the app log: which lines belong to which, as a running state.
EVENTS = f"""{rec_sql("app")},
k as (select *, case when level in ('ERROR', 'FATAL', 'SEVERE', 'CRITICAL') then case when style = 'bracket' and (trim(rest) = '' or regexp_matches(trim(rest), {q(R.MAVEN_ADVISORY)})) then 'advice' when style = 'bracket' then 'bracket' else 'start' end
  when is_new then 'break' when s = '' or regexp_matches(s, '(?i)^(Caused by|Suppressed):\\s+.+$') or regexp_matches(s, {q(R.STACK_AT)}) or regexp_matches(s, {q(R.EXCEPTION_HEAD)}) or regexp_matches(line, '^[ \\t]') then null else 'break' end as kind from rec),
l as (select *, last_value(kind ignore nulls) over (partition by file_id order by line_no rows between unbounded preceding and 1 preceding) as before from k),
o as (select *, kind is not null and not (kind = 'advice' and coalesce(before in ('advice', 'bracket'), false)) as marks from l),
p as (select *, last_value(case when marks then line_no end ignore nulls) over (partition by file_id order by line_no) as start_line from o),
ev as (select p.*, h.kind as opened, h.style as h_style, h.level as h_level from p join p h on h.file_id = p.file_id and h.line_no = p.start_line where h.kind <> 'break' and p.line_no - p.start_line < 500)"""


def signal_sql(s: Signal, f: Family) -> str:
    """A condition on `line` for a signal."""
    tests = []
    if s.words:
        tests.append("(" + " or ".join(f"contains({'line' if s.exact else 'lower(line)'}, {q(w if s.exact else w.lower())})" for w in s.words) + ")")
    if s.pattern:
        tests.append(f"regexp_matches(line, {q(s.pattern)})")
    if s.ratio:
        tests.append(f"regexp_matches(line, {q(s.ratio)}) and try_cast(regexp_extract(line, {q(s.ratio)}, 1) as bigint) >= try_cast(regexp_extract(line, {q(s.ratio)}, 2) as bigint)")
    tests += [f"contains(lower(line), {q(w)})" for w in s.also] + [f"regexp_matches(line, {q(p)})" for p in s.also_any] + [f"not regexp_matches(line, {q(p)})" for p in s.never]
    if s.least_value is not None:
        tests.append(f"{value_sql(s)} >= {s.least_value}")
    if s.below is not None:
        tests.append(f"{value_sql(s)} < {s.below}")
    by = {x.name: x for x in f.signals}
    tests += [f"not ({signal_sql(by[o], f)})" for o in s.after]
    return "coalesce(" + " and ".join(tests) + ", false)"


def value_sql(s: Signal) -> str:
    if not s.value:
        return "null::double"
    groups = s.value.count("(") - s.value.count("(?") - s.value.count(r"\(")
    return f"case when regexp_matches(line, {q(s.value)}) then try_cast(regexp_extract(line, {q(s.value)}, {groups}) as double) end"


def family_sql(f: Family, log: str) -> str:
    hint = " or ".join([f"contains(lower(line), {q(w)})" for w in f.hint] + ([f"regexp_matches(line, {q(f.hint_pattern)})"] if f.hint_pattern else []))
    rows = []
    for s in f.signals:
        tries = ", ".join([f"case when regexp_matches(line, {q(p)}) then regexp_extract(line, {q(p)}, 1) end" for p in s.entity] + [q(s.default_entity) if s.default_entity else "null"])
        rows.append(f"select file_id, line_no, {q(s.name)} as signal, coalesce({tries})::varchar as entity, {value_sql(s)} as value from hinted where {signal_sql(s, f)}")
    found = []
    for x in f.findings:
        names = ", ".join(q(s) for s in x.signals)
        count = "count(*)"
        if x.distinct:
            d = ", ".join(q(s) for s in x.distinct)
            count = f"count(distinct case when signal in ({d}) then signal || entity end) + count(case when signal not in ({d}) or entity is null then 1 end)"
        group = ", entity" if x.per else ""
        listed = "string_agg(distinct entity, ',' order by entity)" if not x.suspects else f"(select string_agg(entity, ',' order by entity) from (select entity from sig z where z.file_id = sig.file_id and z.signal in ({names}) group by entity having count(*) >= {x.suspects}))"
        level = q(x.level) if not x.over else f"case when (select max(value) from sig z where z.file_id = sig.file_id and z.signal = {q(x.over[1])}) > {x.over[0]} then 'CRITICAL' else {q(x.level)} end"
        top = f"(select array_to_string(list_slice(list(entity order by n desc, f, entity), 1, {x.top}), ',') from (select entity, count(*) as n, min(line_no) as f from sig z where z.file_id = sig.file_id and z.signal in ({names}) and entity is not null group by entity))" if x.top else "null::varchar"
        unless = f"and file_id not in (select file_id from sig where signal = {q(x.unless)})" if x.unless else ""
        found.append(
            f"select file_id, {q(x.kind)} as kind, {level} as level, {q(x.category)} as category, ({count})::bigint as n, min(line_no) as first_line, {'entity' if x.per else 'null::varchar'} as entity, coalesce({listed}, '') as entities, {top} as top_entities, string_agg(distinct signal, ',' order by signal) as classes, "
            f"printf('%.3f', avg(value)) as avg_value, printf('%.3f', max(value)) as max_value, printf('%.3f', list_sort(list(value) filter (value is not null))[floor(0.95 * count(value))::int + 1]) as p95_value from sig where signal in ({names}) {'and entity is not null' if x.per else ''} {unless} group by file_id{group} having ({count}) >= {x.least}"
        )
    return f"with {log_sql(log)}, hinted as (select * from lines where {hint}), sig as ({' union all '.join(rows)}) " + " union all ".join(found)


SSH_RULE = "case " + " ".join(f"when regexp_matches(body, {q(p)}) then {q(k)}" for p, _, _, k in SSH_RULES) + " end"
SSH_CATEGORY = "case " + " ".join(f"when regexp_matches(body, {q(p)}) then {q(c)}" for p, _, c, _ in SSH_RULES) + " end"
_IP = r"((?:\d{1,3}\.){3}\d{1,3})"
SSH = f"""{log_sql("auth")},
r as (select *, regexp_extract(line, '\\bsshd\\[(\\d+)\\]', 1) as pid, line as body, regexp_extract(line, {q(rf"(?i)^((?:{R.MONTHS}) +\d+ {R.TIME})")}, 1) as stamp,
  coalesce(nullif(regexp_extract(line, {q(rf"(?i)\bfrom {_IP}")}, 1), ''), nullif(regexp_extract(line, {q(rf"(?i)\bclosed by {_IP}")}, 1), '')) as ip,
  coalesce(nullif(regexp_extract(line, '(?i)invalid user\\s+(\\S+)', 1), ''), nullif(regexp_extract(line, '(?i)Failed password for (\\S+) from', 1), '')) as usr from lines where contains(line, 'sshd[')),
z as (select *, {SSH_RULE} as kind, {SSH_CATEGORY} as category from r),
sess as (select file_id, pid, min(line_no) as first_line, arg_max(ip, line_no) as ip, arg_max(usr, line_no) as usr, arg_max(stamp, line_no) as stamp, string_agg(distinct kind, ',' order by kind) as kinds, arg_max(category, line_no) as category from z group by file_id, pid having count(kind) > 0),
lev as (select *, case when contains(kinds, 'error') then 'ERROR' else 'WARN' end as level from sess)"""
