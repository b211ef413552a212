"""The training-data queries: each applies one operator to its whole table; and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, lm, manifest, mixing, quality, rules, simhash, spelling, substrings, topk, warc
from .common import held_out_col, table


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents")).drop("spans")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identified(docs)
    return found.select("doc_id", held_out_col(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), payload=False)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h").distinct()


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's crc32 is even are checked against a text without its line ends."""
    text = F.col("text")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    return manifest.audited(table(spark, sf_dir, "documents"), {"text": changed})


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents"), spelling.slipped))


def queries() -> dict:
    return {
        "op1_substrings": op1_substrings,
        "op2_langid": op2_langid,
        "op3_warc": op3_warc,
        "op4_lm": op4_lm,
        "op5_quality": op5_quality,
        "op6_rules": op6_rules,
        "op7_mixing": op7_mixing,
        "op8_licenses": op8_licenses,
        "op9_decontaminate": op9_decontaminate,
        "op10_simhash": op10_simhash,
        "op11_topk": op11_topk,
        "op12_manifest": op12_manifest,
        "op13_spelling": op13_spelling,
    }


_STOP = ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS)))
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP6_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
        list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {_SPACES}, '')) > 0) as ls from d),
win as (select r, unnest(range(1, len(ws) - 6)) as i, ws from w),
h as (select r, i, array_to_string(ws[i:i + 7], ' ') as g from win),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as c from h) where c > 1),
rep as (select r, sum(least(8, i - coalesce(p, i - 8)))::bigint as n from (select r, i, lag(i) over (partition by r order by i) as p from again) group by r),
m as (select w.r, doc_id, len(ws)::bigint as n_words, length(translate(t, {_SPACES}, ''))::bigint as word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines,
        len(list_filter(ws, lambda x: lower(translate(x, '.,;:!?"''()', '')) in ({_STOP})))::bigint as n_stop
      from w left join rep on rep.r = w.r),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop, base_failed,
  not base_failed and word_chars >= 1.5 * n_words and word_chars <= 25.0 * n_words and n_symbols <= 0.1::double * n_words
  and n_dup_lines <= 0.3::double * n_lines and n_stop >= 0.02::double * n_words as kept
from f
"""


OP3_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as n, sha256(html) as digest from p),
f as (select *, min(page_id) over (partition by digest) as first from d)
select page_id, n as payload_bytes, digest as payload_digest,
  case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to
from f
"""


OP11_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.r <> c.r where q.vec_id % 50 = 0)
select query_id, row_number() over (partition by r order by score desc, vec_id)::integer as rank, vec_id, score
from s qualify rank <= 5
"""


def _crc32(text: str) -> str:
    """SQL for the crc32 of the UTF-8 bytes of a text of characters under U+0100."""
    bits = "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    octets = "case when unicode(ch) < 128 then [unicode(ch)] else [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] end"
    each = f"flatten(list_transform(string_split({text}, ''), lambda ch: {octets}))::bigint[]"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {each}), lambda c, x: {bits}), 4294967295)"


def _leaf(text: str) -> str:
    fields = (f"coalesce(octet_length(encode({f}::varchar)) || ':' || {f}::varchar, '-')" for f in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(fields)})"


OP12_SQL = f"""
with recursive
c as (select *, case when {_crc32("doc_id::varchar")} % 2 = 0 then replace(text, chr(10), '') else text end as other from documents),
l as (select row_number() over () as r, doc_id, source, {_leaf("text")} as leaf, {_leaf("other")} as changed from c),
n as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as size from l),
t as (
  select source, 0 as level, idx, leaf as h, size from n
  union all
  select source, level + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (size + 2) // 3 from t where size > 1
  group by source, level, idx // 3, size),
s as (select source, h as subroot, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as size from t where size = 1),
u as (
  select 0 as level, idx, subroot as h, size from s
  union all
  select level + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (size + 2) // 3 from u where size > 1 group by level, idx // 3, size),
p as (
  select r, source, 0 as level, idx, size, '' as proof, changed as now from n
  union all
  select p.r, any_value(p.source), p.level + 1, p.idx // 3, (p.size + 2) // 3,
    any_value(p.proof) || coalesce(string_agg(t.h, '' order by t.idx) filter (t.idx <> p.idx), ''),
    sha256(string_agg(case when t.idx = p.idx then p.now else t.h end, '' order by t.idx))
  from p join t on t.source is not distinct from p.source and t.level = p.level and t.idx // 3 = p.idx // 3
  where p.size > 1 group by p.r, p.level, p.idx, p.size),
q as (
  select p.r, 0 as level, s.idx, s.size, p.proof, p.now from p join s on s.source is not distinct from p.source where p.size = 1
  union all
  select q.r, q.level + 1, q.idx // 3, (q.size + 2) // 3,
    any_value(q.proof) || coalesce(string_agg(u.h, '' order by u.idx) filter (u.idx <> q.idx), ''),
    sha256(string_agg(case when u.idx = q.idx then q.now else u.h end, '' order by u.idx))
  from q join u on u.level = q.level and u.idx // 3 = q.idx // 3
  where q.size > 1 group by q.r, q.level, q.idx, q.size)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, now as folded_root, now = root as verified
from n join q on q.r = n.r and q.size = 1 join s on s.source is not distinct from n.source
  cross join (select h as root from u where size = 1)
"""


_RUN = "[A-Za-zÀ-ÿ]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP13_SQL = f"""
with recursive
d as (select doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_RUN}')) as run from documents),
e as (select doc_id, run, count(*) as c from d group by all),
f as (select run, c, {_crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from e where length(run) >= 6),
g as (select case when h % 199 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, c from f),
w as (select word, sum(c)::bigint as n from g where length(word) >= 6 group by word having sum(c) >= 5),
i as (select word, n, unnest(range(length(word))) as p from w),
hole as (select word, n, p, word[:p] || word[p + 2:] as rest from i),
pair as (
  select a.word as s, b.word as r from hole a join hole b on a.p = b.p and a.rest = b.rest and a.word <> b.word
  union select hole.word, w.word from hole join w on hole.rest = w.word
  union select w.word, hole.word from hole join w on hole.rest = w.word),
near as (select s, r, w.n as r_n, count(*) over (partition by s) as n_near, row_number() over (partition by s order by w.n desc, r) as k from pair join w on w.word = r),
best as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when r_n >= 5 * w.n then r end as form, case when r_n >= 5 * w.n then r_n end as form_n
  from w left join near on s = w.word and k = 1),
chain as (select word, word as root, form from best union all select chain.word, chain.form, best.form from chain join best on best.word = chain.form)
select best.word, best.form, root, n, n_near, form_n from best join chain on chain.word = best.word and chain.form is null
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op6_rules": OP6_SQL, "op11_topk": OP11_SQL, "op12_manifest": OP12_SQL, "op13_spelling": OP13_SQL}
