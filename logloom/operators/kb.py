"""The knowledge base as relations: articles, cases, tags, links and revisions, and what is asked of them.

Tables are DataFrames with the columns of SCHEMAS; changes give new DataFrames, to be written beside the old ones and
swapped in, so a reader never sees half a change.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import positioned

SCHEMAS = {
    "articles": "id string, display_id_seq int, title string, summary string, content string, status string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "cases": "id string, display_id_seq int, title string, summary string, content string, analyze_snapshot string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "tags": "id string, name string",
    "article_tags": "article_id string, tag_id string",
    "case_tags": "case_id string, tag_id string",
    "article_relations": "article_id string, related_article_id string",
    "case_articles": "case_id string, article_id string",
    "finding_links": "article_id string, finding_code string",
    "revisions": "id string, article_id string, case_id string, content string, version int, created_at timestamp_ntz, created_by string, change_note string",
}


@dataclass(frozen=True)
class KnowledgeBase:
    articles: DataFrame
    cases: DataFrame
    tags: DataFrame
    article_tags: DataFrame
    case_tags: DataFrame
    article_relations: DataFrame
    case_articles: DataFrame
    finding_links: DataFrame
    revisions: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> KnowledgeBase:
        return KnowledgeBase(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})

    @staticmethod
    def read(spark: SparkSession, folder: str) -> KnowledgeBase:
        return KnowledgeBase(**{n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in SCHEMAS.items()})

    def write(self, folder: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{folder}/{f.name}")


def display_id(seq: Column, prefix: str = "AN") -> Column:
    return F.format_string(f"{prefix}%08d", seq)


def sequence_of(text: Column, prefix: str = "AN") -> Column:
    """The number of a display id, in any case; null if the text is none."""
    return F.when(F.upper(text).rlike(rf"^{prefix}\d{{8}}$"), F.substring(text, len(prefix) + 1, 8).try_cast("int"))


def with_details(kb: KnowledgeBase) -> DataFrame:
    """Articles with display_id and their tags, finding codes and related articles, each sorted."""
    tags = kb.article_tags.join(kb.tags, F.col("tag_id") == F.col("id")).groupBy("article_id").agg(F.sort_array(F.collect_set("name")).alias("tags"))
    codes = kb.finding_links.groupBy("article_id").agg(F.sort_array(F.collect_set("finding_code")).alias("finding_codes"))
    near = kb.article_relations.groupBy("article_id").agg(F.sort_array(F.collect_set("related_article_id")).alias("related"))
    out = kb.articles.withColumn("display_id", display_id(F.col("display_id_seq")))
    for x in (tags, codes, near):
        out = out.join(x.withColumnRenamed("article_id", "id"), "id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("tags", "finding_codes", "related")})


def active(articles: DataFrame) -> DataFrame:
    return articles.where("status = 'active'").orderBy(F.desc("updated_at"), "id")


def page(rows: DataFrame, number: int, size: int = 10) -> DataFrame:
    """Page number (from 1) of ordered rows."""
    return rows.offset((number - 1) * size).limit(size)


def search(kb: KnowledgeBase, query: str, limit: int = 20) -> DataFrame:
    """A display id finds its article; other words are looked for in titles, summaries, texts and tags of active
    articles, whatever their case, latest first."""
    words = (query or "").strip()
    rows = with_details(kb)
    if not words:
        return rows.limit(0)
    if len(words) == 10 and words[:2].upper() == "AN" and words[2:].isdigit():
        return rows.where(F.col("display_id_seq") == int(words[2:]))
    low = F.lit(words.lower())
    has = reduce(Column.__or__, [F.contains(F.lower(F.coalesce(c, F.lit(""))), low) for c in ("title", "summary", "content")]) | F.exists("tags", lambda t: F.contains(F.lower(t), low))
    return active(rows.where(has)).limit(limit)


def by_tag(kb: KnowledgeBase, name: str) -> tuple[DataFrame, DataFrame]:
    """The articles and the cases that have a tag."""
    tag = kb.tags.where(F.col("name") == name).select(F.col("id").alias("tag_id"))
    a = kb.article_tags.join(tag, "tag_id").select(F.col("article_id").alias("id"))
    c = kb.case_tags.join(tag, "tag_id").select(F.col("case_id").alias("id"))
    return kb.articles.join(a, "id", "left_semi"), kb.cases.join(c, "id", "left_semi")


#: Letters of a kind that are joined on.
_GRAM = 3


def _grams(text: Column, *sizes: int) -> Column:
    """The distinct runs of so many letters of a text."""
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in sizes]
    return F.array_distinct(F.concat(*runs))


def containing(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """kind, article_id, updated_at: the texts (article_id, updated_at, t) that have a kind (kind, not empty), whatever its case.

    A text that has a kind has the kind's rarest run of letters (a kind of fewer letters is its own), so only those are joined
    on, and texts are counted for the runs of kinds first. What is joined and shuffled is runs and ids; each text meets
    the few kinds that it may have by its id, once.
    """
    low = kinds.select("kind", F.lower("kind").alias("low")).distinct()
    own = F.when(F.length("low") < _GRAM, F.array("low")).otherwise(_grams(F.col("low"), _GRAM))
    of_kinds = low.select("kind", F.explode(own).alias("gram"))
    runs = texts.select("article_id", F.explode(_grams(F.col("t"), *range(1, _GRAM + 1))).alias("gram"))
    runs = runs.join(of_kinds.select("gram").distinct(), "gram", "left_semi")
    often = runs.groupBy("gram").agg(F.count("article_id").alias("n"))
    # A kind with a run that no text has is in no text.
    rarest = of_kinds.join(often, "gram", "left").groupBy("kind").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    may = runs.join(rarest.where("m.n > 0").select("kind", F.col("m.gram").alias("gram")), "gram").select("article_id", "kind")
    return texts.join(may, "article_id").where(F.contains("t", F.lower("kind"))).select("kind", "article_id", "updated_at")


def for_findings(kb: KnowledgeBase, findings: DataFrame, limit: int = 5, per_kind: int = 3) -> DataFrame:
    """Per finding (finding_id, finding_code, kind) the first articles by id that are linked to its code or whose text
    has its kind: of the latter the latest per_kind."""
    linked = findings.join(kb.finding_links, "finding_code").select("finding_id", "article_id")
    kinds = findings.where("coalesce(kind, '') <> ''").select("kind").distinct()
    texts = kb.articles.where("status = 'active'").select(F.col("id").alias("article_id"), "updated_at", F.lower(F.concat_ws(" ", "title", "summary", "content")).alias("t"))
    w = Window.partitionBy("kind").orderBy(F.desc("updated_at"), "article_id")
    said = containing(texts, kinds).withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_kind).select("kind", "article_id")
    both = linked.union(findings.join(said, "kind").select("finding_id", "article_id")).distinct()
    first = Window.partitionBy("finding_id").orderBy("article_id")
    return both.withColumn("position", F.row_number().over(first)).where(F.col("position") <= limit)


def next_sequence(table: DataFrame, column: str = "display_id_seq") -> int:
    return (table.agg(F.max(column)).first()[0] or 0) + 1


def numbered(rows: DataFrame) -> DataFrame:
    """Rows without a display number get stable ones by creation, after the highest there is."""
    top = rows.agg(F.coalesce(F.max("display_id_seq"), F.lit(0)).alias("top"))
    new = positioned(rows.where("display_id_seq is null"), ["created_at", "id"], "n")
    new = new.crossJoin(F.broadcast(top)).withColumn("display_id_seq", (F.col("n") + F.col("top")).cast("int")).drop("n", "top")
    return rows.where("display_id_seq is not null").unionByName(new)


def updated(kb: KnowledgeBase, changes: DataFrame) -> KnowledgeBase:
    """changes: id, title, summary, content, updated_at, change_note. The old content of each article that changes becomes
    its next revision."""
    old = kb.articles.join(changes.select("id", "change_note", F.col("updated_at").alias("at")), "id")
    top = kb.revisions.groupBy("article_id").agg(F.max("version").alias("top"))
    rev = old.join(top, F.col("id") == F.col("article_id"), "left")
    version = (F.coalesce("top", F.lit(0)) + 1).cast("int")
    rev = rev.select(F.concat("id", F.lit("#"), version.cast("string")).alias("id"), F.col("id").alias("article_id"), F.lit(None).cast("string").alias("case_id"), "content", version.alias("version"), F.col("at").alias("created_at"), F.lit(None).cast("string").alias("created_by"), "change_note")
    c = changes.select("id", *[F.col(x).alias(f"n_{x}") for x in ("title", "summary", "content", "updated_at")])
    rows = kb.articles.join(c, "id", "left")
    rows = rows.select(*[F.coalesce(f"n_{x}", x).alias(x) if x in ("title", "summary", "content", "updated_at") else F.col(x) for x in kb.articles.columns])
    return replace(kb, articles=rows, revisions=kb.revisions.unionByName(rev))


def restored(kb: KnowledgeBase, article_id: str, version: int) -> KnowledgeBase:
    """The article with the content of a revision; no new revision is made."""
    r = kb.revisions.where((F.col("article_id") == article_id) & (F.col("version") == version)).select(F.col("article_id").alias("id"), F.col("content").alias("old"))
    rows = kb.articles.join(F.broadcast(r), "id", "left").withColumn("content", F.coalesce("old", "content")).select(*kb.articles.columns)  # one revision
    return replace(kb, articles=rows)


def without(kb: KnowledgeBase, ids: DataFrame) -> KnowledgeBase:
    """The base without the articles of ids (id) and without all that hangs on them."""
    gone = ids.select(F.col("id").alias("gone"))
    cut = lambda t, *cols: reduce(lambda x, c: x.join(gone, x[c] == gone["gone"], "left_anti"), cols, t)
    return replace(
        kb,
        articles=cut(kb.articles, "id"),
        article_tags=cut(kb.article_tags, "article_id"),
        article_relations=cut(kb.article_relations, "article_id", "related_article_id"),
        case_articles=cut(kb.case_articles, "article_id"),
        finding_links=cut(kb.finding_links, "article_id"),
        revisions=cut(kb.revisions, "article_id"),
    )


def imported(kb: KnowledgeBase, incoming: DataFrame, mode: str = "new") -> tuple[DataFrame, DataFrame]:
    """What becomes of incoming articles (id, title, ...): the rows to add, and the conflicts.

    Conflicts are ids that exist. skip leaves them out; new and replace add them under a new id (an article is never
    overwritten by an import).
    """
    if mode not in ("new", "replace", "skip"):
        raise ValueError(f"unknown mode {mode!r}")
    have = kb.articles.select("id").withColumn("known", F.lit(True))
    rows = incoming.join(have, "id", "left").withColumn("conflict", F.coalesce("known", F.lit(False))).drop("known")
    conflicts = rows.where("conflict").select(F.lit("article").alias("type"), "id", "title")
    add = rows.where("not conflict") if mode == "skip" else rows.withColumn("id", F.when(F.col("conflict"), F.concat(F.lit("import-"), F.sha2("id", 256))).otherwise(F.col("id")))
    return add.drop("conflict"), conflicts


def created(kb: KnowledgeBase, rows: DataFrame) -> KnowledgeBase:
    """The base with new active articles: rows has id, title, summary, content, created_at. They get the display numbers after
    the highest there is, in order of creation; an id that exists is left out."""
    new = rows.join(kb.articles.select("id"), "id", "left_anti")
    return replace(kb, articles=kb.articles.unionByName(_continued(kb.articles, new.withColumn("status", F.lit("active")))))


def cases_created(kb: KnowledgeBase, rows: DataFrame) -> KnowledgeBase:
    """The base with new cases: rows has id, title, summary, content, analyze_snapshot, created_at; numbered as articles are."""
    new = rows.join(kb.cases.select("id"), "id", "left_anti")
    return replace(kb, cases=kb.cases.unionByName(_continued(kb.cases, new)))


def _continued(table: DataFrame, new: DataFrame) -> DataFrame:
    top = table.agg(F.coalesce(F.max("display_id_seq"), F.lit(0)).alias("top"))  # one row
    rows = positioned(new, ["created_at", "id"], "n").crossJoin(F.broadcast(top)).withColumn("display_id_seq", (F.col("n") + F.col("top")).cast("int")).withColumn("updated_at", F.col("created_at"))
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in table.dtypes])


def cases_updated(kb: KnowledgeBase, changes: DataFrame) -> KnowledgeBase:
    """changes: id, title, summary, content, updated_at, change_note; what is null stays. The old content of a case that
    changes becomes its next revision."""
    top = kb.revisions.where("case_id is not null").groupBy(F.col("case_id").alias("_c")).agg(F.max("version").alias("top"))
    old = kb.cases.join(changes.select("id", "change_note", F.col("updated_at").alias("at")), "id").join(top, F.col("id") == F.col("_c"), "left")
    version = (F.coalesce("top", F.lit(0)) + 1).cast("int")
    rev = old.select(F.concat("id", F.lit("#"), version.cast("string")).alias("id"), F.lit(None).cast("string").alias("article_id"), F.col("id").alias("case_id"), "content", version.alias("version"), F.col("at").alias("created_at"), F.lit(None).cast("string").alias("created_by"), "change_note")
    c = changes.select("id", *[F.col(x).alias(f"n_{x}") for x in ("title", "summary", "content", "updated_at")])
    rows = kb.cases.join(c, "id", "left").select(*[F.coalesce(f"n_{x}", x).alias(x) if x in ("title", "summary", "content", "updated_at") else F.col(x) for x in kb.cases.columns])
    return replace(kb, cases=rows, revisions=kb.revisions.unionByName(rev))


def without_cases(kb: KnowledgeBase, ids: DataFrame) -> KnowledgeBase:
    """The base without the cases of ids (id) and without their tags, articles' links and revisions."""
    gone = ids.select(F.col("id").alias("gone"))
    cut = lambda t, c: t.join(gone, t[c] == gone["gone"], "left_anti")
    return replace(kb, cases=cut(kb.cases, "id"), case_tags=cut(kb.case_tags, "case_id"), case_articles=cut(kb.case_articles, "case_id"), revisions=cut(kb.revisions, "case_id"))


def tagged(kb: KnowledgeBase, wanted: DataFrame, of: str = "article") -> KnowledgeBase:
    """The base in which the articles (or cases) of wanted (id, names: array) have exactly those tags; tags that don't exist
    yet are made, once per name, and a tag keeps its id whoever has it."""
    links, column = (kb.article_tags, "article_id") if of == "article" else (kb.case_tags, "case_id")
    names = wanted.select("id", F.explode(F.array_distinct(F.filter("names", lambda n: F.trim(n) != ""))).alias("name"))
    made = names.select("name").distinct().join(kb.tags, "name", "left_anti").select(F.concat(F.lit("tag-"), F.sha2("name", 256)).alias("id"), "name")
    tags = kb.tags.unionByName(made)
    new = names.join(tags.withColumnRenamed("id", "tag_id"), "name").select(F.col("id").alias(column), "tag_id")
    kept = links.join(wanted.select(F.col("id").alias(column)), column, "left_anti").unionByName(new)
    return replace(kb, tags=tags, **{f"{of}_tags": kept})


def revisions_of(kb: KnowledgeBase, id_: str, of: str = "article") -> DataFrame:
    """The revisions of an article or case, latest first."""
    return kb.revisions.where(F.col(f"{of}_id") == id_).orderBy(F.desc("version"))


def case_of_findings(findings: DataFrame, key: str = "case_id", order: str = "ord") -> DataFrame:
    """id, content and analyze_snapshot of a case per key, from its findings (category, kind, level, signature) in order."""
    said = lambda c, default: F.coalesce(c, F.lit(default))
    line = F.concat(F.lit("- **"), said("category", "unknown"), F.lit("**: "), said("kind", "Unknown"), F.lit(" ("), said("level", "INFO"), F.lit(")\n  "), said("signature", "No description"), F.lit("\n"))
    rows = findings.select(F.col(key).alias("id"), F.struct(F.col(order).alias("o"), line.alias("line"), F.to_json(F.struct("category", "kind", "level", "signature")).alias("json")).alias("x"))
    per = rows.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a case is a document; its findings are its text
    text = F.concat(F.lit("# Investigation\n## Findings\n"), F.array_join(F.transform("x", lambda x: x["line"]), ""))
    return per.select("id", text.alias("content"), F.concat(F.lit('{"findings":['), F.array_join(F.transform("x", lambda x: x["json"]), ","), F.lit("]}")).alias("analyze_snapshot"))
