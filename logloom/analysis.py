"""Whole analyses: what a log, a set of files, a SAML trace or a text to be anonymised gives, as DataFrames.

Each field is a table of its own that can be written or joined, and runs when it is read; what several steps of incidents read
(tallies, event lines, incidents) is stored when the analysis is built.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import timestamps
from .operators import events, families, mask, rca, saml, scan, ssh
from .operators import findings as cross
from .sources import saml as saml_source
from .sources import traces
from .sources.config import Config


@dataclass(frozen=True)
class LogAnalysis:
    time_range: DataFrame
    levels: DataFrame
    line_findings: DataFrame
    error_codes: DataFrame
    code_families: DataFrame
    aux_codes: DataFrame
    incidents: DataFrame


def analyze_log(lines: DataFrame, config: Config | None = None, keep: bool = True) -> LogAnalysis:
    """lines: file_id, line_no, line. The lines are kept (memory, then disk) for the branches that read them, unless keep
    is off; unpersist `lines` when done."""
    config = config or Config()
    if keep:
        lines = lines.persist(StorageLevel.MEMORY_AND_DISK)
    groups = events.grouped(events.events(lines))
    found = families.findings(lines, config.families).select("file_id", "family", "kind", "level", "category", "count", "first_line", "signature")
    found = found.unionByName(ssh.incidents(lines), allowMissingColumns=True)
    if config.patterns:
        own = families.custom(lines, config.pattern_rows(lines.sparkSession))
        found = found.unionByName(own.select("file_id", F.lit("custom").alias("family"), "kind", "level", "category", "count", "first_line", F.col("name").alias("signature"), "sample"), allowMissingColumns=True)
    rule = F.coalesce(F.when(F.contains("line", F.lit("sshd[")), ssh.rule(F.col("line"))["level"]), families.line_rule(F.col("line"), config.families)["level"])
    return LogAnalysis(
        time_range=timestamps.time_range(lines),
        levels=scan.level_counts(lines, rule),
        line_findings=scan.notable_lines(lines, ssh.pid(F.col("line")), config.quota),
        error_codes=scan.vendor_codes(lines),
        code_families=scan.vendor_summary(lines),
        aux_codes=scan.aux_counts(lines),
        incidents=events.incidents(groups, found, config.incident_limit),
    )


@dataclass
class FilesAnalysis:
    files: DataFrame
    findings: DataFrame
    by_analyzer: DataFrame
    top_kinds: DataFrame
    timeline: DataFrame
    causal: DataFrame

    @cached_property
    def chains(self) -> DataFrame:
        return rca.chains(self.causal)

    @cached_property
    def links(self) -> DataFrame:
        return rca.links(self.causal)


def analyze_files(lines: DataFrame, folder: str, config: Config | None = None) -> FilesAnalysis:
    """Several files together: their findings, clustered within each file, and the chains among those with a time.

    A finding's time is the last stamp at or before its first line, so that chains can span files. The incidents of the
    files are written to a new table in folder, which every branch then reads.
    """
    config = config or Config()
    log = analyze_log(lines, config)
    at = f"{folder}/incidents"
    log.incidents.drop("codes", "causes", "exception_chain").write.parquet(at)
    incidents = lines.sparkSession.read.parquet(at)
    stamps = timestamps.stamped(lines).where("ts is not null").select("file_id", "line_no", F.col("ts.key").alias("at"))
    i = incidents.select("file_id", "position", "category", "kind", "level", "signature", "count", F.col("first_line").cast("int").alias("first_line"), "sample", "root_cause", "family")
    rows = i.select("file_id", F.col("first_line").alias("line_no"), "position").unionByName(stamps, allowMissingColumns=True)
    when = events.last_known(rows.withColumn("line_no", F.coalesce("line_no", F.lit(0))), "at", "seen", True).where("position is not null").select("file_id", "position", "seen")
    f = i.join(when, ["file_id", "position"]).withColumn("ord", F.col("position").cast("long"))
    f = f.select("ord", F.col("file_id").alias("source_file"), F.coalesce("category", F.lit("log")).alias("category"), F.coalesce("kind", F.lit("error")).alias("kind"), "level", "signature", "count", "first_line", F.date_format("seen", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "sample", "root_cause", F.coalesce("family", F.lit("log")).alias("analyzer"), "seen")
    found = cross.clustered(f, config.cluster_lines) if config.deduplicate else f
    e = f.where("seen is not null").select(F.lit("all").alias("scope"), F.xxhash64("source_file", "ord").alias("ord"), F.col("seen").alias("ts"), "analyzer", "level", "kind")
    return FilesAnalysis(files=cross.per_file(f, lines), findings=found, by_analyzer=cross.severities(f), top_kinds=cross.top_kinds(f), timeline=cross.timeline(found), causal=e)


@dataclass(frozen=True)
class SamlAnalysis:
    documents: DataFrame
    checks: DataFrame
    findings: DataFrame
    summary: DataFrame


def analyze_saml(inputs: DataFrame, at: float | None = None, replayed: float | None = None, supplied: DataFrame | None = None) -> SamlAnalysis:
    """inputs: bundle_id, content. at: seconds since 1970 of the incident, if known; bundles with a trace are judged by what it
    tells, and others at `replayed`, the time of the analysis, if given; without a time none is judged. supplied: bundle_id
    and certificate (Base64) of keys that somebody vouches for."""
    docs = saml_source.documents(inputs).persist(StorageLevel.MEMORY_AND_DISK)
    rows = traces.exchanges(inputs)
    checks = saml.checks(docs)
    found = saml.findings(docs, F.lit(float(at)) if at is not None else None, replayed, traces.timing(rows))
    found = saml.verified_findings(found, saml.signatures(docs, supplied))
    way = saml.transport_findings(traces.transport(rows))
    found = found.unionByName(way.withColumn("rank", F.when(F.col("severity") == "ERROR", 0).otherwise(1)))
    return SamlAnalysis(documents=docs, checks=checks, findings=found, summary=saml.summary(checks, found))


def is_saml(content: Column) -> Column:
    """Whether a text looks like SAML rather than a log, as a column."""
    roots = "|".join(saml_source.ROOTS)
    return content.rlike(rf"(?s)<(?:[A-Za-z_][\w.-]*:)?(?:{roots})\b|SAML(?:Request|Response)[\"'\s]*[=:]|\"saml\"\s*:")


def anonymise(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) anonymised, and what the residual scan still finds in them."""
    done = mask.anonymised(docs)
    lines = done.select(F.col("doc_id").cast("string").alias("file_id"), F.posexplode(F.split("anonymised", r"\R")).alias("line_no", "line"))
    return done, mask.residual(lines.withColumn("line_no", F.col("line_no") + 1))
