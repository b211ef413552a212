"""Reports in Markdown and JSON, from the bounded top of each table of an analysis."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..analysis import FilesAnalysis, LogAnalysis, SamlAnalysis

#: How much of each section is shown.
DETAILS, FAMILIES, EXAMPLES, CODES = 30, 12, 8, 40


def _table(head: list[str], rows: list[list]) -> list[str]:
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")[:200]
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(map(cell, r)) + " |" for r in rows], ""]


def log_report(a: LogAnalysis, files: int = 50) -> str:
    """The report of a log analysis over at most `files` files, first by name."""
    out = ["# Log analysis", "", "## Time ranges", ""]
    rows = a.time_range.orderBy("file_id").limit(files).collect()
    every = a.time_range.count()
    if every > len(rows):
        out += [f"The first {len(rows)} of {every} files.", ""]
    out += _table(["file", "lines", "from", "to", "timezone", "note"], [[r.file_id, r.line_count, r.from_ts, r.to_ts, r.timezone, r.timezone_note] for r in rows])
    names = [r.file_id for r in rows]
    some = lambda df: df.where(df["file_id"].isin(names))
    out += ["## Levels", ""] + _table(["file", "level", "lines"], [[r.file_id, r.level, r.n] for r in some(a.levels).orderBy("file_id", "level").collect()])
    out += ["## Incidents", ""]
    shown = some(a.incidents).where(f"position <= {DETAILS}").orderBy("file_id", "position").collect()
    out += _table(["file", "#", "level", "count", "line", "what"], [[r.file_id, r.position, r.level, r["count"], r.first_line, r.signature] for r in shown])
    out += ["## Notable lines", ""]
    out += _table(["file", "line", "level", "text"], [[r.file_id, r.line_no, r.source_level, r.message] for r in some(a.line_findings).orderBy("file_id", "rank", "line_no").limit(DETAILS * len(names) or 1).collect()])
    out += ["## Codes", ""]
    codes = some(a.error_codes).where(f"position <= {CODES}").orderBy("file_id", "position").collect()
    out += _table(["file", "code", "count", "first line", "example"], [[r.file_id, r.code, r.n, r.first_line, r.example if r.position <= EXAMPLES else ""] for r in codes])
    return "\n".join(out)


def files_report(a: FilesAnalysis) -> str:
    out = ["# Files together", "", "## Files", ""]
    out += _table(["file", "lines", "incidents", "analyzers"], [[r.file_id, r.line_count, r.incident_count, ", ".join(x or "" for x in r.analyzers_active)] for r in a.files.orderBy("file_id").limit(DETAILS).collect()])
    out += ["## Possible chains (a pattern is no proof of a cause)", ""]
    shown = a.chains.orderBy("incident_id", "root_ord").limit(DETAILS).collect()
    linked: dict[tuple, list[str]] = {}
    for r in a.links.where(F.col("root_ord").isin([x.root_ord for x in shown])).orderBy("step").collect():
        linked.setdefault((r.scope, r.root_ord), []).append(r.reason)
    out += _table(["incident", "root", "links", "seconds", "strength"], [[r.incident_id, r.root_kind, " / ".join(linked.get((r.scope, r.root_ord), [])), r.duration_s, round(r.chain_strength, 3)] for r in shown])
    return "\n".join(out)


#: The section of a report that a code belongs to; the first whose pattern is met counts.
SECTIONS = (
    ("Metadata input", r"^METADATA_(?:PARSE_FAILED|WRONG_ROLE|ENTITY_AMBIGUOUS|ENTITY_NOT_SELECTED)$"),
    ("HTTP result", r"^HTTP_RESULT_OBSERVED$"),
    ("Signature validation", r"SIGNATURE|SIGNING_KEY|SIGNER_TRUST|DIGEST|SUPPLIED_CERT"),
    ("IdP metadata validation", r"IDP|^AUTHNREQUEST_DESTINATION"),
    ("SP metadata validation", r"SP_|ACS|AUDIENCE|RECIPIENT|^AUTHNREQUEST_ISSUER|^RESPONSE_DESTINATION"),
    ("Timing", r"NOTBEFORE|NOTONORAFTER|SESSION|CLOCK|EXPIRED|NOT_YET"),
    ("Request / Response correlation", r"INRESPONSETO|RESPONSE_ASSERTION_ISSUER"),
)
OTHER_SECTION = "Protocol / XML structure"


def section(code: Column) -> Column:
    """The section of a report that a finding's code belongs to."""
    return F.coalesce(*[F.when(code.rlike(pattern), name) for name, pattern in SECTIONS], F.lit(OTHER_SECTION))


def saml_report(a: SamlAnalysis, limit: int = DETAILS * 10) -> str:
    out = ["# SAML analysis", "", "## Findings", ""]
    per = a.findings.groupBy(section(F.col("code")).alias("section"), "severity").count().orderBy("section", "severity")
    out += _table(["section", "severity", "findings"], [list(r) for r in per.collect()])
    found = a.findings.withColumn("section", section(F.col("code")))
    shown = found.orderBy("bundle_id", "rank", "code").limit(limit).collect()
    every = found.count()
    if every > len(shown):
        out += [f"The first {len(shown)} of {every} findings.", ""]
    for name in [n for n, _ in SECTIONS] + [OTHER_SECTION]:
        rows = [[r.bundle_id, r.severity, r.code, r.scope] for r in shown if r.section == name]
        if rows:
            out += [f"### {name}", ""] + _table(["bundle", "severity", "code", "where"], rows)
    out += ["## Checks", ""]
    out += _table(["bundle", "status", "check", "left", "right"], [[r.bundle_id, r.status, r["check"], r.left, r.right] for r in a.checks.orderBy("bundle_id", "check").limit(limit).collect()])
    return "\n".join(out)


def anonymisation_report(done: DataFrame, left: DataFrame) -> str:
    """What was renamed, by category, and what the residual scan still finds."""
    kinds = done.select(F.explode("mapping").alias("m")).groupBy("m.type").count().orderBy("type")
    out = ["# Anonymisation", "", "## Pseudonyms", ""] + _table(["category", "values"], [list(r) for r in kinds.collect()])
    rest = left.groupBy("kind").count().orderBy("kind")
    return "\n".join(out + ["## Left over", ""] + _table(["kind", "values"], [list(r) for r in rest.collect()]))


def to_json(rows: DataFrame, limit: int | None = None) -> str:
    """A DataFrame as JSON: total, how many rows are shown, and the rows, all of them unless a limit is given. A table that
    is large is written by exports.write_json instead."""
    total = rows.count()
    shown = [json.loads(x) for x in (rows if limit is None else rows.limit(limit)).toJSON().collect()]
    return json.dumps({"total": total, "shown": len(shown), "rows": shown}, ensure_ascii=False)
