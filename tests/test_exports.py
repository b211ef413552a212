"""Exports, certificates, case and tag upkeep, report sections and time ranges on small cases."""

import base64
import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.operators import kb as K
from logloom.operators import mask
from logloom.operators import saml as S
from logloom.plans import exports, reports
from logloom.plans.signing import Key, metadata
from logloom.sources import artifacts, kb_package
from logloom.sources import saml as X

T = datetime(2024, 1, 1)


def base(spark, n=3):
    b = K.KnowledgeBase.empty(spark)
    rows = spark.createDataFrame([(f"a{i}", f"Title {i}", "s", f"the Timeouts of {i}", T) for i in range(n)], "id string, title string, summary string, content string, created_at timestamp_ntz")
    return K.created(b, rows)


def test_created_articles_and_cases(spark):
    b = base(spark)
    assert sorted((r.id, r.display_id_seq, r.status) for r in b.articles.collect()) == [("a0", 1, "active"), ("a1", 2, "active"), ("a2", 3, "active")]
    again = K.created(b, spark.createDataFrame([("a1", "x", None, None, T), ("b", "x", None, None, T)], "id string, title string, summary string, content string, created_at timestamp_ntz"))
    assert {r.id: r.display_id_seq for r in again.articles.collect()} == {"a0": 1, "a1": 2, "a2": 3, "b": 4}
    findings = spark.createDataFrame([("c1", 2, "db", "deadlock", "ERROR", "two"), ("c1", 1, None, None, None, None)], "case_id string, ord int, category string, kind string, level string, signature string")
    case = K.case_of_findings(findings)
    r = case.first()
    assert r.content == "# Investigation\n## Findings\n- **unknown**: Unknown (INFO)\n  No description\n- **db**: deadlock (ERROR)\n  two\n"
    assert [x.get("kind") for x in json.loads(r.analyze_snapshot)["findings"]] == [None, "deadlock"]
    b = K.cases_created(b, case.select("id", F.lit("t").alias("title"), F.lit(None).cast("string").alias("summary"), "content", "analyze_snapshot", F.lit(T).cast("timestamp_ntz").alias("created_at")))
    b = K.cases_updated(b, spark.createDataFrame([("c1", None, None, "new", T, "why")], "id string, title string, summary string, content string, updated_at timestamp_ntz, change_note string"))
    assert b.cases.first().content == "new" and b.cases.first().title == "t"
    assert [(x.version, x.content.startswith("# Inv")) for x in K.revisions_of(b, "c1", "case").collect()] == [(1, True)]
    gone = K.without_cases(b, spark.createDataFrame([("c1",)], "id string"))
    assert gone.cases.count() == 0 and gone.revisions.count() == 0 and gone.articles.count() == 3


def test_tags_are_made_once_and_replaced(spark):
    b = K.tagged(base(spark), spark.createDataFrame([("a0", ["x", "y", "x"]), ("a1", ["x"])], "id string, names array<string>"))
    assert sorted(r.name for r in b.tags.collect()) == ["x", "y"] and b.article_tags.count() == 3
    b = K.tagged(b, spark.createDataFrame([("a0", ["z"]), ("a1", [])], "id string, names array<string>"))
    assert sorted(r.name for r in b.tags.collect()) == ["x", "y", "z"] and b.article_tags.count() == 1
    assert {r.id: r.tags for r in K.with_details(b).collect()} == {"a0": ["z"], "a1": [], "a2": []}


def test_articles_for_kinds_of_any_length(spark):
    f = spark.createDataFrame([(1, None, "timeout"), (2, None, "of"), (3, None, "0"), (4, None, "none"), (5, None, "")], "finding_id int, finding_code string, kind string")
    got = {(r.finding_id, r.article_id) for r in K.for_findings(base(spark), f).collect()}
    assert got == {(1, "a0"), (1, "a1"), (1, "a2"), (2, "a0"), (2, "a1"), (2, "a2"), (3, "a0")}


def test_packages_of_any_number(spark):
    b = base(spark, 9)
    rows = kb_package.packages(b, 4).collect()
    assert len(rows) == 3 or len(rows) == 2
    names = [n for r in rows for n in zipfile.ZipFile(io.BytesIO(bytes(r.data))).namelist() if n != "manifest.json"]
    assert sorted(names) == [f"articles/a{i}.json" for i in range(9)]
    whole, errors = kb_package.articles_in(spark, kb_package.package(b))
    assert whole.count() == 9 and not errors


def test_decoded_documents_as_files(spark, tmp_path):
    xml = '<p:Response xmlns:p="urn:oasis:names:tc:SAML:2.0:protocol" ID="x1"/>'
    rows = [("logs/my trace.har", base64.b64encode(xml.encode()).decode()), ("logs/my trace.txt", xml.replace("x1", "x2")), ("", "nothing")]
    out = exports.decoded_saml(spark.createDataFrame(rows, "bundle_id string, content string"))
    got = {r.export_name: r.xml for r in out.collect()}
    assert got == {"my_trace.response_01.xml": xml, "my_trace.response_02.xml": xml.replace("x1", "x2")}
    done = exports.write_files(out, f"file://{tmp_path}/out").collect()
    assert sorted(r.name for r in done) == sorted(got) and {f.name: f.read_text() for f in (tmp_path / "out").iterdir()} == got
    docs = spark.createDataFrame([(1, "a@b.org and c@d.org")], "doc_id long, text string")
    a = mask.anonymised(docs)
    exports.write_anonymised(a, f"{tmp_path}/masked")
    assert spark.read.json(f"{tmp_path}/masked/mapping").count() == 2
    assert "| EMAIL | 2 |" in reports.anonymisation_report(a, spark.createDataFrame([], "file_id string, line_no int, kind string, value string"))
    whole = json.loads(reports.to_json(spark.range(1500)))
    assert (whole["total"], whole["shown"], len(whole["rows"])) == (1500, 1500, 1500)
    assert json.loads(reports.to_json(spark.range(5), 2))["shown"] == 2


def test_certificates_and_sources(spark, tmp_path):
    c = Key(1).certificate()
    (tmp_path / "a.pem").write_text(f"-----BEGIN CERTIFICATE-----\n{c[:64]}\n{c[64:]}\n-----END CERTIFICATE-----\n")
    (tmp_path / "b.b64").write_text(c)
    (tmp_path / "c.der").write_bytes(base64.b64decode(c))
    (tmp_path / "d.txt").write_text("no")
    (tmp_path / "e.big").write_text("x" * 6000)
    got = {r.file_id.rsplit("/", 1)[1]: (r.certificate, r.error) for r in artifacts.read_certificates(spark, str(tmp_path), 5000).collect()}
    assert got == {"a.pem": (c, None), "b.b64": (c, None), "c.der": (c, None), "d.txt": (None, "no certificate"), "e.big": (None, "larger than 5000 bytes")}
    files = spark.createDataFrame([("f", "f", "x")], "file_id string, name string, content string")
    assert artifacts.one_source(files, " ") is files and artifacts.one_source(None, None) is None
    assert artifacts.one_source(None, "text").first().content == "text"
    with pytest.raises(ValueError):
        artifacts.one_source(files, "text")


def test_sections_and_entities(spark):
    codes = ["METADATA_ENTITY_AMBIGUOUS", "RESPONSE_SIGNATURE_VALUE_MISSING", "ASSERTION_ISSUER_IDP_ENTITYID_MISMATCH", "AUDIENCE_INVALID_URI", "ASSERTION_EXPIRED", "RESPONSE_INRESPONSETO_MISSING", "RESPONSE_ID_MISSING"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, code string")
    got = [r.s for r in rows.orderBy("i").select(reports.section(F.col("code")).alias("s")).collect()]
    assert got == [name for name, _ in reports.SECTIONS if name != "HTTP result"] + [reports.OTHER_SECTION]
    response = '<p:Response xmlns:p="urn:oasis:names:tc:SAML:2.0:protocol" xmlns:a="urn:oasis:names:tc:SAML:2.0:assertion" ID="r" IssueInstant="2024-01-01T00:00:05Z"><a:Issuer>{}</a:Issuer><a:Assertion ID="s"><a:Issuer>{}</a:Issuer><a:Conditions NotBefore="2023-12-31T23:00:00Z"/></a:Assertion></p:Response>'
    cases = {
        "one": ([response.format("https://x", "https://x"), metadata(entity="https://idp")], "https://idp", None),
        "hint": ([response.format("https://b", "https://b"), metadata(entity="https://a"), metadata(entity="https://b")], "https://b", None),
        "two": ([response.format("https://a", "https://b"), metadata(entity="https://a"), metadata(entity="https://b")], None, "METADATA_ENTITY_AMBIGUOUS"),
        "none": ([response.format("https://c", "https://c"), metadata(entity="https://a"), metadata(entity="https://b")], None, "METADATA_ENTITY_NOT_SELECTED"),
        "unhinted": ([metadata(entity="https://a"), metadata(entity="https://b")], None, "METADATA_ENTITY_NOT_SELECTED"),
    }
    rows = [(f"{n}/{k}", x) for n, (texts, _, _) in cases.items() for k, x in enumerate(texts)]
    docs = X.documents(spark.createDataFrame(rows, "bundle_id string, content string"))
    docs = docs.withColumn("ord", F.substring_index("bundle_id", "/", -1).cast("int")).withColumn("bundle_id", F.substring_index("bundle_id", "/", 1))
    got = {r.bundle_id: (r.idp.entity_id if r.idp else None, r.idp_issue) for r in S.bundles(docs).collect()}
    assert got == {n: (e, i) for n, (_, e, i) in cases.items()}
    r = S.time_range(docs).where("bundle_id = 'one'").first()
    assert (r.first_source, r.last_source, r.last_at - r.first_at) == ("Assertion Conditions NotBefore", "Response IssueInstant", 3605.0)


def test_replay_and_trace_times(spark):
    xml = '<p:Response xmlns:p="urn:oasis:names:tc:SAML:2.0:protocol" xmlns:a="urn:oasis:names:tc:SAML:2.0:assertion" ID="r" Version="2.0" IssueInstant="2024-01-01T00:00:00Z"><a:Assertion ID="s"><a:Conditions NotOnOrAfter="2024-01-01T00:05:00Z"/></a:Assertion></p:Response>'
    docs = X.documents(spark.createDataFrame([("raw", xml), ("good", xml), ("late", xml), ("unknown", xml)], "bundle_id string, content string"))
    timing = spark.createDataFrame([("good", 1704067260.0), ("late", 1704068000.0), ("unknown", None)], "bundle_id string, at double")
    got = {(r.bundle_id, r.code) for r in S.findings(docs, None, 1800000000.0, timing).collect() if "EXPIRED" in r.code or "UNKNOWN" in r.code}
    assert got == {("raw", "ASSERTION_EXPIRED"), ("good", "ASSERTION_EXPIRED_IF_REPLAYED_NOW"), ("late", "ASSERTION_EXPIRED"), ("unknown", "ASSERTION_VALIDITY_TIME_UNKNOWN")}


def test_every_confirmation_and_statement_is_judged(spark):
    data = '<a:SubjectConfirmation Method="urn:oasis:names:tc:SAML:2.0:cm:bearer"><a:SubjectConfirmationData Recipient="https://sp/acs" NotOnOrAfter="{}"/></a:SubjectConfirmation>'
    xml = '<p:Response xmlns:p="urn:oasis:names:tc:SAML:2.0:protocol" xmlns:a="urn:oasis:names:tc:SAML:2.0:assertion" ID="r" Version="2.0" IssueInstant="2024-01-01T00:00:00Z"><a:Assertion ID="s"><a:Subject>' + data.format("2024-01-01T00:05:00Z") + data.format("2023-01-01T00:05:00Z") + '</a:Subject><a:AuthnStatement AuthnInstant="2024-01-01T00:00:00Z" SessionIndex="1"/><a:AuthnStatement AuthnInstant="no"/></a:Assertion></p:Response>'
    docs = X.documents(spark.createDataFrame([("b", xml)], "bundle_id string, content string"))
    codes = {r.code for r in S.findings(docs, F.lit(1704067260.0)).collect()}
    assert {"BEARER_CONFIRMATION_EXPIRED", "AUTHNINSTANT_INVALID"} <= codes and "AUTHNINSTANT_MISSING" not in codes


def test_a_package_of_several_files_is_damaged_once(spark, monkeypatch):
    from logloom.plans import catalogue

    monkeypatch.setattr(kb_package.packages, "__defaults__", (20,))
    rows = {r.kind: (r.articles > 0, r.errors) for r in catalogue.queries()["kb_packages_read"](spark, "/root/testdata/sf0.001").collect()}
    assert rows == {"whole": (True, 0), "damaged": (False, 1)}
