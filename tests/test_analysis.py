"""Whole analyses, settings, packages, reports and the stream."""

import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom import analysis
from logloom.operators import families
from logloom.operators import kb as K
from logloom.plans import reports
from logloom.sources import kb_package
from logloom.sources.artifacts import lines_of
from logloom.sources.config import Config
from logloom.streaming.attempts import bursts
from logloom.streaming.families import tallies

LOG = "\n".join(
    [f"Jan 01 00:00:{i:02d} h sshd[{i}]: Failed password for root from 1.2.3.4 port 1 ssh2" for i in range(6)]
    + ["2024-01-01 00:00:00 ERROR com.x.A : ORD-00042 failed", "Caused by: java.io.IOException: disk", "postgres deadlock detected database=d", "disk 7 is full"]
)


def logs(spark, *texts):
    return lines_of(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file_id string, content string"))


def test_log_analysis_and_report(spark):
    config = Config.from_dict({"patterns": [{"name": "full disks", "pattern": r"disk \d+ is full", "level": "CRITICAL", "kind": "disk"}]})
    lines = logs(spark, LOG)
    a = analysis.analyze_log(lines, config)
    first = a.incidents.orderBy("position").collect()
    assert first[0].kind == "brute_force" and first[0].level == "ERROR"
    assert {"disk", "deadlock", "ssh_session"} <= {r.kind for r in first}
    levels = {r.level: r.n for r in a.levels.collect()}
    assert levels["WARN"] == 6 and levels["ERROR"] == 1 and levels["CRITICAL"] == 1
    text = reports.log_report(a)
    assert "SSH brute-force from 1.2.3.4" in text and "ORD-00042" in text
    assert "brute_force" in reports.to_json(a.incidents)


def test_files_analysis(spark, tmp_path):
    one = "2024-01-01 00:00:00 ERROR x\n2024-01-01 00:00:01 INFO postgres deadlock detected"
    two = '2024-01-01 00:00:05 INFO started\n9.9.9.9 - - [01/Jan/2024:00:00:06 +0000] "GET /a HTTP/1.1" 503 1 "-" "-"'
    a = analysis.analyze_files(logs(spark, one, two), str(tmp_path))
    assert {r.file_id: r.line_count for r in a.files.collect()} == {"f0": 2, "f1": 2}
    chain = {r.root_kind: r for r in a.chains.collect()}["deadlock"]
    assert chain.n_links == 1 and [x.effect for x in a.links.where(F.col("root_ord") == chain.root_ord).collect()] == ["service_unavailable"]  # a database, then a web server within 30 s
    assert "service_unavailable" in reports.files_report(a)


def test_saml_routing_and_report(spark):
    xml = '<p:Response xmlns:p="urn:oasis:names:tc:SAML:2.0:protocol" ID="x1" Version="1.1" IssueInstant="2024-01-01T00:00:00Z"/>'
    df = spark.createDataFrame([("a", xml), ("b", "2024-01-01 ERROR x"), ("c", "SAMLResponse=abc")], "bundle_id string, content string")
    assert [r.s for r in df.select(analysis.is_saml(df["content"]).alias("s")).collect()] == [True, False, True]
    assert "RESPONSE_VERSION_INVALID" in reports.saml_report(analysis.analyze_saml(df.where("bundle_id = 'a'")))


def test_anonymise(spark):
    done, left = analysis.anonymise(spark.createDataFrame([(1, "x a@b.org\ny 10.0.0.1")], "doc_id long, text string"))
    assert done.first().anonymised == "x EMAIL_001\ny IP_001" and left.count() == 0


def test_settings(tmp_path):
    with pytest.raises(ValueError):
        Config.from_dict({"patterns": [{"name": "x", "pattern": "("}]})
    with pytest.raises(ValueError):
        Config.from_dict({"colour": 1})
    (tmp_path / "c.json").write_text('{"families": ["nginx"], "cluster_lines": 10}')
    c = Config.from_file(str(tmp_path / "c.json"))
    assert c.families == ("nginx",) and Config.from_dict(c.to_dict()) == c


def test_packages(spark):
    t = datetime(2024, 1, 1)
    kb = K.replace(K.KnowledgeBase.empty(spark), articles=spark.createDataFrame([("a1", 1, "T", None, "text", "active", t, t)], K.SCHEMAS["articles"]))
    data = kb_package.package(kb)
    rows, errors = kb_package.articles_in(spark, data)
    assert not errors and [(r.id, r.title, r.content) for r in rows.collect()] == [("a1", "T", "text")]
    added, conflicts = K.imported(kb, rows, "skip")
    assert added.count() == 0 and conflicts.count() == 1
    assert K.imported(kb, rows, "new")[0].first().id != "a1"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("manifest.json", '{"schema_version": "9"}')
    assert kb_package.articles_in(spark, out.getvalue())[1] == ["schema version 9 isn't 1.0"]


def test_stream_of_attempts(spark, tmp_path):
    t = datetime(2024, 1, 1, 1)
    line = lambda i, at, ip: ("f", at.strftime("%b %d %H:%M:%S") + f" h sshd[{i}]: Failed password for root from {ip} port 1 ssh2", t + timedelta(hours=3))
    rows = [line(i, t + timedelta(seconds=900 * i), "1.1.1.1") for i in range(5)]  # gaps of exactly 15 minutes: one burst
    rows += [line(10 + i, t + timedelta(seconds=901 * i), "2.2.2.2") for i in range(5)]  # a second more: five
    schema = "file_id string, line string, ingested timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    spark.createDataFrame([line(99, t + timedelta(hours=8), "3.3.3.3")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = bursts(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select ip, attempts, level from bursts").collect()
    assert [tuple(r) for r in got] == [("1.1.1.1", 5, "WARN")]


def test_families_on_a_stream(spark, tmp_path):
    """A file that ends, one that only falls silent, and lines that come after their file's end: tallies flushed by mark and by
    timer add up to what the batch operator finds."""
    said = ["GET endpoint=/a took=1500 ms", "GET endpoint=/b took=6000 ms", "nothing", "endpoint=/a took=2500 ms", "rate limit exceeded", "request timeout"]
    t = datetime(2024, 1, 1)
    row = lambda f, n, minute: (f, n, said[n % len(said)], t + timedelta(minutes=minute))
    parts = [
        [row("a", n, n) for n in range(8)] + [row("b", n, n) for n in range(7)],
        [row("a", n, n) for n in range(8, 15)] + [("a", 99, None, t + timedelta(minutes=20))],
        [row("a", n, 21) for n in range(20, 26)],
        [row("c", n, 300) for n in range(6)],  # time passes: what is silent is flushed
        [row("c", 6, 600)],
    ]
    schema = "file_id string, line_no long, line string, at timestamp"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = tallies(source, ("api_performance",), idle="15 minutes", late="5 minutes", lanes=2)
        out.writeStream.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    lines = spark.createDataFrame([r[:3] for rows in parts for r in rows], "file_id string, line_no long, line string")
    names = ("api_performance",)
    key = lambda df: sorted((str(r) for r in df.where("file_id <> 'c'").collect()))
    assert key(families.judged(got, names)) == key(families.findings(lines, names)) != []
