"""Clusters, causal chains, masking, the knowledge base and SAML on small cases."""

import base64
import html
import json
import random
import urllib.parse
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom import tables
from logloom.operators import findings as FI
from logloom.operators import kb as K
from logloom.operators import mask, rca
from logloom.operators import saml as S
from logloom.sources import saml as X
from logloom.sources import traces

COLUMNS = "ord long, source_file string, category string, kind string, level string, signature string, count long, first_line int, timestamp string, sample string, root_cause string"


def test_clusters_stay_within_files_and_keep_the_gravest(spark):
    rows = [
        (1, "a", "db", "x", "WARN", "s1", 2, 10, "2024-01-02", "one", None),
        (2, "a", "db", "y", "ERROR", "s2", 3, 20, "2024-01-01", "two", "r"),
        (3, "b", "db", "x", "WARN", "s3", 5, 15, None, "", None),
    ]
    got = {r.source_file: r for r in FI.clustered(spark.createDataFrame(rows, COLUMNS)).collect()}
    a = got["a"]
    assert (a["count"], a.level, a.first_line, a.timestamp, a.sample, a.members) == (5, "ERROR", 10, "2024-01-01", "two", 2)
    assert a.signature == "Db incident (2 variations, 5 events)" and got["b"].signature == "s3"


def test_chain_is_greedy(spark):
    t = datetime(2024, 1, 1)
    e = [("s", 1, t, "postgresql", "CRITICAL", "deadlock"), ("s", 2, t + timedelta(seconds=4), "postgresql", "ERROR", "connection_exhausted"), ("s", 3, t + timedelta(seconds=50), "nginx", "ERROR", "timeout"), ("s", 4, t + timedelta(seconds=400), "nginx", "ERROR", "service_restart"), ("q", 5, t, "x", "INFO", "other")]
    df = spark.createDataFrame(e, "scope string, ord long, ts timestamp_ntz, analyzer string, level string, kind string")
    # The restart comes 350 s after the timeout, so nothing explains it; scope q has no grave event and keeps its first.
    assert sorted(r.ord for r in rca.roots(df).collect()) == [1, 4, 5]
    c = {r.root_ord: r for r in rca.chains(df).collect()}[1]
    links = rca.links(df).where("root_ord = 1").orderBy("step").collect()
    assert [(x.step, x.cause, x.effect) for x in links] == [(1, "deadlock", "connection_exhausted"), (2, "connection_exhausted", "timeout")]
    assert abs(links[0].strength - 1.0) < 1e-9 and abs(links[1].strength - 0.72) < 1e-9
    assert (c.duration_s, c.impact, c.analyzers) == (50.0, 3, ["nginx", "postgresql"])


def _causal(a, b):
    delta = b[2] - a[2]
    return 0 <= delta <= 300 and ((a[4], b[4]) in rca.PATTERNS or ((a[3], b[3]) in rca.SEQUENCES and delta <= 30))


def _brute_chains(events):
    """Per root, what a scan over all events after it gives. events: scope, ord, seconds, analyzer, kind, grave."""
    out = {}
    for scope in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == scope), key=lambda e: (e[2], e[1]))
        free = [e for e in own if e[5] and not any(o[2] < e[2] and _causal(o, e) for o in own)] or own[:1]
        for root in free:
            path = [root]
            for e in own:
                if root[2] < e[2] <= root[2] + 300 and _causal(path[-1], e):
                    path.append(e)
            out[scope, root[1]] = [e[1] for e in path]
    return out


@pytest.mark.parametrize("span", [3000, 300])
def test_chains_against_a_scan(spark, span):
    """Few and ten times as many events in a window, with ties in time; successors stay linear in the events."""
    r = random.Random(span)
    kinds = sorted({k for pair in rca.PATTERNS for k in pair}) + ["other", None]
    names = sorted({a for pair in rca.SEQUENCES for a in pair})
    rows = [(r.choice("ab"), i, r.randrange(span), r.choice(names), r.choice(kinds), r.random() < 0.3) for i in range(400)]
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(s, i, t + timedelta(seconds=x), a, "ERROR" if g else "INFO", k) for s, i, x, a, k, g in rows], "scope string, ord long, ts timestamp_ntz, analyzer string, level string, kind string")
    want = _brute_chains(rows)
    got = {(c.scope, c.root_ord): c for c in rca.chains(df).collect()}
    assert {k: (c.n_links, c.last_ord, c.impact) for k, c in got.items()} == {k: (len(p) - 1, p[-1], len(p)) for k, p in want.items()}
    of = {i: a for _, i, _, a, _, _ in rows}
    assert {k: c.analyzers for k, c in got.items()} == {k: sorted({of[i] for i in p}) for k, p in want.items()}
    paths = {}
    for x in sorted(rca.links(df).collect(), key=lambda x: x.step):
        paths.setdefault((x.scope, x.root_ord), [x.root_ord]).append(x.effect_ord)
        assert len(paths[x.scope, x.root_ord]) == x.step + 1
    assert paths == {k: p for k, p in want.items() if len(p) > 1}
    assert max(map(len, want.values())) > 4
    assert rca.successors(df, rca.roots(df)).count() <= 2 * len(rows)


def test_positions(spark):
    r = random.Random(1)
    rows = [(r.randrange(50), str(i), "own") for i in range(700)] + [(7, "same", "own")] * 300
    df = spark.createDataFrame(rows, "k int, v string, _part string").repartition(6)
    got = sorted(tables.positioned(df.drop("_part"), ["k", "v"], "n").collect(), key=lambda x: x.n)
    assert [x.n for x in got] == list(range(1, 1001)) and [(x.k, x.v) for x in got] == sorted((k, v) for k, v, _ in rows)
    assert tables.positioned(df.limit(0), ["k"], "n").count() == 0


def test_masking_is_consistent_and_leaves_nothing(spark):
    text = "mail a.b@corp.example.com from 10.1.2.3, password=hunter2 and again a.b@corp.example.com; Authorization: Bearer abc.def https://u:p@host.corp.com/x?y=1 /home/bob/x 00:11:22:33:44:55"
    out, names = mask.pattern_sequence(text)
    assert out.count("EMAIL_001") == 2 and "hunter2" not in out and "bob" not in out and "10.1.2.3" not in out
    assert ("EMAIL", "a.b@corp.example.com", "EMAIL_001") in names
    again, more = mask.pattern_sequence(out)
    assert again == out and not more
    docs = spark.createDataFrame([(1, text), (2, "x 10.1.2.3 y 999.1.1.1"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in mask.masked(docs).collect()}
    assert got[2] == "x IP_001 y 999.1.1.1" and got[3] is None and "IP_001" in got[1]
    lines = spark.createDataFrame([("f", 1, out), ("f", 2, "c@d.org 127.0.0.1 8.8.8.8")], "file_id string, line_no int, line string")
    assert [(r.kind, r.value) for r in mask.residual(lines).where("line_no = 2 and kind <> 'DOMAIN'").collect()] == [("EMAIL", "c@d.org"), ("IP", "8.8.8.8")]


def test_texts_that_contain_kinds(spark):
    r = random.Random(3)
    texts = [(f"a{i}", i, "".join(r.choice("abcé \n") for _ in range(r.randrange(40)))) for i in range(120)] + [("none", 0, ""), ("null", 0, None)]
    kinds = ["ab", "A", "abc", "Cab\n", "é", "abcabc", "zzz", "abz", "bca a", "aaa"]
    df = spark.createDataFrame(texts, "article_id string, updated_at int, t string")
    found = K.containing(df, spark.createDataFrame([(k,) for k in kinds * 2], "kind string"))
    want = sorted((k, i) for k in kinds for i, _, t in texts if t and k.lower() in t)
    assert sorted((x.kind, x.article_id) for x in found.collect()) == want


def test_kb_round_trip(spark, tmp_path):
    t = datetime(2024, 1, 1)
    b = K.KnowledgeBase.empty(spark)
    rows = [(f"a{i}", i, f"Title {i}", "s", "old", "active", t, t + timedelta(days=i)) for i in (1, 2, 3)]
    b = K.replace(b, articles=spark.createDataFrame(rows, K.SCHEMAS["articles"]), finding_links=spark.createDataFrame([("a1", "C1"), ("a2", "C1")], K.SCHEMAS["finding_links"]))
    c = spark.createDataFrame([("a1", "T", "s", "new", t, "n")], "id string, title string, summary string, content string, updated_at timestamp_ntz, change_note string")
    b = K.updated(b, c)
    b.write(str(tmp_path / "kb"))
    b = K.KnowledgeBase.read(spark, str(tmp_path / "kb"))
    assert [(r.version, r.content) for r in b.revisions.collect()] == [(1, "old")]
    assert K.restored(b, "a1", 1).articles.where("id = 'a1'").first().content == "old"
    assert [r.id for r in K.search(b, "an00000002").collect()] == ["a2"] and K.search(b, "  ").count() == 0
    assert [r.id for r in K.search(b, "TITLE").collect()] == ["a3", "a2"]  # a1 has another title now
    gone = K.without(b, spark.createDataFrame([("a1",)], "id string"))
    assert gone.articles.count() == 2 and gone.finding_links.count() == 1 and gone.revisions.count() == 0
    assert K.next_sequence(b.articles) == 4


XML = '<p:Response xmlns:p="urn:oasis:names:tc:SAML:2.0:protocol" ID="x1" Version="2.0" IssueInstant="2024-01-01T00:00:00Z"/>'


def test_decoding_chains():
    b64 = lambda x: base64.b64encode(x).decode()
    raw = zlib.compressobj(9, wbits=-15)
    deflated = raw.compress(XML.encode()) + raw.flush()
    chains = {
        XML: "raw XML",
        html.escape(XML): "raw XML",
        b64(XML.encode()): "raw + Base64",
        "\ufeff" + b64(b"\xef\xbb\xbf" + XML.encode()): "raw + Base64",
        b64(XML.encode("utf-16")).rstrip("="): "raw + Base64",
        b64(deflated): "raw + Base64 + raw DEFLATE",
        X.deflate(XML): "raw + Base64 + raw DEFLATE",
        b64(zlib.compress(XML.encode())): "raw + Base64 + zlib",
        b64(zlib.compress(XML.encode(), wbits=31)): "raw + Base64 + gzip",
        b64(b64(XML.encode()).encode()): "raw + Base64 x2",
        urllib.parse.quote(b64(XML.encode()), safe=""): "URL-decoded + Base64",
        "%50" + b64(XML.encode())[1:]: "URL-decoded + Base64",
    }
    for value, chain in chains.items():
        if chain.startswith("URL") and "%" not in value:
            continue
        assert X.unwrapped(value) == ([(XML, chain)], None), chain
    assert X.unwrapped("short") == ([], None) and X.unwrapped("x" * 400) == ([], None)
    bomb = zlib.compressobj(9, wbits=-15)
    assert X.unwrapped(b64(bomb.compress(b"<" * (11 << 20)) + bomb.flush()))[1] == f"inflates to more than {10 << 20} bytes"
    assert X.document("<!DOCTYPE x><p:Response/>") == []
    assert X.document('<!DOCTYPE a [<!ENTITY b "c">]>' + XML) == []


def test_traces(spark):
    b64 = base64.b64encode(XML.encode()).decode()
    ask = '<p:AuthnRequest xmlns:p="urn:oasis:names:tc:SAML:2.0:protocol" ID="r1" Version="2.0"/>'
    url = "https://idp.example/sso?SAMLRequest=" + urllib.parse.quote(X.deflate(ask), safe="") + "&RelayState=s1&SigAlg=rsa-sha1&Signature=abc"
    har = {"log": {"entries": [
        {"startedDateTime": "2024-01-01T00:00:01.5Z", "request": {"method": "GET", "url": url}},
        {"request": {"method": "POST", "url": "https://sp.example/acs", "postData": {"params": [{"name": "SAMLResponse", "value": b64}]}}, "response": {"headers": [{"name": "date", "value": "Mon, 01 Jan 2024 00:00:09 GMT"}]}},
        {"request": "broken"}, 5,
    ]}}
    tracer = {"requests": [{"method": "POST", "url": "https://sp.example/acs", "timestamp": 1704067205000, "saml": XML}, {"method": "POST", "url": "https://sp.example/acs", "postData": {"text": "SAMLResponse=" + urllib.parse.quote(b64, safe="")}}]}
    rows = [("h", json.dumps(har)), ("t", json.dumps(tracer)), ("s", json.dumps({"deep": [{"SAMLResponse": b64}]})), ("x", XML), ("j", "{broken"), ("n", None)]
    inputs = spark.createDataFrame(rows, "bundle_id string, content string")
    docs = {(r.bundle_id, r.doc_type): r.source for r in X.documents(inputs).collect()}
    assert set(docs) == {("h", "AuthnRequest"), ("h", "Response"), ("t", "Response"), ("s", "Response"), ("x", "Response")}
    assert docs["x", "Response"] == "input" and docs["s", "Response"] == "JSON SAMLResponse: raw + Base64" and docs["h", "AuthnRequest"].endswith("raw DEFLATE")
    each = traces.exchanges(inputs)
    assert sorted((r.bundle_id, r.row_no, r.kind, r.method) for r in each.collect()) == [("h", 1, "HAR", "GET"), ("h", 2, "HAR", "POST"), ("t", 1, "SAML-tracer", "POST"), ("t", 2, "SAML-tracer", "POST")]
    assert {r.bundle_id: (r.mode, r.source, r["at"]) for r in traces.timing(each).collect()} == {"h": ("incident_trace", "acs_response_date", 1704067209.0), "t": ("incident_trace", None, None)}
    first = traces.timing(each.where("row_no = 1 or bundle_id = 'h'")).where("bundle_id = 't'").first()
    assert (first.source, first["at"]) == ("request_timestamp", 1704067205.0)
    way = {r.bundle_id: r for r in traces.transport(each).collect()}
    h = way["h"]
    assert (h.request_binding, h.response_binding, h.request_method, h.response_target, h.sigalg, h.redirect_signed, h.weak_sigalg, h.relay_states) == (traces.REDIRECT, traces.POST, "GET", "https://sp.example/acs", "rsa-sha1", True, True, ["s1"])
    assert (way["t"].response_binding, way["t"].response_target) == (traces.POST, "https://sp.example/acs")


def test_saml_rules(spark):
    docs = X.documents(spark.createDataFrame([("b", XML), ("e", "nothing here"), ("n", None)], "bundle_id string, content string"))
    codes = {r.code for r in S.findings(docs).collect()}
    assert {"RESPONSE_STATUS_MISSING"} <= codes and "RESPONSE_ID_MISSING" not in codes
    assert {r.status for r in S.checks(docs).collect()} == {"UNKNOWN"}


def test_masking_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com"), (None, "mail a@b.com"), (None, "or c@d.org"), (2, "a@b.com c@d.org"), (None, None), (2, "x e@f.net"), (2, "x e@f.net")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in mask.masked(docs).collect())
    assert got == sorted([("1", "mail EMAIL_001"), ("None", "mail EMAIL_001"), ("None", "or EMAIL_002"), ("2", "EMAIL_001 EMAIL_002"), ("None", "None"), ("2", "x EMAIL_003"), ("2", "x EMAIL_003")])
    names = {r.original: (r.first_doc, r.replacement) for r in mask.dictionary(docs).collect()}
    assert names == {"a@b.com": (1, "EMAIL_001"), "c@d.org": (2, "EMAIL_002"), "e@f.net": (2, "EMAIL_003")}
    only = spark.createDataFrame([(None, "a@b.com"), (None, "c@d.org")], "doc_id long, text string")
    assert sorted(r.text for r in mask.masked(only).collect()) == ["EMAIL_001", "EMAIL_002"]


def test_rules_of_builds_packages_and_urls():
    cases = {
        "INFO --- [billing-app] [main] x": "INFO --- [APP_001] [main] x",
        "INFO --- [main] [x": "INFO --- [main] [x",
        "(started by jdoe in C:\\work\\proj\\)": "(started by USER_001 in PATH_001)",
        "at com.acme.Foo in com\\acme\\Foo": "at PACKAGE_001.Foo in PACKAGE_001\\Foo",
        "at com.google.Foo": "at com.google.Foo",
        "in D:\\proj\\x and C:\\Windows\\y": "in PATH_001\\x and C:\\Windows\\y",
        "Starting BillingApp using Java 17": "Starting APP_001 using Java 17",
        "Building billing core 1.2.3": "Building APP_001 1.2.3",
        "on project billing-web: failed": "on project APP_001: failed",
        "see https://repo.maven.org/x and http://www.w3.org/2000/09/xmldsig#": "see https://repo.maven.org/x and http://www.w3.org/2000/09/xmldsig#",
        "https://portal.acme.com:8443/a?token=abc&x=1#f.": "https://DOMAIN_001:8443/a?token=SECRET_001&x=1#f.",
        "https://u:p@portal.acme.com:8443/": "URL_001",  # the rule for e-mail comes first and leaves no URL that parses
        "RelayState='abc%20d' fe80::1 2001:db8::5": "RelayState='RELAYSTATE_001' fe80::1 IP_001",
        "java.util.List and x.y.com and Foo.com": "java.util.List and x.y.com and Foo.com",
    }
    for text, want in cases.items():
        assert mask.pattern_sequence(text)[0] == want, text
    assert mask.masked_url("https://u:p@[2001:db8::5]:1/", mask.Names()) == "https://USER_001:SECRET_001@[IP_001]:1/"


def test_residual_allows_what_everyone_may_know(spark):
    text = "org.apache.Foo repo.maven.org www.w3.org EMAIL_001 ::1 2001:db8::5 portal.acme.com x.invalid MyClass.com"
    lines = spark.createDataFrame([("f", 1, text)], "file_id string, line_no int, line string")
    assert [(r.kind, r.value) for r in mask.residual(lines).collect()] == [("IP", "2001:db8::5"), ("DOMAIN", "portal.acme.com")]
