"""Log operators on lines written here, with results worked out by hand."""

import random
import re

from pyspark.sql import functions as F

from logloom.functions import records as R
from logloom.functions import timestamps as T
from logloom.operators import events as E
from logloom.operators import families as FA
from logloom.operators import scan as S
from logloom.operators import ssh
from logloom.sources.artifacts import lines_of, read_artifacts, with_pasted


def lines(spark, text, file_id="f"):
    return lines_of(spark.createDataFrame([(file_id, text)], "file_id string, content string"))


def test_lines_split_at_every_line_end(spark):
    got = [r.line for r in lines(spark, "a\r\nb\x0bc\x85d\n\ne\n").orderBy("line_no").collect()]
    assert got == ["a", "b", "c", "d", "", "e"]
    assert lines(spark, "").count() == 0


def test_artifacts(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"ok \xff\n")
    (tmp_path / "b.log").write_bytes(b"x" * 50)
    rows = {r.name: r for r in with_pasted(read_artifacts(spark, str(tmp_path), 20), "pasted text").collect()}
    assert rows["a.log"].content.startswith("ok ") and rows["b.log"].content is None and "larger" in rows["b.log"].error
    assert rows["pasted"].content == "pasted text"
    assert with_pasted(read_artifacts(spark, str(tmp_path)), "  ").count() == 2


def test_record_styles(spark):
    text = "\n".join(
        [
            "[WARNING] low disk",
            "2024-01-02 03:04:05,678 ERROR com.x.Y : boom",
            "[Wed Jan 03 04:05:06 2024] [notice] started",
            "FATAL: gone",
            "01/02/2024 10:00:00 plain text",
            "errors were found",
            "   ",
            "2024-01-02T03:04:05Z [crit] unknown level",
        ]
    )
    got = [(r.rec.level, r.rec.style, r.rec.new) for r in R.with_record(lines(spark, text)).orderBy("line_no").collect()]
    assert got == [
        ("WARN", "bracket", True),
        ("ERROR", "timestamped", True),
        ("INFO", "timestamp_bracket", True),
        ("FATAL", "bare", True),
        (None, None, True),
        (None, None, False),
        (None, None, False),
        (None, None, True),
    ]


def test_vendor_codes_by_position(spark):
    text = "ORA-00600: internal\nsee ORA-00601 below\n2024-01-01 00:00:00 ERROR x ORA-00602 y\n2024-01-01 00:00:00 TNS-12500 z"
    rows = R.with_record(lines(spark, text)).select("line_no", R.vendor_code(F.col("rec")).alias("c")).orderBy("line_no").collect()
    assert [r.c for r in rows] == ["ORA-00600", None, "ORA-00602", "TNS-12500"]


def test_slash_dates_need_proof(spark):
    a = lines(spark, "25/01/2024 10:00:00 x\n03/02/2024 10:00:00 y", "day first")
    b = lines(spark, "01/25/2024 10:00:00 x\n03/02/2024 10:00:00 y", "month first")
    c = lines(spark, "03/02/2024 10:00:00 y", "unknown")
    d = lines(spark, "2024-02-03 00:00:00 z\n03/02/2024 10:00:00 y", "by date")
    rows = {r.file_id: r for r in T.time_range(a.union(b).union(c).union(d)).collect()}
    assert rows["day first"].to_ts == "2024-02-03T10:00:00"
    assert rows["month first"].to_ts == "2024-03-02T10:00:00"
    assert rows["unknown"].to_ts is None and rows["unknown"].timestamped_lines == 0
    assert rows["by date"].to_ts == "2024-02-03T10:00:00"


def test_time_zones(spark):
    text = "2024-01-01T10:00:00Z a\n2024-01-01T10:30:00+02:00 b\n2024-01-01 09:00:00 c"
    r = T.time_range(lines(spark, text)).first()
    assert (r.from_ts, r.to_ts, r.timezone) == ("2024-01-01T10:30:00+02:00", "2024-01-01T10:00:00Z", "mixed")
    r = T.time_range(lines(spark, "2024-01-01 09:00:00.5 c\n2024-02-30 09:00:00 d")).first()
    assert (r.from_ts, r.to_ts, r.timezone, r.timezone_note) == ("2024-01-01T09:00:00.500000", "2024-01-01T09:00:00.500000", None, "timezone not present in source stamps")
    r = T.time_range(lines(spark, "Jan  2 03:04:05 h a\nJan 10 00:00:00 h b")).first()
    assert (r.from_ts, r.to_ts, r.year_present) == ("Jan  2 03:04:05", "Jan 10 00:00:00", False)


EVENT = """2024-01-01 00:00:00 ERROR com.x.Service : failed
java.lang.IllegalStateException: outer
    at com.x.A.b(A.java:1)
Suppressed: java.io.IOException: closing
Caused by: java.io.IOException: disk full
    ... 3 more
2024-01-01 00:00:01 INFO next
    at not.part.of.Anything
[ERROR] build failed -> [Help 1]
[ERROR] [Help 1] http://x
[ERROR]
[ERROR] other failure
2024-01-01 00:00:02 ERROR com.x.Service : failed
Caused by: java.io.IOException: disk full"""


def test_event_assembly_and_chains(spark):
    rows = E.events(lines(spark, EVENT)).orderBy("start_line").collect()
    assert [(r.start_line, r.n_lines) for r in rows] == [(1, 6), (9, 3), (12, 1), (13, 2)]
    first = rows[0]
    assert first.top_exception == "java.lang.IllegalStateException: outer"
    assert first.root_cause == "java.io.IOException: disk full"
    assert first.suppressed == ["java.io.IOException: closing"]
    assert first.exception_chain == ["java.lang.IllegalStateException", "java.io.IOException"]
    assert rows[1].signature == "build failed"
    groups = {r.key: r for r in E.grouped(E.events(lines(spark, EVENT))).collect()}
    assert groups["java.io.IOException: java.io.IOException: disk full"]["count"] == 2


def test_assembly_does_not_depend_on_chunks(spark):
    text = "\n".join(EVENT.split("\n") * 20)
    whole = E.member_lines(lines(spark, text)).select("line_no", "start_line").collect()
    parts = E.member_lines(lines(spark, text), chunk=7).select("line_no", "start_line").collect()
    assert sorted(whole) == sorted(parts)


def test_events_have_a_limit(spark):
    text = "ERROR: x\n" + "\n".join(f"  line {i}" for i in range(700))
    assert E.events(lines(spark, text)).first().n_lines == E.MOST_LINES


def test_quota_and_context(spark):
    text = "\n".join(f"Jan 01 00:00:00 h sshd[7]: error: try {i}" for i in range(20))
    rows = S.notable_lines(lines(spark, text), ssh.pid(F.col("line"))).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == [1, 2, 3, 4, 5]
    assert [len(r.context) for r in rows] == [1, 2, 3, 4, 5]


def session(i, second, ip="1.2.3.4"):
    return f"Jan 01 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d} h sshd[{i}]: Failed password for root from {ip} port 1 ssh2"


def clusters(spark, seconds):
    text = "\n".join(session(100 + i, s) for i, s in enumerate(seconds))
    return [(r["count"], r.level) for r in ssh.clusters(ssh.sessions(lines(spark, text))).orderBy("first_line").collect()]


def test_brute_force_edges(spark):
    assert clusters(spark, [0, 10, 20, 30]) == []
    assert clusters(spark, [0, 10, 20, 30, 60]) == [(5, "ERROR")]
    assert clusters(spark, [0, 10, 20, 30, 61]) == [(5, "WARN")]
    assert clusters(spark, [300 * i for i in range(10)]) == [(10, "ERROR")]
    assert clusters(spark, [900 * i for i in range(5)]) == [(5, "WARN")]
    assert clusters(spark, [901 * i for i in range(5)]) == []


def test_repeated_message_is_judged_by_its_body(spark):
    line = "Jan 01 00:00:00 h sshd[9]: message repeated 2 times: [ Failed password for root from 9.9.9.9 port 1]"
    s = ssh.sessions(lines(spark, line)).first()
    assert (s.kinds, s.ip, s.user) == (["failed_password"], "9.9.9.9", "root")


def test_family_thresholds(spark):
    access = '{ip} - - [01/Jan/2024:00:00:00 +0000] "GET {path} HTTP/1.1" {status} 10 "-" "x"'
    rows = [access.format(ip="1.1.1.1", path="/a", status=403)] * 2 + [access.format(ip="2.2.2.2", path="/.env", status=401)] * 3
    got = {(r.kind, r.entity): r["count"] for r in FA.findings(lines(spark, "\n".join(rows)), ("nginx",)).collect()}
    assert got == {("auth_cascade", "2.2.2.2"): 3, ("attack_probe", "2.2.2.2"): 3}
    keys = "ssh key deleted user: a\nssh key rotation user: b"
    kinds = {r.kind for r in FA.findings(lines(spark, keys), ("ssh_keys",)).collect()}
    assert kinds == {"key_rotation_performed"}
    tokens = "access_token=eyJa.b\naccess_token=eyJa.b\nrefresh_token=x\nrefresh_token=x"
    r = FA.findings(lines(spark, tokens), ("oauth2",)).where("kind = 'token_exposure'").first()
    assert r["count"] == 3
    pg = "\n".join(["postgres statement timeout duration: 2000 ms"] * 2)
    r = FA.findings(lines(spark, pg), ("postgresql",)).where("kind = 'slow_queries'").first()
    assert (r["count"], r.avg_value) == (4, 2000.0)  # such a line counts as a timeout and as slow


def test_classes_top_users_and_percentiles(spark):
    access = '1.1.1.1 - - [01/Jan/2024:00:00:00 +0000] "GET {path} HTTP/1.1" 404 10 "-" "x" {time}'
    paths = ["/admin/x.php?id=1", "/x.php?id=1", "/.env", "/q?select=1", "/..\\x", "/plain"]
    rows = [access.format(path=p, time=0.1) for p in paths] + [access.format(path="/plain", time=t) for t in (1.5, 2.5, 2.5, 9)]
    got = {r.kind: r for r in FA.findings(lines(spark, "\n".join(rows)), ("nginx",)).collect()}
    probe = got["attack_probe"]
    assert (probe.entity, probe["count"], probe.first_line) == ("1.1.1.1", 5, 1)
    assert probe.classes == ["admin_probe", "dotfile_probe", "path_traversal", "sql_injection", "webshell_probe"]
    slow = got["slow_requests"]
    assert (slow["count"], slow.avg_value, slow.max_value, slow.p95_value) == (4, 3.875, 9.0, 9.0)
    users = "eve eve bob ann ann ann zoe kim lea max max".split()
    text = "\n".join(f"postgres FATAL: password authentication failed for user={u}" for u in users)
    r = FA.findings(lines(spark, text), ("postgresql",)).where("kind = 'auth_failure'").first()
    assert r["count"] == 11 and r.top_entities == ["ann", "eve", "max", "bob", "zoe"]


def test_tests_are_paired_with_their_latest_start(spark):
    text = "test: alpha started\ntest: alpha started again\ntest: alpha completed took 15 ms\ntest: beta finished\nfixture destroyed\nnothing"
    got = [(r.test, r.line_no, r.start_line, r.duration) for r in FA.test_runs(lines(spark, text)).orderBy("line_no").collect()]
    assert got == [("alpha", 3, 2, 15), ("beta", 4, None, 0), ("test_5", 5, None, 0)]


def test_custom_patterns_in_several_passes(spark):
    rules = [(f"r{i}", f"word{i}\\b", "WARN", "c", "k", "match" if i else "ignore") for i in range(7)]
    patterns = spark.createDataFrame(rules, "name string, pattern string, level string, category string, kind string, action string")
    got = {r.name: (r["count"], r.first_line, r["sample"]) for r in FA.custom(lines(spark, "a word1 word6\nword0\nword6"), patterns, at_once=3).collect()}
    assert got == {"r1": (1, 1, "a word1 word6"), "r6": (2, 1, "a word1 word6")}
    assert FA.custom(lines(spark, "x"), patterns.limit(0)).count() == 0


def test_incident_total_is_exact_beyond_the_limit(spark):
    text = "\n".join(f"ERROR: failure {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150))
    rows = E.incidents(E.grouped(E.events(lines(spark, text))), limit=100).collect()
    assert len(rows) == 100 and {r.total for r in rows} == {150}


def test_judged_sessions_are_counted_apart(spark):
    """Sessions that no rule fits take places of the store, but not among the judged ones."""
    idle = [f"Jan 01 00:00:00 h sshd[{i}]: Connection from 1.2.3.4 port 1" for i in range(3)]
    text = "\n".join(idle + [session(100 + i, i) for i in range(7)])
    s = ssh.sessions(lines(spark, text), 6)
    assert [(r.judged, r.kept) for r in s.orderBy("first_line").collect()] == [(i + 1, i < 3) for i in range(7)]
    assert [r["count"] for r in ssh.clusters(s.where("judged <= 6"), every=True).collect()] == [6]


def test_runs_cross_slots(spark):
    """Runs by a plain loop over sessions in order, with and without clocks, where gaps are near the slots' width."""
    r = random.Random(3)
    for clockless in (0, 0.1):
        rows = [(f"9.9.9.{r.randrange(4)}", None if r.random() < clockless else r.randrange(40) * 450 + r.randrange(3), i + 1) for i in range(90)]
        text = "\n".join(session(i, at or 0, ip).removeprefix("Jan 01 00:00:00 " if at is None else "") for ip, at, i in rows)
        want = []
        for ip in {ip for ip, _, _ in rows}:
            run, last = [], None
            for _, at, i in sorted((r for r in rows if r[0] == ip), key=lambda r: (r[1] is None, r[1] or 0, r[2])):
                if at is not None and last is not None and at - last > ssh.GAP:
                    want.append((ip, run))
                    run = []
                run.append((at, i))
                last = last if at is None else at
            want.append((ip, run))
        all_lines = text.split("\n")
        want = [(ip, len(run), run[0][1], None if None in (run[0][0], run[-1][0]) else float(run[-1][0] - run[0][0]), "\n".join(all_lines[i - 1] for _, i in run[:8])) for ip, run in want if len(run) >= 5]
        got = ssh.clusters(ssh.sessions(lines(spark, text))).select("ip", "count", "first_line", "duration_s", "sample").collect()
        assert len(want) > 4 and sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_families_read_their_lines_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    text = "\n".join(f'10.0.0.1 - - [01/Jan/2024:00:00:00 +0000] "GET /items HTTP/1.1" 500 10 "-" "x" {i}.00' for i in range(20))
    source = lines(spark, text)
    assert FA.findings(source.mapInArrow(seen, source.schema), ("nginx",)).count() > 0
    assert reads.value == 20


def counted(source, reads):
    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    return source.mapInArrow(seen, source.schema)


def test_events_and_incidents_read_their_lines_once(spark):
    reads = spark.sparkContext.accumulator(0)
    source = lines(spark, EVENT)
    got = E.incidents(E.grouped(E.events(counted(source, reads)))).collect()
    assert len(got) == 3 and {r.total for r in got} == {3}
    assert reads.value == source.count()


def test_a_file_of_a_log_is_numbered_by_hours(spark, tmp_path):
    """Places run on from hour to hour, in any order of the input; stamps before the first hour, equal or missing ones too."""
    from logloom.sources import render

    stamps = [None, "2023-12-31 23:10:00", "2023-12-31 22:59:59", "2024-01-01 00:30:00", "2024-01-01 00:30:00", "2024-01-01 03:00:00", None]
    rows = [(i, s, u, "view", 1.5, '{"k": 3}') for u in (0, 3, None) for i, s in enumerate(stamps, 10 * (u or 1))]
    e = spark.createDataFrame(rows[::-1], "event_id long, ts string, user_id long, event_type string, value double, props string")
    e = e.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(3)
    got = render.numbered(e, 8).groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "event_id"))).alias("l")).collect()
    order = [0, 6, 2, 1, 3, 4, 5]
    assert {r.file_no: [(x.line_no, x.event_id) for x in r.l] for r in got} == {u: [(n, 10 * (u or 1) + i) for n, i in enumerate(order, 1)] for u in (0, 3, None)}
    e.write.parquet(f"{tmp_path}/events.parquet")
    log = render.log(spark, str(tmp_path), "ops")
    assert log.where("line is not null").count() == 10  # without a stamp, or without the user that a phrase names, there is none
    assert re.search(r"row_number\(\) windowspecdefinition\(_file#\d+, _hour#", log._jdf.queryExecution().optimizedPlan().toString())
