"""Renders tables as log lines, so that log operators can run over tables whose content is known.

Each log has one SQL expression that Spark and the checking engine both understand, over columns that each derives with
its own date functions: t (ISO), dmy, syslog, access (stamps), v2 (value with two decimals), k (a number from props).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

APP = """case
  when event_type = 'error' and event_id % 5 = 0 then '[ERROR] ORD-' || lpad(cast(k as string), 5, '0') || ' rejected for user ' || cast(user_id as string)
  when event_type = 'error' and event_id % 5 = 1 then t || ' ERROR com.shop.Cart : payment failed, error code: E' || cast(k % 7 as string)
  when event_type = 'error' and event_id % 5 = 2 then '[' || t || '] [error] [client 10.0.0.' || cast(user_id % 250 as string) || '] child ' || cast(event_id as string) || ' timed out'
  when event_type = 'error' and event_id % 5 = 3 then 'FATAL: disk failure on node ' || cast(k % 7 as string)
  when event_type = 'error' then t || ' ERROR java.lang.RuntimeException: request failed'
  when event_type = 'view' and event_id % 4 = 0 then 'Caused by: java.io.IOException: disk ' || cast(k % 5 as string)
  when event_type = 'view' and event_id % 4 = 1 then '    at com.shop.Main.run(Main.java:' || cast(k as string) || ')'
  when event_type = 'view' then t || ' INFO page viewed by user=' || cast(user_id as string)
  when event_type = 'click' and event_id % 3 = 0 then ''
  when event_type = 'click' and event_id % 3 = 1 then t || '+02:00 DEBUG click'
  when event_type = 'click' then 'click on item ' || cast(k as string)
  when event_type = 'purchase' then dmy || ' WARN slow purchase HTTP 503, status code: 503 user=' || cast(user_id as string)
  else syslog || ' host sshd[' || cast(event_id % 500 as string) || ']: error: login of user' || cast(user_id as string) || ' refused' end"""

AUTH = """case
  when k % 5 = 0 then slow || ' host sshd[' || cast(event_id as string) || ']: Invalid user guest from 10.0.0.' || cast(user_id % 12 as string) || ' port 22'
  when k % 5 = 1 then slow || ' host sshd[' || cast(event_id as string) || ']: error: maximum authentication attempts exceeded from 10.0.0.' || cast(user_id % 12 as string)
  when k % 5 = 2 then slow || ' host sshd[' || cast(event_id as string) || ']: Connection closed by 10.0.0.' || cast(user_id % 12 as string)
  else slow || ' host sshd[' || cast(event_id as string) || ']: Failed password for root from 10.0.0.' || cast(user_id % 12 as string) || ' port 22 ssh2' end"""

ACCESS = """'10.0.0.' || cast(user_id % 30 as string) || ' - - [' || access || '] "GET ' || case k % 6
  when 0 then '/admin' when 1 then '/index.html' when 2 then '/x.php?id=1' when 3 then '/.env' when 4 then '/items' else '/api/v1/items' end
  || ' HTTP/1.1" ' || case event_id % 9 when 0 then '500' when 1 then '502' when 2 then '503' when 3 then '504' when 4 then '401' when 5 then '403' when 6 then '404' else '200' end
  || ' ' || cast(k * 10 as string) || ' "-" "curl/8" ' || v2"""

#: Lines of an operations log; {u} is a user, {n} a number.
PHRASES = (
    "INFO pod/web-{u} container=app CrashLoopBackOff",
    "ERROR pod/web-{u} OOMKilled in namespace=prod",
    "WARN docker pod/web-{u} restarted",
    "ERROR docker pull rate exceeded, connection refused",
    "WARN kubernetes node MemoryPressure",
    "ERROR postgres deadlock detected database=db{u}",
    "ERROR postgres statement timeout user=user{u} duration: {n}00 ms",
    "ERROR postgres too many connections database=db{u}",
    "WARN ldap bind failed uid=user{u}",
    "WARN account locked user=user{u}",
    "ERROR mfa failed for account=user{u}",
    "WARN password expired uid=user{u}",
    "INFO ssh key deleted user: user{u}",
    "WARN weak key rsa 1024 for user: user{u}",
    "CRITICAL unauthorized key fingerprint=ab{n} user: user{u}",
    "INFO oauth client_id=c{u} access_token=eyJ{n}.abc refresh_token=r{n}",
    "WARN oauth error invalid_grant code={n}",
    "WARN authorization code={n} already used",
    "ERROR jwt token signature verify failed kid=k{u}",
    "WARN jwt claim=aud missing in payload",
    "WARN api endpoint=/v{u}/items response_time={n}00ms",
    "ERROR api request=/v{u}/items timed out",
    "ERROR test cleanup failed for fixture: t{u}, {n} rows orphaned",
    "ERROR transaction abort, rollback of test data",
    "WARN mfa totp clock drift {n} user=user{u}",
    "ERROR sms delivery failed, sms retry {u}/3 user=user{u}",
    "INFO permission grant: role{u} for user: user{u}",
    "ERROR attempted sudo, privilege escalation",
    "WARN service circuit breaker open",
    "ERROR service lookup not found, circuit open",
    "WARN slow: {n}00 ms database query",
    "ERROR sequential database query deadlock",
    "ERROR message rejected, moved to dead letter queue",
    "WARN kafka event consumer lag={n}",
    "ERROR browser element #b{u} not found",
    "ERROR javascript undefined exception in browser",
    "WARN visual diff: {n}% regression",
    "INFO session={u} action: buy",
    "WARN user dropout in funnel",
    "ERROR outage, users affected: {n}{n} lasted {n} m",
    "<html><h1>{n}00 internal</h1> ValueError: at file.py line {n}",
    "INFO ssh key rotation for user: user{u}",
)


def _phrase(text: str) -> str:
    parts = []
    for piece in text.replace("{u}", "\0u\0").replace("{n}", "\0n\0").split("\0"):
        if piece == "u":
            parts.append("cast(user_id % 4 as string)")
        elif piece == "n":
            parts.append("cast(k as string)")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts)


OPS = f"t || ' ' || case event_id % {len(PHRASES)} " + " ".join(f"when {i} then {_phrase(p)}" for i, p in enumerate(PHRASES)) + " end"

#: Per log: the line's expression, the events that have one, and the number of files.
LOGS = {"app": (APP, "true", 20), "auth": (AUTH, "event_type = 'error'", 3), "access": (ACCESS, "true", 10), "ops": (OPS, "true", 8)}


#: Rows are numbered within an hour of their file, after those of earlier hours: an hour is a task's, a file is not.
HOUR = "coalesce(timestampdiff(HOUR, timestamp_ntz '2024-01-01 00:00:00', ts), -9223372036854775808)"


#: A line's expression in a lambda is interpreted, so that its dozens of cases are not compiled as one method.
_INTERPRETED = "element_at(transform(array(0), _x -> {}), 1)"


def numbered(e: DataFrame, files: int) -> DataFrame:
    """Events with file_no and line_no, their place in the file by ts and event_id."""
    e = e.withColumns({"file_no": (F.col("user_id") % files).cast("int"), "_hour": F.expr(HOUR)}).withColumn("_file", F.coalesce("file_no", F.lit(-files)))
    counts = e.groupBy("_file", "_hour").agg(F.count(F.lit(1)).alias("_n"))  # a row per hour and file
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_file", "_hour", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = e.withColumn("_place", F.row_number().over(Window.partitionBy("_file", "_hour").orderBy("ts", "event_id")))
    return rows.join(counts, ["_file", "_hour"]).withColumn("line_no", (F.col("_before") + F.col("_place")).cast("int")).drop("_file", "_hour", "_place", "_before")


def log(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """file_id, file_ord, line_no, line of the log of that name, rendered from events."""
    line, some, files = LOGS[name]
    e = numbered(spark.read.parquet(f"{sf_dir}/events.parquet").where(some), files)
    since = F.expr("cast(floor(timestampdiff(SECOND, timestamp_ntz '2024-01-01 00:00:00', ts) / 400) as int)")
    e = e.withColumns(
        {
            "k": F.get_json_object("props", "$.k").cast("int"),
            "t": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            "dmy": F.date_format("ts", "dd/MM/yyyy HH:mm:ss"),
            "syslog": F.date_format("ts", "MMM dd HH:mm:ss"),
            "access": F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss '+0000'"),
            "slow": F.date_format(F.expr("timestamp_ntz '2024-01-01 00:00:00'") + F.make_interval(secs=since), "MMM dd HH:mm:ss"),
            "v2": F.format_string("%.2f", "value"),
        }
    )
    return e.select(F.concat(F.lit(f"{name}-"), F.col("file_no").cast("string")).alias("file_id"), F.col("file_no").alias("file_ord"), "line_no", F.expr(_INTERPRETED.format(line)).alias("line"))


def log_sql(name: str) -> str:
    """The same lines as a common table expression `lines` of the checking engine."""
    line, some, files = LOGS[name]
    return f"""e as (select *, cast(json_extract_string(props, '$.k') as int) as k, strftime(ts, '%Y-%m-%d %H:%M:%S') as t, strftime(ts, '%d/%m/%Y %H:%M:%S') as dmy,
  strftime(ts, '%b %d %H:%M:%S') as syslog, strftime(ts, '%d/%b/%Y:%H:%M:%S +0000') as access, printf('%.2f', value) as v2,
  strftime(timestamp '2024-01-01' + to_seconds(floor(date_diff('second', timestamp '2024-01-01', date_trunc('second', ts)) / 400)::int), '%b %d %H:%M:%S') as slow
  from events where {some}),
lines as (select '{name}-' || cast(user_id % {files} as string) as file_id, cast(row_number() over (partition by user_id % {files} order by ts, event_id) as int) as line_no, {line} as line from e)"""
