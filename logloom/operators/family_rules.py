"""Log families as data: what a line must contain, which signals it can carry, and which findings signals add up to.

Words and patterns are fixed values of the log formats that the families read. hint: a line is looked at only if one of
these occurs in it (lower case), or, as a pattern, matches. A signal matches if any of its words occurs (in lower case, or
as written with exact), or its pattern matches, and all of its `also` words and none of its `never` words occur. value is
a pattern with a number, entity one with a name; the first pattern that finds one counts. A finding needs `least` rows of
its signals, with per over each entity alone; unless names a signal whose presence in the file forbids it; top asks for the
entities with most rows. A signal with `after` counts only where none of those named there does.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Signal:
    name: str
    words: tuple[str, ...] = ()
    pattern: str = ""
    exact: bool = False
    also: tuple[str, ...] = ()
    also_any: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    entity: tuple[str, ...] = ()
    default_entity: str | None = None
    value: str = ""
    least_value: float | None = None
    below: float | None = None
    ratio: str = ""
    after: tuple[str, ...] = ()


@dataclass(frozen=True)
class Finding:
    kind: str
    level: str
    category: str
    signals: tuple[str, ...]
    least: int = 1
    per: bool = False
    distinct: tuple[str, ...] = ()
    unless: str = ""
    suspects: int = 0
    title: str = ""
    over: tuple[float, str] | None = None
    top: int = 0


@dataclass(frozen=True)
class Family:
    name: str
    hint: tuple[str, ...]
    signals: tuple[Signal, ...]
    findings: tuple[Finding, ...]
    hint_pattern: str = ""
    rules: tuple[tuple[str, str, str, str], ...] = field(default=())
    builtin: bool = False


_USER = r"(?i)user=([a-zA-Z0-9_\-]+)"
_POD = r"\bpod/([a-z0-9\-]+)"
_ACCESS = r'^([\d.]+)\s+-\s+\S+\s+\[[^\]]+\]\s+"\w+\s+\S+\s+HTTP/[\d.]+"\s+'
_PATH = r'^[\d.]+\s+-\s+\S+\s+\[[^\]]+\]\s+"\w+\s+\S*'
_TAIL = r'\s+(?:\d+|-)\s+"[^"]*"\s+"[^"]*"'
_LDAP_USER = (r"(?:uid|user|account)=([a-zA-Z0-9._\-]+)", r"Account Name:\s*([a-zA-Z0-9._\-]+)")
_KEY_USER = r"(?i)(?:user|for user)[:=\s]+([a-zA-Z0-9_\-]+)"
_ENDPOINT = r"""(?i)(?:endpoint|uri|path|request)\s*[:=]\s*["']?(/[^\s"']+)"""
_MS = r"(?i)(?:response_time|duration|elapsed|took|latency)\s*[:=]\s*(\d+)\s*(?:ms|milliseconds)?"
_MFA_USER = r"(?i)(?:user|username|uid)[:\s=]*([^,\s;]+)"
_KID = r"""(?i)kid["']?\s*[:=]\s*["']?([A-Za-z0-9_-]+)"""
_CLAIM = r"""(?i)claim["']?\s*[:=]\s*["']?(\w+)["']?"""


def _status(code: int) -> Signal:
    return Signal(f"status_{code}", pattern=rf"{_ACCESS}{code}{_TAIL}", entity=(_ACCESS,))


#: Classes of attacks by what a path holds; the first that fits counts.
ATTACKS = (
    ("admin_probe", r"/admin|/wp-admin|/panel|/phpmyadmin"),
    ("webshell_probe", r"\.php\?|\.asp\?|shell\.php"),
    ("dotfile_probe", r"\.env|\.git|\.aws"),
    ("sql_injection", r"sql|union|select|drop|insert"),
    ("path_traversal", r"\.\./|\.\.\\"),
)


def _probes() -> tuple[Signal, ...]:
    pattern = lambda held: rf"""(?i){_PATH}(?:{held})\S*\s+HTTP/[\d.]+"\s+\d{{3}}{_TAIL}"""
    return tuple(Signal(name, pattern=pattern(held), also_any=(f"(?i){held}",), entity=(_ACCESS,), after=tuple(n for n, _ in ATTACKS[:k])) for k, (name, held) in enumerate(ATTACKS))


FAMILIES: tuple[Family, ...] = (
    Family(
        "nginx",
        (),
        (
            _status(500),
            _status(502),
            _status(503),
            _status(504),
            Signal("denied", pattern=rf"{_ACCESS}(?:401|403){_TAIL}", entity=(_ACCESS,)),
            *_probes(),
            Signal("slow", pattern=rf"{_ACCESS}\d{{3}}{_TAIL}\s+[\d.]+", value=rf"{_ACCESS}\d{{3}}{_TAIL}\s+(\d+(?:\.\d+)?)", least_value=1.0000001, entity=(_ACCESS,)),
        ),
        (
            Finding("internal_error", "ERROR", "http", ("status_500",), title="HTTP 500 errors"),
            Finding("bad_gateway", "ERROR", "http", ("status_502",), title="HTTP 502 errors"),
            Finding("service_unavailable", "ERROR", "http", ("status_503",), title="HTTP 503 errors"),
            Finding("gateway_timeout", "ERROR", "http", ("status_504",), title="HTTP 504 errors"),
            Finding("auth_cascade", "WARN", "security-auth", ("denied",), least=3, per=True, title="Auth cascade from {entity}"),
            Finding("attack_probe", "ERROR", "security", tuple(name for name, _ in ATTACKS), least=2, per=True, title="Attack probe from {entity}"),
            Finding("slow_requests", "WARN", "performance", ("slow",), least=3, title="Slow requests detected"),
        ),
        hint_pattern=r"\d{3}\s+\d+",
        rules=(
            (rf"{_ACCESS}40[13]{_TAIL}", "WARN", "http", "forbidden"),
            (rf"{_ACCESS}404{_TAIL}", "INFO", "http", "not_found"),
            (rf"{_ACCESS}(?:429|50[0234]){_TAIL}", "ERROR", "http", "error"),
        ),
        builtin=True,
    ),
    Family(
        "oauth2",
        ("oauth", "token", "grant_type", "client_id", "scope", "authorization", "refresh_token", "access_token", "bearer", "code="),
        (
            Signal("access_token", pattern=r"(?i)(?:access_token|Bearer)\s*[=:]\s*(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", entity=(r"(?i)(?:access_token|Bearer)\s*[=:]\s*(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)",)),
            Signal("refresh_token", pattern=r"(?i)refresh_token\s*[=:]\s*([A-Za-z0-9._-]+)"),
            Signal("secret", pattern=r"(?i)(?:client_secret|secret)\s*[=:]\s*([^\s,;]+)", entity=(r"(?i)(?:client_secret|secret)\s*[=:]\s*([^\s,;]+)",)),
            Signal("no_state", pattern=r"(?i)(?:auth|authorization).*?(?:endpoint|code)\s*[=:]\s*", also=("authorization",), never=(r"(?i)state\s*[=:]\s*\S+",)),
            Signal("code_reuse", pattern=r"(?i)(?:code.*(?:already used|reuse|duplicate)|authorization code.*(?:invalid|expired|used))"),
            Signal("implicit", pattern=r"(?i)response_type.*token|grant_type.*implicit|implicit.*flow.*deprecated|response_type\s*[=:]\s*token(?:\s|$)"),
            Signal("no_pkce", pattern=r"(?i)grant_type\s*[=:]\s*authorization_code(?:\s|$)", also=("native",), never=(r"(?i)pkce|code_challenge",)),
            Signal("expired", pattern=r"(?i)(?:token|access).*(?:expired|invalid)"),
            Signal("invalid_grant", pattern=r"(?i)invalid_grant|error.*grant"),
            Signal("invalid_scope", pattern=r"(?i)invalid_scope|error.*scope"),
            Signal("redirect", also=("redirect_uri", "mismatch"), words=("mismatch",)),
        ),
        (
            Finding("token_exposure", "CRITICAL", "oauth2", ("access_token", "refresh_token"), distinct=("access_token",), title="OAuth2 token_exposure"),
            Finding("client_secret_exposure", "CRITICAL", "oauth2", ("secret",), distinct=("secret",), title="OAuth2 client_secret_exposure"),
            Finding("missing_state", "CRITICAL", "oauth2", ("no_state",), title="OAuth2 missing_state"),
            Finding("code_reuse", "HIGH", "oauth2", ("code_reuse",), title="OAuth2 code_reuse"),
            Finding("implicit_flow", "HIGH", "oauth2", ("implicit",), title="OAuth2 implicit_flow"),
            Finding("missing_pkce", "HIGH", "oauth2", ("no_pkce",), title="OAuth2 missing_pkce"),
            Finding("token_validation_fail", "WARN", "oauth2", ("expired",), title="OAuth2 token_validation_fail"),
            Finding("invalid_grant", "WARN", "oauth2", ("invalid_grant",), title="OAuth2 invalid_grant"),
            Finding("invalid_scope", "WARN", "oauth2", ("invalid_scope",), title="OAuth2 invalid_scope"),
            Finding("redirect_uri_mismatch", "WARN", "oauth2", ("redirect",), title="OAuth2 redirect_uri_mismatch"),
        ),
        rules=(
            (r"(?i)(?:access_token|Bearer|token).*(?:exposed|leaked|logged|plaintext)", "CRITICAL", "oauth2", "token_exposure"),
            (r"(?i)(?:client_secret|secret)\s*[=:]\s*[^\s,;]+", "CRITICAL", "oauth2", "client_secret_exposure"),
            (r"(?i)(?:code.*(?:already used|reuse|duplicate)|authorization code.*(?:invalid|expired|used))", "HIGH", "oauth2", "code_reuse"),
            (r"(?i)response_type.*token|grant_type.*implicit|implicit.*flow.*deprecated", "HIGH", "oauth2", "implicit_flow"),
            (r"(?i)invalid_grant|error.*grant", "WARN", "oauth2", "invalid_grant"),
        ),
        builtin=True,
    ),
    Family(
        "docker",
        ("docker", "container", "pod", "kubernetes", "k8s", "replica", "crashloop", "oomkilled", "imagepull", "namespace="),
        (
            Signal("crashloop", words=("crashloop",), entity=(_POD,)),
            Signal("oom", words=("OOMKilled", "Out of memory", "Memory limit exceeded", "Cannot allocate"), exact=True, entity=(_POD,)),
            Signal("pull", words=("ImagePullBackOff", "pull rate exceeded", "unauthorized", "manifest not found", "connection refused"), exact=True, entity=(_POD,)),
            Signal("restart", words=("restart", "rebooted", "bouncing", "respawning"), pattern="", also_any=(_POD,), entity=(_POD,)),
            Signal("pressure", words=("MemoryPressure", "DiskPressure", "PIDPressure", "NotReady", "evicted"), exact=True),
            Signal("crash", words=("CrashLoopBackOff", "Terminated", "Exit code", "fatal", "panic", "segmentation fault"), exact=True, entity=(_POD,)),
        ),
        (
            Finding("crashloop", "CRITICAL", "container", ("crashloop",), title="Container crash loop"),
            Finding("oomkilled", "CRITICAL", "resource", ("oom",), title="Out of memory"),
            Finding("image_pull_error", "ERROR", "image", ("pull",), title="Image pull errors"),
            Finding("restart_storm", "WARN", "lifecycle", ("restart",), least=3, per=True, title="Restart storm of {entity}"),
            Finding("node_pressure", "WARN", "node", ("pressure",), title="Node pressure"),
        ),
        rules=(
            (r"CrashLoopBackOff|OOMKilled", "CRITICAL", "container", "lifecycle_error"),
            (r"ImagePullBackOff", "ERROR", "image", "pull_error"),
            (r"MemoryPressure|DiskPressure|PIDPressure|NotReady|evicted", "WARN", "node", "pressure"),
        ),
        builtin=True,
    ),
    Family(
        "postgresql",
        ("postgres", "postgresql", "pg", "pgsql", "deadlock", "statement timeout", "too many connections", "authentication failed", "error", "warning"),
        (
            Signal("deadlock", words=("deadlock detected", "could not serialize access", "concurrent update"), entity=(r"(?i)database=([a-zA-Z0-9_\-]+)",)),
            Signal("timeout", words=("timeout", "canceling statement"), entity=(_USER,)),
            Signal("timeout_took", words=("timeout", "canceling statement"), value=r"duration:\s*(\d+(?:\.\d+)?)\s*ms", least_value=0.0),
            Signal("connections", words=("too many connections", "connection limit exceeded", "role limit exceeded"), entity=(r"(?i)database=([a-zA-Z0-9_\-]+)",)),
            Signal("auth", words=("authentication failed", "permission denied", "does not exist", "invalid password"), entity=(_USER,)),
            Signal("disk", words=("no space left on device", "disk full", "write failed", "checkpoint")),
            Signal("took", words=("duration:",), value=r"duration:\s*(\d+(?:\.\d+)?)\s*ms", least_value=1000.0000001),
        ),
        (
            Finding("deadlock", "CRITICAL", "concurrency", ("deadlock",), title="Deadlocks"),
            Finding("query_timeout", "ERROR", "performance", ("timeout",), title="Query timeouts"),
            Finding("connection_exhausted", "ERROR", "connection", ("connections",), title="Connections exhausted"),
            Finding("auth_failure", "WARN", "security", ("auth",), title="Authentication failures", top=5),
            Finding("disk_issue", "CRITICAL", "storage", ("disk",), title="Disk issues"),
            Finding("slow_queries", "WARN", "performance", ("timeout_took", "took"), least=3, title="Slow queries"),
        ),
        rules=(
            (r"(?i)deadlock", "CRITICAL", "concurrency", "deadlock"),
            (r"(?i)timeout", "ERROR", "performance", "timeout"),
            (r"(?i)too many connections", "ERROR", "connection", "exhaustion"),
            (r"(?i)no space left", "CRITICAL", "storage", "disk_full"),
        ),
        builtin=True,
    ),
    Family(
        "ldap",
        ("ldap", "active directory", "ad", "bind", "auth", "account", "lockout", "password", "authentication", "domain"),
        (
            Signal("bind", words=("bind failed", "invalid credentials", "invalid password", "authentication failed", "invalid dn"), entity=_LDAP_USER),
            Signal("lockout", words=("account locked", "too many failures", "failed login attempts", "lockout threshold", "password incorrect"), entity=_LDAP_USER),
            Signal("expired", words=("password expired", "account expired", "grace logins", "password must change"), entity=_LDAP_USER),
            Signal("group", words=("added to group", "removed from group", "group membership", "group change")),
            Signal("denied", words=("access denied", "permission denied", "insufficient privileges", "authorization failed"), entity=_LDAP_USER),
            Signal("mfa", words=("mfa required", "mfa failed", "mfa timeout", "mfa challenge", "2fa", "totp"), also_any=("(?i)failed|timeout",), entity=_LDAP_USER),
        ),
        (
            Finding("account_lockout", "CRITICAL", "iam", ("lockout",), title="Account lockouts"),
            Finding("bind_failures", "WARN", "iam", ("bind",), suspects=5, title="Bind failures"),
            Finding("mfa_failure", "ERROR", "iam", ("mfa",), title="MFA failures"),
            Finding("password_expiration", "WARN", "iam", ("expired",), title="Password expirations"),
            Finding("permission_denied", "WARN", "iam", ("denied",), title="Permissions denied"),
            Finding("group_membership_change", "INFO", "iam", ("group",), title="Group changes"),
        ),
        rules=(
            (r"(?i)account locked", "CRITICAL", "iam", "lockout"),
            (r"(?i)mfa failed|mfa timeout", "ERROR", "iam", "mfa_failure"),
            (r"(?i)bind failed|authentication failed", "WARN", "iam", "bind_failure"),
            (r"(?i)permission denied", "WARN", "iam", "permission"),
        ),
        builtin=True,
    ),
    Family(
        "ssh_keys",
        ("ssh", "key", "authorized_keys", "rsa", "ed25519", "keygen", "fingerprint", "pubkey", "authentication"),
        (
            Signal("generated", words=("key generated", "new key created", "keygen", "generating key", "key creation"), entity=(_KEY_USER,)),
            Signal("deleted", words=("key deleted", "key removed", "removed from authorized", "revoked key", "key revocation"), entity=(_KEY_USER,)),
            Signal("rotated", pattern=r"(?i)key rotation|rotating key|replace.*key|update.*key", entity=(_KEY_USER,)),
            Signal("weak", pattern=r"(?i)weak key|rsa.*1024|dsa|deprecated|insufficient key|key size too small", entity=(_KEY_USER,)),
            Signal("unauthorized", words=("unauthorized key", "unexpected key", "unknown key", "suspicious key", "unauthorized access"), entity=(_KEY_USER,)),
            Signal("stale", words=("stale key", "old key", "obsolete", "not rotated"), entity=(_KEY_USER,)),
        ),
        (
            Finding("unauthorized_ssh_key", "CRITICAL", "iam-security", ("unauthorized",), title="Unauthorized SSH keys"),
            Finding("weak_ssh_key", "CRITICAL", "iam-security", ("weak",), title="Weak SSH keys"),
            Finding("key_deletion_without_rotation", "WARN", "iam-operations", ("deleted",), unless="rotated", title="Key deletions without rotation"),
            Finding("stale_ssh_key", "WARN", "iam-hygiene", ("stale",), title="Stale SSH keys"),
            Finding("key_rotation_performed", "INFO", "iam-hygiene", ("rotated",), title="Key rotations"),
        ),
        rules=(
            (r"(?i)unauthorized key", "CRITICAL", "iam-security", "unauthorized_key"),
            (r"(?i)weak key|rsa 1024", "CRITICAL", "iam-security", "weak_key"),
            (r"(?i)key deletion", "WARN", "iam-operations", "deletion"),
            (r"(?i)stale key", "WARN", "iam-hygiene", "stale"),
        ),
        builtin=True,
    ),
    Family(
        "html",
        ("<html", "<body", "<div", "<p", "error", "exception", "500", "502", "503", "504", "traceback", "stack trace"),
        (
            Signal("server", pattern=r"<[^>]*>[5-9]\d\d[<\s]", value=r"<[^>]*>(\d{3})[<\s]", least_value=500.0),
            Signal("client", pattern=r"<[^>]*>4\d\d[<\s]", value=r"<[^>]*>(\d{3})[<\s]", least_value=400.0, below=500.0),
            Signal("exception", pattern=r"(?i)(?:<[^>]*>)?((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*(?:Exception|Error))[<:\s]", entity=(r"(?i)(?:<[^>]*>)?((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*(?:Exception|Error))[<:\s]",)),
            Signal("trace", pattern=r"""(?i)(?:File|at)\s+["']?([^"'<>\s]+)["']?.*?(?:line|:)\s+(\d+)""", entity=(r"""(?i)(?:File|at)\s+["']?([^"'<>\s]+)["']?.*?(?:line|:)\s+\d+""",)),
        ),
        (
            Finding("server_error", "CRITICAL", "http-error", ("server",), title="HTML server error"),
            Finding("exception", "ERROR", "code-error", ("exception",), title="HTML exceptions found"),
            Finding("stack_trace", "WARN", "debugging", ("trace",), title="HTML stack traces"),
            Finding("client_error", "INFO", "http-error", ("client",), title="HTML client errors"),
        ),
    ),
    Family(
        "jwt",
        ("jwt", "token", "signature", "expired", "jwks", "claim", "revok", "payload", "kid", "aud", "iss", "sub"),
        (
            Signal("signature", pattern=r"(?i)(?:jwt|token).*?(?:signature|verify).*?(?:fail|invalid|mismatch)", entity=(_KID,)),
            Signal("expired", pattern=r"(?i)(?:token|jwt).*?(?:expired|exp|expir)"),
            Signal("claim", pattern=r"(?i)(?:claim|payload).*?(?:invalid|mismatch|missing)", entity=(_CLAIM,), default_entity="unknown"),
            Signal("revoked", pattern=r"(?i)(?:token|jwt).*?(?:revok|blacklist|logout)"),
            Signal("rotation", pattern=r"(?i)(?:jwks|key.*?rotation|key.*?update)", value=r"(?i)(\d+)\s*keys?"),
            Signal("missing", words=("missing",), also_any=(r"(?i)claim|aud|iss|sub|exp",), entity=(_CLAIM,), default_entity="unknown"),
        ),
        (
            Finding("signature_validation_fail", "CRITICAL", "security-token", ("signature",), title="JWT signature validation failures"),
            Finding("token_expired", "WARN", "token-lifecycle", ("expired",), title="Expired JWT tokens"),
            Finding("claim_validation_fail", "ERROR", "token-payload", ("claim",), title="JWT claim validation failures"),
            Finding("token_revoked", "ERROR", "token-revocation", ("revoked",), title="Revoked JWT tokens"),
            Finding("jwks_rotation", "INFO", "key-management", ("rotation",), title="JWKS key rotation events"),
            Finding("claim_missing", "WARN", "token-payload", ("missing",), title="Missing JWT claims"),
        ),
        hint_pattern=r"(?i)eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+",
    ),
    Family(
        "api_performance",
        ("response_time", "duration", "elapsed", "took", "latency", "endpoint", "api", "timeout", "rate_limit", "429", "p95", "p99", "slow", "throttle"),
        (
            Signal("critical", pattern=_MS, value=_MS, least_value=5000.0, entity=(_ENDPOINT,), default_entity="unknown"),
            Signal("slow", pattern=_MS, value=_MS, least_value=1000.0, below=5000.0, entity=(_ENDPOINT,), default_entity="unknown"),
            Signal("timeout", pattern=r"(?i)(?:timeout|timed out|exceeded.*?timeout)", entity=(_ENDPOINT,), default_entity="unknown"),
            Signal("limit", pattern=r"(?i)(?:429|rate.*?limit|throttl)", entity=(_ENDPOINT,), default_entity="unknown"),
        ),
        (
            Finding("critical_slow", "CRITICAL", "performance", ("critical",), title="Critical slow API responses"),
            Finding("slow_api", "WARN", "performance", ("slow",), title="Slow API responses"),
            Finding("timeout", "ERROR", "reliability", ("timeout",), title="API timeout events"),
            Finding("rate_limit", "WARN", "reliability", ("limit",), title="Rate limit events"),
        ),
    ),
    Family(
        "test_lifecycle",
        ("test", "fixture", "setup", "teardown", "cleanup", "mock", "database", "rollback", "transaction", "orphan", "state", "isolation"),
        (
            Signal("cleanup", words=("cleanup",), also=("fail",), value=r"(?i)(\d+)\s*rows?", entity=(r"(?i)(?:cleanup|delete|remove).*?(?:test.*?data|fixture)[:\s]*(\w+)",), default_entity="unknown"),
            Signal("orphan", pattern=r"(?i)(?:orphan|stale|abandoned|cleanup.*?fail)", value=r"(?i)(\d+)\s*rows?", entity=(r"(?i)(?:table|from)\s*=?\s*(\w+)",), default_entity="unknown"),
            Signal("rollback", pattern=r"(?i)(?:rollback|transaction.*?(?:fail|abort|cancel))"),
            Signal("leak", pattern=r"(?i)(?:state.*?leak|cross-test.*?pollution|isolation.*?fail)"),
            Signal("mock", pattern=r"(?i)(?:mock|stub|fake).*?(?:service|server).*?(?:start|stop|unavailable)", also=("unavailable",)),
        ),
        (
            Finding("rollback_failure", "CRITICAL", "test-infrastructure", ("rollback",), title="Rollback failures"),
            Finding("state_leakage", "ERROR", "test-flakiness", ("leak",), title="State leakage"),
            Finding("cleanup_failure", "ERROR", "test-infrastructure", ("cleanup",), title="Cleanup failures"),
            Finding("orphaned_data", "WARN", "test-infrastructure", ("orphan",), title="Orphaned data"),
            Finding("mock_unavailable", "WARN", "test-infrastructure", ("mock",), title="Mock services unavailable"),
        ),
    ),
    Family(
        "mfa",
        ("mfa", "2fa", "totp", "sms", "backup", "code", "token", "hardware", "yubikey", "push", "notification", "authenticator", "factor", "otp", "time_skew", "bypass"),
        (
            Signal("totp", pattern=r"(?i)(?:totp|time.*?based.*?otp).*?(?:fail|invalid|mismatch|expired)", entity=(_MFA_USER,), default_entity="unknown"),
            Signal("skew", pattern=r"(?i)(?:totp|otp).*?(?:time.*?skew|clock.*?drift|time_diff)[:\s=]*(\d+)", value=r"(?i)(?:totp|otp).*?(?:time.*?skew|clock.*?drift|time_diff)[:\s=]*(\d+)", entity=(_MFA_USER,), default_entity="unknown"),
            Signal("sms", pattern=r"(?i)sms.*?(?:fail|error|unable|rejected|timeout)", entity=(_MFA_USER,), default_entity="unknown"),
            Signal("retry", ratio=r"(?i)sms.*?retry[:\s=]*(\d+)/(\d+)", entity=(_MFA_USER,), default_entity="unknown"),
            Signal("backup", pattern=r"(?i)(?:backup.*?code|backup).*?(?:exhausted|depleted|empty|no.*?remaining)", entity=(_MFA_USER,), default_entity="unknown"),
            Signal("bypass", pattern=r"(?i)(?:mfa|2fa).*?(?:bypass|circumvent|skip|disable)", entity=(_MFA_USER,), default_entity="unknown"),
            Signal("hardware", pattern=r"(?i)(?:hardware|yubikey|hardware token).*?(?:fail|error|not.*?responding)", entity=(_MFA_USER,), default_entity="unknown"),
            Signal("push", pattern=r"(?i)push.*?(?:timeout|expired|no.*?response)", entity=(_MFA_USER,), default_entity="unknown"),
        ),
        (
            Finding("backup_codes_exhausted", "CRITICAL", "mfa", ("backup",), title="Backup codes exhausted"),
            Finding("mfa_bypass", "CRITICAL", "security-auth", ("bypass",), title="MFA bypass attempts"),
            Finding("sms_retry_exhausted", "ERROR", "mfa-delivery", ("retry",), title="SMS retries exhausted"),
            Finding("hardware_failure", "ERROR", "mfa", ("hardware",), title="Hardware token failures"),
            Finding("totp_failure", "WARN", "mfa", ("totp",), title="TOTP failures"),
            Finding("totp_time_skew", "WARN", "mfa", ("skew",), title="TOTP time skew"),
            Finding("sms_failure", "WARN", "mfa-delivery", ("sms",), title="SMS failures"),
            Finding("push_timeout", "WARN", "mfa-delivery", ("push",), title="Push timeouts"),
        ),
    ),
    Family(
        "permissions",
        ("role", "permission", "grant", "deny", "access", "group", "admin", "escalat", "revok", "assign", "privilege", "service", "account", "tenant"),
        (
            Signal("grant", pattern=r"(?i)(?:role|permission).*?(?:grant|assign|add)[:\s]+(\w+).*?(?:user|account)[:\s]+(\w+)", entity=(r"(?i)(?:role|permission).*?(?:grant|assign|add)[:\s]+\w+.*?(?:user|account)[:\s]+(\w+)",)),
            Signal("revoke", pattern=r"(?i)(?:role|permission).*?(?:revok|remov|deniy)[:\s]+(\w+).*?(?:user|account)[:\s]+(\w+)", entity=(r"(?i)(?:role|permission).*?(?:revok|remov|deniy)[:\s]+\w+.*?(?:user|account)[:\s]+(\w+)",)),
            Signal("escalation", pattern=r"(?i)(?:permission|privilege).*?escalat|attempted.*?(?:admin|sudo|root)"),
            Signal("group", pattern=r"(?i)(?:group|team).*?(?:add|remove|member)[:\s]+(\w+).*?group[:\s]+(\w+)", entity=(r"(?i)(?:group|team).*?(?:add|remove|member)[:\s]+(\w+).*?group[:\s]+\w+",)),
            Signal("service", pattern=r"(?i)(?:service.*?account|bot|automation).*?permission"),
            Signal("tenant", pattern=r"(?i)(?:cross-tenant|multi-tenant|inter-org).*?access"),
        ),
        (
            Finding("escalation_attempt", "CRITICAL", "access-control", ("escalation",), title="Permission escalation attempts"),
            Finding("cross_tenant", "CRITICAL", "multi-tenancy", ("tenant",), title="Cross-tenant accesses"),
            Finding("role_grant", "INFO", "access-control", ("grant",), title="Role grants"),
            Finding("role_revoke", "INFO", "access-control", ("revoke",), title="Role revokes"),
            Finding("group_change", "INFO", "group-management", ("group",), title="Group changes"),
        ),
    ),
    Family(
        "service_comms",
        ("service", "circuit", "retry", "timeout", "discovery", "unavailable", "endpoint"),
        (
            Signal("discovery", pattern=r"(?i)(?:service.*?discovery|lookup).*?(?:fail|not.*?found)"),
            Signal("circuit", pattern=r"(?i)(?:circuit.*?breaker|open|trip)", after=("discovery",)),
            Signal("cascade", pattern=r"(?i)(?:cascad|chain).*?timeout", after=("discovery", "circuit")),
            Signal("retry", ratio=r"(?i)retry[:\s=]*(\d+)/(\d+)"),
        ),
        (
            Finding("circuit_breaker", "CRITICAL", "service-reliability", ("circuit",), title="Circuit breaker events"),
            Finding("timeout_cascade", "ERROR", "service-reliability", ("cascade",), title="Timeout cascades"),
            Finding("retry_exhausted", "ERROR", "service-reliability", ("retry",), title="Retry exhaustion"),
        ),
    ),
    Family(
        "database",
        ("query", "database", "sql", "slow", "deadlock"),
        (
            Signal("slow", pattern=r"(?i)(?:slow|duration)[:\s=]*(\d+)\s*(?:ms|s)", value=r"(?i)(?:slow|duration)[:\s=]*(\d+)\s*(?:ms|s)"),
            Signal("many", pattern=r"(?i)(?:n\+1|sequential.*?query)"),
            Signal("deadlock", words=("deadlock",)),
        ),
        (
            Finding("deadlock", "CRITICAL", "database", ("deadlock",), title="Database deadlocks"),
            Finding("slow_query", "WARN", "database", ("slow",), title="Slow queries"),
            Finding("n_plus_one", "ERROR", "database", ("many",), title="N+1 query patterns"),
        ),
    ),
    Family(
        "message_queue",
        ("message", "queue", "event", "dlq", "kafka", "rabbit"),
        (
            Signal("delivery", pattern=r"(?i)(?:message|event).*?(?:fail|error|rejected)"),
            Signal("dlq", pattern=r"(?i)(?:dlq|dead.*?letter|dead.*?queue)"),
            Signal("order", pattern=r"(?i)(?:order|sequence).*?(?:violation|wrong)"),
            Signal("lag", pattern=r"(?i)(?:lag|consumer.*?lag)[:\s=]*(\d+)", value=r"(?i)(?:lag|consumer.*?lag)[:\s=]*(\d+)", least_value=1.0),
        ),
        (
            Finding("delivery_failure", "ERROR", "messaging", ("delivery",), title="Message delivery failures"),
            Finding("dlq", "ERROR", "messaging", ("dlq",), title="DLQ messages"),
            Finding("consumer_lag", "WARN", "messaging", ("lag",), title="Consumer lag"),
        ),
    ),
    Family(
        "browser",
        ("element", "javascript", "browser", "selenium", "playwright", "js_error"),
        (
            Signal("element", pattern=r"(?i)(?:element|selector).*?(?:not.*?found|timeout|stale)"),
            Signal("script", pattern=r"(?i)(?:javascript|js).*?(?:error|undefined|exception)"),
        ),
        (
            Finding("element_failure", "ERROR", "browser", ("element",), title="Element not found"),
            Finding("js_error", "ERROR", "browser", ("script",), title="JS errors"),
        ),
    ),
    Family(
        "visual",
        ("visual", "screenshot", "regression", "diff", "pixel"),
        (
            Signal("diff", pattern=r"(?i)(?:visual|diff|difference)[:\s=]*(\d+)(?:\.\d+)?%", value=r"(?i)(?:visual|diff|difference)[:\s=]*(\d+)(?:\.\d+)?%"),
            Signal("regression", pattern=r"(?i)(?:regression|changed|differs)"),
        ),
        (
            Finding("visual_diff", "WARN", "visual", ("diff",), title="Visual diffs"),
            Finding("regression", "ERROR", "visual", ("regression",), title="Visual regressions"),
        ),
    ),
    Family(
        "user_journey",
        ("session", "user", "action", "journey", "funnel", "dropout"),
        (
            Signal("action", pattern=r"(?i)(?:action|event)[:\s=]*([a-z_]+)"),
            Signal("dropout", pattern=r"(?i)(?:dropout|abandon|exit)"),
        ),
        (
            Finding("dropout", "WARN", "analytics", ("dropout",), title="User dropouts"),
            Finding("action", "INFO", "analytics", ("action",), title="User actions"),
        ),
    ),
    Family(
        "error_impact",
        ("error", "outage", "impact", "affected", "unavailable"),
        (
            Signal("error", pattern=r"(?i)(?:error|outage|unavailable)"),
            Signal("users", pattern=r"(?i)users?.*?(?:affected|impact)[:\s=]*(\d+)", value=r"(?i)users?.*?(?:affected|impact)[:\s=]*(\d+)"),
            Signal("lasted", pattern=r"(?i)(?:duration|lasted)[:\s=]*(\d+)\s*(?:s|m|ms)", value=r"(?i)(?:duration|lasted)[:\s=]*(\d+)\s*(?:s|m|ms)"),
        ),
        (Finding("error_impact", "ERROR", "incident", ("error",), over=(100.0, "users"), title="Error events"),),
    ),
)

#: Line rules of sshd, first match wins; the body of a "message repeated" line counts as the line.
SSH_RULES = (
    (r"(?i)POSSIBLE BREAK-IN ATTEMPT", "WARN", "security", "reverse_dns_mismatch"),
    (r"(?i)\bfatal:", "ERROR", "ssh", "fatal"),
    (r"(?i)Too many authentication failures", "ERROR", "security", "too_many_failures"),
    (r"(?i)No more user authentication methods available", "ERROR", "security-auth", "no_more_methods"),
    (r"(?i)PAM\b.*\bauthentication failures?\b", "ERROR", "security-auth", "pam_failures"),
    (r"(?i)\berror:", "ERROR", "ssh", "error"),
    (r"(?i)Failed password", "WARN", "security-auth", "failed_password"),
    (r"(?i)Failed none", "WARN", "security-auth", "failed_none"),
    (r"(?i)authentication failure", "WARN", "security-auth", "auth_failure"),
    (r"(?i)Invalid user", "WARN", "security-auth", "invalid_user"),
)
