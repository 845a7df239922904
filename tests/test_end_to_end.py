import json

from secspark.plans.run import run_pipeline

AUTH = "\n".join(
    [f"Mar  7 14:00:0{i} edge3 sshd[1{i}]: Accepted publickey for noor from 10.8.7.6 port 40404 ssh2" for i in range(2)]
    + [f"Mar  7 14:10:{7 * i:02d} edge3 sshd[2{i}]: Failed password for invalid user kim from 198.18.4.9 port 40404 ssh2"
       for i in range(8)]
    + ["Mar  7 14:11:05 edge3 sshd[30]: Accepted password for kim from 198.18.4.9 port 40404 ssh2",
       "Mar  7 14:30:00 edge3 cron[9]: rotated logs"]) + "\n"
NGINX = "\n".join([
    '203.0.113.7 - - [07/Mar/2026:14:05:00 +0000] "GET /search?q=1\' OR \'1\'=\'1 HTTP/1.1" 200 64 "-" "curl/8.4.0"',
    '10.0.0.5 - - [07/Mar/2026:14:01:12 +0000] "GET / HTTP/1.1" 200 7421 "-" "curl/8.4.0"']) + "\n"
APACHE = '198.51.100.42 - - [07/Mar/2026:14:07:10 +0000] "GET /etc/passwd HTTP/1.1" 404 64 "-" "curl/8.4.0"\n'
WINDOWS = json.dumps([
    {"EventID": 4688, "TimeCreated": "2026-03-07T14:20:00+00:00",
     "Properties": [{"Key": "NewProcessName", "Value": "C:\\Tools\\mimikatz.exe"},
                    {"Key": "CommandLine", "Value": "mimikatz.exe privilege::debug"}]},
    {"EventID": 4624, "TimeCreated": "2026-03-07T14:21:00+00:00",
     "Properties": [{"Key": "TargetUserName", "Value": "root"}, {"Key": "IpAddress", "Value": "::1"}]}])
TRAVEL = "\n".join(json.dumps(r) for r in [
    {"timestamp": "2026-03-07T14:00:00+00:00", "user_name": "alice", "source_ip": "1.2.3.4", "source_geo_country": "US",
     "event_action": "login", "event_outcome": "success"},
    {"timestamp": "2026-03-07T14:30:00+00:00", "user_name": "alice", "source_ip": "5.6.7.8", "source_geo_country": "CN",
     "event_action": "login", "event_outcome": "success"}]) + "\n"


def test_pipeline_files(spark, tmp_path):
    files = {"auth.log": AUTH, "nginx_access.log": NGINX, "apache_access.log": APACHE,
             "windows_events.json": WINDOWS, "impossible_travel.jsonl": TRAVEL}
    paths = []
    for name, text in files.items():
        p = tmp_path / name
        p.write_text(text)
        paths.append(str(p))
    out = str(tmp_path / "out")
    res = run_pipeline(spark, paths, out=out, year=2026)
    s = res["summary"]
    assert s["by_source_type"] == {"linux_auth": 11, "nginx": 2, "apache": 1, "windows_json": 2, "json": 2}
    assert s["by_rule"] == {"BF-001": 1, "SP-001": 1, "WA-001": 2, "IT-001": 1}
    assert s["by_severity"] == {"high": 2, "critical": 2, "medium": 1}
    ts = [r["timestamp"] for r in res["alerts"].collect()]
    assert ts == sorted(ts, reverse=True)
    assert json.loads(spark.read.text(out + "/summary").first()["value"])["event_count"] == 18
    assert res["counters"] == {"linux_auth": {"parsed": 11, "skipped": 1}, "nginx": {"parsed": 2, "skipped": 0},
                               "apache": {"parsed": 1, "skipped": 0}, "windows_json": {"parsed": 2, "skipped": 0},
                               "json": {"parsed": 2, "skipped": 0}}
    again = run_pipeline(spark, paths, year=2026)["summary"]
    assert again["by_rule"] == s["by_rule"]


def _document(path):
    import json
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


def test_report_is_one_json_document(spark, tmp_path):
    """The part files, one after the other, are the report: summary, alerts newest first with their events, event count."""
    from pyspark.sql import functions as F

    from events_helper import at, make_events
    from secspark.operators.rules import all_rules, detect, evidence
    from secspark.session import stored
    from secspark.sources import sinks
    rows = [{"timestamp": at(i), "event_action": "login", "event_outcome": "failure", "user_name": "u", "source_ip": "9.9.9.9"}
            for i in range(300)]
    rows += [{"timestamp": at(1000 + i), "event_action": "http_request", "http_url": f"/x?q={i}' UNION SELECT \"a\",b\n é", "source_ip": "1.1.1.1"}
             for i in range(20)]
    ev = make_events(spark, rows)
    alerts = stored(detect(ev, all_rules()), "alerts")
    found = evidence(ev, all_rules())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several part files for few lines
    try:
        summary = sinks.write_report(alerts, ev, str(tmp_path / "r"), found)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    doc = _document(tmp_path / "r")
    assert list(doc) == ["summary", "alerts", "event_count"] and doc["event_count"] == 320 == summary["event_count"]
    assert len(doc["alerts"]) == alerts.count() == doc["summary"]["total_alerts"] == 21
    times = [a["timestamp"] for a in doc["alerts"]]
    assert times == sorted(times, reverse=True)
    want = {r["alert_id"]: sorted(r["f"]) for r in found.groupBy("alert_id").agg(F.collect_list("event_fingerprint").alias("f")).collect()}
    assert {a["alert_id"]: a["source_events"] for a in doc["alerts"]} == want
    assert max(len(a["source_events"]) for a in doc["alerts"]) == 300
    assert set(doc["alerts"][0]) == {"rule_id", "rule_name", "severity", "description", "timestamp", "alert_id", "source_events", "context"}
    assert len(list((tmp_path / "r").glob("part-*"))) > 1
    sinks.write_report(alerts.limit(0), ev, str(tmp_path / "none"), found.limit(0))
    assert _document(tmp_path / "none")["alerts"] == []


def test_findings_report_is_one_json_document(spark, tmp_path):
    from secspark.operators import legacy as L
    from secspark.sources import sinks
    lines = [f'1.2.3.4 - - [07/Mar/2026:14:00:{i:02d} +0000] "GET /?q=<script> HTTP/1.1" 200 5' for i in range(5)]
    f = L.detect_legacy(L.parse_legacy(spark.createDataFrame([(x,) for x in lines], "value string"), 2026))
    sinks.write_findings_report(f, str(tmp_path / "f"))
    doc = _document(tmp_path / "f")
    assert doc["summary"]["total_findings"] == 5 == len(doc["findings"]) and doc["findings"][0]["evidence"][0]["source"] == "web"
