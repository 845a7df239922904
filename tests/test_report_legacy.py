import json

from events_helper import at, make_events

from secspark.operators import legacy as L
from secspark.operators import report as R
from secspark.operators.rules import BruteForce, WebAttack, detect
from secspark.sources import sinks


def _alerts(spark):
    rows = [{"timestamp": at(7 * i), "event_action": "login", "event_outcome": "failure", "user_name": "root",
             "source_ip": "203.0.113.5", "source_type": "linux_auth"} for i in range(6)]
    rows += [{"timestamp": at(0), "event_action": "http_request", "http_url": "/?q=1' OR '1'='1", "source_type": "nginx"}]
    ev = make_events(spark, rows)
    return detect(ev, [BruteForce(), WebAttack()]), ev


def test_summary_counts(spark):
    alerts, ev = _alerts(spark)
    s = R.summary_dict(alerts, ev)
    assert s["total_alerts"] == 2 and s["by_severity"] == {"high": 2}
    assert s["by_rule"] == {"BF-001": 1, "WA-001": 1} and s["by_source_type"] == {"linux_auth": 6, "nginx": 1}
    empty = alerts.limit(0)
    assert R.summary_dict(empty, ev.limit(0))["total_alerts"] == 0
    rows = {(r["severity"], r["rule_id"], r["gid"]): r["n_alerts"] for r in R.rollup(alerts).collect()}
    assert rows[(None, None, 3)] == 2
    assert [r["rule_id"] for r in R.rules_list(spark).collect()] == ["BF-001", "IT-001", "SP-001", "WA-001"]


def test_write_alerts(spark, tmp_path):
    alerts, ev = _alerts(spark)
    out = str(tmp_path / "report")
    summary = sinks.write_alerts(R.newest_first(alerts), ev, out)
    assert summary["event_count"] == 7
    lines = [json.loads(r["value"]) for r in spark.read.text(out + "/alerts").collect()]
    assert len(lines) == 2 and all(isinstance(l["context"], dict) for l in lines)
    bf = next(l for l in lines if l["rule_id"] == "BF-001")
    assert bf["context"]["failed_attempts"] == 6 and bf["timestamp"] == at(35).isoformat()
    assert json.loads(spark.read.text(out + "/summary").first()["value"])["total_alerts"] == 2


def test_legacy_chain(spark, tmp_path):
    lines = ['{"timestamp": "2026-03-07T14:00:00Z", "event_type": "login_success", "user": "a", "ip": "1.2.3.4", "x": 1}',
             '{"timestamp": "2026-03-07T14:20:00Z", "event_type": "login_success", "user": "a", "ip": "5.6.7.8"}',
             '{"timestamp": "2026-03-07T14:00:00Z", "event_type": "process_creation", "message": "powershell.exe -enc AAA"}',
             '{"timestamp": "2026-03-07T14:00:00Z", "event_type": "windows_event", "encoded_powershell": true}',
             '10.0.0.1 - - [07/Mar/2026:14:00:00 +0000] "GET /../x?q=union select 1 HTTP/1.1" 200 -',
             '10.0.0.1 - - [07/Mar/2026:14:00:00 +0000] "GET /<script> HTTP/1.1" 200 12',
             ''] + [f"Mar  7 14:0{i}:00 h sshd[1]: Failed password for root from 9.9.9.9 port 22 ssh2" for i in range(5)]
    df = spark.createDataFrame([(l,) for l in lines], "value string")
    ev = L.parse_legacy(df, 2026)
    assert ev.count() == 11
    f = L.detect_legacy(ev).collect()
    by = sorted((r["rule_id"], r["severity"]) for r in f)
    assert by == [("brute_force_login_attempts", "high"), ("encoded_powershell", "critical"),
                  ("encoded_powershell", "critical"), ("impossible_travel", "medium"),
                  ("web_attack_pattern", "high"), ("web_attack_pattern", "medium")]
    bf = [r for r in f if r["rule_id"] == "brute_force_login_attempts"][0]
    assert abs(bf["confidence"] - 0.85) < 1e-12 and bf["n_evidence"] == 5
    ev5 = L.legacy_brute_force_evidence(ev).collect()
    assert len(ev5) == 5 and {(r["user"], r["ip"]) for r in ev5} == {("root", "9.9.9.9")}
    assert json.loads(ev5[0]["event"]) == {
        "timestamp": ev5[0]["timestamp"].strftime("%Y-%m-%dT%H:%M:%S+00:00"), "event_type": "auth_failure",
        "source": "linux_auth", "host": "h", "user": "root", "ip": "9.9.9.9",
        "raw_message": json.loads(ev5[0]["event"])["raw_message"], "metadata": json.loads(ev5[0]["event"])["metadata"]}
    web = sorted(r["description"] for r in f if r["rule_id"] == "web_attack_pattern")
    assert web == ["The request path matched: sqli, path_traversal.", "The request path matched: xss."]
    s = L.findings_summary_dict(L.detect_legacy(ev))
    assert s["total_findings"] == 6 and s["severity_counts"]["critical"] == 2
    out = sinks.write_findings(L.detect_legacy(ev), str(tmp_path / "legacy"))
    assert out["rule_counts"]["impossible_travel"] == 1


def test_legacy_tree_in_arrival_order(spark, tmp_path):
    """Equal times keep the order of file names, then of lines."""
    (tmp_path / "b").mkdir()
    for name, users in (("b/z 1.log", ["u3", "u4"]), ("a.log", ["u1", "u2"])):
        (tmp_path / name).write_text("".join(
            f'{{"timestamp": "2026-03-07T14:00:00Z", "event_type": "login_success", "user": "{u}"}}\n' for u in users))
    got = [r["user"] for r in L.read_legacy(spark, str(tmp_path)).collect()]
    assert got == ["u1", "u2", "u3", "u4"]


def test_legacy_time_must_be_a_json_string(spark):
    lines = ['{"timestamp": 20260307, "meta": {"timestamp": "2026-03-07T14:00:00Z"}}', '{"timestamp": "20260307"}',
             '{"timestamp": "14:00:00"}', '{"timestamp": {"timestamp": "2026-03-07"}}']
    ev = L.parse_legacy(spark.createDataFrame([(l,) for l in lines], "value string"), 2026).collect()
    assert len(ev) == 1


def test_event_json_has_every_field(spark):
    from secspark.operators.rules.base import event_json
    from secspark.schema import EVENT_FIELDS
    ev = make_events(spark, [{"timestamp": at(1), "user_name": "a", "source_port": 22, "labels": {"k": "v"}}])
    got = json.loads(ev.select(event_json()).first()[0])
    assert set(got) == {n for n, _ in EVENT_FIELDS}
    assert (got["timestamp"], got["user_name"], got["source_port"], got["labels"], got["http_url"]) == (
        at(1).isoformat(), "a", 22, {"k": "v"}, None)


def test_rule_rollup_has_prior_and_note(spark):
    alerts, _ = _alerts(spark)
    got = {r["rule_id"]: r for r in R.by_rule(alerts).collect()}
    assert got["BF-001"]["true_positive_estimate"] == 0.85
    assert got["WA-001"]["false_positive_note"].startswith("security scanners")
