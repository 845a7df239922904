import datetime as dt
import ipaddress

from pyspark.sql import functions as F

from secspark.functions import constants as K
from secspark.functions import scalar as X


def _py_country(ip):
    """The documented E1 rule, written with the standard library."""
    if not ip:
        return None
    try:
        a = ipaddress.ip_address(ip)
    except ValueError:
        return None
    if a.is_private or a.is_loopback or isinstance(a, ipaddress.IPv6Address):
        return "ZZ"
    return K.OCTET_TO_COUNTRY.get(int(ip.split(".")[0]), "XX")


def test_country_matches_stdlib(spark):
    ips = ["1.2.3.4", "5.6.7.8", "10.0.0.5", "127.0.0.1", "192.168.1.20", "203.0.113.5", "198.51.100.42", "172.16.0.1",
           "172.32.0.1", "169.254.1.1", "100.64.0.1", "0.1.2.3", "240.0.0.1", "255.255.255.255", "192.0.0.9", "192.0.0.8",
           "192.0.2.1", "198.18.0.1", "51.1.1.1", "256.1.1.1", "01.2.3.4", "1.2.3", "", None, "::1", "::", "2001:db8::1",
           "::ffff:1.2.3.4", "fe80::1", "1:2:3:4", "abc", "1.2.3.4.5", "8.8.8.8", "50.0.0.1", "224.0.0.1"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r["ip"]: r["c"] for r in df.select("ip", X.country_of_ip("ip").alias("c")).collect()}
    assert got == {ip: _py_country(ip) for ip in ips}


def test_haversine_and_coords(spark):
    r = spark.range(1).select(X.haversine_km(F.lit(38.0), F.lit(-97.0), F.lit(35.0), F.lit(105.0)).alias("d"),
                              X.country_coords(F.lit("cn")).alias("c")).collect()[0]
    assert abs(r["d"] - 11586.9152) < 1e-3
    assert (r["c"]["lat"], r["c"]["lon"]) == (35.0, 105.0)


def test_severity_from_score(spark):
    scores = [-10, 9, 10, 39, 40, 69, 70, 89, 90, 200, 89.9]
    df = spark.createDataFrame([(float(s),) for s in scores], "s double")
    got = [r["v"] for r in df.select(X.severity_from_score("s").alias("v")).collect()]
    assert got == ["info", "info", "low", "low", "medium", "medium", "high", "high", "critical", "critical", "high"]


def test_time_text(spark):
    spans = [0, 1_800_000_000, 86_400_000_000, 2 * 86_400_000_000 + 3_723_000_000, 1_500_000]
    df = spark.createDataFrame([(s,) for s in spans], "us long")
    got = [r["t"] for r in df.select(X.timedelta_text("us").alias("t")).collect()]
    assert got == [str(dt.timedelta(microseconds=s)) for s in spans]
    ts = [dt.datetime(2026, 3, 7, 14, 0, tzinfo=dt.timezone.utc), dt.datetime(2026, 3, 7, 14, 0, 0, 120, tzinfo=dt.timezone.utc)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp")
    assert [r["i"] for r in df.select(X.iso_utc("t").alias("i")).collect()] == [t.isoformat() for t in ts]


def test_basename_and_decode(spark):
    rows = [("C:\\Program Files\\Microsoft Office\\WINWORD.EXE", "powershell -enc VwByAGkAdABlAC0ASABvAHMAdAAgACcAeAAnAA=="),
            ("/usr/bin/", "powershell.exe -e VwByAGkAdABl"),
            (None, "powershell -enc VwByAGkAdABlAA")]
    df = spark.createDataFrame(rows, "p string, c string")
    got = df.select(X.basename_lower("p").alias("b"), X.decode_powershell(F.col("c")).alias("d")).collect()
    assert [r["b"] for r in got] == ["winword.exe", "", ""]
    assert got[0]["d"] == "Write-Host 'x'"
    assert got[1]["d"] == "Writ\ufffd"  # odd byte count: replacement character
    assert got[2]["d"] is None  # bad padding


def test_fingerprint_stable_and_distinct(spark):
    from secspark.operators.rules.base import event_fingerprint
    from events_helper import at, make_events
    ev = make_events(spark, [{"timestamp": at(0), "user_name": "a"}, {"timestamp": at(0), "user_name": "a"},
                             {"timestamp": at(1), "user_name": "a"}])
    fps = [r["fp"] for r in ev.select(event_fingerprint().alias("fp")).collect()]
    assert fps[0] == fps[1] != fps[2] and len(fps[0]) == 64


def _reference_time(text):
    """The documented J3 rule, written with the standard library (micros since 1970, or None)."""
    try:
        t = dt.datetime.fromisoformat(text[:-1] + "+00:00" if text.endswith("Z") else text)
    except (TypeError, ValueError, AttributeError):
        return None
    t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
    return (t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def test_iso_times_match_the_standard_library(spark):
    texts = ["2026-03-07T14:00:00Z", "2026-03-07T14:00:00", "2026-03-07 14:00:00.5+02:00", "2026-03-07", "20260307",
             "20260307T140000", "2026-03-07T14", "2026-03-07T14:05", "20260307T1405+0530", "2026-03-07T14:00:00,25",
             "2026-03-07T14:00:00.1234567-08:00", "2026-03-07T140000", "20260307 14:00:01Z", "2026-03-07x14:00",
             "2026-03-07T10:00:00+05:30:15", "14:00:00", "T14:00:00", "2026", "2026-03", "2026-3-7", "+12026-01-01",
             " 2026-03-07", "2026-03-07 ", "2026-03-07T14:00:00 America/New_York", "2026-02-30", "2026-13-01",
             "2026-03-07T14:60", "2026-03-07T14:00:60", "x", "", "0000-01-01", "2026-03-07T14:00:00+24:00", "2026-03-07T",
             None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", F.unix_micros(X.iso_ts("t")).alias("v")).collect()}
    assert got == {t: _reference_time(t) for t in texts}


def test_case_folding_of_the_literal_gate(spark):
    """Every character that a case-insensitive pattern takes for an ASCII letter folds onto that letter."""
    from secspark.functions.patterns import java_regex
    from secspark.operators.rules.patterns import _folded
    chars = [(chr(c),) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    df = spark.createDataFrame(chars, "c string").repartition(2)
    hits = df.filter(F.col("c").rlike(java_regex("^[a-z]$", True))).select("c", _folded(F.col("c")).alias("f"))
    hits = hits.collect()
    assert {"\u017f", "\u212a"} <= {r["c"] for r in hits}
    assert all(len(r["f"]) == 1 and "a" <= r["f"] <= "z" for r in hits), hits
    letters = [("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")]
    for c, a in letters:
        assert spark.createDataFrame([(c,)], "c string").select(_folded(F.col("c"))).first()[0] == a


def test_decoded_payload_is_whole(spark):
    import base64
    text = "Write-Host " + "x" * 900
    cmd = "powershell -enc " + base64.b64encode(text.encode("utf-16-le")).decode()
    assert spark.createDataFrame([(cmd,)], "c string").select(X.decode_powershell(F.col("c"))).first()[0] == text


def test_fingerprint_is_the_hash_of_sorted_json_text(spark):
    """SHA-256 of ``json.dumps(event, sort_keys=True)``: escapes, nulls, numbers, nested raw records."""
    import hashlib
    import json

    from events_helper import at, make_events
    from secspark.functions import scalar as X
    from secspark.operators.rules.base import event_fingerprint
    from secspark.schema import EVENT_FIELDS
    odd = 'q"uo\\te, a:b {} [] \n\t\r\b\f é 日本 😀 \x7f / </script>'
    rows = [
        {"timestamp": at(0), "raw": json.dumps({"line": odd}), "user_name": odd, "source_port": 22, "labels": {"z": odd, "a": "1", "é": ""}},
        {"timestamp": at(1.25), "raw": json.dumps({"line": "x"}, ensure_ascii=False), "http_status_code": 404},
        {"timestamp": at(2), "raw": '{"b": [1, -2, {"y": null, "x": [true, false]}], "a": {}, "é": [], "B": "a,b:\\"c"}', "process_pid": 0},
        {"timestamp": at(3), "raw": '{"k": "' + "x,:" * 5000 + '", "n": 12345678901234567890}'},
    ]
    ev = make_events(spark, rows)
    got = ev.select(X.canonical_json(EVENT_FIELDS).alias("j"), event_fingerprint().alias("fp")).collect()
    for row, r in zip(rows, got, strict=True):
        full = {n: row.get(n) for n, _ in EVENT_FIELDS} | {
            "timestamp": row["timestamp"].isoformat(), "raw": json.loads(row["raw"]), "labels": row.get("labels", {}), "source_type": "test"}
        want = json.dumps(full, sort_keys=True)
        assert r["j"] == want
        assert r["fp"] == hashlib.sha256(want.encode()).hexdigest()


def test_fingerprint_of_parsed_lines(spark):
    """The event of an SSH line, field by field as the text that is hashed."""
    import hashlib
    import json

    from secspark.operators.parse import parse
    from secspark.operators.rules.base import event_fingerprint
    line = "Mar  7 14:00:01 web01 sshd[42]: Failed password for invalid user ad\"min from 9.9.9.9 port 22 ssh2"
    ev = parse(spark.createDataFrame([(line + "  ",)], "value string"), "linux_auth", 2026)
    want = dict.fromkeys(["user_id", "source_geo_country", "destination_ip", "destination_port", "event_reason", "http_method", "http_url",
                          "http_status_code", "http_user_agent", "process_command_line", "process_parent_name"])
    want |= {"timestamp": "2026-03-07T14:00:01+00:00", "source_type": "linux_auth", "raw": {"line": line}, "user_name": 'ad"min',
             "source_ip": "9.9.9.9", "source_port": 22, "destination_host": "web01", "event_action": "login", "event_outcome": "failure",
             "process_name": "sshd", "process_pid": 42, "auth_method": "ssh2", "labels": {"host": "web01"}}
    r = ev.select(event_fingerprint().alias("fp"), "*").first()
    assert r["fp"] == hashlib.sha256(json.dumps(want, sort_keys=True).encode()).hexdigest(), r
