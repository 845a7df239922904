import os
import random

from events_helper import at

from secspark.operators.rules import BruteForce
from secspark.sources import files as SRC
from secspark.streaming import live
from test_sequence import py_greedy


def _ssh(t, user, ip):
    return f"{t.strftime('%b')} {t.day:2d} {t.strftime('%H:%M:%S')} h sshd[1]: Failed password for {user} from {ip} port 22 ssh2"


def test_stream_bf_matches_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b"]), rnd.randrange(3000)) for _ in range(200)]
    lines = [_ssh(at(s), u, "9.9.9.9") for u, s in sorted(rows, key=lambda r: r[1])]
    src = tmp_path / "in"
    src.mkdir()
    half = len(lines) // 2
    (src / "part1.log").write_text("\n".join(lines[:half]) + "\n")
    (src / "part2.log").write_text("\n".join(lines[half:]) + "\n")
    # a far-future line moves the watermark past every real window (end of stream)
    (src / "part3.log").write_text(_ssh(at(hours=5), "zz", "1.1.1.1") + "\n")
    ev = live.read_stream(spark, str(src), "linux_auth", year=2026, max_files_per_trigger=1)
    q = (live.stream_brute_force(ev, threshold=4, window_seconds=60, watermark="0 seconds")
         .writeStream.format("memory").queryName("bf_stream").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = sorted((r["user_name"], r["failed_attempts"]) for r in spark.sql("SELECT * FROM bf_stream").collect())
    want = []
    for u in ("a", "b"):
        want += [(u, n) for _, n in py_greedy([s for u2, s in rows if u2 == u], 60, 4)]
    assert got == sorted(want)
    batch = BruteForce(threshold=4, window_seconds=60).alerts(
        SRC.read_events(spark, [str(src / "part1.log"), str(src / "part2.log")], year=2026)).count()
    assert batch == len(want)


def test_stream_per_event_rules(spark, tmp_path):
    src = tmp_path / "web"
    src.mkdir()
    (src / "a.log").write_text(
        '1.2.3.4 - - [07/Mar/2026:14:00:00 +0000] "GET /etc/passwd HTTP/1.1" 404 1 "-" "curl"\n'
        '1.2.3.4 - - [07/Mar/2026:14:00:01 +0000] "GET /index.html HTTP/1.1" 200 1 "-" "curl"\nno line\n\n')
    ev = live.read_stream(spark, str(src), "nginx")
    q = (live.stream_alerts(ev).writeStream.format("memory").queryName("wa_stream")
         .option("checkpointLocation", str(tmp_path / "ck2")).start())
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT rule_id, severity FROM wa_stream").collect()
    assert [(r["rule_id"], r["severity"]) for r in rows] == [("WA-001", "critical")]
    seen = [p["observedMetrics"].get("parse_nginx") for p in q.recentProgress]
    seen = [(m["parsed"], m["skipped"]) for m in seen if m is not None]
    assert (sum(a for a, _ in seen), sum(b for _, b in seen)) == (2, 1)


def _run(df, name, tmp_path):
    q = (df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", str(tmp_path / name)).start())
    q.processAllAvailable()
    q.stop()
    return q


def test_stream_bf_alerts_equal_batch_open_bursts_and_late_rows(spark, tmp_path):
    """Decided and flushed bursts together give the batch rule's alerts, methods and sources included;
    rows behind the watermark are counted."""
    rows = [("a", s) for s in (0, 0, 5, 9, 100, 101, 102, 103, 104)] + [("b", s) for s in (100, 110, 120)]
    src = tmp_path / "in"
    src.mkdir()
    (src / "p1.log").write_text("\n".join(_ssh(at(s), u, "9.9.9.9") for u, s in rows) + "\n")
    (src / "p2.log").write_text(_ssh(at(90), "zz", "1.1.1.1") + "\n")
    (src / "p3.log").write_text(_ssh(at(1), "a", "9.9.9.9") + "\n")
    for i in (1, 2, 3):  # the source takes files by age
        os.utime(src / f"p{i}.log", (1000 * i, 1000 * i))
    ev = live.read_stream(spark, str(src), "linux_auth", year=2026, max_files_per_trigger=1)
    late = live.LateRows()
    spark.streams.addListener(late)
    try:
        q = _run(live.stream_brute_force(ev, threshold=3, window_seconds=60, watermark="0 seconds"), "bf_open", tmp_path)
        _wait(lambda: late.total(q.id) >= 1)
    finally:
        spark.streams.removeListener(late)
    done = spark.table("bf_open")
    left = live.flush_brute_force(spark, str(tmp_path / "bf_open"), 3, 60)
    assert done.count() and left.count()
    rule = BruteForce(threshold=3, window_seconds=60)
    got = live.brute_force_alerts(done.unionByName(left), rule)
    want = rule.alerts(SRC.read_events(spark, [str(src / "p1.log"), str(src / "p2.log")], year=2026))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 3
    assert '"auth_methods":["ssh2"]' in got.first()["context"]


def _wait(done, seconds=30):
    import time
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.2)
    assert done()


def test_stream_bf_evidence_by_interval_join(spark, tmp_path):
    rows = [("a", s) for s in (0, 0, 5, 9, 100, 300, 301, 302)] + [("b", 5)]
    src = tmp_path / "in"
    src.mkdir()
    (src / "p1.log").write_text("\n".join(_ssh(at(s), u, "9.9.9.9") for u, s in rows) + "\n")
    for i in (2, 3, 4):
        (src / f"p{i}.log").write_text(_ssh(at(hours=i), "zz", "1.1.1.1") + "\n")
    for i in (1, 2, 3, 4):
        os.utime(src / f"p{i}.log", (1000 * i, 1000 * i))
    ev = live.read_stream(spark, str(src), "linux_auth", year=2026, max_files_per_trigger=1)
    _run(live.stream_brute_force_evidence(ev, threshold=3, window_seconds=60, watermark="0 seconds"), "bf_ev", tmp_path)
    got = sorted((r["us"], r["event_fingerprint"]) for r in spark.table("bf_ev").collect())
    rule = BruteForce(threshold=3, window_seconds=60)
    want = rule.evidence(SRC.read_events(spark, [str(src / "p1.log")], year=2026))
    assert [f for _, f in got].__len__() == 7 and sorted(f for _, f in got) == sorted(r["event_fingerprint"] for r in want.collect())


def test_late_rows_are_counted_past_a_hundred_batches(spark, tmp_path):
    """One on-time and one late row per batch: the listener has them all, the recent progress only the last hundred."""
    from pyspark.sql import functions as F
    src = tmp_path / "in"
    src.mkdir()
    n = 112
    for i in range(n):
        (src / f"p{i:03d}.csv").write_text(f"{1000 + i}\n" + ("1\n" if i > 1 else ""))
        os.utime(src / f"p{i:03d}.csv", (1000 + i, 1000 + i))
    late = live.LateRows()
    spark.streams.addListener(late)
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        s = (spark.readStream.schema("t long").option("maxFilesPerTrigger", 1).csv(str(src))
             .withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", "0 seconds").groupBy("ts").count())
        q = _run(s, "late_many", tmp_path)
        _wait(lambda: late.batches.get(str(q.id), 0) >= n)
    finally:
        spark.streams.removeListener(late)
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    assert late.total(q.id) == n - 2 == late.total()
    seen = sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p["stateOperators"])
    assert len(q.recentProgress) <= 100 and seen < late.total(q.id)


def _json(rows):
    import json
    return "".join(json.dumps({"timestamp": t.isoformat(), "event_action": "login", "event_outcome": o, "user_name": u,
                               "source_ip": ip, "source_geo_country": c}) + "\n" for t, o, u, ip, c in rows)


def test_stream_travel_and_stuffing_match_batch(spark, tmp_path):
    from secspark.operators.rules import CredentialStuffing, ImpossibleTravel
    rnd = random.Random(6)
    rows = [(at(rnd.randrange(4000)), rnd.choice(["success", "failure", "failure"]), rnd.choice("ab"),
             f"9.9.9.{rnd.randrange(2)}", rnd.choice(["US", "CN", "DE"])) for _ in range(120)]
    rows = sorted({r[0]: r for r in rows}.values())
    end = [(at(hours=9), "failure", "zz", "8.8.8.8", "US")]
    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate((rows[:60], rows[60:], end, [(at(hours=10), "failure", "zz", "8.8.8.8", "US")])):
        (src / f"p{i}.jsonl").write_text(_json(part))
        os.utime(src / f"p{i}.jsonl", (1000 * i + 1000, 1000 * i + 1000))
    batch = SRC.read_events(spark, [str(src / "p0.jsonl"), str(src / "p1.jsonl")])
    stream = live.read_stream(spark, str(src), "json", max_files_per_trigger=1)
    for name, rule, make in (("it", ImpossibleTravel(), live.stream_impossible_travel),
                             ("cs", CredentialStuffing(window_seconds=60), live.stream_credential_stuffing)):
        _run(make(stream, rule, "0 seconds"), f"{name}_live", tmp_path)
        got = sorted((r["description"], r["timestamp"]) for r in spark.sql(f"SELECT * FROM {name}_live").collect())
        want = sorted((r["description"], r["timestamp"]) for r in rule.alerts(batch).collect())
        assert got == want and want, name


def _login_files(src, parts):
    src.mkdir()
    for i, part in enumerate(parts):
        (src / f"p{i}.jsonl").write_text(_json(part))
        os.utime(src / f"p{i}.jsonl", (1000 * i + 1000, 1000 * i + 1000))


def test_idle_keys_leave_the_state(spark, tmp_path):
    """After the watermark has moved on, only what can still matter is kept, for every rule."""
    from secspark.operators.rules import CredentialStuffing, ImpossibleTravel
    old = [(at(i), ("failure", "success")[i % 2], f"u{i}", f"7.7.7.{i}", "US") for i in range(40)]
    parts = [old] + [[(at(hours=40 * k), "failure", "zz", "8.8.8.8", "US"), (at(hours=40 * k, seconds=1), "success", "zz", "8.8.8.9", "US")]
                     for k in (1, 2, 3)]
    _login_files(tmp_path / "in", parts)
    ev = live.read_stream(spark, str(tmp_path / "in"), "json", max_files_per_trigger=1)
    for name, stream, states in (
            ("bf_idle", live.stream_brute_force(ev, 3, 60, "0 seconds"), ["ticks", "due"]),
            ("it_idle", live.stream_impossible_travel(ev, ImpossibleTravel(), "0 seconds"), ["waiting", "last", "arrived", "due"]),
            ("cs_idle", live.stream_credential_stuffing(ev, CredentialStuffing(), "0 seconds"), ["waiting", "failures", "arrived", "due"])):
        _run(stream, name, tmp_path)
        for state in states:
            keys = {tuple(r["key"]) for r in live._state(spark, str(tmp_path / name), state).select("key").collect()}
            assert all(k[0] in ("zz", "8.8.8.8", "8.8.8.9") for k in keys), (name, state, keys)


def test_flush_of_travel_and_stuffing_completes_the_batch_alerts(spark, tmp_path):
    """What the stream has decided and what is flushed are the batch rule's alerts, ids included."""
    from secspark.operators.rules import CredentialStuffing, ImpossibleTravel
    rows = [(at(60 * i), ("failure", "success")[i % 2], "a", "9.9.9.9", ("US", "CN", "DE")[i % 3]) for i in range(20)]
    rows += [(at(60 * 19), "failure", "a", "9.9.9.9", "US"), (at(60 * 19), "success", "a", "9.9.9.9", "US")]
    _login_files(tmp_path / "in", (rows[:10], rows[10:], [(at(60 * 12), "failure", "zz", "1.1.1.1", "US")]))
    batch = SRC.read_events(spark, [str(tmp_path / "in" / f"p{i}.jsonl") for i in (0, 1)])
    stream = live.read_stream(spark, str(tmp_path / "in"), "json", max_files_per_trigger=1)
    for name, rule, make, flush in (
            ("it_open", ImpossibleTravel(), live.stream_impossible_travel, live.flush_impossible_travel),
            ("cs_open", CredentialStuffing(window_seconds=90), live.stream_credential_stuffing, live.flush_credential_stuffing)):
        _run(make(stream, rule, "5 minutes"), name, tmp_path)
        done, left = spark.table(name), flush(spark, str(tmp_path / name), rule)
        assert done.count() and left.count(), name
        got = sorted((r["description"], r["timestamp"], r["context"]) for r in done.unionByName(left).collect())
        assert got == sorted((r["description"], r["timestamp"], r["context"]) for r in rule.alerts(batch).collect()), name


def test_successes_of_one_moment_have_their_own_ids(spark, tmp_path):
    from secspark.operators.rules import CredentialStuffing
    rows = [(at(0), "failure", "a", "9.9.9.9", "US"), (at(5), "success", "a", "9.9.9.9", "US"), (at(5), "success", "b", "9.9.9.9", "US")]
    _login_files(tmp_path / "in", (rows, [(at(hours=1), "failure", "z", "1.1.1.1", "US")], [(at(hours=2), "failure", "z", "1.1.1.1", "US")]))
    ev = live.read_stream(spark, str(tmp_path / "in"), "json", max_files_per_trigger=1)
    _run(live.stream_credential_stuffing(ev, CredentialStuffing(), "0 seconds"), "cs_same", tmp_path)
    assert len({r["alert_id"] for r in spark.table("cs_same").collect()}) == 2
