import json

import pytest
from pyspark.sql import functions as F

from secspark.sources import files as SRC

NAMES = ["auth.log", "nginx_access.log", "apache_access.log", "x.jsonl", "win.evtx.json", "a.json", "access.log",
         "site.nginx", "site.apache", "README.txt", "NGINX-edge.log", "/var/log/host.AUTH.LOG", "data.csv"]


def test_route_python_and_column_agree(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "p string")
    got = {r["p"]: r["f"] for r in df.select("p", SRC.route_format_col(F.col("p")).alias("f")).collect()}
    assert got == {n: SRC.route_format(n) for n in NAMES}
    assert SRC.route_format("access.log") == "linux_auth"  # only a .log suffix
    assert SRC.route_format("nginx_access.log") == "nginx"
    assert SRC.route_format("README.txt") is None


def _write(d, name, text):
    p = d / name
    p.write_text(text)
    return str(p)


def test_read_events_mixed_files(spark, tmp_path):
    auth = _write(tmp_path, "auth.log", "Mar  7 14:10:00 h sshd[1]: Failed password for root from 1.2.3.4 port 1 ssh2\n"
                                        "junk\n\nMar  7 14:11:00 h sshd[2]: Accepted password for bob from 1.2.3.4 port 2 ssh2\n")
    web = _write(tmp_path, "apache_access.log",
                 '1.2.3.4 - - [07/Mar/2026:14:00:00 +0000] "GET /x HTTP/1.1" 200 1 "-" "ua"\n')
    win = _write(tmp_path, "security.json", json.dumps([
        {"EventID": 4625, "TimeCreated": "2026-03-07T14:00:00Z", "Properties": [{"Key": "TargetUserName", "Value": "a"}]},
        {"EventID": 1, "TimeCreated": "2026-03-07T14:00:00Z"}]))
    one = _write(tmp_path, "single.json", json.dumps({"EventID": 4624, "TimeCreated": "2026-03-07T14:00:00Z"}))
    sniffed = _write(tmp_path, "mystery.txt", '\n{"timestamp": "2026-03-07T14:00:00Z", "user_name": "q"}\n')
    ev = SRC.read_events(spark, [auth, web, win, one, sniffed], year=2026)
    got = sorted((r["source_type"], r["event_outcome"] or "") for r in ev.collect())
    assert got == sorted([("linux_auth", "failure"), ("linux_auth", "success"), ("apache", "success"),
                          ("windows_json", "failure"), ("windows_json", "success"), ("json", "")])
    ranks = {r["source_type"]: r["ingest_seq"]["path"] for r in ev.collect()}
    assert ranks["linux_auth"] == 0 and ranks["json"] == 4
    counts = {r["source_file"].rsplit("/", 1)[-1]: (r["parsed"], r["skipped"])
              for r in SRC.parse_counts(spark, [auth, win], year=2026).collect()}
    assert counts == {"auth.log": (2, 1), "security.json": (1, 1)}


def test_unknown_file_raises(spark, tmp_path):
    p = _write(tmp_path, "notes.txt", "hello world\n")
    with pytest.raises(ValueError):
        SRC.read_events(spark, [p])


def test_broken_json_document_fails(spark, tmp_path):
    p = _write(tmp_path, "broken.json", "[{\"EventID\": 4624,")
    with pytest.raises(Exception):
        SRC.read_events(spark, [p]).collect()


@pytest.mark.parametrize("n", [1, 16, 17, 40])
def test_sniffing_is_the_same_for_any_number_of_files(spark, tmp_path, n):
    folder = tmp_path / "in put é"
    folder.mkdir()
    paths = []
    for i in range(n):
        p = _write(folder, f"part {i:02d}%20.txt", f'\n \n1.2.3.4 - - [07/Mar/2026:14:00:{i:02d} +0000] "GET /{i} HTTP/1.1" 200 1 "-" "u"\n')
        paths.append(("file://" + p) if i % 2 else p)
    assert set(SRC.sniff_formats(spark, paths).values()) == {"nginx"}
    ev = SRC.read_events(spark, paths)
    assert sorted((r["http_url"], r["ingest_seq"]["path"]) for r in ev.collect()) == sorted((f"/{i}", i) for i in range(n))


def test_arrival_order_of_equal_times(spark, tmp_path):
    """Given order first, then names inside a folder: URIs, spaces, folders and globs alike."""
    (tmp_path / "d 1").mkdir()
    (tmp_path / "g").mkdir()

    def line(u):
        return f'{{"timestamp": "2026-03-07T14:00:00Z", "user_name": "{u}"}}\n'
    last = _write(tmp_path / "d 1", "b.jsonl", line("d"))
    _write(tmp_path / "d 1", "a.jsonl", line("c"))
    first = _write(tmp_path, "z z.jsonl", line("a") + line("b"))
    _write(tmp_path / "g", "1.jsonl", line("e"))
    paths = ["file://" + first, str(tmp_path / "d 1"), str(tmp_path / "g" / "*.jsonl")]
    ev = SRC.read_events(spark, paths, fmt="json").orderBy("timestamp", "ingest_seq")
    assert [r["user_name"] for r in ev.collect()] == ["a", "b", "c", "d", "e"]
    assert [r["ingest_seq"]["path"] for r in ev.collect()] == [0, 0, 1, 1, 2] and last
