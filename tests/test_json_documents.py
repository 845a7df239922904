"""A4 read in pieces, against the standard library's parser; H2 against a loop over the given names."""
import json
import random

import pytest
from pyspark.sql import functions as F

from secspark.sources import files as SRC
from secspark.sources.json_documents import json_records

TEXTS = ["", "}", "{", "a}b{c", '"', '\\"}', "\\", "\\\\", "[]", "],", "\n", "é}", "}\"}", "x" * 90]


def _value(rng, depth):
    kind = rng.randrange(6 if depth else 4)
    if kind == 0:
        return rng.choice(TEXTS)
    if kind == 1:
        return rng.choice([0, -1, 2.5, True, False])
    if kind == 2:
        return None
    if kind == 4:
        return [_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(TEXTS) + str(k): _value(rng, max(0, depth - 1)) for k in range(rng.randrange(4))} if depth else "t"


def _write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_documents_of_any_shape(spark, tmp_path):
    rng = random.Random(5)
    docs = []
    for k in range(40):
        doc = [_value(rng, 3) for _ in range(rng.choice([0, 1, 2, 5, 30]))]
        doc = [x for x in doc if x is not None]
        if k % 4 == 0:
            doc = {"EventID": k, "a": _value(rng, 3), "z": {"b": {"c}": "}{"}}}
        docs.append(doc)
    paths = []
    for k, doc in enumerate(docs):
        text = json.dumps(doc, indent=rng.choice([None, None, 1, 4]), ensure_ascii=rng.random() < 0.5,
                          separators=rng.choice([None, (",", ":")]))
        text = rng.choice(["", "\n", " \r\n\t"]) + text + rng.choice(["", "\n", " \n "])
        data = text.encode()
        paths.append(_write(tmp_path / f"{k:02d}.json", b"\xef\xbb\xbf" + data if k % 7 == 3 else data))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # files are cut anywhere
    try:
        rows = json_records(spark, paths).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["source_file"], r["record"], r["pos"])):
        got.setdefault(int(r["source_file"].rsplit("/", 1)[1][:2]), []).append(r["value"])

    def loose(text):  # scalars come without their quotes
        try:
            return json.loads(text, strict=False)
        except ValueError:
            return text
    for k, doc in enumerate(docs):
        want = [doc] if isinstance(doc, dict) else doc
        have = got.get(k, [])
        assert len(have) == len(want), k
        for w, h in zip(want, have, strict=True):
            assert loose(h) == w if isinstance(w, (dict, list)) else h == (w if isinstance(w, str) else json.dumps(w)), (k, w, h)


@pytest.mark.parametrize("text", [" \n", "5", "[", '[{"a":1}', '[{"a":1}\n', '{"a":{"b":1}', '[{"a":1}]]', '[{"a":1},]',
                                  '[{"a":1} {"b":2}]', '[{"a":1}] {"b":2}', '{"a":1} {"b":2}', '[{"a":"}]', '[{"a":1}}'])
def test_broken_documents_fail(spark, tmp_path, text):
    good = _write(tmp_path / "good.json", '[{"a":1}]')
    bad = _write(tmp_path / "bad.json", text)
    with pytest.raises(Exception, match="invalid JSON document.*bad.json"):
        json_records(spark, [good, bad]).collect()


def test_an_empty_file_has_no_records(spark, tmp_path):
    paths = [_write(tmp_path / "a.json", '[{"a":1}]'), _write(tmp_path / "b.json", "")]
    assert [r["value"] for r in json_records(spark, paths).collect()] == ['{"a":1}']


def test_one_large_array_is_read_in_many_tasks(spark, tmp_path):
    """One file holds all rows on one line: no task gets a large share, and the order is kept."""
    n = 20_000
    path = _write(tmp_path / "big.json", json.dumps([{"EventID": 4625, "TimeCreated": "2026-03-07T14:00:00Z", "k": k,
                                                      "p": [{"Key": "a}", "Value": "{"}]} for k in range(n)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # would make one task of 2 MB
    try:
        rows = json_records(spark, [path])
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 4
        per_task = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        order = [json.loads(r["value"])["k"] for r in rows.orderBy("record", "pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert order == list(range(n))
    assert max(per_task) < 0.5 * n


def test_ranges_of_given_names():
    rng = random.Random(9)
    parts = ["a", "b", "a b", "a0", "a/b", "é", "a-", "a/b/c"]
    for _ in range(300):
        names = [("file:/" + "/".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "/"]), i)
                 for i in range(rng.randint(1, 6))]
        ranges = SRC.name_ranges(names)
        assert ranges == sorted(ranges)
        for _ in range(20):
            file = "file:/" + "/".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
            want = min((i for n, i in names if file == n or file.startswith(n.rstrip("/") + "/")), default=-1)
            assert [i for first, i in ranges if first <= file][-1] == want


def test_positions_of_files_without_a_join(spark, tmp_path):
    folder = tmp_path / "in é"
    folder.mkdir()
    names = [_write(folder / f"{k:03d}.jsonl", f'{{"timestamp": "2026-03-07T14:00:00Z", "user_name": "{k}"}}\n') for k in range(60)]
    rng = random.Random(2)
    rng.shuffle(names)
    given = [*names[:50], str(folder), str(folder / "0[0-9]*.jsonl")]
    ev = SRC.read_events(spark, given, fmt="json")
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = {r["source_file"].rsplit("/", 1)[1]: r["ingest_seq"]["path"] for r in ev.collect()}
    assert got == {n.rsplit("/", 1)[1]: min(k, 50) for k, n in enumerate(names)}
