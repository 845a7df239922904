import hashlib
import random

import numpy as np
import pytest

from secspark.llm import suffix


def brute(texts, length=suffix.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for s in range(len(d) - length + 1):
            w = d[s:s + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if seen[d[s:s + length]] > 1:
                gone[s:s + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.fixture(scope="module")
def texts(vocab):
    """Random texts with shared passages of many lengths, cut at any byte, and periodic text."""
    rng = random.Random(21)
    pool = ["".join(rng.choice("abcde éñ") for _ in range(rng.choice([150, 190, 199, 200, 201, 260, 500, 900]))) for _ in range(12)]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.55:
                p = rng.choice(pool)
                a = rng.randint(0, 60)
                parts.append(p[a:len(p) - rng.randint(0, 60)])
            else:
                parts.append("".join(rng.choice("abcde éñ\n") for _ in range(rng.randint(1, 300))))
        out.append("".join(parts))
    line = " ".join(rng.choice(vocab) for _ in range(12))
    out += [("ab" * 150), ("x" * 205), ("x" * 199), (line + "\n") * 9, "q" + "y" * 400, out[0], None, ""]
    out += [f"{rng.random()} {line} {rng.random()} " * 6 for _ in range(8)]
    return out


@pytest.mark.parametrize("batches,hot,segment", [(1, suffix.HOT, suffix.SEGMENT), (4, 3, 333), (5, 2, 1 << 12)])
def test_matches_brute_force(spark, texts, monkeypatch, batches, hot, segment):
    monkeypatch.setattr(suffix, "SEGMENT", segment)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    if hot != suffix.HOT:
        monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (batches, hot))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.removal_digest(docs, batches).collect()}
    want = brute(texts)
    for i, w in enumerate(want):
        assert got[i] == w[:4], i


def test_every_window_picks_a_place_that_depends_on_it_alone():
    rng = random.Random(2)
    data = bytes(rng.choice(b"abcd ") for _ in range(5000)) + b"z" * 700
    ends = np.array([1000, 1100, 1250, len(data)])
    place, first, last = suffix.picked(data, ends)
    covered = sorted(w for a, b in zip(first, last) for w in range(a, b + 1))
    starts = np.r_[0, ends[:-1]]
    assert covered == [w for a, b in zip(starts, ends) for w in range(a, b - suffix.LENGTH + 1)]
    assert all(w <= p and p + suffix.GRAM <= w + suffix.LENGTH for p, a, b in zip(place, first, last) for w in (a, b))
    for a, b in ((0, 300), (1300, 1700), (4900, 5600)):
        alone = suffix.picked(data[a:b], np.array([b - a]))
        of = {w: p for p, x, y in zip(place, first, last) for w in range(x, y + 1)}
        assert all(of[w + a] == p + a for p, x, y in zip(*alone) for w in range(x, y + 1))


def test_levels_merge_geometrically(spark, texts):
    docs = suffix.keyed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    family = suffix.Family(spark, 3)
    sizes = []
    for k in range(5):
        family.insert(family.array(docs.filter(f"doc_id % 5 = {k}")))
        sizes.append([s for s, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    n = sum(spark.table(t).agg({"n": "sum"}).first()[0] for _, t in family.levels)
    assert n == suffix.places(docs).count()
    tables = [t for _, t in family.levels]
    plan = spark.table(tables[0]).join(spark.table(tables[1]).select("name"), "name", "left_semi")
    assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    family.drop()
    assert family.levels == []


def test_documents_and_pipeline_stage(spark, docs, rows, no_docs):
    want = brute([r[1] for r in rows])
    got = sorted(map(tuple, suffix.removal_digest(docs).collect()), key=str)
    assert got == sorted([(r[0], *w[:4]) for r, w in zip(rows, want)], key=str)
    out = suffix.remove_repeats(spark, docs, "")
    assert out.schema == docs.schema
    left = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert left == sorted(((r[0], None if r[1] is None else w[4].decode("utf-8", "ignore")) for r, w in zip(rows, want)), key=str)
    assert suffix.removal_digest(no_docs).count() == 0 and suffix.remove_repeats(spark, no_docs, "").count() == 0


def test_rows_without_id_whose_short_hashes_meet(spark):
    """Two rows without id and with equal 32-bit text hashes: only the one with a repeated passage loses bytes."""
    from pyspark.sql import functions as F
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    d = spark.range(60_000).select(F.concat(F.lit(passage), F.lit(" "), F.col("id").cast("string")).alias("a"),
                                   F.concat(F.sha2(F.concat(F.lit("x"), F.col("id")), 512), F.sha2(F.concat(F.lit("y"), F.col("id")), 512),
                                            F.col("id").cast("string")).alias("b"))
    pair = (d.select("a", F.hash("a").alias("h")).join(d.select("b", F.hash("b").alias("h")), "h").limit(1).collect())
    assert pair, "no pair of equal hashes among these texts"
    rows = [(None, pair[0]["a"]), (None, pair[0]["b"]), (5, passage)]
    got = {r["n_bytes"]: r for r in suffix.removal_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[len(pair[0]["b"])]["n_removed"] == 0 and got[len(pair[0]["a"])]["n_removed"] == len(passage)


def test_many_identical_rows_keep_their_spans_few(spark):
    """A repeated row's spans are kept once, not once per copy."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(500))
    docs = spark.createDataFrame([(None, text)] * 2000, "doc_id long, text string").repartition(4)
    spans = suffix.repeated_spans(suffix.keyed(docs)).collect()
    assert len(spans) == 1 and len(spans[0]["spans"]) <= 500
    got = suffix.removal_digest(docs)
    assert got.count() == 2000 and got.filter("n_removed = 500").count() == 2000
