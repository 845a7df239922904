import math
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

from secspark.llm import sharding


def draw(key, shard, weight=1.0):
    seed = xxhash.xxh64_intdigest(key.encode(), 42)
    bits = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 11
    return -math.log((bits + 0.5) / (1 << 53)) / weight


def test_matches_brute_force(docs, rows, no_docs):
    got = sharding.shard_records(docs).collect()
    assert len(got) == len(rows)
    place = {}
    for doc_id, text, *_ in rows:
        key = "null" if doc_id is None else str(doc_id)
        draws = [draw(key, j) for j in range(25)]
        shard = min(range(24), key=lambda j: draws[j])
        place[doc_id, zlib.crc32((text or "").encode())] = (
            len((text or "").encode()) + 8, shard, 24 if draws[24] < draws[shard] else shard)
    slots = defaultdict(list)
    for r in got:
        assert (r["size"], r["shard"], r["grown_shard"]) == place[r["doc_id"], r["text_crc32"]]
        assert r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_records(no_docs).count() == 0


def test_slots_over_many_buckets_are_gapless(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 3 AS int) AS shard")
    out = sharding.with_slots(df, "doc_id", ["doc_id"], rows_per_bucket=50).collect()
    for s in range(3):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(1000))


def test_weights_and_growth(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "cast(null AS string) AS text")
    out = sharding.shard_records(df, weights=[1.0, 2.0, 1.0, 0.0], grown_weight=1.0).collect()
    share = Counter(r["shard"] for r in out)
    assert share[3] == 0 and abs(share[1] / 20000 - 0.5) < 0.02
    moved = [r for r in out if r["grown_shard"] != r["shard"]]
    assert all(r["grown_shard"] == 4 for r in moved) and abs(len(moved) / 20000 - 0.2) < 0.02
