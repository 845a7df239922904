import random
import re

import numpy as np
import pytest
import xxhash

from secspark.llm import simhash
from secspark.llm.components import components


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    return {f: find(f) for f in fs}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_cover_is_a_perfect_code():
    cover = simhash.HammingCover()
    codewords = np.unique(cover.home)
    assert len(codewords) == 1 << 11
    for v in (0, 1, 77, 32767, 12345):
        d = np.bitwise_count((codewords ^ v).astype(np.uint64))
        assert d.min() <= 1 and set(codewords[d <= 2]) == set(cover.near[v][cover.near[v] >= 0])


def planted(seed, n, spread):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(rng.randint(0, spread)):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
            out.add(base)
    return out


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_links_join_what_brute_force_joins(spark, hot):
    fps = planted(4, 60, 12) | {0, 1, 3, (1 << 64) - 1}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r["node"]: r["component"] for r in components(simhash.links(df, hot=hot)).distinct().collect()}
    classes, want = {}, {}
    for f, r in brute_groups(fps).items():
        want.setdefault(r, set()).add(signed(f))
        classes.setdefault(got.get(signed(f), signed(f)), set()).add(signed(f))
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_one_dense_group_gives_a_forest_not_all_pairs(spark):
    rng = random.Random(8)
    fps = {sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(900)}
    df = spark.createDataFrame([(f if f < 1 << 63 else f - (1 << 64),) for f in fps], "fp long")
    links = simhash.links(df, hot=64).distinct()
    assert links.count() < 60 * len(fps)
    assert components(links).select("component").distinct().count() == 1


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).distinct().collect()}
    assert got == {**{i: 1 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents(docs, rows, no_docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {r[1]: brute_fingerprint(r[1]) for r in rows}
    groups = brute_groups(set(fps.values()))
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            g = groups[fps[text]]
            least[g] = min(doc_id, least.get(g, doc_id))
    want = sorted(((r[0], f"{fps[r[1]]:016x}", least.get(groups[fps[r[1]]])) for r in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_document_of_each_group_stays(spark, docs, rows):
    kept = simhash.keep_first(spark, docs, "")
    assert kept.columns == docs.columns
    got = kept.select("doc_id", "text").collect()
    groups = brute_groups({brute_fingerprint(r[1]) for r in rows})
    stays = [groups[brute_fingerprint(r["text"])] for r in got]
    assert sorted(stays) == sorted(set(groups.values()))
    assert {r["doc_id"] for r in got} >= {3, 5, 70, 73} and not {60, 61, 71} & {r["doc_id"] for r in got}
