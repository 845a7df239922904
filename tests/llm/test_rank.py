import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from secspark.llm import rank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=rank.K):
    """Every item against every document, straight from the definition."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(x for _, c in counted for x in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for (d, c), n in zip(counted, sizes, strict=True):
            m = 100 - 25 + (25 * n * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 12 * m))
                        for x in terms(text) if x in c)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        found.sort()
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(2)
    words = terms(" ".join(r[1] or "" for r in rows[:50]))
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(30)]
    return out + [(30, rows[3][1]), (31, None), (32, ""), (33, "  ;; "), (34, "zzz nowhere"), (35, "É x X 日本語 aaaa" + "a" * 1196),
                  (None, rows[5][1]), out[0], (0, "other text of item 0 " + out[1][1]), (36, "x " * 300)]


@pytest.mark.parametrize(("block", "bucket", "seed"), [(rank.BLOCK, rank.BUCKET, rank.SEED), (100, 7, 3), (1 << 20, 1, 1)])
def test_equals_brute_force(spark, docs, rows, items, block, bucket, seed):
    asked = spark.createDataFrame(items, "item_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("rank", "score", "doc_id", "n")])
    got = rank.rank_documents(docs, asked, 5, block, bucket, seed)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute([(r[0], r[1]) for r in rows], items, 5)


def test_ties_copies_and_empty_tables(spark, docs, no_docs, items):
    same = spark.createDataFrame([(i % 70, "alpha beta") for i in range(100)] + [(200 + i, f"gamma{i}") for i in range(300)],
                                 "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta gamma7")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in same.collect()]
    assert sorted(map(tuple, rank.rank_documents(same, asked).collect()), key=str) == brute(rows, [(1, "alpha"), (2, "beta gamma7")])
    no_items = asked.limit(0)
    assert rank.rank_documents(same, no_items).count() == 0
    assert rank.rank_documents(no_docs, asked).count() == 0
    assert rank.rank_documents(docs.limit(0), no_items).count() == 0


def test_terms_of_any_characters():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("aZ09 \n\t-_@[`{\x7f\x80\xa0éÉİ日😀\x00") for _ in range(40))
        assert [t.decode() for t in rank.terms(text)] == terms(text)


def test_buckets_are_pruned():
    """Short vectors are skipped by length, and inside a bucket documents with common terms only are not looked at."""
    rng = np.random.default_rng(0)
    df = {x: (900 if x < 20 else 2) for x in range(200)}
    block = rank.Block(list(range(20)), [[*range(10), 20 + i] for i in range(20)], [[1] * 11] * 20, df, 1000)
    found = rank.Search(block, np.zeros(20, np.int64), 5)
    vectors = []
    for d in range(1000):
        term = np.unique(np.r_[rng.integers(0, 20, 8), [20 + d % 40] if d % 3 == 0 else []]).astype(np.int64)
        vectors.append((d, term, np.full(len(term), 400_000 + 100 * d)))
    vectors.sort(key=lambda v: -np.sqrt(((block.w[v[1]] * v[2]) ** 2.0).sum()))
    open_ = True
    for s in range(0, 1000, 50):
        part = vectors[s:s + 50]
        lengths = np.array([np.sqrt(((block.w[t] * i) ** 2.0).sum()) for _, t, i in part])
        open_ = open_ and found.add(np.array([v[0] for v in part]), lengths, np.array([len(v[1]) for v in part]),
                                    np.concatenate([v[1] for v in part]), np.concatenate([v[2] for v in part]))
    assert not open_ and found.buckets < 20 and found.pairs < 0.2 * 20 * 1000
    for k in range(20):
        scores = sorted(((-sum(int(block.w[t]) * int(i) for t, i in zip(v[1], v[2], strict=True) if t < 10 or t == 20 + k), v[0])
                         for v in vectors))
        assert found.best[k] == scores[:5]
