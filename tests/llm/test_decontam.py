import math
import random
import re
from collections import Counter

import numpy as np
import pyspark.sql
import pytest

from secspark.llm import decontam
from secspark.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def bench(vocab):
    rng = random.Random(31)
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([6, 9, 15, 20, 31, 32, 33, 50, 64, 70, 150, 40])]
    items += [(50, items[4][1]), (51, "too short"), (52, None), (53, ""), (None, items[6][1] + " nothing here"),
              (54, "what is the colour of the old house on the hill. answer: dark purple")]
    return items


def test_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 12))]
        b = [rng.randint(-1, 6) for _ in range(rng.randint(0, 15))]
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontam.common_subsequence(a, b) == t[-1, -1]


def test_planted_passages_are_found_and_clean_texts_left(spark, bench, vocab):
    rng = random.Random(32)

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    docs, want = [], set()
    for i, text in bench:
        words = (text or "").split()
        if len(words) < decontam.MIN_WORDS or i is None:
            continue
        docs.append((len(docs), f"{prose(rng.randint(0, 90))} {text.upper()} {prose(rng.randint(0, 90))}", i))
        changed = [rng.choice(vocab) if k % 6 == 2 and k < len(words) - decontam.ANSWER_WORDS else w for k, w in enumerate(words)]
        if len(words) >= 15:
            docs.append((len(docs), f"{prose(40)}\n{' '.join(changed)}, {prose(30)}", i))
    clean = [(1000 + k, prose(rng.randint(0, 300)), None) for k in range(60)] + [(2000, None, None), (2001, "", None)]
    df = spark.createDataFrame(docs + clean, "doc_id long, text string, lcs long").repartition(4)
    got = decontam.leaks(df, spark.createDataFrame(bench, "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    want = {(d, 4 if i == 50 else i) for d, _, i in docs}
    assert want <= pairs
    assert not {d for d, _ in pairs} & {d for d, *_ in clean}
    assert {r["n_items"] for r in got if r["item_id"] == 4} == {2}


def test_a_paraphrase_needs_the_answer(spark):
    item = [(1, "what is the colour of the old house on the hill by the sea. answer: dark purple")]
    near = "what is the colour of an old house on a hill by the sea"
    docs = [(1, f"{near}. answer: dark purple"), (2, f"{near}. answer: pale green"), (3, "dark purple")]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(item, "item_id long, text string")).collect()
    assert [(r["doc_id"], r["answer"]) for r in got] == [(1, True)]


@pytest.mark.parametrize("others", [20, 2000])
def test_rewordings_with_foreign_words_are_found(spark, bench, vocab, others):
    """15 to 40 % of the words replaced by words outside the benchmark, at two corpus sizes."""
    rng = random.Random(33)
    foreign = [f"{w}x{k}" for k in range(3) for w in vocab]
    docs, want = [], set()
    for i, text in bench[:9]:
        words = text.split()
        if len(words) < 15:
            continue
        for rate in (0.15, 0.25, 0.4):
            changed = list(words)
            for k in rng.sample(range(len(words) - decontam.ANSWER_WORDS), int(rate * len(words))):
                changed[k] = rng.choice(foreign)
            before, after = (" ".join(rng.choices(foreign, k=40)) for _ in range(2))
            want.add((len(docs), i))
            docs.append((len(docs), f"{before} {' '.join(changed)} {after}"))
    docs += [(10000 + k, " ".join(rng.choices(foreign + vocab, k=80))) for k in range(others)]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                         spark.createDataFrame(bench[:9], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_blocks_change_nothing(spark, bench, vocab, monkeypatch):
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(50)) + " " + (bench[k % 12][1])) for k in range(24)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(df, items).collect()}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 150)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(df, items).collect()} == whole
    assert {(k, 4 if k % 12 == 4 else k % 12) for k in range(24)} <= whole


@pytest.fixture(scope="module")
def fitted(spark):
    docs, items = table(spark, SF, "documents", "doc_id", "text"), table(spark, SF, "benchmark", "item_id", "text")
    texts, items = [r["text"] for r in docs.collect()], items.orderBy("item_id").collect()
    block = decontam.Block([(r["item_id"], 1, r["text"]) for r in items])
    block.fit(docs, *decontam.word_weights(docs))
    return texts, [r["text"] for r in items], decontam.Searcher(vars(block))


def latent_hits(s, text):
    """(query, window start) pairs that the latent search alone finds."""
    hashes, _ = s.cut([text])
    ids = s.known.numbers(hashes)
    return {(q, a) for q, a, _, _ in s.candidates(ids, np.array([len(ids)]), s.lost(hashes, ids))}


def test_recall_of_the_latent_search_against_brute_force(fitted):
    """Windows whose TF-IDF cosine over all words reaches the bar, with weights counted one by one."""
    texts, _, s = fitted
    words = [s.cut([t])[0].tolist() for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    idf = {w: math.log((1 + len(texts)) / (1 + c)) + 1 for w, c in df.items()}
    name = {k: w for w, k in s.vocab.items()}
    queries = []
    for q in s.queries:
        v = {name[k]: idf.get(name[k], math.log(1 + len(texts)) + 1) for k in q["words"]}
        size = math.sqrt(sum(x * x for x in v.values()))
        queries.append({w: x / size for w, x in v.items()})
    holding: dict[int, list[int]] = {}
    for k, q in enumerate(queries):
        for w in q:
            holding.setdefault(w, []).append(k)
    seen = hit = 0
    for text, ws in zip(texts, words, strict=True):
        got = None
        for scale in s.by_scale:
            for a in range(0, max(1, len(ws) - scale // 2), max(1, scale // 4)):
                window = set(ws[a:a + scale])
                size = math.sqrt(sum(idf[w] ** 2 for w in window))
                dots = Counter()
                for w in window:
                    for k in holding.get(w, ()):
                        dots[k] += queries[k][w] * idf[w]
                for k, dot in dots.items():
                    if s.queries[k]["scale"] == scale and dot / size >= decontam.COSINE:
                        got = latent_hits(s, text) if got is None else got
                        seen += 1
                        hit += (k, a) in got
    assert seen > 100 and hit / seen >= 0.9, (hit, seen)


@pytest.mark.parametrize("rate", [0.15, 0.3, 0.4])
def test_rewordings_are_found_by_the_latent_search_alone(fitted, rate):
    """Items with words replaced by words of the corpus, between passages of such words."""
    texts, items, s = fitted
    rng = random.Random(36)
    pool = [w for t in texts for w in t.split()]
    found = total = 0
    for k, q in enumerate(s.queries):
        words = items[k].split()
        for i in rng.sample(range(len(words) - decontam.ANSWER_WORDS), round(rate * (len(words) - decontam.ANSWER_WORDS))):
            words[i] = rng.choice(pool)
        text = " ".join(rng.choices(pool, k=40) + words + rng.choices(pool, k=40))
        found += k in {hit for hit, _ in latent_hits(s, text)}
        total += 1
    assert found >= 0.9 * total, (found, total)


def test_weights_are_counted_over_all_documents(spark, rows):
    texts = [r[1] for r in rows]
    cut = decontam.WordHasher()
    n, weights = decontam.word_weights(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = np.zeros(decontam.COUNTERS)
    for t in texts:
        want[np.unique(decontam.cells(cut([t])[0]))] += 1
    assert n == len(texts)
    assert np.allclose(weights, np.log((1 + n) / (1 + want)) + 1)


def test_the_space_comes_from_all_documents(spark, bench, vocab):
    """Every window of 2,000 documents is in it, and the space is that of the whole matrix."""
    rng = random.Random(37)
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 3, 64, 65, 150]))) for _ in range(2000)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    items = [(i, 1, t) for i, t in bench if t and i is not None]
    block = decontam.Block(items)
    block.fit(df, *decontam.word_weights(df))
    cut, known, rows = decontam.WordHasher(), decontam.Vocabulary(block.vocab), []
    for t in texts:
        ids = known.numbers(cut([t])[0])
        rows += [np.unique(w[w >= 0]) for a in range(0, len(ids), decontam.PASSAGE) for w in [ids[a:a + decontam.PASSAGE]] if (w >= 0).any()]
    got = decontam.passages(block, df).collect()
    lists = [np.split(np.frombuffer(r["terms"], np.int32), np.cumsum(np.frombuffer(r["sizes"], np.int32))[:-1]) for r in got]
    assert Counter(tuple(w) for part in lists for w in part) == Counter(tuple(w) for w in rows)

    def matrix(lists, scale):
        a = np.zeros((len(lists), len(block.vocab)))
        for k, ids in enumerate(lists):
            a[k, ids] = scale * block.idf[ids] / np.linalg.norm(block.idf[ids])
        return a

    own = [np.unique(q["words"]) for q in block.queries]
    a = np.vstack([matrix(own, 1.0), matrix(rows, math.sqrt(len(own) / len(rows)))])
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((a.shape[1], len(own) + decontam.OVERSAMPLE)))[0]
    for _ in range(decontam.POWER + 1):
        basis = np.linalg.qr(a.T @ (a @ basis))[0]
    values, vectors = np.linalg.eigh((a @ basis).T @ (a @ basis))
    want = basis @ vectors[:, np.argsort(-values)[:len(own)]]
    assert np.abs(block.space @ block.space.T - want @ want.T).max() < 1e-3


def test_no_more_partial_sums_than_cores(spark, bench, monkeypatch):
    """However many partitions the windows lie in, a group of partial sums stays small."""
    df = spark.createDataFrame([(k, bench[k % 12][1]) for k in range(300)], "doc_id long, text string").repartition(60)
    block, most = decontam.Block([(i, 1, t) for i, t in bench if t and i is not None]), []
    total = pyspark.sql.GroupedData.applyInPandas

    def counted(self, f, schema):
        if "block" in self._df.columns:
            most.extend(r["count"] for r in self._df.groupBy("block").count().collect())
        return total(self, f, schema)

    monkeypatch.setattr(pyspark.sql.GroupedData, "applyInPandas", counted)
    block.fit(df, *decontam.word_weights(df))
    assert most and max(most) <= spark.sparkContext.defaultParallelism


def test_stage_and_empty_tables(spark, docs, no_docs):
    out = decontam.drop_leaks(spark, docs, SF)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert decontam.drop_leaks(spark, no_docs, SF).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(docs, none).count() == 0


def test_reworded_long_items_keep_their_answer(spark, vocab):
    """Every part of the item has changed words among its last five; the answer decides."""
    rng = random.Random(35)
    items, docs, want = [], [], set()

    def prose():
        return [f"{rng.choice(vocab)}x" for _ in range(30)]

    def reworded(words, keep):
        return [f"{w}y" if k % 4 == 3 and k < len(words) - keep else w for k, w in enumerate(words)]

    def add(words, item=None):
        if item is not None:
            want.add((len(docs), item))
        docs.append((len(docs), " ".join(prose() + words + prose())))

    for n in (70, 130, 200):
        words = [rng.choice(vocab) for _ in range(n)]
        marked = [*words, "answer:", "dark", "purple"]
        items += [(n, " ".join(words)), (n + 1, " ".join(marked))]
        add(reworded(words, 5), n)  # the item's last five words stand
        add([*reworded(words, 0), "answer:", "dark", "purple"], n + 1)  # its tail is changed, its answer stands
        add([*reworded(words, 0), "answer:", "pale", "green"])
    # the texts with a mark hold the changed words of the item without, whose tail is changed there
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert want <= pairs
    assert not {d for d, _ in pairs} & {2, 5, 8}


def test_a_leak_takes_no_other_text_of_its_id(spark, vocab):
    item = table(spark, SF, "benchmark", "text").orderBy("text").first()["text"]
    rng = random.Random(34)
    clean = [" ".join(rng.choices(vocab, k=30)) for _ in range(3)]
    rows = [(None, f"so {item} it is"), (None, clean[0]), (None, None), (7, item), (7, clean[1]), (8, clean[2]), (7, item)]
    out = decontam.drop_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert {tuple(r) for r in out} == {(None, clean[0]), (None, None), (7, clean[1]), (8, clean[2])}


def test_words_of_many_texts_are_the_words_of_each(monkeypatch, rows):
    texts = [r[1] for r in rows] + ["“Quoted” text — with marks…", "a_b c-d", "ÀÉ àé", "w" * 3000 + " x"]
    cut = decontam.WordHasher()
    alone = [cut([t])[0].tolist() for t in texts]
    for t, words in zip(texts, alone):
        assert len(words) == len(re.findall(r"\w+", (t or "").lower())), t
    monkeypatch.setattr(decontam, "GROUP", 700)
    hashes, owner = decontam.WordHasher()(texts)
    assert [hashes[owner == i].tolist() for i in range(len(texts))] == alone
    assert cut(["Quoted"])[0][0] == cut(["“quoted”!"])[0][0]


def test_regions_without_enough_words_are_not_compared(monkeypatch):
    """Texts that hold all but a few of an item's words, some often, cost no subsequence; those that hold enough do."""
    rng, done, compare = random.Random(38), [], decontam.subsequence

    def counted(hits, n):
        done.append(n)
        return compare(hits, n)

    monkeypatch.setattr(decontam, "subsequence", counted)
    for n in (1, 5, 20, 64, 65):
        words = [rng.randrange(n) for _ in range(n)]
        least = decontam.least_common(n)
        for _ in range(40):
            text = [rng.choice([*words, -1, -2]) for _ in range(rng.randint(0, 90))]
            # words of the item that an alignment in any order could use
            enough = min(sum(w in words for w in text), sum(w in text for w in words)) >= least
            done.clear()
            got, want = decontam.matched(decontam.places(words), n, text, least), decontam.common_subsequence(words, text)
            assert got == want if enough else got == 0 and want < least
            assert len(done) == 1 + enough


def test_words_with_equal_low_bits_keep_their_numbers():
    """More words than slots they could lie in, and foreign words in those slots."""
    rng = np.random.default_rng(39)
    low = rng.integers(0, 8, 64, dtype=np.uint64)
    words = (np.arange(64, dtype=np.uint64) << np.uint64(20)) | low
    foreign = (np.arange(100, 164, dtype=np.uint64) << np.uint64(20)) | low
    known = decontam.Vocabulary({int(w): k for k, w in enumerate(words)})
    both = rng.permutation(np.r_[words, foreign, np.arange(9, 20, dtype=np.uint64)])
    want = {int(w): k for k, w in enumerate(words)}
    assert known.numbers(both).tolist() == [want.get(int(w), -1) for w in both]


def test_hashes_do_not_depend_on_the_pieces(monkeypatch, rows):
    """Cut at any number of bytes, with words longer than a piece, the words and their texts stay."""
    texts = [r[1] for r in rows] + ["é" * 900 + " “x”", "", None, "w" * 3000 + " y"]
    want = decontam.WordHasher()(texts)
    for size in (1, 7, 300, 5000):
        monkeypatch.setattr(decontam, "CUT", size)
        got = decontam.WordHasher()(texts)
        assert all(np.array_equal(a, b) for a, b in zip(got, want))
