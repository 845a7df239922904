import hashlib
import random

from secspark.llm import fingerprint as fp


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_estimates_are_close_to_the_true_likeness(vocab):
    op = fp.OnePermutation()
    rng = random.Random(3)
    errors = []
    for n in (3, 8, 30, 100, 400, 3000):
        for share in (0.0, 0.3, 0.7, 0.95, 1.0):
            a = [rng.choice(vocab) for _ in range(n)]
            cut = int(n * share)
            b = a[:cut] + [rng.choice(vocab) for _ in range(n - cut)]
            est = op.likeness(op.codes(" ".join(a)), op.codes(" ".join(b)))
            errors.append(est - jaccard(" ".join(a), " ".join(b)))
    assert max(map(abs, errors)) < 0.15 and abs(sum(errors) / len(errors)) < 0.02


def test_short_and_empty_texts():
    op = fp.OnePermutation()
    assert op.likeness(op.codes("a b"), op.codes("a c")) < 0.1
    assert op.likeness(op.codes("a b"), op.codes("a  b")) == 1.0
    assert op.likeness(None, None) == 1.0 and op.likeness(op.codes("a"), None) == 0.0
    assert op.pack(op.codes(None)) == fp.EMPTY and len(op.pack(op.codes("a"))) == 2 * fp.BINS * fp.BITS // 8


def test_chain_matches_brute_force(docs, rows, no_docs, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 4)
    got = fp.near_chain(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    op = fp.OnePermutation()
    want = []
    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        edited = fp.edit(text, following)
        a, b, c = op.codes(text), op.codes(edited), op.codes(following)
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), op.pack(a), op.pack(b),
                     op.likeness(a, b), op.likeness(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert fp.near_chain(no_docs).count() == 0


def test_a_single_document_follows_itself(spark):
    r = fp.near_chain(spark.createDataFrame([(9, "a b c d")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0
    assert r[0]["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()


def test_equal_texts_have_equal_fingerprints(docs):
    pairs = {(r["text"], r["fingerprint"]) for r in docs.select("doc_id", "text").join(
        fp.near_chain(docs).select("doc_id", "fingerprint"), "doc_id").filter("doc_id in (3, 60, 61)").collect()}
    assert len(pairs) == 1


def test_ids_beyond_the_exact_doubles(spark, vocab, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 3)
    ids = [(1 << 60) + i for i in range(40)] + [None, -(1 << 62), 5]
    rows = [(i, " ".join(vocab[k:k + 9])) for k, i in enumerate(ids)]
    got = fp.near_chain(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted(ids, key=str)
    text = dict(rows)
    order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
    follows = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    for r in got:
        edited = fp.edit(text[r["doc_id"]], text[follows[r["doc_id"]]])
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
