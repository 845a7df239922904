import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from secspark.llm import align
from secspark.llm.bpe import byte_letters

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    first = Tokenizer.from_file(A_FILE)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def tokens(plain, text):
    """Ids and byte ends of both tokenizers by the plain libraries; None where they do not spell the text."""
    first, second = plain
    of = {c: x for x, c in byte_letters().items()}
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    a_bytes = [bytes(of[c] for c in first.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i)
               else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    want = (" " + text).encode()
    return (a, a_bytes, b, b_bytes) if b"".join(a_bytes) == want == b"".join(b_bytes) else None


def brute(plain, rows):
    """Every link by comparing all byte ranges, every group by intersecting the ends."""
    one, held = [], Counter()
    for _, text in rows:
        t = tokens(plain, text) if text else None
        if t is None:
            one.append(None)
            continue
        a, a_bytes, b, b_bytes = t
        spans = []
        for part in (a_bytes, b_bytes):
            ends = [sum(map(len, part[:k + 1])) for k in range(len(part))]
            spans.append([(e - len(p), e) for e, p in zip(ends, part, strict=True)])
        links = [(a[i], b[j]) for i, (x, y) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if x < v and u < y]
        held.update(set(links))
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        text_groups = []
        for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True):
            text_groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, s, strict=True) if lo < e <= hi)
                                        for ids, s in ((a, spans[0]), (b, spans[1]))))
        one.append((len(a), len(b), len(cuts), links, ";".join(text_groups)))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (doc_id, _), r in zip(rows, one, strict=True):
        if r is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_g, links, text = r
            out.append((doc_id, n_a, n_b, n_g, len(links), sum(held[x] == top[x[0]] for x in links),
                        sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_groups_of_random_end_arrays(data):
    total = data.draw(st.integers(1, 80))
    sides = [sorted({*data.draw(st.lists(st.integers(1, total), max_size=80)), total}) for _ in range(2)]
    a, b = sides
    runs, odd, left, right = align.groups(a, b)
    common = sorted(set(a) & set(b))
    assert sum(n for _, _, n in runs) + len(odd) == len(common)
    ends = sorted([a[i + k] for i, _, n in runs for k in range(n)] + [a[i_end - 1] for _, i_end, _, _ in odd])
    assert ends == common
    got = {(i + k, j + k) for i, j, n in runs for k in range(n)} | set(zip(left, right, strict=True))
    starts = [[0, *x[:-1]] for x in sides]
    assert got == {(i, j) for i in range(len(a)) for j in range(len(b))
                   if starts[0][i] < b[j] and starts[1][j] < a[i]}
    assert len(got) == sum(n for _, _, n in runs) + len(left)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t.'s1é日 　😀<|endoftxs>▁́", max_size=60))
def test_encoding_equals_the_plain_libraries(text):
    pair = encoding_pair()
    with open(A_FILE, encoding="utf-8") as f:
        first = first_tokenizer(f.read())
    if not text:
        return
    a, b, n_a, n_b = pair.encode([text, None, "", text])
    want = first.encode(" " + text, add_special_tokens=False).ids, pair.second.encode(text)
    if tokens((first, pair.second), text) is None:
        assert a.tolist() == b.tolist() == [] and n_a.tolist() == n_b.tolist() == [0] * 4
    else:
        assert (a.tolist(), b.tolist()) == (want[0] * 2, want[1] * 2) and n_a.tolist() == [len(want[0]), 0, 0, len(want[0])]


_kept = {}


def encoding_pair():
    if "pair" not in _kept:
        with open(A_FILE, encoding="utf-8") as f, open(B_FILE, "rb") as g:
            _kept["pair"] = align.Pair(align.merge_ranks(f.read()), g.read())
    return _kept["pair"]


def first_tokenizer(spec):
    if "first" not in _kept:
        _kept["first"] = Tokenizer.from_str(spec)
        _kept["first"].encode_special_tokens = True
    return _kept["first"]


def test_every_token_is_sound_and_other_files_are_refused():
    with open(A_FILE, encoding="utf-8") as f:
        assert align.unsound(f.read()) == []
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        align.merge_ranks(f.read())


@pytest.mark.parametrize("hot", [1, 40, align.HOT])
def test_documents_equal_brute_force(spark, docs, rows, plain, hot):
    """All odd cases, with every pair joined (hot = 1 or 40) and with common pairs sent to the tasks."""
    want = brute(plain, [(r[0], r[1] if r[0] != 74 else r[1][:3000]) for r in rows])
    from pyspark.sql import functions as F
    short = docs.withColumn("text", F.when(F.col("doc_id") == 74, F.substring("text", 1, 3000)).otherwise(F.col("text")))
    got = align.align_documents(short, A_FILE, B_FILE, hot)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == want


def test_long_text_empty_table_and_text_ids(spark, docs, no_docs, plain):
    assert align.align_documents(no_docs, A_FILE, B_FILE).count() == 0
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(60000))
    df = spark.createDataFrame([("x", long), (None, "a  b"), ("y", "no\r\n▁ spelling")], "doc_id string, text string")
    got = {r["doc_id"]: r for r in align.align_documents(df, A_FILE, B_FILE).collect()}
    a, _, b, _ = tokens(plain, long)
    assert (got["x"]["n_a"], got["x"]["n_b"]) == (len(a), len(b))
    assert got["x"]["n_links"] == len(a) + len(b) - got["x"]["n_groups"]
    assert got["y"]["n_a"] == 0 and got["y"]["groups_sha256"] == "" and got[None]["n_groups"] == 3
