import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from secspark.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.SpeculativeBpe(bpe.vocabulary_spec(PATH))


def test_random_texts_match_the_library(own, lib):
    rng = random.Random(1)
    parts = ["a", "the", "'s", "'ll", " ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "<", "|", ">", "</w>", "é", "é", "́",
             "ß", "İ", "Σ", "日本", "1", "23", "!!!", "aaaa", "ing", "\x1c", " ", "🎉", "hello", "ation", "\x00", "ABC", "½", "_"]
    for _ in range(4000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = lib.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == want, s
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_both_ways_are_taken_and_agree(own, lib):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    own.forget()
    before = own.speculated, own.failed
    assert own.encode(" ".join(words)) == lib.encode(" ".join(words), add_special_tokens=False).ids
    speculated, failed = own.speculated - before[0], own.failed - before[1]
    assert 0 < failed < speculated


def test_slices_and_memo_limits_change_nothing(own, lib, monkeypatch, rows):
    text = max((r[1] or "" for r in rows), key=len)
    monkeypatch.setattr(bpe, "SLICE", 100)
    monkeypatch.setattr(bpe, "MEMO", 50)
    monkeypatch.setattr(bpe, "GROUP", 400)
    texts = [text[:3000], "", text[:90], text[100:700]]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [own.encode(t) for t in texts] == want
    digests = list(own.digests(texts))
    assert [d[0] for d in digests] == [len(w) for w in want]
    assert digests[0][2] == hashlib.sha256(lib.decode(want[0], skip_special_tokens=False).encode()).hexdigest()


def test_documents(docs, no_docs, lib, rows):
    got = sorted(map(tuple, bpe.encode_documents(docs, PATH).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(no_docs, PATH).count() == 0
    lists = bpe.token_lists(docs.filter("doc_id = 3"), PATH).first()
    assert lists["decoded"] == lib.decode(list(lists["ids"]), skip_special_tokens=False)
