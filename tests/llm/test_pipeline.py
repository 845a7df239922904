import hashlib

import numpy as np
import pytest

import corpus_pipeline
from secspark.llm import quality
from secspark.llm.common import table
from secspark.llm.queries import ORACLES, QUERIES
from test_simhash import brute_fingerprint, brute_groups
from test_suffix import brute as brute_suffix

SF = "/root/testdata/sf0.001"


def test_names_and_stages():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5
    import __spark_entry__ as entry
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_run_matches_brute_force(spark):
    """Each stage by a plain version on the driver (the classifier's decisions are its own)."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    good = {r["doc_id"] for r in quality.op5_quality(spark, SF).filter("predicted = 1").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    fps = {i: brute_fingerprint(t) for i, t in rows.items()}
    groups, least = brute_groups(set(fps.values())), {}
    for i in sorted(rows):
        least.setdefault(groups[fps[i]], i)
    ids = sorted(least.values())
    texts = [w[4].decode("utf-8", "ignore") for w in brute_suffix([rows[i] for i in ids])]
    items = [r["text"].lower() for r in table(spark, SF, "benchmark").collect()]
    left = {i: t for i, t in zip(ids, texts, strict=True) if not any(x in t.lower() for x in items)}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    want = {i: hashlib.sha256(np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
            for i, t in left.items()}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_on_odd_and_empty_tables(spark, docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema, name
        assert 0 < out.count() <= docs.count()
        assert stage(spark, no_docs, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
