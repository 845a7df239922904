import numpy as np
import pytest

from secspark.llm import langid, quality
from secspark.llm.common import table
from secspark.llm.linear import dual_coordinate_descent

SF = "/root/testdata/sf0.01"


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 5))
    y = np.sign(x @ np.array([1.0, -2, 0, 0.5, 0]) + 0.3 * rng.standard_normal(200))
    rows = [(np.arange(5), r) for r in x]
    w = dual_coordinate_descent(rows, y, 5, epochs=500, tol=1e-6)
    xb = np.c_[x, np.ones(200)]

    def primal(v):
        return 0.5 * v @ v + np.maximum(0, 1 - y * (xb @ v)).sum()

    best = primal(w)
    assert all(primal(w + 0.05 * rng.standard_normal(6)) >= best - 1e-3 for _ in range(300))


def test_language_accuracy_on_held_out_rows(spark):
    docs = table(spark, SF, "documents", "doc_id", "text", "lang")
    got = langid.op1_langid(spark, SF).join(docs, "doc_id").filter("held_out").collect()
    right = np.mean([r["lang"] == r["lang_pred"] for r in got if r["lang"]])
    assert len(got) > 200 and right > 0.99 and all(0 <= r["score"] <= 1 for r in got)


def test_language_cases(spark, docs, no_docs, rows):
    model = langid.fit(docs)
    assert set(model.langs) == {"en", "de", "fr", "es"} and len(model.pairs) == 2
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert langid.identify(docs, model).count() == len(rows)
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (70, 71, 72, 77))
    assert got[73]["lang_pred"] in model.langs
    nothing = langid.fit(no_docs)
    assert langid.identify(docs, nothing).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(no_docs, model).count() == 0
    only = langid.fit(docs.filter("lang = 'fr'"))
    assert only.predict("abc") == ("fr", 1.0)
    odd = langid.Hierarchy([("xx", *langid.features("abc")), ("yy", *langid.features("zzz"))], langid.FAMILIES)
    assert odd.families == ["only xx", "only yy"] and odd.predict("abc abc")[0] == "xx"


def test_one_family_votes_among_pairs():
    texts = {"en": "the and of to", "de": "der die und das", "nl": "het een van ij"}
    model = langid.Hierarchy([(k, *langid.features(v)) for k, v in texts.items()], langid.FAMILIES)
    assert len(model.families) == 1 and len(model.pairs) == 3
    assert all(model.predict(v)[0] == k for k, v in texts.items())


def test_quality_on_held_out_rows(spark):
    labels = table(spark, SF, "labels", "doc_id", "quality")
    got = quality.op5_quality(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in got]) > 0.97
    good = [r for r in got if r["quality"] == 1]
    assert np.mean([r["predicted"] == 1 for r in good]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("marks", [[], [(1, 1), (2, 1)], [(i, i % 2) for i in range(40)] + [(70, None), (None, 1), (3, 0)]])
def test_quality_cases(spark, docs, no_docs, rows, marks):
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    if len(marks) < 3:
        assert {r["score"] for r in got} == {0.5}
    assert quality.classify(no_docs, labels).count() == 0


def test_keep_good_keeps_columns(spark, docs):
    kept = quality.keep_good(spark, docs, SF)
    assert kept.columns == docs.columns and kept.schema == docs.schema


def test_sample_keeps_every_label_and_repeated_ids_once(spark):
    """300 labels are all kept; an id on 5,000 rows is one row of the sample."""
    from pyspark.sql import functions as F

    from secspark.llm.linear import sampled, with_texts
    many = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 300).alias("lang"))
    assert sampled(many, "doc_id", "lang", 3).select("lang").distinct().count() >= 280
    assert sampled(many, "doc_id", "lang", 5).count() == 1500
    same = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("en").alias("lang"), F.lit("text").alias("text"))
    sample = sampled(same.select("doc_id", "lang"), "doc_id", "lang", 10_000).distinct()
    assert sample.count() == 1 and with_texts(sample, same).count() == 1
