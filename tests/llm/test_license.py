import math
import random
import re

import pytest

from secspark.llm import license as lic
from secspark.llm.common import table

LINES = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache",
         "This work is licensed under the GNU General Public License, version 3.": "gpl",
         "Released under the MIT License.": "mit", "All rights reserved.": "proprietary",
         "LICENSED under the terms of the Mozilla Public License 2.0": "mpl"}


@pytest.fixture(scope="module")
def planted(spark, vocab):
    rng = random.Random(41)

    def prose(n):
        return " ".join(rng.choice([*vocab, "the", "of", "under", "this", "work", "is", "all", "rights"]) for _ in range(n))

    rows, want = [], set()
    for k in range(120):
        lines = [prose(rng.randint(0, 90)) for _ in range(rng.randint(1, 6))]
        if k % 3 == 0:
            text, family = rng.choice(list(LINES.items()))
            at = rng.randint(0, len(lines))
            lines.insert(at, text)
            want.add((k, at, family))
        rows.append((k, "\n".join(lines), 1))
    odd = [(500, None, 1), (501, "", 1), (502, "\n\n  \n", 1), (None, "Released under the MIT License.", 1),
           (503, prose(30000), 1), (504, "All rights reserved.", 1), (504, "All rights reserved.", 1),
           (505, "the rights of all people reserved for the work under this", 1)]
    want |= {(None, 0, "mit"), (504, 0, "proprietary")}
    return spark.createDataFrame(rows + odd, "doc_id long, text string, family int").repartition(3), want


def test_planted_notices_are_found_and_prose_is_not(planted):
    docs, want = planted
    got = lic.scan(docs).collect()
    assert {(r["doc_id"], r["line"], r["family"]) for r in got} == want
    assert sum(r["doc_id"] == 504 for r in got) == 2
    assert all(r["probability"] >= 0.5 and r["overlap"] >= lic.OVERLAP for r in got)


def test_full_notices_inside_long_lines(spark, vocab, planted):
    docs, _ = planted
    model = lic.Model(spark, docs)
    rows = [(i, f, t) for i, (f, t) in enumerate((f, t) for f in lic.FAMILIES for t in lic.NOTICES[f])]
    pieces = spark.createDataFrame(rows, "key int, want string, body string").withColumn(
        "grams", lic.grams(lic.words(lic.F.col("body"))))
    got = model.scored(pieces, ["key", "want"]).collect()
    right = sum(r["family"] == r["want"] for r in got)
    assert right / len(rows) > 0.9


def test_notices_across_the_cuts_of_long_lines(spark, vocab):
    """Each notice at every place round a cut of a line of prose, among the documents of a driver table."""
    docs = table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text")
    rng = random.Random(43)
    rows, want = [], set()
    for text, family in LINES.items():
        for before in range(lic.PIECE - len(re.findall(r"\w+", text)), lic.PIECE + 1):
            want.add((-1 - len(rows), family))
            rows.append((-1 - len(rows), f"{' '.join(rng.choices(vocab, k=before))} {text} {' '.join(rng.choices(vocab, k=300))}"))
    got = lic.scan(docs.union(spark.createDataFrame(rows, docs.schema))).filter("doc_id < 0").collect()
    assert sorted((r["doc_id"], r["family"]) for r in got) == sorted(want)


def test_no_python_on_the_main_path(planted):
    docs, _ = planted
    plan = lic.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty_table(spark, no_docs):
    assert lic.scan(no_docs).count() == 0


def test_model_does_not_depend_on_the_layout(spark):
    """The same table in one and in seven partitions gives the same model."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(5)) for _ in range(300)]
    rows = [(i if i % 5 else None, "\n".join(" ".join(rng.choice(vocab) for _ in range(12)) for _ in range(3))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (lic.Model(spark, docs.repartition(n)) for n in (1, 7))
    assert a.threshold == b.threshold and max(abs(x - y) for x, y in zip(a.bias, b.bias, strict=True)) < 1e-9


def test_the_model_learns_from_every_paragraph(spark, planted, monkeypatch):
    """Fit and calibration together get each paragraph once, also of a table with more than 4,000 of them."""
    rows = [(i, "\n".join(f"line{k} of text {'a b c' if k else 'd e f'} {i % 7}" for k in range(3))) for i in range(2500)]
    docs = spark.createDataFrame([*rows, (1, "All rights reserved."), (2, None)], "doc_id long, text string")
    seen, kept = {}, lic.materialise

    def counted(df, name):
        out = kept(df, name)
        if name == "licence-negatives":
            seen.update({r["fit"]: r["count"] for r in out.groupBy("fit").count().collect()})
        return out

    monkeypatch.setattr(lic, "materialise", counted)
    model = lic.Model(spark, docs)
    assert sum(seen.values()) == 7500 and min(seen.values()) > 3000
    grams = {r["gram"] for r in model.weights.collect()}
    assert {"line0", "line2", "of text", "a b", "software", "mit license"} <= grams
    found = lic.scan(docs).collect()
    assert [(r["doc_id"], r["family"]) for r in found] == [(1, "proprietary")]


def test_words_are_looked_for_once_a_pass(planted):
    """The filter on the number of words does not make Spark look for them a second time."""
    docs, _ = planted
    for found in (lic.lines(docs), lic.numbered(docs).filter("fit").select("words")):
        assert found._jdf.queryExecution().executedPlan().toString().count("lower(") == 1


def test_notice_test_is_that_of_a_plain_reading(spark, planted):
    """Prose, notices in whole, cut or inside prose: the test by numbers first agrees with all shares worked out."""
    rng = random.Random(47)
    known = {w for f in lic.FAMILIES for t in lic.NOTICES[f] for w in re.findall(r"\w+", t.lower())}
    bodies = [[], ["all"], ["all", "rights"], ["under", "the"]]
    for f in lic.FAMILIES:
        for t in lic.NOTICES[f]:
            notice = re.findall(r"[a-z0-9]+", t.lower())
            for _ in range(6):
                a, b = sorted(rng.choices(range(len(notice) + 1), k=2))
                prose = rng.choices([*sorted(known), "x", "y", "z"], k=rng.randint(0, 40))
                bodies.append(prose[:9] + notice[a:b] + prose[9:])
    notices = [set(p) for p in lic.notice_pairs()]

    def plain(words):
        mine = {f"{a} {b}" for a, b in zip(words, words[1:])}
        like = len(mine & set().union(*notices)) / max(1, len(mine))
        holds = max(len(mine & n) / len(n) for n in notices)
        return like < lic.OVERLAP and holds < lic.OVERLAP

    body = lic.F.col("words")
    got = (spark.createDataFrame(list(enumerate(bodies)), "i int, words array<string>")
                .select("i", "words", lic.once(pairs=lic.two_grams(body))).select("i", lic.unlike_notices(body, lic.F.col("pairs")).alias("un")))
    assert {r["i"]: r["un"] for r in got.collect()} == {i: plain(w) for i, w in enumerate(bodies)}


def test_two_grams_of_given_words_only(spark):
    """Those of all two-grams whose words are in the two lists, in their order and with repeats."""
    rng = random.Random(53)
    bodies = [[], ["a"], ["a", "b"], ["b", "a"], *([rng.choice("abcdé") for _ in range(rng.randint(2, 30))] for _ in range(40))]
    first, second = ["a", "é"], ["b", "a"]
    got = spark.createDataFrame(list(enumerate(bodies)), "i int, words array<string>").select(
        "i", lic.two_grams_of(lic.F.col("words"), first, second).alias("g"))
    assert {r["i"]: r["g"] for r in got.collect()} == {
        i: [f"{x} {y}" for x, y in zip(w, w[1:]) if x in first and y in second] for i, w in enumerate(bodies)}


def test_first_bound_is_that_of_a_plain_reading(spark, planted):
    """The documents of the first bound are those of its definition; words without a gain go before the joins."""
    docs, _ = planted
    model = lic.Model(spark, docs)
    gain = {r["gram"]: r["gain"] for r in model.gains()[0].collect()}
    start, needed = max(model.bias[:-1]) - model.bias[-1], math.log(model.threshold / (1 - model.threshold))

    def worth(text):
        for line in (text or "").split("\n"):
            w = re.findall(r"[^\W_]+", line.lower())
            one = [gain.get(x, 0.0) + gain.get(f"{x} {y}", 0.0) for x, y in zip(w, [*w[1:], ""])]
            known = [x in gain or f"{x} {y}" in gain for x, y in zip(w, [*w[1:], ""])]
            for at in range(-lic.HALF, len(w), lic.HALF):
                s = slice(max(at, 0), at + lic.PIECE)
                if any(known[s]) and sum(one[s]) + start >= needed:
                    return True
        return False

    look = model.worth_a_look(docs)
    assert {r["doc_id"] for r in look.collect()} == {r["doc_id"] for r in docs.collect() if worth(r["text"])}
    assert "arrays_zip" not in look._jdf.queryExecution().optimizedPlan().toString()
