"""Operator 2, licence scans, with DataFrame and SQL functions only.

A trained paragraph classifier.  Every line of a text, cut into pieces of at most
``PIECE`` words, is a paragraph; its features are the presence of word one- and two-grams.
A multinomial logistic regression tells the licence families and an unknown class apart.  It
is fitted on windows of the licence notices below and on the paragraphs of all documents, which
together weigh as much as ``UNKNOWN_WEIGHT`` rows at most; paragraphs that resemble or hold a notice
are not taken as unknown.  The model knows the n-grams of the notices and, up to ``VOCABULARY`` in all,
those that most paragraphs have: words, and two-grams of the ``COMMON`` most frequent words.

The unknown class is calibrated: half of the paragraphs, by a hash, take no part in the fit, and a
family must be more probable than all but ``FALSE_RATE`` of them claim (and than 0.5).  The
prediction must then be confirmed by a template: the two-grams that the paragraph shares with
one notice of the family reach ``OVERLAP`` of the paragraph's or of the notice's.

A notice that lies across a cut is read in a piece that starts half a piece later.  Such a
piece counts only if what it shares with a notice lies on both sides of the cut, and if no whole
piece beside it claims the family; a whole piece that has only a part of that notice gives way.

Scoring reads every text.  In a first pass only n-grams that speak for a family are joined
(the model is a broadcast table of at most ``VOCABULARY`` rows); their sum over two neighbouring
halves of pieces bounds a paragraph's score from above, so documents without a paragraph above
the bound are done.  The others are scored in full.

Defined results: null and empty texts have no paragraphs; a repeated row is scored for itself;
rows without doc_id keep null; of equal probabilities the first family in name order wins; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from secspark.llm.common import materialise, table

PIECE = 64
UNKNOWN_WEIGHT = 2000
VOCABULARY = 4096
COMMON = 256
FALSE_RATE = 0.001
OVERLAP = 0.5
HALF = PIECE // 2
BLOCK_MB = 4
UNKNOWN = "unknown"

# Wording of common licence notices.
NOTICES: dict[str, list[str]] = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
        "to this work.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v2.0 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
}
FAMILIES = sorted(NOTICES)
CLASSES = [*FAMILIES, UNKNOWN]


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def two_grams(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.concat(x, F.lit(" "), y))


def two_grams_of(w: Column, first: list[str], second: list[str]) -> Column:
    """The two-grams of a word of ``first`` and then one of ``second``; no others are put together."""
    after = F.slice(w, F.lit(2), F.size(w))
    return F.array_compact(F.zip_with(w, after, lambda x, y: F.when(
        x.isin(first) & y.isin(second), F.concat(x, F.lit(" "), y))))


def grams(w: Column) -> Column:
    return F.array_distinct(F.concat(w, two_grams(w)))


def once(**columns: Column) -> Column:
    """Columns that are worked out once: a filter on what a one-row ``inline`` gives is not put before it."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (position in the scan), line (number), all (its words)."""
    return (docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
                .select("doc_id", "row", F.posexplode(F.split("text", r"\n")).alias("line", "body"))
                .select("doc_id", "row", "line", once(all=words(F.col("body"))))
                .filter(F.size("all") > 0))


def paragraphs(docs: DataFrame, across: bool = False) -> DataFrame:
    """doc_id, row, line, at (first word), piece (number), words: all lines, long ones in pieces;
    with ``across`` also the pieces that lie across two of them."""
    n = F.size("all")
    starts = F.sequence(F.lit(0), n - 1, F.lit(HALF if across else PIECE))
    if across:
        starts = F.filter(starts, lambda a: (a % PIECE == 0) | (a + HALF < n))
    return (lines(docs).select("doc_id", "row", "line", "all", F.explode(starts).alias("at"))
                       .select("doc_id", "row", "line", "at", (F.col("at") / PIECE).cast("int").alias("piece"),
                               F.slice("all", F.col("at") + 1, PIECE).alias("words")))


def notices(spark: SparkSession) -> DataFrame:
    rows = [(f, i, t) for f in FAMILIES for i, t in enumerate(NOTICES[f])]
    return spark.createDataFrame(rows, "family string, notice int, body string").select(
        "family", "notice", words(F.col("body")).alias("words"))


def shared(paragraph: Column, notice: Column) -> Column:
    """Number of two-grams in common."""
    return F.size(F.array_intersect(two_grams(paragraph), two_grams(notice)))


def overlap(paragraph: Column, notice: Column) -> Column:
    """Share of the two-grams in common, of the paragraph's or the notice's, whichever is larger."""
    a, b = F.array_distinct(two_grams(paragraph)), F.array_distinct(two_grams(notice))
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def windows(known: DataFrame) -> DataFrame:
    """Training rows of the families: each notice in whole and its windows of several widths."""
    n = F.size("words")
    parts = [known.select("family", "words")]
    for width in (6, 10, 16, 24):
        at = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)), F.lit(max(1, width // 4)))
        parts.append(known.select("family", "words", F.explode(at).alias("at"))
                          .select("family", F.slice("words", F.col("at") + 1, width).alias("words")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("family", grams(F.col("words")).alias("grams"))


def numbered(docs: DataFrame) -> DataFrame:
    """words, key (a hash of its place and words), fit (whether it takes part in the fit) of all paragraphs."""
    place = F.xxhash64("doc_id", "line", "at", "words", F.lit("half"))
    return paragraphs(docs).select("words", place.alias("key")).withColumn("fit", F.pmod("key", F.lit(2)) == 0)


def notice_pairs() -> list[list[str]]:
    """The two-grams of each notice."""
    return [sorted({f"{a} {b}" for a, b in _pairs(t)}) for f in FAMILIES for t in NOTICES[f]]


def unlike_notices(w: Column, pairs: Column) -> Column:
    """Whether words neither resemble nor hold a notice; ``pairs``: their two-grams, at least those of the notices."""
    all_grams = sorted({g for known in notice_pairs() for g in known})

    def enough(known: Column, grams: list[str]) -> Column:
        need = next(k for k in range(1, len(grams) + 1) if k / len(grams) >= OVERLAP)
        # The number alone settles it for most paragraphs.
        return (F.size(known) >= need) & (F.size(F.array_intersect(known, F.array(*map(F.lit, grams)))) >= need)

    def few(known: Column) -> Column:
        like = F.size(known) / F.greatest(F.size(F.array_distinct(two_grams(w))), F.lit(1))
        # A notice inside a longer paragraph would be lost in that share.
        holds = reduce(Column.__or__, [enough(known, grams) for grams in sorted(notice_pairs(), key=len)])
        return (F.size(known) == 0) | ((like < OVERLAP) & ~holds)

    # An array of one element: what a lambda is given is worked out once.
    return F.exists(F.array(F.array_distinct(F.filter(pairs, lambda g: g.isin(all_grams)))), few)


def vocabulary(known: DataFrame, rows: DataFrame) -> list[str]:
    """The n-grams of the notices, then those that most rows have."""
    own = sorted(r["gram"] for r in windows(known).select(F.explode("grams").alias("gram")).distinct().collect())

    def most(found: Column) -> list[tuple[int, str]]:
        counts = rows.select(F.explode(F.array_distinct(found)).alias("gram")).groupBy("gram").count()
        return [(-r["count"], r["gram"]) for r in counts.orderBy(F.desc("count"), "gram").limit(VOCABULARY).collect()]

    single = most(F.col("words"))
    common = [g for _, g in single[:COMMON]]
    double = most(two_grams_of(F.col("words"), common, common)) if common else []
    others = [g for _, g in sorted(single + double) if g not in set(own)]
    return (own + others)[:VOCABULARY]


class Model:
    """Weights of the n-grams per class, intercepts and the calibrated threshold."""

    def __init__(self, spark: SparkSession, docs: DataFrame):
        known, rows = notices(spark), numbered(docs)
        grams = vocabulary(known, rows.filter("fit"))
        vector = CountVectorizerModel.from_vocabulary(grams, "grams", "features", binary=True)
        double = [g for g in grams if " " in g]
        first, second = (sorted(set(part)) for part in zip(*(g.split(" ") for g in double), strict=True))
        pairs = F.filter(two_grams_of(F.col("words"), first, second), lambda g: g.isin(double))
        rows = rows.select("words", "key", "fit", once(pairs=pairs)).filter(unlike_notices(F.col("words"), F.col("pairs")))
        # In one order whatever the files' layout: the fit adds small tables up the same way.
        negatives = materialise(vector.transform(rows.withColumn("grams", F.concat("words", "pairs"))).select(
            "features", "fit", "key").repartition("key").sortWithinPartitions("key"), "licence-negatives")
        weight = min(1.0, UNKNOWN_WEIGHT / max(1, negatives.filter("fit").count()))
        index = F.create_map(*[x for i, f in enumerate(CLASSES) for x in (F.lit(f), F.lit(float(i)))])
        positives = windows(known).orderBy("family", F.xxhash64("grams"), "grams").coalesce(1)
        positives = vector.transform(positives).select(index[F.col("family")].alias("label"), "features", F.lit(1.0).alias("weight"))
        fitted = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, weightCol="weight",
                                    maxBlockSizeInMB=BLOCK_MB).fit(positives.union(
            negatives.filter("fit").select(F.lit(float(len(FAMILIES))), "features", F.lit(weight))))
        present = fitted.numClasses
        matrix = fitted.coefficientMatrix.toArray()
        self.bias = [float(x) for x in fitted.interceptVector.toArray()] + [-math.inf] * (len(CLASSES) - present)
        data = [(g, [float(matrix[c, i]) if c < present else 0.0 for c in range(len(CLASSES))])
                for i, g in enumerate(vector.vocabulary)]
        self.weights = spark.createDataFrame(data, T.StructType([
            T.StructField("gram", T.StringType()), T.StructField("w", T.ArrayType(T.DoubleType()))]))
        claim = F.array_max(F.slice(vector_to_array("probability"), 1, len(FAMILIES)))
        held = fitted.transform(negatives.filter("not fit")).select(claim.alias("p"))
        share = held.agg(F.percentile_approx("p", 1 - FALSE_RATE, 10000).alias("p")).first()["p"]
        self.threshold = max(0.5, share or 0.0)

    def scored(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """rows (keys, grams) -> keys, family, probability of the most probable licence family."""
        hits = rows.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(self.weights), "gram")
        sums = hits.groupBy(*keys).agg(*[F.sum(F.col("w")[c]).alias(f"c{c}") for c in range(len(CLASSES))])
        logits = [F.col(f"c{c}") + F.lit(self.bias[c]) for c in range(len(CLASSES))]
        top = F.greatest(*logits)
        total = sum((F.exp(x - top) for x in logits[1:]), F.exp(logits[0] - top))
        best = F.array_max(F.array(*[F.struct(x.alias("logit"), F.lit(-c).alias("rank")) for c, x in enumerate(logits[:-1])]))
        names = F.array(*[F.lit(f) for f in FAMILIES])
        return sums.select(*keys, F.element_at(names, 1 - best["rank"]).alias("family"),
                           (F.exp(best["logit"] - top) / total).alias("probability"))

    def gains(self) -> tuple[DataFrame, Column]:
        """What an n-gram can add at most to a family's lead over ``unknown``, and whether a sum of gains suffices."""
        last = len(CLASSES) - 1
        gain = F.greatest(*[F.col("w")[c] - F.col("w")[last] for c in range(last)])
        start = max(b for b in self.bias[:-1]) - self.bias[-1]
        needed = math.log(self.threshold / (1 - self.threshold)) if self.threshold < 1 else math.inf
        return self.weights.select("gram", gain.alias("gain")).filter("gain > 0"), F.col("gain") + F.lit(start) >= F.lit(needed)

    def worth_a_look(self, docs: DataFrame) -> DataFrame:
        """Ids of documents with a paragraph whose words, one by one, can reach the threshold.

        Each word counts with its own gain and that of the two-gram with the next word, however often it
        stands: a bound from above, for which no gram of the text is made or made distinct.
        """
        for_family, enough = self.gains()
        own = for_family.filter(~F.col("gram").contains(" ")).select(F.col("gram").alias("word"), F.col("gain").alias("own"))
        two = for_family.filter(F.col("gram").contains(" ")).select(
            F.split_part("gram", F.lit(" "), F.lit(1)).alias("word"), F.split_part("gram", F.lit(" "), F.lit(2)).alias("next"),
            F.col("gain").alias("two"))
        known = sorted({r["gram"].split(" ")[0] for r in for_family.select("gram").collect()})  # at most VOCABULARY words
        # Other words go before anything is made of them, and the next word is looked up for those that stay.
        found = (lines(docs).select("doc_id", "row", "line", "all", F.posexplode("all").alias("p", "word"))
                            .filter(F.col("word").isin(known))
                            .select("doc_id", "row", "line", "p", "word", F.get("all", F.col("p") + 1).alias("next"))
                            .join(F.broadcast(own), "word", "left").join(F.broadcast(two), ["word", "next"], "left")
                            .filter("own is not null or two is not null"))
        gain = F.coalesce("own", F.lit(0.0)) + F.coalesce("two", F.lit(0.0))
        half = F.col("p") - F.col("p") % HALF
        return (found.groupBy("doc_id", "row", "line", half.alias("at")).agg(F.sum(gain).alias("gain"))
                     .select("doc_id", "row", "line", "gain", F.explode(F.array(F.col("at"), F.col("at") - HALF)).alias("at"))
                     .groupBy("doc_id", "row", "line", "at").agg(F.sum("gain").alias("gain"))
                     .filter(enough).select("doc_id").distinct())

    def candidates(self, docs: DataFrame) -> DataFrame:
        """Ids of documents with a paragraph whose score bound reaches the threshold."""
        for_family, enough = self.gains()
        n = F.size("all")
        # Every paragraph is two halves; a half has the two-gram that leads out of it, too.
        halves = (lines(docs).select("doc_id", "row", "line", "all", F.explode(F.sequence(F.lit(0), n - 1, F.lit(HALF))).alias("at"))
                             .select("doc_id", "row", "line", "at",
                                     F.explode(grams(F.slice("all", F.col("at") + 1, HALF + 1))).alias("gram")))
        return (halves.join(F.broadcast(for_family), "gram")
                      .select("doc_id", "row", "line", "gain", F.explode(F.array(F.col("at"), F.col("at") - HALF)).alias("at"))
                      .groupBy("doc_id", "row", "line", "at").agg(F.sum("gain").alias("gain"))
                      .filter(enough).select("doc_id").distinct())


def _pairs(text: str) -> list[tuple[str, str]]:
    found = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return list(zip(found, found[1:], strict=False))


def scan(docs: DataFrame) -> DataFrame:
    """One row per licence paragraph: doc_id, line, piece, family, probability, overlap, paragraph (its words)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    model = Model(spark, docs)
    chosen = docs
    for bound in (model.worth_a_look, model.candidates):
        maybe = materialise(bound(chosen).select(F.col("doc_id").alias("_id")), "licence-candidates")
        chosen = docs.join(maybe, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    keys = ["doc_id", "row", "line", "at", "piece", "words"]
    pieces = materialise(paragraphs(chosen, across=True), "licence-paragraphs")
    found = model.scored(pieces.withColumn("grams", grams(F.col("words"))), keys).filter(
        F.col("probability") >= model.threshold)
    templates = notices(spark).select("family", F.col("words").alias("notice_words"))
    body, notice = F.col("words"), F.col("notice_words")
    whole = shared(body, notice)
    evidence = F.struct(overlap(body, notice).alias("overlap"),
                        (whole > shared(F.slice(body, 1, HALF), notice)).alias("after"),
                        (whole > shared(F.slice(body, HALF + 1, PIECE), notice)).alias("before"))
    hits = (found.join(F.broadcast(templates), "family")
                 .groupBy(*keys, "family", "probability").agg(F.max(evidence).alias("e"))
                 .select(*keys, "family", "probability", "e.*")
                 .filter(F.col("overlap") >= OVERLAP))
    return one_each(hits).select("doc_id", "line", "piece", "family", "probability", "overlap",
                                 F.concat_ws(" ", "words").alias("paragraph"))


def one_each(hits: DataFrame) -> DataFrame:
    """Of pieces that share words, those that have a notice of their own.  ``before`` and ``after`` tell
    in which halves of a piece its evidence lies."""
    across = F.col("at") % PIECE != 0
    hits = hits.filter(~across | (F.col("before") & F.col("after")))
    line = W.partitionBy("row", "line").orderBy("at")
    best = F.max(F.when(across, F.col("overlap")))
    hits = (hits.withColumn("_next", best.over(line.rangeBetween(HALF, HALF)))
                .withColumn("_last", best.over(line.rangeBetween(-HALF, -HALF)))
                .filter(across | ~(F.coalesce(~F.col("before") & (F.col("_next") > F.col("overlap")), F.lit(False))
                                   | F.coalesce(~F.col("after") & (F.col("_last") > F.col("overlap")), F.lit(False)))))
    beside = W.partitionBy("row", "line", "family").orderBy("at").rangeBetween(-HALF, HALF)
    return hits.withColumn("_whole", F.max(~across).over(beside)).filter(~across | ~F.col("_whole"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))
