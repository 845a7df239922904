"""Operator 1, language identification: hierarchical discrimination.

Texts become byte n-grams (orders 2 to 4 of the lower-cased text, ASCII marks and digits as
blanks), hashed into ``2**BITS`` places per order, with relative frequencies as values.  Linear
support vector machines, one against the rest, choose the language family.  Inside the chosen
family, one machine for each pair of languages votes (ties: the larger sum of margins, then
the name).  All machines are fitted by dual coordinate descent on about ``PER_LANGUAGE`` texts
of each language, chosen by a hash of the id.  Since a score is a mean of weights over the
text's n-grams, prediction is one table look-up per n-gram for all machines at once.

``FAMILIES`` is a parameter; a language that it lacks is a family of its own.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing was
learnt; rows with null lang are not learnt from; a single learnt language is always predicted,
with score 1; an empty table gives no rows; repeated rows are predicted alike.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import crc_mod, key_id, restored, table
from secspark.llm.linear import dual_coordinate_descent, logistic, sampled, with_texts

PER_LANGUAGE = 800
BITS = 16
ORDERS = (2, 3, 4)
SCALE = 30.0
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "cs", "sk", "pl", "mk"),
    "baltic": ("lt", "lv"), "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"), "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "am", "mt"), "sinitic": ("zh", "yue"),
}
BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def family_of(lang: str, families: dict[str, tuple[str, ...]]) -> str:
    return next((f for f, members in families.items() if lang in members), f"only {lang}")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngrams(text: str) -> list[np.ndarray]:
    """Place numbers of the text's n-grams, one array per order."""
    data = b" " + text.lower().encode("utf-8", "replace").translate(BLANKS) + b"  "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, code = [], b[:-1] * np.uint32(256) + b[1:]
    for k, n in enumerate(ORDERS):
        if n > 2:
            code = code[:-1] * np.uint32(257) + b[n - 1:] + np.uint32(n)
        out.append((code * np.uint32(2654435761) >> np.uint32(32 - BITS)) + np.uint32(k << BITS))
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(g, return_counts=True) for g in ngrams(text)]
    return (np.concatenate([i for i, _ in found]).astype(np.int32),
            np.concatenate([c * (SCALE / c.sum()) for _, c in found]).astype(np.float32))


class Hierarchy:
    """Family machines, then pair machines inside a family."""

    def __init__(self, texts: list[tuple[str, np.ndarray, np.ndarray]], families: dict[str, tuple[str, ...]]):
        dim = len(ORDERS) << BITS
        self.langs = sorted({lang for lang, _, _ in texts})
        of = {lang: family_of(lang, families) for lang in self.langs}
        self.members: dict[str, list[str]] = {}
        for lang in self.langs:
            self.members.setdefault(of[lang], []).append(lang)
        self.families = sorted(self.members)

        def machine(rows, positive):
            y = np.array([1.0 if positive(lang) else -1.0 for lang, _, _ in rows])
            return dual_coordinate_descent([(i, v) for _, i, v in rows], y, dim)

        columns = []
        if len(self.families) > 1:
            columns += [machine(texts, lambda lang, f=f: of[lang] == f) for f in self.families]
        self.pairs = [p for f in self.families for p in combinations(self.members[f], 2)]
        for a, b in self.pairs:
            columns.append(machine([t for t in texts if t[0] in (a, b)], lambda lang, a=a: lang == a))
        w = np.stack(columns, 1) if columns else np.zeros((dim + 1, 0))
        self.weights, self.bias = np.ascontiguousarray(w[:-1], np.float32), w[-1]

    def margins(self, text: str) -> np.ndarray:
        return sum(SCALE * self.weights[g].mean(0, dtype=np.float64) for g in ngrams(text)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        m = self.margins(text) if self.weights.shape[1] else np.empty(0)
        family, score, offset = self.families[0], 1.0, 0
        if len(self.families) > 1:
            offset = len(self.families)
            best, second = np.sort(m[:offset])[::-1][:2]
            family, score = self.families[int(m[:offset].argmax())], float(logistic(best - second))
        votes = dict.fromkeys(self.members[family], (0, 0.0))
        for (a, b), margin in zip(self.pairs, m[offset:], strict=True):
            if a in votes:
                winner, by = (a, margin) if margin >= 0 else (b, -margin)
                votes[winner] = (votes[winner][0] + 1, votes[winner][1] + by)
        lang = max(sorted(votes), key=lambda x: votes[x])
        mine = [abs(x) for p, x in zip(self.pairs, m[offset:], strict=True) if lang in p]
        return lang, score * float(logistic(2 * min(mine))) if mine else score


def learnable() -> Column:
    return crc_mod("doc_id", 4) != 2


def fit(docs: DataFrame, families: dict[str, tuple[str, ...]] = FAMILIES, per_language: int = PER_LANGUAGE) -> Hierarchy:
    """Learn from rows with text and lang outside the held-out quarter."""
    known = docs.filter(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def vectors(batches):
        for pdf in batches:
            rows = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"],
                                "i": [i.tobytes() for i, _ in rows], "v": [v.tobytes() for _, v in rows]})

    sample = with_texts(sampled(known.select("doc_id", "lang"), "doc_id", "lang", per_language).distinct(), known)
    data = sample.mapInPandas(vectors, "doc_id long, lang string, i binary, v binary").toPandas()
    data = data.sort_values(["doc_id", "lang"])
    return Hierarchy([(lang, np.frombuffer(i, np.int32), np.frombuffer(v, np.float32))
                      for lang, i, v in zip(data["lang"], data["i"], data["v"], strict=True)], families)


def identify(docs: DataFrame, model: Hierarchy) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays: workers need no package

    def run(batches):
        model = Hierarchy.__new__(Hierarchy)
        vars(model).update(held.value)
        for pdf in batches:
            found = [model.predict(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"],
                                "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    rows = docs.select(key_id().alias("doc_id"), F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "text")
    return restored(rows.mapInPandas(run, SCHEMA), "doc_id")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, fit(docs))
