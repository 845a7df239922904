import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])
# Columns whose names the operators use themselves.
CLASHING = ["score", "predicted", "slot", "shard", "fp", "name", "block", "spans", "th", "_n", "row", "line", "anchor", "cell"]


def sentence(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="session")
def vocab():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def rows(vocab):
    """Documents with every odd case: nulls, empty and long texts, copies, repeated rows."""
    rng = random.Random(11)
    passage = sentence(rng, 60, vocab)
    out = []
    for i in range(40):
        text = sentence(rng, rng.randint(1, 120), vocab).capitalize() + "."
        out.append((i, text, rng.choice(["en", "de", "fr", "es"]), "s0", len(text)))
    out += [(50 + i, f"{sentence(rng, 20, vocab)}\n{passage}\n{sentence(rng, 20, vocab)}", "en", "s1", 1) for i in range(4)]
    out += [(60, out[3][1], "en", "s0", 1), (61, out[3][1], "en", "s0", 1), out[5], out[5]]
    out += [(70, None, None, None, None), (71, "", "en", None, 0), (72, " \t\n", "en", "s", 3), (73, "x", "fr", "s", 1),
            (None, "no id " + passage, "de", None, 1), (None, "no id " + passage, "de", None, 1), (None, None, None, None, None),
            (74, "long " + sentence(rng, 20000, vocab), "en", "s", 1), (75, "aaaa" * 300, "en", "s", 1),
            (76, "é" * 500 + " <|endoftext|> İ 日本語 ½ ñ́", "es", "s", 1), (77, "12345 !!! ---", "en", "s", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DOC).repartition(3)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
