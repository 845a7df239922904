"""Operator 10, document fingerprints: one-permutation MinHash.

A text's five-word shingles are hashed once.  The top bits of a hash name its bin and each
bin keeps its smallest hash.  An empty bin borrows from the first non-empty bin in its own
fixed random order of all bins (optimal densification: every empty bin draws independently).
Each bin stores ``BITS`` low-order bits of its hash mixed with the bin number.  Two
fingerprints agree by chance in ``1 / 2**BITS`` of the bins, which the estimate corrects.

``near_chain`` fingerprints each text, an edited text (the last half of its code points
replaced by the first as many of the next document in descending id order) and compares.
The order is kept without a global sort: texts are dealt by id ranges (cut near the quantiles
of the ids, at most ``MAX_RANGES``, so the broadcast bounds stay under 1 MB) in one shuffle,
and the first text of each range is also sent to the range that precedes it.

Defined results: null text is empty; a text without words has the fingerprint ``empty``,
likeness 1 to another such text and 0 to any other; fewer than five words are one shingle;
equal ids are ordered by text; null ids come last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import key_id, mix64, restored, shingle_hashes, table

BINS = 512
BITS = 4
WIDTH = 5
ROWS_PER_RANGE = 128
MAX_RANGES = 65536
EMPTY = "empty"

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


class OnePermutation:
    """Fingerprints of ``bins`` bins with ``bits`` bits each (bins a power of two)."""

    def __init__(self, bins: int = BINS, bits: int = BITS, width: int = WIDTH):
        self.bins, self.bits, self.width = bins, bits, width
        self.shift = np.uint64(64 - int(math.log2(bins)))
        numbers = np.arange(bins * bins, dtype=np.uint64) + np.uint64(0x51ED2701)
        self.order = mix64(numbers * np.uint64(0x9E3779B97F4A7C15)).reshape(bins, bins)
        self.salt = mix64((np.arange(bins, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))

    def codes(self, text: str | None) -> np.ndarray | None:
        """The stored low-order bits of every bin; None for a text without words."""
        words = (text or "").split()
        if not words:
            return None
        tokens = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        h = np.sort(shingle_hashes(tokens, self.width))
        which = (h >> self.shift).astype(np.int64)
        full, first = np.unique(which, return_index=True)
        least = np.zeros(self.bins, np.uint64)
        least[full] = h[first]
        if len(full) < self.bins:
            empty = np.setdiff1d(np.arange(self.bins), full, assume_unique=True)
            least[empty] = least[full[self.order[np.ix_(empty, full)].argmin(1)]]
        return (mix64(least ^ self.salt) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def pack(self, codes: np.ndarray | None) -> str:
        if codes is None:
            return EMPTY
        bits = np.unpackbits(codes[:, None], axis=1)[:, 8 - self.bits:]
        return np.packbits(bits.ravel()).tobytes().hex()

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """Estimated Jaccard similarity, corrected for chance agreement."""
        if a is None or b is None:
            return float(a is None and b is None)
        chance = 1.0 / (1 << self.bits)
        return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def edit(text: str, following: str) -> str:
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


def _chain(batches):
    """Rows of an id range in order; each row is compared with the one after it."""
    op = OnePermutation()
    held = None
    for pdf in batches:
        out = []
        for range_id, guest, doc_id, text in zip(pdf["_range"], pdf["_guest"], pdf["doc_id"], pdf["text"], strict=True):
            text = "" if text is None else text
            codes = None if guest and held is None else op.codes(text)
            if held is not None and held[0] == range_id:
                _, held_id, held_text, held_codes = held
                edited = edit(held_text, text)
                edited_codes = op.codes(edited)
                out.append((held_id, len(held_text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(),
                            op.pack(held_codes), op.pack(edited_codes),
                            op.likeness(held_codes, edited_codes), op.likeness(held_codes, codes)))
            held = None if guest else (range_id, int(doc_id), text, codes)
        yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                         "near_edited", "near_next"]).astype({"doc_id": "int64"})


def near_chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = docs.select(key_id(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    n = docs.count()
    ranges = min(MAX_RANGES, max(1, math.ceil(n / ROWS_PER_RANGE)))
    if not n:
        return spark.createDataFrame([], SCHEMA)
    cuts = docs.agg(F.percentile_approx("doc_id", [(i + 1) / ranges for i in range(ranges)], 20 * ranges)).first()[0]
    near = spark.sparkContext.broadcast(np.unique(np.array(cuts, np.int64)))

    @F.pandas_udf("int")
    def about(ids: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(near.value, ids.to_numpy(), "left"), len(near.value) - 1))

    # quantiles are doubles inside; a range's exact top is the largest id that falls into it
    found = docs.groupBy(about("doc_id").alias("at")).agg(F.max("doc_id").alias("top")).toPandas()
    tops = spark.sparkContext.broadcast(np.sort(found["top"].to_numpy(np.int64)))

    @F.pandas_udf("array<int>")
    def dealt_to(ids: pd.Series) -> pd.Series:
        # range k holds the ids in (tops[k-1], tops[k]]; its first id, tops[k], also closes range k + 1
        own = np.searchsorted(tops.value, ids.to_numpy(), "left")
        opens = tops.value[own] == ids.to_numpy()
        last = len(tops.value) - 1
        return pd.Series([[k, 0 if k == last else k + 1] if o else [k]
                          for k, o in zip(own.tolist(), opens.tolist(), strict=True)])

    dealt = (docs.withColumn("_at", dealt_to("doc_id"))
                 .select("doc_id", "text", F.posexplode("_at").alias("_guest", "_range"))
                 .repartition("_range")
                 .sortWithinPartitions("_range", "_guest", F.col("doc_id").desc(), F.col("text").asc()))
    return restored(dealt.select("_range", "_guest", "doc_id", "text").mapInPandas(_chain, SCHEMA), "doc_id")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_chain(table(spark, sf_dir, "documents", "doc_id", "text"))
