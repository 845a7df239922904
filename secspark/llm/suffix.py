"""Operator 4, suffix-array dedup: a logarithmic family of sampled suffix arrays.

The rule: a byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else.  Whether a window of ``LENGTH`` bytes is repeated is decided as follows.

*Sampling.*  Each window picks one of its ``GRAM``-byte grams by a hash (the least, leftmost on
ties).  Equal windows pick the same place, so only suffixes that start at picked places are
indexed, one in about 77 bytes.  The windows that pick one place start in a row, ``first`` to
``last``; the text from ``first`` to ``last + LENGTH`` is the suffix's block.

*Suffix arrays.*  A batch of documents becomes an array of (name, block, n): ``name`` is the
fingerprint of the suffix's first bytes, ``block`` that of its block, n how often the two
occur.  Arrays are sorted by name, then block; as in prefix doubling, names stand for the
strings, so equal prefixes are neighbours although the order is not alphabetic.  Counting with
map-side combine keeps one row of a string that fills many documents.

*Family of levels.*  A new batch is merge-scanned against every level (a sort-merge join of
tables bucketed by name, without a shuffle) for names that occur more than once.  Then it
becomes a level; two levels of equal size merge into one of twice the size, and so on, so a
family of n batches has at most log2(n) + 1 levels.

*Matches.*  A block that occurs twice is repeated in whole.  Where a repeated name stands in
different blocks, one context per block is fetched, and all windows of a name's contexts are
compared at the same distance from the name: in one group, if the name has at most ``HOT``
contexts.  The windows of a more crowded name become rows that are counted (with map-side
combine) and joined back, so its work is spread over the windows and grows in proportion.  Fingerprints of blocks and windows have 64 bits for the array and 128
bits for windows; names only gather candidates.

Defined results: null text is empty; texts under ``LENGTH`` bytes keep all bytes; repeated
rows are copies of each other and lose everything that is long enough; the id together with
the text names a row, so null and repeated ids are safe; an empty table gives no rows.  In the
pipeline, letters that a cut leaves incomplete go with it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import key_id, materialise, mix64, restored, scratch, table

LENGTH = 200
GRAM = 48
SEGMENT = 1 << 18
BATCHES = 3
HOT = 4096
SALTS = 32
PLACES = "doc_id long, th long, name long, block long, place long, before int, after int"
BYTE_CODES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes, by doubling."""
    n = len(codes) - gram + 1
    total, done, power, width, factor = None, 0, codes, 1, 0x9E3779B97F4A7C15
    while width <= gram:
        if gram & width:
            part = power[done:done + n]
            total = part.copy() if total is None else total * np.uint64(factor) + part
            done += width
        width *= 2
        if width <= gram:
            power = power[:-(width // 2)] * np.uint64(factor) + power[width // 2:]
            factor = factor * factor & 0xFFFFFFFFFFFFFFFF
    return mix64(total)


def picked(data: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Rows (place, first window, last window) for each place that some window picks.  ``data``
    holds texts back to back, ``ends`` where each ends; windows stay inside their text."""
    windows = len(data) - length + 1
    found = [np.empty((3, 0), np.int64)]
    span = length - gram + 1
    low = np.uint64((1 << 20) - 1)
    codes = np.frombuffer(data, np.uint8)
    for start in range(0, windows, SEGMENT):
        count = min(SEGMENT, windows - start)
        h = gram_hashes(BYTE_CODES[codes[start:start + count + length - 1]], gram)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # hash, then place: leftmost on ties
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = span - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        place = (least & low).astype(np.int64) + start
        # Windows that would cross the end of their text pick nothing.
        border = ends[(ends > start) & (ends < start + count + length - 1)] - start
        crossing = np.zeros(count + 1, np.int64)
        np.add.at(crossing, np.maximum(border - length + 1, 0), 1)
        np.add.at(crossing, np.minimum(border, count), -1)
        place[np.cumsum(crossing)[:-1] > 0] = -1
        heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        rows = np.stack([place[heads], heads + start, np.r_[heads[1:] - 1, count - 1] + start])
        found.append(rows[:, rows[0] >= 0])
    out = np.concatenate(found, 1)
    same = np.flatnonzero(out[0, 1:] == out[0, :-1])  # a run that a segment border cut
    for k in same[::-1]:
        out[2, k] = out[2, k + 1]
    return np.delete(out, same + 1, 1)


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def places(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The sampled suffixes of every text."""
    def rows(group: list[tuple[int, int, bytes]]) -> pd.DataFrame:
        digest = xxhash.xxh3_64_intdigest
        data = b"".join([d for _, _, d in group])
        ends = np.cumsum([len(d) for _, _, d in group])
        place, first, last = picked(data, ends, length, gram)
        owner = np.searchsorted(ends, place, "right")
        names = [digest(data[p:p + gram]) for p in place.tolist()]
        blocks = [digest(data[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
        begin = np.r_[0, ends[:-1]]
        return pd.DataFrame({
            "doc_id": np.array([i for i, _, _ in group], np.int64)[owner],
            "th": np.array([t for _, t, _ in group], np.int64)[owner],
            "name": np.array(names, np.uint64).view(np.int64), "block": np.array(blocks, np.uint64).view(np.int64),
            "place": place - begin[owner], "before": (place - first).astype(np.int32),
            "after": (last - place).astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            group, size = [], 0
            for doc_id, th, text in zip(pdf["doc_id"].tolist(), pdf["th"].tolist(), pdf["text"], strict=True):
                data = text_bytes(text)
                if len(data) < length:
                    continue
                group.append((doc_id, th, data))
                size += len(data)
                if size >= SEGMENT:
                    yield rows(group)
                    group, size = [], 0
            if group:
                yield rows(group)

    return docs.select("doc_id", "th", "text").mapInPandas(run, PLACES)


class Family:
    """Levels of bucketed suffix arrays; sizes are counted in batches."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = scratch(spark, "suffix-levels")
        self.levels: list[tuple[int, str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        (rows.write.option("path", f"{self.path}/{name}").bucketBy(self.buckets, "name").sortBy("name", "block")
             .saveAsTable(name))
        return name

    def _forget(self, name: str) -> None:
        """Drop a level that was merged or is done with, and its files."""
        self.spark.sql(f"DROP TABLE {name}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def array(self, docs: DataFrame) -> str:
        """The suffix array of a batch: sampled suffixes by name and block, with counts."""
        counted = (places(docs).groupBy("name", "block").agg(F.count(F.lit(1)).alias("n")))
        return self._write(counted.repartition(self.buckets, "name"))

    def scan(self, new: str) -> DataFrame:
        """Merge-scan of a batch's array against all levels: names that occur more than once."""
        batch = self.spark.table(new)
        own = batch.groupBy("name").agg(F.sum("n").alias("n")).filter("n > 1").select("name")
        found = [own] + [batch.join(self.spark.table(level).select("name"), "name", "left_semi").select("name").distinct()
                         for _, level in self.levels]
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out

    def insert(self, new: str) -> None:
        """Add a batch's array as a level, merging levels of equal size first."""
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, old = self.levels.pop()
            a, b = self.spark.table(old).alias("a"), self.spark.table(new).alias("b")
            both = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.block") == F.col("b.block")), "full_outer")
            merged = self._write(both.select(
                F.coalesce("a.name", "b.name").alias("name"), F.coalesce("a.block", "b.block").alias("block"),
                (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"))
                .repartition(self.buckets, "name"))
            for gone in (old, new):
                self._forget(gone)
            new, size = merged, 2 * size
        self.levels.append((size, new))

    def blocks(self, names: DataFrame) -> DataFrame:
        """All blocks of the given names over all levels: name, block, n, and is the name in several blocks."""
        rows = None
        for _, level in self.levels:
            hit = self.spark.table(level).join(names, "name", "left_semi")
            rows = hit if rows is None else rows.union(hit)
        blocks = rows.groupBy("name", "block").agg(F.sum("n").alias("n"))
        spread = blocks.groupBy("name").agg((F.count(F.lit(1)) > 1).alias("mixed"))
        return blocks.join(spread, "name")

    def drop(self) -> None:
        for _, level in self.levels:
            self._forget(level)
        self.levels = []


def keyed(docs: DataFrame) -> DataFrame:
    """Rows named by id and a 64-bit hash of the text and its length."""
    return docs.select(key_id().alias("doc_id"), text_hash().alias("th"), "text")


def text_hash() -> Column:
    return F.xxhash64("text", F.length("text"))


def build(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Put all documents into a family, batch by batch; returns the blocks of repeated names."""
    family = Family(docs.sparkSession)
    batch_of = F.pmod(F.xxhash64("doc_id", "th"), F.lit(batches))
    names = None
    for k in range(batches):
        new = family.array(docs.filter(batch_of == k))
        found = materialise(family.scan(new), "repeated")
        names = found if names is None else names.union(found)
        family.insert(new)
    blocks = materialise(family.blocks(names.distinct()), "blocks")
    family.drop()
    return blocks


def _contexts(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, th, text, wanted in zip(pdf["doc_id"], pdf["th"], pdf["text"], pdf["wanted"], strict=True):
                data = text_bytes(text)
                for w in wanted:
                    first = w["place"] - w["before"]
                    rows.append((doc_id, th, w["name"], w["place"], w["before"], w["n"] == 1,
                                 data[first:w["place"] + w["after"] + length]))
            yield pd.DataFrame(rows, columns=["doc_id", "th", "name", "place", "before", "single", "data"])
    return run


def compare(contexts: list[tuple[int, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context (bytes of the windows, distance of its first window from the name): the
    runs of windows that stand at the same distance in another context."""
    digest = xxhash.xxh3_128_digest
    seen: dict[tuple[int, bytes], list[int]] = defaultdict(list)
    for i, (before, data) in enumerate(contexts):
        for t in range(len(data) - length + 1):
            seen[before - t, digest(data[t:t + length])].append(i)
    hits: list[list[int]] = [[] for _ in contexts]
    for (distance, _), members in seen.items():
        if len(members) > 1:
            for i in members:
                hits[i].append(contexts[i][0] - distance)
    out = []
    for h in hits:
        t = np.sort(np.array(h, np.int64))
        cut = np.flatnonzero(np.diff(t) > 1)
        out.append(list(zip(t[np.r_[0, cut + 1]].tolist(), t[np.r_[cut, len(t) - 1]].tolist(), strict=True)) if len(t) else [])
    return out


SPAN = "doc_id long, th long, start long, stop long"


def _resolve(length: int):
    """Rows sorted by name -> spans of the repeated windows of blocks that occur once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        key = None
        spans: list[tuple] = []

        def settle():
            if len(group) > 1:
                for (doc_id, th, place, before, single, _), runs in zip(
                        group, compare([(g[3], g[5]) for g in group], length), strict=True):
                    if single:
                        spans.extend((doc_id, th, place - before + a, place - before + b + length) for a, b in runs)
            group.clear()

        for pdf in batches:
            for name, *row in zip(pdf["name"], pdf["doc_id"], pdf["th"], pdf["place"], pdf["before"], pdf["single"],
                                  pdf["data"], strict=True):
                if name != key:
                    settle()
                    key = name
                group.append(tuple(row))
            yield pd.DataFrame(spans, columns=["doc_id", "th", "start", "stop"]).astype({"doc_id": "int64"})
            spans.clear()
        settle()
        yield pd.DataFrame(spans, columns=["doc_id", "th", "start", "stop"]).astype({"doc_id": "int64"})
    return run


def _windows(length: int):
    """Every window of a context as a row: its distance from the name and two halves of its fingerprint."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for pdf in batches:
            for name, doc_id, th, place, before, single, data in zip(
                    *(pdf[c] for c in ("name", "doc_id", "th", "place", "before", "single", "data")), strict=True):
                n = len(data) - length + 1
                marks = np.frombuffer(b"".join([digest(data[t:t + length]) for t in range(n)]), np.int64).reshape(n, 2)
                yield pd.DataFrame({"name": name, "distance": before - np.arange(n), "high": marks[:, 0], "low": marks[:, 1],
                                    "doc_id": doc_id, "th": th, "start": place - before + np.arange(n), "single": single})
    return run


def same_row(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def repeated_spans(docs: DataFrame, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """keyed documents -> doc_id, th, spans (start, stop): all spans of repeated windows of a row."""
    blocks = build(docs, batches)
    hits = materialise(places(docs).join(blocks, ["name", "block"]), "suffix-hits")
    whole = hits.filter("n > 1").select("doc_id", "th", (F.col("place") - F.col("before")).alias("start"),
                                        (F.col("place") + F.col("after") + LENGTH).alias("stop"))
    # One place of each block of the names that stand in several blocks (equal rows have equal contexts).
    one = F.struct("doc_id", "th", "place", "before", "after")
    places_of = hits.filter("mixed").groupBy("name", "block").agg(F.min(one).alias("at"), F.min("n").alias("n"))
    crowded = (places_of.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot)
                        # at most one name in ``hot`` places: repeating it per salt is cheap
                        .select("name", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = places_of.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    texts = docs.select("doc_id", "th", "text").alias("t")

    def contexts(kind: str) -> DataFrame:
        """Bytes around the places of names that are crowded (``left_semi``) or not (``left_anti``)."""
        wanted = (salted.join(crowded, ["name", "salt"], kind).groupBy("at.doc_id", "at.th")
                        .agg(F.collect_list(F.struct("name", "n", "at.place", "at.before", "at.after")).alias("wanted")))
        return (wanted.alias("w").join(texts, same_row("w", "t")).select("w.doc_id", "w.th", "t.text", "w.wanted")
                      .mapInPandas(_contexts(LENGTH), "doc_id long, th long, name long, place long, before int, "
                                                      "single boolean, data binary"))

    few = (contexts("left_anti").repartition("name").sortWithinPartitions("name", "doc_id", "th", "place")
                                .mapInPandas(_resolve(LENGTH), SPAN))
    window = ["name", "distance", "high", "low"]
    many = contexts("left_semi").mapInPandas(
        _windows(LENGTH), "name long, distance int, high long, low long, doc_id long, th long, start long, single boolean")
    repeated = many.groupBy(*window).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    resolved = few.union(many.filter("single").join(repeated, window, "left_semi").select(
        "doc_id", "th", "start", (F.col("start") + LENGTH).alias("stop")))
    return whole.union(resolved).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def joined_runs(spans) -> list[tuple[int, int]]:
    """Overlapping or touching spans as maximal runs."""
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(r) for r in out]


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, stop in runs:
        kept.append(data[at:start])
        at = stop
    return b"".join([*kept, data[at:]])


def removal_digest(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = keyed(docs)
    spans = repeated_spans(rows, batches)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, found in zip(pdf["text"], pdf["spans"], strict=True):
                data = text_bytes(text)
                runs = joined_runs(found) if found is not None else []
                kept = cut(data, runs)
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            part = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield part.assign(doc_id=pdf["doc_id"])[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]]

    found = rows.alias("t").join(spans.alias("s"), same_row("t", "s"), "left").select("t.doc_id", "t.text", "s.spans")
    return restored(found.mapInPandas(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "doc_id")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages leave the texts; all rows and columns are kept."""
    spans = repeated_spans(keyed(docs))

    @F.pandas_udf("string")
    def kept(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut(text_bytes(t), joined_runs(s)).decode("utf-8", "ignore")
                          for t, s in zip(texts, found, strict=True)])

    columns = docs.columns
    rows = docs.withColumns({"__th": text_hash(), "__id": key_id()}).alias("t")
    same = (F.col("t.__id") == F.col("s.doc_id")) & (F.col("t.__th") == F.col("s.th"))
    out = rows.join(spans.alias("s"), same, "left").withColumn("__text", F.when(
        F.col("s.spans").isNull(), F.col("t.text")).otherwise(kept(F.col("t.text"), F.col("s.spans"))))
    return out.select(*[F.col("__text").alias("text") if c == "text" else F.col(f"t.`{c}`") for c in columns])
