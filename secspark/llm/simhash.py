"""Operator 9, SimHash near-dedup: anchor-point covering.

A text's fingerprint has a bit set if over half of its four-word shingles' hashes have it
set.  The 64 bits are cut into three blocks.  Two fingerprints within 4 bits of each other
are within 1 bit in some block, so each block is covered with threshold 1.

The anchors of a block are a covering code: Hamming codewords on its first 15 bits (a perfect
code, covering radius 1), joined with every value of its remaining bits.  Every fingerprint
has one home anchor per block, at most 1 bit away, and is copied to each anchor that can be
the home of a fingerprint within the threshold (at most radius + threshold = 2 bits away).
Per anchor, the residents are compared with all copies on the full 64 bits.

Copies of one text share a fingerprint, and only distinct fingerprints are compared.  An
anchor reports its links as a spanning forest: as many links as it joins, not all pairs.  An
anchor with more than ``HOT`` fingerprints is cut into a grid of (part of residents, part of
copies) cells, each its own group, so no link is lost and no group exceeds about ``2 * HOT``.

Defined results: null text has no words; a text without words has fingerprint zero, linked
like any other; repeated rows share a component; a null id never names a component unless no
member has an id; an empty table gives no rows; other columns are ignored.  In the pipeline a
document is its id together with its text, and one row of the component's first stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from secspark.llm.common import NO_ID, key_id, materialise, table
from secspark.llm.components import components

WIDTH = 4
DISTANCE = 4
SEED = 42
BLOCKS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15
HOT = 8192
PAIRS = 1 << 21


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WIDTH, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
    h = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for part in range(0, len(h), 1 << 15):
        chunk = h[part:part + (1 << 15)]
        ones += np.unpackbits(chunk.view(np.uint8).reshape(len(chunk), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


class HammingCover:
    """For each 15-bit value: its nearest codeword, and all codewords within 2 bits."""

    def __init__(self):
        n = 1 << CODE_BITS
        values = np.arange(n, dtype=np.int64)
        syndrome = np.zeros(n, np.int64)
        for i in range(CODE_BITS):
            syndrome ^= np.where(values >> i & 1, i + 1, 0)
        self.home = np.where(syndrome, values ^ (1 << np.maximum(syndrome - 1, 0)), values)
        # Within 2 bits of a value off the code: the pairs of flips whose sum is its syndrome.
        self.near = np.full((n, 1 + CODE_BITS // 2), -1, np.int64)
        self.near[:, 0] = self.home
        filled = np.ones(n, np.int64)
        for i in range(CODE_BITS):
            for j in range(i + 1, CODE_BITS):
                hit = np.flatnonzero(syndrome == ((i + 1) ^ (j + 1)))
                self.near[hit, filled[hit]] = hit ^ (1 << i) ^ (1 << j)
                filled[hit] += 1


def anchors(fps: np.ndarray, cover: HammingCover) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the fingerprint, anchor, is it the home anchor) for every copy of each fingerprint."""
    rows, keys, homes = [], [], []
    every = np.arange(len(fps))
    for b, (start, width) in enumerate(BLOCKS):
        value = (fps.view(np.uint64) >> np.uint64(start)).astype(np.int64) & ((1 << width) - 1)
        head, rest = value & ((1 << CODE_BITS) - 1), value >> CODE_BITS
        base = (b << 32) | (rest << CODE_BITS)
        for k in range(cover.near.shape[1]):
            here = cover.near[head, k]
            ok = here >= 0
            rows.append(every[ok])
            keys.append((base | here)[ok])
            homes.append(np.full(int(ok.sum()), k == 0))
        for j in range(width - CODE_BITS):
            rows.append(every)
            keys.append((base ^ (1 << (CODE_BITS + j))) | cover.home[head])
            homes.append(np.zeros(len(fps), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (member, least member) of each component of the pairs (a, b)."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[:len(a)], index[len(a):]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    hang = root != np.arange(len(nodes))
    return nodes[hang], nodes[root[hang]]


def cell_links(cell: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of complete, sorted cells: residents against all copies, at most ``PAIRS`` pairs at a time."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    group = np.repeat(np.arange(len(starts)), sizes)
    left = np.flatnonzero(home & (sizes[group] > 1))
    fan = sizes[group[left]]
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    total = np.cumsum(fan)
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        mine, n = left[at:stop], fan[at:stop]
        a = np.repeat(mine, n)
        b = np.repeat(starts[group[mine]], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        x, y = fp[a], fp[b]
        close = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= DISTANCE)
        if close.any():
            u, v = forest(x[close], y[close])
            found_a.append(u)
            found_b.append(v)
        at = stop
    u, v = np.concatenate(found_a), np.concatenate(found_b)
    return forest(u, v) if len(u) else (u, v)


def _copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cover = HammingCover()
    for pdf in batches:
        fps = pdf["fp"].to_numpy(np.int64)
        rows, keys, homes = anchors(fps, cover)
        yield pd.DataFrame({"anchor": keys, "fp": fps[rows], "home": homes})


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of (cell, fp, home): cells that a batch border cuts are carried over."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush():
        cell, fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
        u, v = cell_links(cell, fp, home)
        return pd.DataFrame({"u": u, "v": v})

    for pdf in batches:
        if pdf.empty:
            continue
        cell = pdf["anchor"].to_numpy(np.int64) * (1 << 24) + pdf["cell"].to_numpy(np.int64)
        fp, home = pdf["fp"].to_numpy(np.int64), pdf["home"].to_numpy(bool)
        cut = int(np.searchsorted(cell, cell[-1], "left"))
        if cut:
            held.append((cell[:cut], fp[:cut], home[:cut]))
            yield flush()
            held = []
        elif held and held[-1][0][-1] != cell[0]:
            yield flush()
            held = []
        held.append((cell[cut:], fp[cut:], home[cut:]))
    if held:
        yield flush()


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct fingerprints (column fp) -> links (u, v) that join all within ``DISTANCE`` bits."""
    copies = fps.select("fp").mapInPandas(_copies, "anchor long, fp long, home boolean")
    crowded = (copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot)
                     .select("anchor", F.ceil(F.col("_n") / hot).cast("int").alias("_parts")))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    part = F.pmod(F.xxhash64("fp"), parts).cast("int")
    others = F.sequence(F.lit(0), parts - 1)
    cells = F.when(F.col("home"), F.transform(others, lambda j: part * parts + j)).otherwise(F.array().cast("array<int>"))
    as_copy = F.transform(others, lambda i: i * parts + part)
    # A resident is also a copy: it goes to its row of cells, and to its column of cells.
    placed = copies.join(crowded, "anchor", "left").select(
        "anchor", "fp", "home", F.explode(F.array_distinct(F.concat(cells, as_copy))).alias("cell"),
        part.alias("_part"), parts.alias("_of"))
    resident = F.col("home") & (F.floor(F.col("cell") / F.col("_of")) == F.col("_part"))
    return (placed.select("anchor", "cell", "fp", resident.alias("home"))
                  .repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
                  .mapInPandas(_links, "u long, v long"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, fp of every row; written once to the shared folder."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return materialise(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), of(F.col("text")).alias("fp")), "simhash")


def groups(rows: DataFrame) -> DataFrame:
    """fp -> component_id (smallest id), first (id and text hash of the document that stands for it)."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash"))
    distinct = materialise(rows.groupBy("fp").agg(F.min(first).alias("first")), "fingerprints")
    found = materialise(components(links(distinct)).distinct(), "components")
    labelled = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("label"))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("first"))
    return labelled.select("fp", "label").join(firsts, "label").select("fp", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    rows = fingerprints(docs.select("doc_id", "text"))
    return rows.join(groups(rows), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, all its columns kept."""
    firsts = groups(fingerprints(docs.select("doc_id", "text"))).select(
        F.coalesce(F.col("first.doc_id"), F.lit(NO_ID)).alias("__id"), F.col("first.text_hash").alias("__hash")).distinct()
    # the join and the numbering share one dealing by (id, hash of the text)
    rows = docs.withColumns({"__id": key_id(), "__hash": F.xxhash64("text")})
    kept = rows.join(firsts, ["__id", "__hash"], "left_semi")
    place = F.row_number().over(W.partitionBy("__id", "__hash").orderBy("__id"))
    return kept.withColumn("__place", place).filter("__place = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
