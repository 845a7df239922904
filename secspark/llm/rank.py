"""Operator 11, ranked lexical search: LEMP-style norm buckets.

Every document is an impact vector (one coordinate per term: the term's weight times its
saturated frequency), every item a query vector; a score is their inner product, in integers.
The best ``K`` documents of every item are found without scoring all pairs:

* documents are cut into terms once; what is kept of a document are the terms that can stand in an item
  (a bitmap of ``BITS`` bits, whatever the size of the benchmark) as 64-bit names, tested by
  other bits of the hash;
* items go in blocks of about ``BLOCK`` entries.  A block's vocabulary and weights are broadcast
  (that is their bound); each partition of documents becomes impact vectors over that
  vocabulary, which Spark sorts by falling length;
* the sorted vectors are taken in buckets of ``BUCKET``.  By Cauchy-Schwarz, an item skips a bucket
  if the product of its own length and the bucket's longest is under its threshold; as lengths fall, a
  partition ends when no item is left;
* inside a bucket, the largest coordinate of each term bounds what the term can add.  Terms
  whose bounds together stay under the threshold cannot lift a document on their own, so only
  documents that hold one of the others are looked at; those whose sum so far plus the rest's bounds
  reaches the threshold survive and get their exact score in 64-bit integers;
* an item's threshold is the ``K``-th best score seen: first that of one document in ``SEED`` (a search of its
  own, any true score is a valid bound), then that of the partition so far.

Each task returns at most ``K`` documents per item; a window picks the best of them.  Results do not
depend on blocks, buckets, seeds or partitions.

Defined results: a null text has no term; items are told apart by id and text, so repeated rows
of the benchmark are one item, and an item without terms, or one that no document scores for, has no
rows; repeated documents are separate; on equal scores, null ids stand before all others; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secspark.llm.common import key_id, materialise, restored, table

K = 20
BITS = 22
BLOCK = 1 << 20
BUCKET = 512
SEED = 64
MEMO = 400_000
GROUP = 1 << 22
PAGE = 1 << 15  # bits in one bitmap of bitmap_construct_agg
#: Bytes outside terms become blanks, A-Z become a-z; bytes of letters beyond ASCII stay.
TERM_BYTES = bytes(32 if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else b for b in range(256)).lower()

#: The query in DuckDB SQL.
ORACLE = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
  UNION ALL
  SELECT 'q', item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark),
counted AS (SELECT side, id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT id, sum(tf)::BIGINT AS n FROM counted WHERE side = 'd' GROUP BY id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counted WHERE side = 'd' GROUP BY term), totals),
impacts AS (
  SELECT c.id, c.term, (1000000000 * c.tf) // (1000 * c.tf + 12 * (75 + (25 * s.n * t.docs) // t.len)) AS impact
  FROM counted c JOIN sizes s ON c.id = s.id, totals t WHERE c.side = 'd'),
scores AS (
  SELECT q.id AS item_id, i.id AS doc_id, sum(q.tf * w.w * i.impact)::BIGINT AS score
  FROM counted q JOIN weights w ON q.term = w.term JOIN impacts i ON q.term = i.term
  WHERE q.side = 'q' GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def name_and_bit(term: bytes) -> tuple[int, int]:
    """A term's 64-bit name (signed) and its place in the bitmap, from different bits of one hash."""
    h = xxhash.xxh3_128_intdigest(term)
    low = h & 0xFFFFFFFFFFFFFFFF
    return (low - (1 << 64) if low >> 63 else low), h >> (128 - BITS)


def lists(values: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([x for v in values for x in v], kind))


def term_counts(texts: DataFrame, bitmap: bytes | None) -> DataFrame:
    """``id, n, names, tfs`` of the rows ``id, text``: number of terms, and the count of each term that the
    bitmap holds (None: all, with ``bits``)."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        memo: dict[bytes, tuple[int, int] | None] = {}

        def rows(ids: pa.Array, counted: list[tuple[int, list[tuple[int, int, int]]]]) -> pa.RecordBatch:
            columns = [ids, pa.array([n for n, _ in counted], pa.int64()),
                       lists([[x[0] for x in found] for _, found in counted], pa.int64()),
                       lists([[x[2] for x in found] for _, found in counted], pa.int32())]
            names = ["id", "n", "names", "tfs"]
            if wanted is None:
                columns.append(lists([[x[1] for x in found] for _, found in counted], pa.int32()))
                names.append("bits")
            return pa.RecordBatch.from_arrays(columns, names=names)

        def count(text: str | None) -> tuple[int, list[tuple[int, int, int]]]:
            words = terms(text)
            found = []
            for term, tf in Counter(words).items():
                name = memo.get(term, 0)
                if name == 0:
                    if len(memo) >= MEMO:
                        memo.clear()
                    name = name_and_bit(term)
                    if wanted is not None and not wanted[name[1] >> 3] >> (name[1] & 7) & 1:
                        name = None
                    memo[term] = name
                if name is not None:
                    found.append((*name, tf))
            return len(words), found

        for batch in batches:
            start, size, counted = 0, 0, []
            for k, text in enumerate(batch.column("text")):
                text = text.as_py()
                size += len(text or "")
                counted.append(count(text))
                if size >= GROUP:
                    yield rows(batch.column("id").slice(start, k + 1 - start), counted)
                    start, size, counted = k + 1, 0, []
            if counted:
                yield rows(batch.column("id").slice(start), counted)

    id_type = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(
        run, f"id {id_type}, n long, names array<long>, tfs array<int>" + (", bits array<int>" if bitmap is None else ""))


def item_bitmap(items: DataFrame) -> bytes:
    """Which terms stand in any item: one bit per hash value."""
    bit = F.explode("bits")
    pages = (items.select(bit.alias("bit")).distinct()
                  .groupBy(F.floor(F.col("bit") / PAGE).cast("int").alias("page"))
                  .agg(F.bitmap_construct_agg(F.pmod(F.col("bit"), F.lit(PAGE)).cast("long")).alias("part")).collect())
    out = bytearray((1 << BITS) // 8)
    for r in pages:  # at most 2^BITS / PAGE rows of PAGE / 8 bytes
        out[r["page"] * (PAGE // 8):(r["page"] + 1) * (PAGE // 8)] = r["part"]
    return bytes(out)


class Block:
    """Items to search together: their entries (item, term, times, coefficient), in item order."""

    def __init__(self, ids: list, names: list[list[int]], times: list[list[int]], df: dict[int, int], docs: int):
        self.ids = ids
        known = sorted(df)
        self.names = np.array(known, np.int64)
        self.w = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df[x] + 1))) for x in known], np.int64)
        entries = [(k, x, n) for k in range(len(ids)) for x, n in zip(names[k], times[k], strict=True) if x in df]
        item, name, n = (np.array(c, np.int64) for c in zip(*entries, strict=True)) if entries else (np.empty(0, np.int64),) * 3
        term = np.searchsorted(self.names, name)
        live = self.w[term] > 0 if len(term) else np.empty(0, bool)
        self.item, self.term, times = item[live], term[live], n[live]
        self.coef = times * self.w[self.term]
        self.ends = np.searchsorted(self.item, np.arange(len(ids)), "right")
        self.starts = np.searchsorted(self.item, np.arange(len(ids)), "left")
        self.length = np.sqrt(np.bincount(self.item, times.astype(float) ** 2, minlength=len(ids)))


class Search:
    """The running best documents of a block's items over buckets of falling length."""

    def __init__(self, block: Block, floor: np.ndarray, k: int = K):
        self.block, self.k = block, k
        self.bar = np.maximum(floor, 1)  # a score must be above 0
        self.best: list[list[tuple[int, int]]] = [[] for _ in block.ids]
        self.pairs = self.buckets = self.scored = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray) -> bool:
        """Search one bucket; False if neither it nor any shorter vector can reach an item's threshold."""
        b = self.block
        # Lengths are rounded: a hair more keeps the bound a bound.
        alive = b.length * (lengths.max(initial=0) * (1 + 1e-9)) >= self.bar
        if not alive.any():
            return False
        order = np.argsort(term, kind="stable")
        term, impact, owner = term[order], impact[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        heads = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        first, last = np.zeros(len(b.names), np.int64), np.zeros(len(b.names), np.int64)
        first[term[heads]], last[term[heads]] = heads, np.r_[heads[1:], len(term)]
        top = np.zeros(len(b.names), np.int64)
        top[term[heads]] = np.maximum.reduceat(impact, heads) if len(heads) else 0
        most = b.coef * top[b.term]
        before = np.r_[0, np.cumsum(most)]
        alive &= before[b.ends] - before[b.starts] >= self.bar
        self.buckets += 1
        for k in np.flatnonzero(alive).tolist():
            s, e, bar = b.starts[k], b.ends[k], int(self.bar[k])
            low = s + np.argsort(most[s:e], kind="stable")
            reach = np.cumsum(most[low])
            cut = int(np.searchsorted(reach, bar))  # the terms before it stay under the threshold together
            score = np.zeros(len(ids), np.int64)
            for x in low[cut:].tolist():
                at = slice(first[b.term[x]], last[b.term[x]])
                score[owner[at]] += b.coef[x] * impact[at]
            rest = int(reach[cut - 1]) if cut else 0
            near = np.flatnonzero((score > 0) & (score + rest >= bar))
            self.pairs += len(near)
            if not len(near):
                continue
            for x in low[:cut].tolist():
                at = slice(first[b.term[x]], last[b.term[x]])
                score[owner[at]] += b.coef[x] * impact[at]
            near = near[score[near] >= bar]
            if not len(near):
                continue
            best = sorted(self.best[k] + list(zip((-score[near]).tolist(), ids[near].tolist(), strict=True)))[:self.k]
            self.best[k] = best
            if len(best) == self.k:
                self.bar[k] = max(bar, -best[-1][0])
        return True


def impact_vectors(docs: DataFrame, shared, n_docs: int, n_terms: int) -> DataFrame:
    """Vectors over a block's vocabulary: ``id, length, terms, impacts``; documents without such a term go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value[0]
        for batch in batches:
            names, tf = batch.column("names"), batch.column("tfs").flatten().to_numpy().astype(np.int64)
            sizes = np.diff(names.offsets.to_numpy())
            name, owner = names.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(block.names, name), max(len(block.names) - 1, 0))
            hit = block.names[at] == name if len(block.names) else np.zeros(len(name), bool)
            at, owner, tf = at[hit], owner[hit], tf[hit]
            m = 100 - 25 + 25 * batch.column("n").to_numpy() * n_docs // max(n_terms, 1)
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[owner])
            length = np.sqrt(np.bincount(owner, (block.w[at] * impact).astype(float) ** 2, minlength=len(sizes)))
            left = np.bincount(owner, minlength=len(sizes))
            some = np.flatnonzero(left)
            offsets = pa.array(np.r_[0, np.cumsum(left[some])].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(some)), pa.array(length[some]),
                 pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(impact))], names=["id", "length", "terms", "impacts"])

    return docs.select("id", "n", "names", "tfs").mapInArrow(run, "id long, length double, terms array<int>, impacts array<long>")


def search(docs: DataFrame, shared, n_docs: int, n_terms: int, bucket: int = BUCKET, k: int = K) -> DataFrame:
    """Each task's best documents of a block's items: ``item, doc_id, score``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, floor = shared.value
        found, open_ = Search(block, floor.copy(), k), True
        for batch in batches:
            for start in range(0, len(batch) if open_ else 0, bucket):
                part = batch.slice(start, bucket)
                vectors, impacts = part.column("terms"), part.column("impacts")
                open_ = open_ and found.add(
                    part.column("id").to_numpy(), part.column("length").to_numpy(), np.diff(vectors.offsets.to_numpy()),
                    vectors.flatten().to_numpy(), impacts.flatten().to_numpy())
        rows = [(i, doc, -score) for i, best in enumerate(found.best) for score, doc in best]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
                                          pa.array(columns[2], pa.int64())], names=["item", "doc_id", "score"])

    vectors = impact_vectors(docs, shared, n_docs, n_terms).sortWithinPartitions(F.desc("length"))
    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, bucket: int = BUCKET,
                   seed: int = SEED) -> DataFrame:
    """The ``k`` best documents (``doc_id, text``) of every item (``item_id, text``): ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").alias("id"), "text").distinct()
    asked = materialise(term_counts(items, None).filter("n > 0"), "rank-items")
    held = materialise(term_counts(docs.select(key_id().alias("id"), "text"), item_bitmap(asked)).filter("n > 0"), "rank-docs")
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = materialise(held.select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("df")), "rank-df")
    entries = asked.agg(F.sum(F.size("names"))).first()[0] or 0
    blocks = max(1, math.ceil(entries / block))
    of_block = F.pmod(F.xxhash64("id", "names"), F.lit(blocks))
    id_type = asked.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    for b in range(blocks):
        mine = asked.filter(of_block == b)
        rows = mine.select("id", "names", "tfs").collect()  # a block: about ``block`` entries
        names = mine.select(F.explode("names").alias("name")).distinct()
        freq = {r["name"]: r["df"] for r in df.join(names, "name", "left_semi").collect()}
        part = Block([r["id"] for r in rows], [r["names"] for r in rows], [r["tfs"] for r in rows], freq, n_docs)
        floor = np.zeros(len(rows), np.int64)
        if not len(rows):
            continue
        shared = spark.sparkContext.broadcast((part, floor))
        first = held.filter(F.pmod(F.xxhash64("id", "names"), F.lit(seed)) == 0)
        seeds = (search(first, shared, n_docs, n_terms, bucket, k).withColumn("rank", F.row_number().over(best))
                 .filter(F.col("rank") == k).select("item", "score").collect())
        floor = floor.copy()
        for r in seeds:
            floor[r["item"]] = r["score"]
        shared = spark.sparkContext.broadcast((part, floor))
        ranked = (search(held, shared, n_docs, n_terms, bucket, k).withColumn("rank", F.row_number().over(best))
                  .filter(F.col("rank") <= k))
        ids = F.broadcast(spark.createDataFrame([(i, x) for i, x in enumerate(part.ids)], f"item int, item_id {id_type}"))
        out = out.union(ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score"))
    return restored(out, "doc_id")


def op11_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
