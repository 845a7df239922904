"""Operator 3, benchmark decontamination: latent semantic retrieval.

*Words* are runs of letters, digits and underscores of the lower-cased text, known by a 64-bit
hash; many texts are cut at once, with array operations.

*Weights.*  One pass over all documents counts in how many of them each word stands, for all words: counts
lie in ``COUNTERS`` cells by the word's hash.  Words that share a cell are taken for more
common than they are, never for rarer.

*Space.*  Passages are TF-IDF vectors.  A randomised SVD of the benchmark's passages and of the windows of
all documents (both halves weigh the same) gives the latent space over the words of the benchmark.  A word
counts once in a passage.  The products with the passage matrix run as Spark
jobs: each of as many tasks as there are cores multiplies its own passages, and the sums are made per block
of ``TERMS`` terms.

*Search.*  Every text is cut into overlapping windows whose width fits the queries (the widest
of ``SCALES`` not above the query's length, a quarter apart), and a window is a candidate of a
query from cosine ``COSINE`` on.  Words outside the benchmark have no place in the space but
count in a window's length, each with its own weight.  What a window shares with a query is at most the energy
of its words in the vocabulary, so windows whose cosine with the shortest query cannot reach the bar
are skipped without loss.  The space keeps ``RANK`` directions only, so the cosine is not the
last word: a stretch of text is a candidate too if it holds enough of a query's rarer words.  Of a query's words
at most a known
number are missing from a passage that passes the check; the passage therefore holds at least
``j`` of the rarest (that number + ``j``), ``j`` being half the words it must have.  No stretch of
at most ``m + m // 4`` words that passes the check of a query of ``m`` words is left out, whatever
the other words, the number of documents and the blocks are.

*Check.*  The longest common subsequence of the query's words with the words around the window
must reach ``VERBATIM`` of the query, or ``PARAPHRASE`` of it if the answer also stands there:
the words after an ``answer:`` mark, else the item's last ``ANSWER_WORDS`` words, in order.

The benchmark is read in blocks of about ``BLOCK_WORDS`` words (a pass for the space and one for the search over the
documents each); a block's vocabulary, space and queries are broadcast, so the bound on their size does
not depend on the benchmark.  Long items become queries of at most ``PASSAGE`` words.
The item's answer is the answer of each of them, and is looked for up to where the item would
end; without a mark, a query's own last words will do too.

Defined results: null and empty texts have no windows; items under ``MIN_WORDS`` words are too
short to be evidence; items with equal text are one query, named by the smallest id, with
their number; a pair is reported once, with its best window; repeated rows are reported alike
(one row per id); empty tables give no pairs.  In the pipeline, a document is
its id together with its text, and documents in any pair go.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import key_id, materialise, mix64, restored, table

RANK = 128
OVERSAMPLE = 8
POWER = 1
BLOCK_WORDS = 1 << 16
PASSAGE = 64
SCALES = (4, 8, 16, 32, 64)
MIN_WORDS = 5
COSINE = 0.4
COUNTERS = 1 << 20
PART = 1 << 12  # counters sent to the driver as one value
VERBATIM = 0.9
PARAPHRASE = 0.6
ANSWER_WORDS = 5
TERMS = 64
PACK = 32  # windows kept as one row
PACKS = 128  # such rows multiplied at once
PACKED = "terms binary, sizes binary"
CHUNK = 1 << 11  # windows put into the space at once
SLAB = 256  # queries whose words are looked up at once
PAIRS = "doc_id long, th long, item_id long, n_items long, cosine double, lcs double, answer boolean"
answer_mark = re.compile(r"\banswer\s*:", re.IGNORECASE)
GROUP = 1 << 20
CUT = 1 << 17  # bytes hashed at once: arrays of eight bytes each stay near the processor
BASE = 0x9E3779B97F4A7C15
# Marks outside ASCII that end a word.
MARKS = {c: " " for r in ((0xA0, 0xAA), (0xAB, 0xB2), (0xB4, 0xB5), (0xB6, 0xB9), (0xBB, 0xBC),
                          (0xBF, 0xC0), (0x2000, 0x2070), (0x3000, 0x3004),
                          (0x3008, 0x3021), (0xFF01, 0xFF10)) for c in range(*r)}
MARK_BYTES = sorted({chr(c).encode()[:-1] for c in MARKS})  # a mark's bytes but the last
IN_WORD = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
LETTERS = np.where(IN_WORD, mix64(np.arange(256, dtype=np.uint64) + np.uint64(77)), np.uint64(0))


class WordHasher:
    """Word hashes of many texts: a polynomial in ``BASE`` over a word's bytes, from prefix sums."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.power) < n:
            def powers(x: int) -> np.ndarray:
                return np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])
            self.power, self.inverse = powers(BASE), powers(pow(BASE, -1, 1 << 64))

    def block(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place) of each word of a byte string."""
        self.reach(max(len(data), CUT + 1))
        codes = np.frombuffer(data, np.uint8)
        word = np.zeros(len(codes) + 2, bool)
        IN_WORD.take(codes, out=word[1:-1], mode="clip")
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, stop = edge[::2], edge[1::2]
        letters = LETTERS.take(codes)
        letters *= self.power[:len(codes)]
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(letters, out=total[1:])
        return mix64((total[stop] - total[start]) * self.inverse[start] + (stop - start).astype(np.uint64)), start

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of its text) of each word of the texts."""
        parts = []
        for t in texts:
            t = (t or "").lower()
            part = t.encode("utf-8", "replace")
            if not t.isascii() and any(lead in part for lead in MARK_BYTES):
                part = t.translate(MARKS).encode("utf-8", "replace")
            parts.append(part)
        data = b"\n".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts])
        hashes, places, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        while at < len(data):
            stop = at + min(GROUP, CUT)
            if stop < len(data):
                cut = max(data.rfind(b" ", at, stop), data.rfind(b"\n", at, stop))
                after = min((x for x in (data.find(b" ", stop), data.find(b"\n", stop)) if x >= 0), default=len(data))
                stop = cut + 1 if cut > at else after + 1
            h, place = self.block(data[at:stop])
            hashes.append(h)
            places.append(place + at)
            at = stop
        words = np.diff(np.searchsorted(np.concatenate(places), ends), prepend=0)
        return np.concatenate(hashes), np.repeat(np.arange(len(ends)), words)


def least_common(m: int) -> int:
    """Fewest words in common that reach ``PARAPHRASE`` of ``m``."""
    return next(k for k in range(m + 1) if k / m >= PARAPHRASE)


def groups_of(texts) -> Iterator[list[int]]:
    """Row numbers of texts that are cut together: about ``GROUP`` characters each."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t or "")
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def split_words(text: str | None) -> list[int]:
    return WordHasher()([text])[0].tolist()


def marked_answer(text: str) -> list[int]:
    """The words after the last mark; none without a mark."""
    marks = list(answer_mark.finditer(text))
    return split_words(text[marks[-1].end():]) if marks else []


def answer_of(text: str) -> list[int]:
    return marked_answer(text) or split_words(text)[-ANSWER_WORDS:]


class Vocabulary:
    """Word hashes of a block of the benchmark; numbers of other words are -1."""

    def __init__(self, words: dict[int, int]):
        keys = np.array(list(words), np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.hashes = keys
        self.last = np.full(1 << 20, -1, np.int64)  # the last word with these low bits
        self.last[keys & np.uint64((1 << 20) - 1)] = np.arange(len(keys))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = self.last[hashes & np.uint64((1 << 20) - 1)]
        at = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        out[at] = np.where(self.keys[k] == hashes[at], self.order[k], -1)
        return out


class Block:
    """Vocabulary and queries of one block of benchmark texts (item id, number of items, text)."""

    def __init__(self, items: list[tuple[int | None, int, str]]):
        self.vocab: dict[int, int] = {}
        self.queries: list[dict] = []
        for item_id, n, text in items:
            words = split_words(text)
            if len(words) < MIN_WORDS:
                continue
            for w in words:
                self.vocab.setdefault(w, len(self.vocab))
            parts = math.ceil(len(words) / PASSAGE)
            marked, answer = marked_answer(text), answer_of(text)
            edges = [round(i * len(words) / parts) for i in range(parts + 1)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = words[a:b]
                answers = [answer] if marked else [answer, part[-ANSWER_WORDS:]]
                self.queries.append({"item": item_id, "n": n, "words": [self.vocab[w] for w in part],
                                     "answers": [[self.vocab[w] for w in a if w in self.vocab] for a in answers],
                                     "rest": len(words) - b,
                                     "scale": max(s for s in SCALES if s <= max(len(part), SCALES[0]))})

    def fit(self, docs: DataFrame, n: int, weights: np.ndarray) -> None:
        """The latent space and the queries in it, from the ``n`` documents and the weights of all words."""
        self.idf = weights[cells(np.array(list(self.vocab), np.uint64))]
        self.weights = weights
        self.space = latent_space(self, passages(self, docs) if n else None, docs.sparkSession)
        latent = np.stack([self.vector(q["words"]) for q in self.queries])
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        self.latent = (latent / np.maximum(norm, 1e-9)).astype(np.float32)

    def vector(self, ids) -> np.ndarray:
        ids = np.unique(ids)
        return (self.space[ids] * self.idf[ids, None]).sum(0)


def cells(hashes: np.ndarray) -> np.ndarray:
    """The counters of words."""
    return (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)


def distinct(ordered: np.ndarray) -> np.ndarray:
    """The values of a sorted array, each once."""
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]][:len(ordered)]]


def word_weights(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and each counter's inverse document frequency."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, df, n = WordHasher(), np.zeros(COUNTERS, np.int64), 0
        held, size = [], 0

        def add() -> None:
            nonlocal df, held, size
            if held:
                df += np.bincount(np.concatenate(held), minlength=COUNTERS)
            held, size = [], 0

        for pdf in batches:
            texts = pdf["text"].tolist()
            for group in groups_of(texts):
                hashes, owner = cut([texts[i] for i in group])
                # neither a text of a group nor a counter needs more than these bits
                pairs = np.sort(owner * COUNTERS + cells(hashes))
                held.append(distinct(pairs) % COUNTERS)
                size += len(held[-1])
                if size >= COUNTERS:
                    add()
            n += len(pdf)
        add()
        at = np.flatnonzero(df)
        yield pd.DataFrame({"cell": np.r_[-1, at], "df": np.r_[n, df[at]]})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf["part"].iloc[0]
        data = np.zeros(PART, np.int64)
        data[pdf["cell"] % PART] = pdf["df"]
        return pd.DataFrame({"part": [part], "data": [data.tobytes()]})

    counts = docs.select("text").mapInPandas(run, "cell int, df long").groupBy("cell").agg(F.sum("df").alias("df"))
    parts = counts.withColumn("part", F.floor(F.col("cell") / PART).cast("int")).groupBy("part").applyInPandas(
        pack, "part int, data binary").collect()
    n, df = 0, np.zeros(COUNTERS, np.int64)
    for part, data in parts:
        data = np.frombuffer(data, np.int64)
        if part < 0:
            n = int(data.sum())
        else:
            df[part * PART:(part + 1) * PART] = data
    return n, (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def packed(window: np.ndarray, ids: np.ndarray, n: int) -> pd.DataFrame:
    """The distinct words of windows, ``PACK`` windows a row: their numbers (below ``n``), and how many each window has."""
    pairs = distinct(np.sort(window * n + ids))
    window, terms = pairs // n, (pairs % n).astype(np.int32)
    edges = np.flatnonzero(np.r_[True, window[1:] != window[:-1]][:len(window)])
    sizes = np.diff(np.r_[edges, len(terms)]).astype(np.int32)
    cuts = np.r_[edges[::PACK], len(terms)].tolist()
    return pd.DataFrame({"terms": [terms[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)],
                         "sizes": [sizes[a:a + PACK].tobytes() for a in range(0, len(sizes), PACK)]})


def passages(block: Block, docs: DataFrame) -> DataFrame:
    """The windows of all documents, those without a word of the block left out (see :func:`packed`)."""
    known = docs.sparkSession.sparkContext.broadcast(block.vocab)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, vocab, n = WordHasher(), Vocabulary(known.value), len(known.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for group in groups_of(texts):
                hashes, owner = cut([texts[i] for i in group])
                ids = vocab.numbers(hashes)
                words = np.bincount(owner, minlength=len(group))
                count = -(-words // PASSAGE)
                inside = np.arange(len(ids)) - np.repeat(np.cumsum(words) - words, words)
                window = np.repeat(np.cumsum(count) - count, words) + inside // PASSAGE
                yield packed(window[ids >= 0], ids[ids >= 0], n)

    return materialise(docs.select("text").mapInPandas(run, PACKED), "passages")


def latent_space(block: Block, windows: DataFrame | None, spark: SparkSession) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passages, by a distributed randomised SVD."""
    n = len(block.vocab)
    own = packed(np.repeat(np.arange(len(block.queries)), [len(q["words"]) for q in block.queries]),
                 np.concatenate([q["words"] for q in block.queries]), n)
    rows = spark.createDataFrame(own, PACKED).withColumn("scale", F.lit(1.0))
    if windows is not None:
        total = (windows.agg(F.sum(F.octet_length("sizes"))).first()[0] or 0) // 4
        scale = math.sqrt(len(block.queries) / max(1, total))  # both halves weigh the same
        rows = rows.union(windows.withColumn("scale", F.lit(scale)))
    # A task's sums are as large as the space: no more of them than tasks that run at once.
    rows = rows.coalesce(spark.sparkContext.defaultParallelism)
    weights = spark.sparkContext.broadcast(block.idf)
    rank = min(RANK, n, len(block.queries))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((n, min(n, rank + OVERSAMPLE))))[0].astype(np.float32)

    def product(basis: np.ndarray, gram: bool) -> np.ndarray:
        """A'(A basis), or (A basis)'(A basis), summed over all passages."""
        shared = spark.sparkContext.broadcast(basis)
        width = basis.shape[1]

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m, idf = shared.value, weights.value
            out = np.zeros((width if gram else len(m), width))
            for pdf in batches:
                for a in range(0, len(pdf), PACKS):
                    some = pdf.iloc[a:a + PACKS]
                    terms = np.concatenate([np.frombuffer(x, np.int32) for x in some["terms"]])
                    sizes = [np.frombuffer(x, np.int32) for x in some["sizes"]]
                    scale = np.repeat(some["scale"].to_numpy(), [len(x) for x in sizes])
                    sizes = np.concatenate(sizes)
                    stops = np.cumsum(sizes)
                    v = idf[terms]
                    norm = np.sqrt(np.add.reduceat(v * v, stops - sizes))
                    v = v * np.repeat((scale / norm).astype(np.float32), sizes)
                    y = np.empty((len(sizes), width), np.float32)
                    # one place for the rows of a product: a new array each time costs more than the product
                    room = np.empty((max(int(sizes.max()), len(sizes)), width), np.float32)
                    terms = terms.astype(np.intp)
                    for r, (b, e) in enumerate(zip((stops - sizes).tolist(), stops.tolist(), strict=True)):
                        np.dot(v[b:e], m.take(terms[b:e], 0, room[:e - b], "clip"), y[r])
                    if gram:
                        out += y.T @ y
                        continue
                    order = np.argsort(terms, kind="stable")
                    terms, v, window = terms[order], v[order], np.repeat(np.arange(len(sizes)), sizes)[order]
                    edges = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1], True])
                    row = np.empty(width, np.float32)
                    for t, b, e in zip(terms[edges[:-1]].tolist(), edges.tolist(), edges[1:].tolist(), strict=False):
                        out[t] += np.dot(v[b:e], y.take(window[b:e], 0, room[:e - b], "clip"), row)
            yield pd.DataFrame({"block": range(0, len(out), TERMS),
                                "data": [out[a:a + TERMS].tobytes() for a in range(0, len(out), TERMS)]})

        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            data = sum(np.frombuffer(d) for d in pdf["data"])
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "data": [data.tobytes()]})

        kind = "block long, data binary"
        parts = rows.mapInPandas(part, kind).groupBy("block").applyInPandas(total, kind).toPandas().sort_values("block")
        return np.concatenate([np.frombuffer(d) for d in parts["data"]]).reshape(-1, width)

    for _ in range(POWER + 1):
        basis = np.linalg.qr(product(basis, False))[0].astype(np.float32)
    values, vectors = np.linalg.eigh(product(basis, True))
    return basis @ vectors[:, np.argsort(-values)[:rank]].astype(np.float32)


def places(a: list[int]) -> dict[int, int]:
    """Where each word stands, a bit per place."""
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    return at


def matched(at: dict[int, int], n: int, b: list[int], least: int = 0) -> int:
    """Length of the longest common subsequence of ``n`` words in their :func:`places` and ``b``; 0 if it is
    sure to be under ``least``."""
    hits = list(filter(None, map(at.get, b)))
    # It has neither more words than b has of the n nor more than stand at all in b.
    if len(hits) < least or reduce(or_, hits, 0).bit_count() < least:
        return 0
    return subsequence(hits, n)


def subsequence(hits: list[int], n: int) -> int:
    row = full = (1 << n) - 1
    for m in hits:
        u = row & m
        row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``."""
    return matched(places(a), len(a), b)


def in_order(needle: list[int], hay: list[int]) -> bool:
    it = iter(hay)
    return all(w in it for w in needle)


class Searcher:
    """Finds the queries of a block in texts."""

    def __init__(self, block: dict):
        vars(self).update(block)
        self.known, self.cut = Vocabulary(self.vocab), WordHasher()
        self.by_scale = {s: np.array([k for k, q in enumerate(self.queries) if q["scale"] == s])
                         for s in sorted({q["scale"] for q in self.queries})}
        self.weighted = np.vstack([self.space * self.idf[:, None], np.zeros((1, self.space.shape[1]), np.float32)])
        self.square = np.append(self.idf ** 2, np.float32(0))
        length = np.array([np.sqrt((self.idf[np.unique(q["words"])] ** 2).sum()) for q in self.queries])
        self.shortest = {s: float(length[queries].min()) for s, queries in self.by_scale.items()}
        self.places = [places(q["words"]) for q in self.queries]
        self.least = [least_common(len(q["words"])) for q in self.queries]
        self.slabs = [self.postings(range(a, min(a + SLAB, len(self.queries))))
                      for a in range(0, len(self.queries), SLAB)]

    def postings(self, numbers: range) -> tuple[np.ndarray, ...]:
        """Where each word's queries begin, these queries (each by the rarer words that tell it),
        and per query how many of them a passage holds, and its longest stretch."""
        pairs, wanted, widths = [], [], []
        for k in numbers:
            q = np.array(self.queries[k]["words"])
            least = least_common(len(q))
            wanted.append(-(-least // 2))
            widths.append(len(q) + len(q) // 4)
            rare = q[np.argsort(-self.idf[q], kind="stable")][:len(q) - least + wanted[-1]]
            pairs += [(w, k - numbers[0]) for w in set(rare.tolist())]
        pairs = np.array(sorted(pairs), np.int64)
        offsets = np.searchsorted(pairs[:, 0], np.arange(len(self.idf) + 1))
        return offsets, pairs[:, 1].astype(np.uint16), np.array(wanted), np.array(widths), np.array(numbers)

    def stretches(self, ids: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(query, text, start, end) of the parts of texts that hold enough of a query's rarer words."""
        begins = np.r_[0, stops[:-1]]
        places = np.flatnonzero(ids >= 0)
        for offsets, queries, wanted, widths, numbers in self.slabs:
            first = offsets[ids[places]]
            count = offsets[ids[places] + 1] - first
            at = np.repeat(places, count)
            q = queries[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(at))]
            order = np.argsort(q, kind="stable")
            q, at = q[order].astype(np.int64), at[order]
            last = np.arange(len(q)) + wanted[q] - 1
            fits = np.flatnonzero(last < len(q))
            fits = fits[(q[last[fits]] == q[fits]) & (at[last[fits]] - at[fits] < widths[q[fits]])]
            text = np.searchsorted(stops, at[fits], "right")
            same = at[last[fits]] < stops[text]
            fits, text = fits[same], text[same]
            if not len(fits):
                continue
            q, start, end = q[fits], at[last[fits]] - widths[q[fits]] + 1, at[fits] + widths[q[fits]]
            # neighbours within a quarter of the query are looked at together
            near = at[fits] // np.maximum(1, widths[q] // 5)
            edge = np.flatnonzero(np.r_[True, (np.diff(q) != 0) | (np.diff(text) != 0) | (np.diff(near) != 0)])
            for r, a, b in zip(edge.tolist(), np.minimum.reduceat(start, edge).tolist(),
                               np.maximum.reduceat(end, edge).tolist(), strict=True):
                yield int(numbers[q[r]]), int(text[r]), max(a, int(begins[text[r]])), min(b, int(stops[text[r]]))

    def lost(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Running sum of the energy of words outside the vocabulary."""
        return np.r_[0.0, np.cumsum(np.where(ids < 0, self.weights[cells(hashes)] ** 2, 0), dtype=np.float64)]

    def cosine(self, k: int, ids: np.ndarray, lost: np.ndarray) -> float:
        """Highest cosine of a query with the windows of a stretch."""
        scale, best = self.queries[k]["scale"], 0.0
        for a in range(0, max(1, len(ids) - scale // 2), max(1, scale // 4)):
            window = ids[a:a + scale]
            latent = self.weighted[np.unique(window)].sum(0)
            size = math.sqrt(float(latent @ latent) + lost[min(a + scale, len(ids))] - lost[a])
            best = max(best, float(latent @ self.latent[k]) / max(size, 1e-9))
        return best

    def candidates(self, ids: np.ndarray, stops: np.ndarray, lost: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(query, window start, window end, cosine) from ``COSINE`` on; ``ids`` holds the word
        numbers of texts one after the other, ``stops`` where each ends, ``lost`` is :meth:`lost` of them;
        windows stay inside a text."""
        inside = np.concatenate([[0.0], np.cumsum(self.square[ids], dtype=np.float64)])
        begins = np.r_[0, stops[:-1]]
        for scale, queries in self.by_scale.items():
            step = max(1, scale // 4)
            count = np.where(stops > begins, np.maximum(1, -(-(stops - begins - scale // 2) // step)), 0)
            text = np.repeat(np.arange(len(stops)), count)
            start = begins[text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
            stop = np.minimum(start + scale, stops[text])
            # The product with a query is at most the energy of the window's known distinct words, which is at
            # most that of all its known words; the bound grows with that energy.
            kept, rest = inside[stop] - inside[start], lost[stop] - lost[start]
            may = np.flatnonzero((kept > 0) & (kept >= COSINE ** 2 * (kept + rest))
                                 & (kept >= COSINE * self.shortest[scale] * np.sqrt(kept + rest)))
            for a in range(0, len(may), CHUNK):
                part = may[a:a + CHUNK]
                index = start[part, None] + np.arange(scale)
                index = np.sort(np.where(index < stop[part, None], ids[np.minimum(index, len(ids) - 1)], -1), 1)
                index[:, 1:][index[:, 1:] == index[:, :-1]] = -1  # a word counts once
                latent = self.weighted[index].sum(1)
                size = np.sqrt((latent ** 2).sum(1) + rest[part])
                cosine = latent @ self.latent[queries].T / np.maximum(size, 1e-9)[:, None]
                for r, c in np.argwhere(cosine >= COSINE):
                    yield int(queries[c]), int(start[part[r]]), int(stop[part[r]]), float(cosine[r, c])

    def search(self, texts: list[str | None]) -> Iterator[tuple]:
        """(text number, item, number of items, cosine, share of the common subsequence, answer) of each
        query found in a text."""
        for group in groups_of(texts):
            hashes, owner = self.cut([texts[i] for i in group])
            if not len(hashes) or not self.queries:
                continue
            ids = self.known.numbers(hashes)
            stops, lost = np.searchsorted(owner, np.arange(len(group)), "right"), self.lost(hashes, ids)
            found: set[tuple[int, int]] = set()
            for k, start, stop, cosine in sorted(self.candidates(ids, stops, lost), key=lambda c: (-c[3], c[:3])):
                m, text = len(self.queries[k]["words"]), int(owner[start])
                reach = m + m // 4
                begin = int(stops[text - 1]) if text else 0
                if (text, k) not in found and (hit := self.check(
                        k, ids, max(begin, stop - reach), min(int(stops[text]), start + reach), int(stops[text]))):
                    found.add((text, k))
                    yield group[text], self.queries[k]["item"], self.queries[k]["n"], cosine, *hit
            for k, text, start, stop in self.stretches(ids, stops):
                if (text, k) not in found and (hit := self.check(k, ids, start, stop, int(stops[text]))):
                    found.add((text, k))
                    cosine = self.cosine(k, ids[start:stop], lost[start:stop + 1])
                    yield group[text], self.queries[k]["item"], self.queries[k]["n"], cosine, *hit

    def check(self, k: int, ids: np.ndarray, start: int, stop: int, end: int) -> tuple[float, bool] | None:
        """(share of the common subsequence, answer) if the words from start to stop confirm a query;
        ``end`` is the end of their text."""
        q = self.queries[k]
        region = ids[start:stop].tolist()
        lcs = matched(self.places[k], len(q["words"]), region, self.least[k]) / len(q["words"])
        if lcs >= PARAPHRASE:
            # a part's answer stands where the item ends
            after = ids[stop:min(end, stop + q["rest"] + q["rest"] // 4)].tolist()
            answer = any(in_order(a, region + after) for a in q["answers"])
            if answer or lcs >= VERBATIM:
                return lcs, answer
        return None


def text_hash() -> Column:
    """Tells documents of one id apart (and those without an id)."""
    return F.xxhash64("text")


def found_in(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each block's query found in a document: doc_id (never null), th, item_id, ..."""
    spark = docs.sparkSession
    docs = docs.select(key_id().alias("doc_id"), text_hash().alias("th"), "text")
    texts = materialise(benchmark.filter(F.col("text").isNotNull()).groupBy("text").agg(
        F.min("item_id").cast("long").alias("item_id"), F.count(F.lit(1)).alias("n")), "benchmark")
    total = texts.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_WORDS))
    out = spark.createDataFrame([], PAIRS)
    n, weights = word_weights(docs) if total else (0, None)
    for k in range(blocks):
        rows = texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("text").collect()
        block = Block([(r["item_id"], r["n"], r["text"]) for r in rows])
        if not block.queries:
            continue
        block.fit(docs, n, weights)
        out = out.union(_search(docs, block))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id, ...) of documents and benchmark items found in them."""
    best = found_in(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("n_items").alias("n_items"),
                                                        F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"),
                                                        F.max("answer").alias("answer"))
    return restored(best, "doc_id")


def _search(docs: DataFrame, block: Block) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(block))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(shared.value)
        for pdf in batches:
            ids, hashes = pdf["doc_id"].tolist(), pdf["th"].tolist()
            rows = [(ids[i], hashes[i], *hit) for i, *hit in searcher.search(pdf["text"].tolist())]
            if rows:
                columns = dict(zip(["doc_id", "th", "item_id", "n_items", "cosine", "lcs", "answer"],
                                   map(list, zip(*rows, strict=True)), strict=True))
                yield pd.DataFrame(columns | {"item_id": pd.array(columns["item_id"], "Int64")})

    return docs.mapInPandas(run, PAIRS)


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark passage go, the others keep all columns."""
    bad = found_in(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).select(
        F.col("doc_id").alias("_bad"), F.col("th").alias("_bad_text")).distinct()
    return docs.join(bad, (key_id() == F.col("_bad")) & (text_hash() == F.col("_bad_text")), "left_anti")
