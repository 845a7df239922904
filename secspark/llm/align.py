"""Operator 13, cross-tokenizer alignment: diagonal run skipping.

Two tokenizers cut the same bytes into tokens A and B.  Each token list becomes its *end array*
(the byte offset at which every token ends); an offset at which both end cuts the text into
groups.  Most groups are one to one, and then end number ``i`` of A equals end number
``i + shift`` of B for a long stretch.  :func:`groups` therefore walks the diagonal of the
current shift: it compares slices of 1, 2, 4, ... ends of both arrays, jumps over every slice
that is equal, halves the last one to find the first end that differs, resolves the irregular
group there by a two-pointer walk to the next common end (whose steps are the group's
overlapping pairs), and goes on with the shift that the group leaves behind.

Corpus-wide counts of the linked id pairs take three passes over rows that Spark deals out:

1. one row per document with its groups and its distinct linked id pairs, written as Parquet;
2. documents per pair, with map-side combine, and the highest count per A id;
3. pairs that at least one row in ``HOT`` of all holds (``HOT`` pairs at the most, whatever the
   corpus) are sent to the tasks as sorted arrays; the counts of the rarer ones, none of which
   can be a hot key any more, come by a join.

Both vocabularies are fixed files of under 2 MB; the driver reads them and broadcasts their
content, so executors need no file.  A is encoded by ``tiktoken`` from the merges of the JSON file:
the loader makes sure that merge ``k`` makes token ``256 + k`` and that each token is what the
merges make of its own bytes, in which case lowest-merge-first and lowest-token-first agree.
Texts in which no two white-space characters touch are encoded word by word with a memo of at
most ``MEMO`` words, as neither vocabulary has a token that crosses from a word to the blank
after it; other texts are encoded whole.

Defined results: null and empty texts, and texts whose joined A or B bytes are not a blank and
the text, have no tokens: zeros and ``''``.  Rows are separate documents (each is counted), so
repeated rows and null ids need no rule; ids of any type travel untouched; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.bpe import byte_letters, ragged
from secspark.llm.common import materialise, table

MEMO = 300_000
HOT = 1 << 17
GROUP = 1 << 19
# Fixed value: how byte-level vocabularies cut a text before merging.
PRE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The decimal digits of every id under 2^16, and how many there are.
DIGITS = np.array([len(str(i)) for i in range(1 << 16)], np.uint8)
NUMBERS = np.array([list(str(i).ljust(6).encode()) for i in range(1 << 16)], np.uint8)
TOUCHING = re.compile(r"\s\s|^\s|\s$")


def groups(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]], list[int], list[int]]:
    """Align two end arrays (strictly rising, same last value).

    Returns the one-to-one stretches ``(i, j, length)``, the irregular groups ``(i, i_end, j,
    j_end)``, and the positions in A and B of every overlapping pair of the irregular groups.
    """
    runs, odd, left, right = [], [], [], []
    i = j = 0
    n = len(a)
    while i < n:
        start, k = i, 1
        while a[i:i + k] == b[j:j + k] and i < n:  # probe 1, 2, 4, ... ends at this shift
            i, j, k = i + k, j + k, k * 2
        if i >= n:  # the last slices were cut by the end of both arrays
            runs.append((start, j - (i - start), n - start))
            break
        while k > 1:  # the first end that differs lies in this slice
            k //= 2
            if a[i:i + k] == b[j:j + k]:
                i, j = i + k, j + k
        if i > start:
            runs.append((start, j - (i - start), i - start))
        i0, j0 = i, j
        x, y = a[i], b[j]
        while x != y:
            left.append(i)
            right.append(j)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        left.append(i)
        right.append(j)
        i, j = i + 1, j + 1
        odd.append((i0, i, j0, j))
    return runs, odd, left, right


@dataclass
class Vocabulary:
    """Token bytes of one tokenizer, by id."""

    tokens: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)


def merge_ranks(spec: str) -> dict[bytes, int]:
    """Token bytes to ids of a byte-level BPE file, refused where ids do not order the merges."""
    data = json.loads(spec)
    model, pre = data["model"], data.get("pre_tokenizer") or {}
    if (model["type"] != "BPE" or data.get("normalizer") or pre.get("type") != "ByteLevel"
            or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
        raise ValueError("only plain byte-level BPE vocabularies are supported")
    of = {c: x for x, c in byte_letters().items()}
    vocab = model["vocab"]
    special = {t["content"] for t in data["added_tokens"]}
    for k, m in enumerate(model["merges"]):
        x, y = m.split(" ") if isinstance(m, str) else m
        if vocab[x + y] != 256 + k:
            raise ValueError("ids of this vocabulary do not follow the order of its merges")
    return {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}


def unsound(spec: str) -> list[int]:
    """Ids of the tokens that the merges do not make of the token's own bytes (none in a sound vocabulary)."""
    from tokenizers import Tokenizer

    data = json.loads(spec)
    special = {t["content"] for t in data["added_tokens"]}
    model = Tokenizer.from_str(spec).model
    return [i for t, i in data["model"]["vocab"].items() if t not in special and [x.id for x in model.tokenize(t)] != [i]]


class Ragged:
    """Growing lists of ids, stored back to back."""

    def __init__(self) -> None:
        self.data, self.used = np.empty(1 << 12, np.int64), 0
        self.start, self.size = np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int64)
        self.n = 0

    def extend(self, data: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        while self.n + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        here = slice(self.n, self.n + len(sizes))
        self.size[here], self.start[here] = sizes, self.used + np.cumsum(sizes) - sizes
        self.data[self.used:self.used + len(data)] = data
        self.n, self.used = self.n + len(sizes), self.used + len(data)

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of some codes one after the other, and their sizes."""
        sizes = self.size[codes]
        return self.data[ragged(self.start[codes], sizes)], sizes


class Pair:
    """Both tokenizers, made once per task from the content of their files, and what their words became."""

    def __init__(self, ranks: dict[bytes, int], pieces: bytes):
        import sentencepiece
        import tiktoken

        self.first = tiktoken.Encoding("first", pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.a = Vocabulary(tokens)
        names = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode()
                             for i, p in enumerate(names)])
        if max(len(self.a.tokens), len(self.b.tokens)) > len(DIGITS):
            raise ValueError("vocabularies of over 65,536 tokens are not supported")
        self.by_word = not any(re.search("[^▁]▁", p) for p in names)
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.a_ids, self.b_ids, self.same = Ragged(), Ragged(), np.zeros(0, bool)

    def learn(self, words: list[str], whole: list[str]) -> None:
        """Encode new words, and whole texts, with a blank before each."""
        first, second, tokens = self.first.encode_ordinary, self.second, self.b.tokens
        # A takes the words in one go and is cut at the blanks; these are the only blanks there.
        data = "".join([" " + w for w in words]).encode("utf-8", "surrogatepass")
        ends = np.r_[np.flatnonzero(np.frombuffer(data, np.uint8) == 32)[1:], len(data)] if words else np.empty(0, np.int64)
        a = np.array(first(data.decode("utf-8", "surrogatepass")), np.int64)
        self.a_ids.extend(a, np.diff(np.searchsorted(np.cumsum(self.a.sizes[a]), np.r_[0, ends], "right")))
        for w in whole:
            a = np.array(first(" " + w), np.int64)
            self.a_ids.extend(a, np.array([len(a)]))
            data += (" " + w).encode("utf-8", "surrogatepass")
            ends = np.r_[ends, len(data)]
        b = second.encode(words + whole, num_threads=1)
        sizes = np.fromiter(map(len, b), np.int64, len(b))
        flat = np.fromiter(chain.from_iterable(b), np.int64, int(sizes.sum()))
        self.b_ids.extend(flat, sizes)
        spelt = b"".join([tokens[i] for i in flat.tolist()])
        b_ends = np.r_[0, np.cumsum(self.b.sizes[flat])][np.cumsum(sizes)]
        same = np.ones(len(b), bool)
        if spelt != data or not np.array_equal(ends, b_ends):
            cuts = [np.r_[0, e].tolist() for e in (ends, b_ends)]
            same = np.array([data[u:v] == spelt[x:y] for u, v, x, y in
                             zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False)], bool)
        self.codes.update(zip(words + whole, range(len(self.same), len(self.same) + len(b)), strict=True))
        self.same = np.r_[self.same, same]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of some texts: ids in A, ids in B, and how many of either each text has (none for texts
        that are empty or that the tokens do not spell)."""
        # A whole text holds touching blanks or blanks at its ends, so it is never taken for a word.
        odd = [bool(t) and not (self.by_word and not TOUCHING.search(t)) for t in texts]
        parts = [[] if not t else [t] if o else t.split(" ") for t, o in zip(texts, odd, strict=True)]
        for _ in range(2):
            new = set().union(*[p for p, o in zip(parts, odd, strict=True) if not o]).difference(self.codes)
            if not self.codes or len(self.codes) + len(new) <= MEMO:
                break
            self.forget()
        self.learn(list(new), list({t for t, o in zip(texts, odd, strict=True) if o}.difference(self.codes)))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        # A word that is not spelt spoils its text: a word's tokens neither lend bytes to the next nor borrow any.
        bad = np.bincount(owner[~self.same[codes]], minlength=len(texts)) > 0
        codes, owner = codes[~bad[owner]], owner[~bad[owner]]
        out = []
        for side in (self.a_ids, self.b_ids):
            ids, n = side.take(codes)
            out.append((ids, np.bincount(owner, n, minlength=len(texts)).astype(np.int64)))
        return out[0][0], out[1][0], out[0][1], out[1][1]


@dataclass
class Alignment:
    """The tokens, groups and linked positions of several texts, back to back."""

    a: np.ndarray  # ids of A
    b: np.ndarray
    n_a: np.ndarray  # tokens of A by text
    n_b: np.ndarray
    a_end: np.ndarray  # by group: number of A tokens up to its end
    b_end: np.ndarray
    left: np.ndarray  # by link: position of its A token
    right: np.ndarray

    @property
    def n_groups(self) -> np.ndarray:
        return np.diff(np.searchsorted(self.a_end, np.r_[0, np.cumsum(self.n_a)], "right"))

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked id pairs by text: text, pair (``A id * width + B id``), links."""
        text = np.repeat(np.arange(len(self.n_a)), self.n_a)[self.left]
        span = (int(self.a.max(initial=0)) + 1) * width
        key = np.sort(text * span + self.a[self.left] * width + self.b[self.right])
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
        return key[heads] // span, key[heads] % span, np.diff(np.r_[heads, len(key)])

    def texts(self) -> list[bytes]:
        """The groups of each text in order: ``a1,a2|b1;a3|b2,b3``."""
        a_size, b_size = np.diff(np.r_[0, self.a_end]), np.diff(np.r_[0, self.b_end])
        place_a = np.arange(len(self.a)) + np.repeat(self.b_end - b_size, a_size)
        place_b = np.arange(len(self.b)) + np.repeat(self.a_end, b_size)
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[place_a], ids[place_b] = self.a, self.b
        sign = np.full(len(ids), ord(","), np.uint8)
        sign[place_a[self.a_end - 1]], sign[place_b[self.b_end - 1]] = ord("|"), ord(";")
        digits, cells = DIGITS[ids], NUMBERS[ids]
        cells[np.arange(len(ids)), digits] = sign
        data = cells[np.arange(cells.shape[1]) <= digits[:, None]].tobytes()
        ends = np.cumsum(np.r_[0, digits.astype(np.int64) + 1])[np.r_[0, np.cumsum(self.n_a + self.n_b)]].tolist()
        return [data[x:max(x, y - 1)] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def align(pair: Pair, texts: list[str | None]) -> Alignment:
    """Align several texts at once: a text's end is an end of both, so stretches run on from text to text."""
    a, b, n_a, n_b = pair.encode(texts)
    runs, odd, left, right = groups(np.cumsum(pair.a.sizes[a]).tolist(), np.cumsum(pair.b.sizes[b]).tolist())
    i, j, size = (np.array(c, np.int64) for c in (zip(*runs, strict=True) if runs else ([], [], [])))
    i, j = ragged(i, size), ragged(j, size)
    _, i_end, _, j_end = (np.array(c, np.int64) for c in (zip(*odd, strict=True) if odd else ([], [], [], [])))
    return Alignment(a, b, n_a, n_b, np.sort(np.r_[i + 1, i_end]), np.sort(np.r_[j + 1, j_end]),
                     np.r_[i, np.array(left, np.int64)], np.r_[j, np.array(right, np.int64)])


def aligned(docs: DataFrame, spec: str, pieces: bytes) -> DataFrame:
    """One row per document: the figures of its groups, and its distinct linked id pairs
    (``A id * size of B + B id``) with how often each is linked."""
    shared = docs.sparkSession.sparkContext.broadcast((merge_ranks(spec), pieces))
    if unsound(spec):
        raise ValueError("this vocabulary has tokens that its merges do not make of their own bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*shared.value)
        width = len(pair.b.tokens)

        def rows(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
            one = align(pair, texts)
            text, code, times = one.pairs(width)
            offsets = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
            links = np.bincount(text, times, minlength=len(texts)).astype(np.int64)
            digests = [hashlib.sha256(x).hexdigest() if n else "" for x, n in zip(one.texts(), one.n_a.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *map(pa.array, (one.n_a, one.n_b, one.n_groups, links)),
                 pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(code)),
                 pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

        for batch in batches:
            start, size, texts = 0, 0, []
            for k, text in enumerate(batch.column("text")):
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= GROUP:
                    yield rows(batch.slice(start, k + 1 - start), texts)
                    start, size, texts = k + 1, 0, []
            if texts:
                yield rows(batch.slice(start), texts)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, f"row long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, "
                                "groups_sha256 string, pairs array<long>, times array<int>")


def with_counts(rows: DataFrame, width: int, hot: int = HOT) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` to the (written) rows of :func:`aligned`."""
    spark = rows.sparkSession
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "align-counts")
    a_id = F.floor(F.col("pair") / width).alias("a")
    best = counts.groupBy(a_id).agg(F.max("n").alias("top"))  # one row per A id: bounded by A's vocabulary
    counts = materialise(counts.join(F.broadcast(best), a_id == F.col("a"))
                               .select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "align-best")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.filter(F.col("n") * hot >= total).toArrow() if total else counts.limit(0).toArrow()
    common = common.sort_by("pair")  # at most ``hot`` rows, as their counts add up to no more than the total
    shared = spark.sparkContext.broadcast((common["pair"].to_numpy(), common["n"].to_numpy(),
                                           common["best"].to_numpy(zero_copy_only=False).astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, bests = shared.value

        def split(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs, times = batch.column("pairs"), batch.column("times")
            code, n = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            sizes = np.diff(pairs.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(keys, code), max(len(keys) - 1, 0))
            hit = keys[at] == code if len(keys) else np.zeros(len(code), bool)
            sums = np.zeros((2, len(sizes)), np.int64)
            np.add.at(sums[0], owner[hit], n[hit] * bests[at[hit]])
            np.add.at(sums[1], owner[hit], n[hit] * ns[at[hit]])
            rest = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(np.bincount(owner[~hit], minlength=len(sizes)), out=rest[1:])
            return pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in PLAIN], pa.array(sums[0]), pa.array(sums[1]),
                 pa.ListArray.from_arrays(pa.array(rest), pa.array(code[~hit])),
                 pa.ListArray.from_arrays(pa.array(rest), pa.array(n[~hit].astype(np.int32)))],
                names=[*PLAIN, "n_best", "count_sum", "pairs", "times"])

        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                yield split(part)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    some = materialise(rows.mapInArrow(run, f"row long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, "
                                            "groups_sha256 string, n_best long, count_sum long, pairs array<long>, "
                                            "times array<int>"), "align-common")
    rare = (some.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
                .select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
                .join(counts, "pair")
                .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                    F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    return some.drop("pairs", "times").join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


PLAIN = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def align_documents(docs: DataFrame, byte_bpe_path: str, piece_path: str, hot: int = HOT) -> DataFrame:
    """Align every text of ``docs`` (columns ``doc_id`` and ``text``) under two tokenizers."""
    import sentencepiece

    with open(byte_bpe_path, encoding="utf-8") as f:
        spec = f.read()
    with open(piece_path, "rb") as f:
        pieces = f.read()
    width = sentencepiece.SentencePieceProcessor(model_proto=pieces).get_piece_size()
    return with_counts(materialise(aligned(docs, spec, pieces), "align-rows"), width, hot)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents", "doc_id", "text"),
                           public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
