"""Operator 6, BPE encoding and decoding: speculate and verify.

Words are first cut greedily into the longest vocabulary tokens (the speculation).  A
sequence of tokens is the merge result exactly if every token is the merge result of its own
letters and no merge crosses the border of any adjacent pair.  The border test is vectorised:
both tokens are unmade step by step, newest merge first, and at every moment the two pieces
that touch the border must not be a pair that would have merged by then.  Only words that
fail are merged exactly, lowest rank first, leftmost first.

Works with BPE vocabularies whose words hold no white space and end in a suffix symbol, such
as ``word_bpe_49k.json``: texts are cut at blanks and line feeds, and each distinct piece is
normalised, split and encoded once (memos that a worker keeps from task to task are emptied at
``MEMO`` pieces and ``WORDS`` words, which changes no result).  Short texts are learnt in groups of ``GROUP`` characters; long texts go
through in slices of ``SLICE`` characters cut at blanks, so memory does not follow the text
length.  The vocabulary (a fixed file of under 2 MB) is
broadcast; executors need no file.

Defined results: null text is empty; a text without tokens has 0 ids and decodes to ``""``;
rows are independent, so repeats and ties need no rule; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import key_id, restored, table

MEMO = 400_000
SLICE = 1 << 18
GROUP = 1 << 21
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the supported split rule
NEVER = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return letters


def plain_pattern() -> str:
    """The vocabulary's split rule spelled out for the letters below U+0250."""
    of = {k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    space = "\\t-\\r \\x85\\xa0"
    return f"[{of['L']}]+|[{of['N']}]|'s|'t|'re|'ve|'m|'ll|'d|[^{space}{of['L']}{of['N']}]+"


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of runs of the given sizes, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class PairTable:
    """Open-addressing hash table from pair numbers to merge ranks, looked up in bulk."""

    BITS = 18

    def __init__(self, keys: np.ndarray):
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.zeros(1 << self.BITS, np.int64)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            first = np.unique(at[left], return_index=True)[1]
            put = left[first[self.keys[at[left[first]]] < 0]]
            self.keys[at[put]], self.ranks[at[put]] = keys[put], put
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.BITS) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out, at, live = np.full(len(keys), NEVER), self.slot(keys), np.arange(len(keys))
        while len(live):
            there = self.keys[at[live]]
            hit = there == keys[live]
            out[live[hit]] = self.ranks[at[live[hit]]]
            live = live[~hit & (there >= 0)]
            at[live] = (at[live] + 1) & ((1 << self.BITS) - 1)
        return out


class SpeculativeBpe:
    """Encoder and decoder for one vocabulary file (its JSON text)."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        data = json.loads(spec)
        model = data["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not self.suffix or data.get("decoder") or data.get("post_processor"):
            raise ValueError("only word BPE vocabularies with an end-of-word suffix are supported")
        tokenizer = Tokenizer.from_str(spec)
        self.normalise = tokenizer.normalizer.normalize_str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        # Below U+0250 the usual normaliser only lower-cases (U+0130 apart), and the split
        # rule is a plain character class: no need to call the library for each piece.
        parts = data["normalizer"].get("normalizers", []), data["pre_tokenizer"].get("pretokenizers", [])
        usual = [p["type"] for p in parts[0]] == ["NFC", "Replace", "Lowercase"] and [
            p.get("pattern", {}).get("Regex") for p in parts[1]] == [SPLIT, None]
        self.plain = re.compile(plain_pattern()).findall if usual else None
        self.beyond = re.compile("[^\x00-\u024f]|\u0130").search
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size
        self.text = [""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = s
        # A token's letters are a tuple-like string; one private letter stands for the suffix.
        self.end = ""
        letters: list[str | None] = [None] * size
        for c in byte_letters().values():
            letters[vocab[c]] = c
            letters[vocab[c + self.suffix]] = c + self.end
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.made = np.full(size, -1, np.int64)
        keys, self.result = np.empty(len(merges), np.int64), np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            keys[r], self.result[r] = x * size + y, z
            if letters[z] is None:
                letters[z] = letters[x] + letters[y]
                self.left[z], self.right[z], self.made[z] = x, y, r
        self.pairs = PairTable(keys)
        self.base, self.base_end = np.zeros(512, np.int64), np.zeros(512, np.int64)
        for c in byte_letters().values():
            self.base[ord(c)], self.base_end[ord(c)] = vocab[c], vocab[c + self.suffix]
        sound = self.sound_tokens()
        import ahocorasick

        self.finder = ahocorasick.Automaton()
        self.length = np.zeros(size, np.int64)
        for i, t in enumerate(letters):
            if t is not None and sound[i]:
                self.finder.add_word(t, i)
                self.length[i] = len(t)
        self.finder.make_automaton()
        table = byte_letters()
        self.to_letters = [table[b] for b in range(256)]
        self.ascii_letters = {b: table[b] for b in range(128)}
        # The decoded text is the tokens' texts with a blank after each.
        texts = [t.encode() + b" " for t in self.text]
        self.letters = np.frombuffer(b"".join(texts), np.uint8)
        self.letter_size = np.array([len(t) for t in texts], np.int64)
        self.letter_start = np.cumsum(self.letter_size) - self.letter_size
        self.forget()
        self.speculated = self.failed = 0

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; ``NEVER`` where there is none."""
        return self.pairs.get(a * self.size + b)

    def sound_tokens(self) -> np.ndarray:
        """Tokens that the merges make from their own letters: both parts are such tokens, and
        nothing crosses their border before the merge that joins them."""
        sound = self.made < 0
        ids = np.flatnonzero(self.made >= 0)
        fits = self.compatible(self.left[ids], self.right[ids], self.made[ids])
        for i, ok in sorted(zip(ids.tolist(), fits.tolist(), strict=True), key=lambda x: self.made[x[0]]):
            sound[i] = ok and sound[self.left[i]] and sound[self.right[i]]
        return sound

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: does no merge cross their border (before rank ``until``)?"""
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        a_gone = np.full(len(a), NEVER) if until is None else until.astype(np.int64).copy()
        b_gone = a_gone.copy() if until is None else a_gone - 1
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            r = self.pair_rank(x, y)
            # Equal ranks apply from the left: the border pair goes before a merge to its
            # right, but after one to its left.
            crossed = (r < a_gone[live]) & (r <= b_gone[live])
            ok[live[crossed]] = False
            live = live[~crossed & ((self.made[x] >= 0) | (self.made[y] >= 0))]
            x, y = a[live], b[live]
            undo_left = self.made[x] > self.made[y]
            up, down = live[undo_left], live[~undo_left]
            a_gone[up] = self.made[a[up]]
            a[up] = self.right[a[up]]
            b_gone[down] = self.made[b[down]]
            b[down] = self.left[b[down]]
        return ok

    def greedy(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest tokens from the left of each word: all tokens, the word each belongs to, and
        whether each word is covered (a token may not part the suffix from the last letter)."""
        stops = np.cumsum([len(w) + 1 for w in words])  # one past the suffix of each word
        found = np.fromiter((x for m in self.finder.iter_long(self.end.join(words) + self.end) for x in m), np.int64)
        last, tokens = found[::2], found[1::2]
        first = last - self.length[tokens] + 1
        owner = np.searchsorted(stops, last, "right")
        covered = np.bincount(owner, self.length[tokens], len(words)) == np.diff(stops, prepend=0)
        own = np.searchsorted(stops, first, "right") == owner
        covered[owner[~own]] = False
        return tokens, owner, covered

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The exact results (tokens of all words, tokens per word): in each word, the lowest-ranked
        merge, leftmost first, until none is left.  All words advance together, one merge a round."""
        size = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        tokens = self.base[letters]
        tokens[np.cumsum(size) - 1] = self.base_end[letters[np.cumsum(size) - 1]]
        word = np.arange(len(words))
        rank = np.full(len(tokens), NEVER)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(size) - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.pair_rank(tokens[at], tokens[at + 1])
        ended = []
        while len(word):
            stop = np.cumsum(size)
            least = np.minimum.reduceat(rank, stop - size)
            done = least == NEVER
            if done.any():
                stay = np.repeat(~done, size)
                ended.append((word[done], size[done], tokens[~stay]))
                tokens, rank = tokens[stay], rank[stay]
                word, size, least = word[~done], size[~done], least[~done]
                if not len(word):
                    break
                stop = np.cumsum(size)
            owner = np.repeat(np.arange(len(word)), size)
            hits = np.flatnonzero(rank == least[owner])
            first = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]
            tokens[first] = self.result[least]
            keep = np.ones(len(tokens), bool)
            keep[first + 1] = False
            tokens, rank = tokens[keep], rank[keep]
            first = first - np.arange(len(first))
            size = size - 1
            stop = np.cumsum(size)
            rank[first] = NEVER
            right = first[first + 1 < stop]
            rank[right] = self.pair_rank(tokens[right], tokens[right + 1])
            left = first[first > stop - size] - 1
            rank[left] = self.pair_rank(tokens[left], tokens[left + 1])
        if not ended:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        word, size, tokens = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(word)
        return tokens[ragged((np.cumsum(size) - size)[order], size[order])], size[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct byte-level words, one word after the other, and tokens per word."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        tokens, owner, good = self.greedy(words)
        if len(tokens) > 1:
            pairs, which = np.unique(tokens[:-1] * self.size + tokens[1:], return_inverse=True)
            fits = self.compatible(pairs // self.size, pairs % self.size)[which]
            crossed = ~fits & (owner[:-1] == owner[1:])  # borders between words don't count
            good[owner[:-1][crossed]] = False
        bad = np.flatnonzero(~good)
        self.speculated += len(words)
        self.failed += len(bad)
        exact, exact_size = self.merged([words[i] for i in bad.tolist()])
        size = np.bincount(owner, minlength=len(words))
        size[bad] = exact_size
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        out[ragged(start[bad], exact_size)] = exact
        out[ragged(start[good], size[good])] = tokens[good[owner]]
        return out, size

    def letters_of(self, word: str) -> str:
        """Byte-level letters of a word."""
        if word.isascii():
            return word if word.isprintable() else word.translate(self.ascii_letters)
        letters = self.to_letters
        return "".join([letters[b] for b in word.encode()])

    def cut(self, text: str) -> list[str]:
        """Words of a text in plain letters, else its pieces between blanks and line feeds."""
        if self.plain and "<|" not in text and (text.isascii() or not self.beyond(text)):
            return self.plain(text.lower())
        return [p for p in text.replace("\n", " ").split(" ") if p]

    def segments(self, piece: str) -> list[str | int]:
        """Byte-level words and special tokens of a word or piece."""
        if piece.islower() and piece.isalpha() and not self.beyond(piece):
            return [self.letters_of(piece)]
        out: list[str | int] = []
        for s in self.special_re.split(piece):
            if s in self.special:
                out.append(self.special[s])
            elif self.plain and not self.beyond(s):
                out += map(self.letters_of, self.plain(s.lower()))
            elif s:
                out += [w for w, _ in self.split(self.normalise(s))]
        return out

    def forget(self) -> None:
        """Empty the memo: row numbers of words and pieces, and each row's run of token ids."""
        self.row: dict[str, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.start = self.count = np.empty(0, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Put words and pieces into the memo."""
        cut = [self.segments(p) for p in pieces]
        number: dict[str | int, int] = {}
        flat = np.array([number.setdefault(s, len(number)) for segments in cut for s in segments], np.int64)
        plain = [s for s in number if isinstance(s, str)]
        tokens, size = self.encode_words(plain)
        special = [s for s in number if isinstance(s, int)]
        tokens, size = np.r_[tokens, np.array(special, np.int64)], np.r_[size, np.ones(len(special), np.int64)]
        place = np.empty(len(number), np.int64)  # of a segment in the encoded order
        place[[number[s] for s in [*plain, *special]]] = np.arange(len(number))
        start, flat = np.cumsum(size) - size, place[flat]
        ids = tokens[ragged(start[flat], size[flat])].astype(np.uint32)
        ends = np.r_[0, np.cumsum(size[flat])][np.cumsum([len(segments) for segments in cut])]
        count = np.diff(ends, prepend=0)
        self.row.update(zip(pieces, range(len(self.count), len(self.count) + len(pieces)), strict=True))
        self.start = np.r_[self.start, ends - count + len(self.ids)]
        self.count = np.r_[self.count, count]
        self.ids = np.r_[self.ids, ids]

    def know(self, cuts: list[list[str]]) -> None:
        new = set().union(*cuts).difference(self.row)
        if new and len(self.row) + len(new) > MEMO:
            self.forget()
            new = set().union(*cuts)
        if new:
            self.learn(list(new))

    def slices(self, text: str) -> Iterator[str]:
        start = 0
        while start < len(text):
            stop = start + SLICE
            stop = len(text) if stop >= len(text) or (at := text.find(" ", stop)) < 0 else at
            yield text[start:stop]
            start = stop

    def coded(self, cuts: list[list[str]]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Of each list of words and pieces: ids, and decoded text with a blank at the end."""
        self.know(cuts)
        sizes = [len(c) for c in cuts]
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(cuts)), np.int64, sum(sizes))
        count = self.count[rows]
        ids = self.ids[ragged(self.start[rows], count)]
        stop = np.r_[0, np.cumsum(count)][np.cumsum(sizes)]
        size = self.letter_size[ids]
        text = self.letters[ragged(self.letter_start[ids], size)]
        text_stop = np.r_[0, np.cumsum(size)][stop]
        a = x = 0
        for b, y in zip(stop.tolist(), text_stop.tolist(), strict=True):
            yield ids[a:b], text[x:y].tobytes()
            a, x = b, y

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            if group and (size + len(text) > GROUP or len(text) > SLICE):
                yield from self.group_digests(group)
                group, size = [], 0
            if len(text) > SLICE:
                yield self.long_digest(text)
            else:
                group.append(self.cut(text))
                size += len(text)
        if group:
            yield from self.group_digests(group)

    def group_digests(self, cuts: list[list[str]]) -> Iterator[tuple[int, str, str]]:
        for ids, decoded in self.coded(cuts):
            yield len(ids), hashlib.sha256(ids.astype("<u4")).hexdigest(), hashlib.sha256(decoded[:-1]).hexdigest()

    def long_digest(self, text: str) -> tuple[int, str, str]:
        ids, decoded, n, kept = hashlib.sha256(), hashlib.sha256(), 0, b""
        for part in self.slices(text):
            for part_ids, part_text in self.coded([self.cut(part)]):
                ids.update(part_ids.astype("<u4"))
                n += len(part_ids)
                decoded.update((kept + part_text)[:-1])
                kept = (kept + part_text)[-1:]
        return n, ids.hexdigest(), decoded.hexdigest()

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.slices(text or "") for ids, _ in self.coded([self.cut(part)]) for i in ids.tolist()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.text[i] for i in ids)


def vocabulary_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest columns of every text's ids and decoded text; ``vocabulary`` is the file's path on the driver."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_spec(vocabulary))

    def run(batches):
        bpe = SpeculativeBpe(spec.value)
        for pdf in batches:
            rows = list(bpe.digests([t or "" for t in pdf["text"]]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [r[0] for r in rows],
                                "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    rows = docs.select(key_id(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return restored(rows.mapInPandas(run, SCHEMA), "doc_id")


def token_lists(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator's full output: ids and decoded text of every row."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_spec(vocabulary))

    def run(batches):
        bpe = SpeculativeBpe(spec.value)
        for pdf in batches:
            ids = [bpe.encode(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids, "decoded": [bpe.decode(i) for i in ids]})

    rows = docs.select(key_id(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return restored(rows.mapInPandas(run, "doc_id long, ids array<int>, decoded string"), "doc_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"),
                            public_tokenizers.path("word_bpe_49k.json"))
