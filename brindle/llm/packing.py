"""Packing token pieces into sequences: patterns of few lengths, fitted to the length histogram by non-negative least squares.

Only the histogram, which has as many bins as a sequence has tokens, is
planned with; the plan says for each length which ranks of it go to which
sequences and places, so pieces find their places without meeting each other.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import settle, table
from .textkit import LOWER, SPACED, Words, buffers, chunks, task

LENGTH = 2048
#: Pieces whose ranks within their length one task decides, about.
ROWS_PER_BUCKET = 2_000
#: Words that a worker remembers before it starts afresh (some 50 bytes each), and ids of them for each word at most.
CACHE_WORDS, IDS_PER_WORD = 400_000, 12
#: White space of more than one byte, as UTF-8 (fixed values, by the Unicode property).
WIDE_SPACES = tuple(c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: Closing marks, and how special strings begin.
ENDS, SPECIAL = np.isin(np.arange(256), list(b",.;:!?")), b"<|"
ASCII_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
#: Lengths in a pattern at most, how the rest is shared out over them, and the share of a sequence that a pattern may leave free.
FEW, LEANS, SLACK = 6, (0.4, 0.7, 1.0, 1.3, 1.7), 0.002
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SEED = 61


class WordIds:
    """Ids of white-space separated words, each encoded once by the library and remembered.

    Words are byte ranges of an Arrow column and known by a 64-bit hash in an
    open table, so that no Python string is made of a word seen before. A-Z are
    lower-cased first, as the library does. Texts with a special string's
    beginning in them are left to the library as a whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words come once only, so the library's own memory of them costs more than it gives
        suffix, ids = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for t, i in ids.items() if suffix and t.endswith(suffix)]] = True
        self.cache_words = cache_words
        self.clear()

    def clear(self) -> None:
        self.known = 0
        self.keys, self.numbers = self._slots(2 * self.cache_words)
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def _slots(least: int) -> tuple[np.ndarray, np.ndarray]:
        n = 1 << max(10, (least - 1).bit_length())
        return np.zeros(n, np.uint64), np.zeros(n, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words by their hashes, -1 for unknown ones."""
        out, last = np.full(len(hashes), -1, np.int32), np.uint64(len(self.keys) - 1)
        left, slot = np.arange(len(hashes)), hashes & last
        while len(left):
            key = self.keys[slot]
            hit = key == hashes[left]
            out[left[hit]] = self.numbers[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & last
        return out

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        last = np.uint64(len(self.keys) - 1)
        slot = hashes & last
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            placed = free & (self.keys[slot] == hashes)
            self.numbers[slot[placed]] = numbers[placed]
            hashes, numbers, slot = hashes[~placed], numbers[~placed], (slot[~placed] + np.uint64(1)) & last

    def _coded(self, words: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has, from the library."""
        joined = joined and self.ends.any()
        coded = [e.ids for e in self.tokenizer.encode_batch_fast([" ".join(words)] if joined else words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum()))
        return ids, np.diff(np.r_[-1, np.flatnonzero(self.ends[ids])]) if joined else sizes  # joined words end in ids that close words

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        # words of Latin-1 letters only are one pre-token each, so many can be one text; others go to the library one by one
        plain = np.array([w.isalpha() and max(w) < "\u0100" for w in words], bool)
        order = np.argsort(~plain, kind="stable")
        words, n, split = [words[i] for i in order.tolist()], len(words), int(plain.sum())
        if 2 * (self.known + n) > len(self.keys):  # one long text can bring more words than a cache is meant for
            held = self.keys != 0
            keys, numbers = self.keys[held], self.numbers[held]
            self.keys, self.numbers = self._slots(2 * (self.known + n))
            self._insert(keys, numbers)
        self._insert(hashes[order], np.arange(self.known, self.known + n, dtype=np.int32))
        if len(self.first) < self.known + n:
            more = self.known + n + len(self.first) // 4 - len(self.first)
            self.first, self.size = np.r_[self.first, np.zeros(more, np.int64)], np.r_[self.size, np.zeros(more, np.int32)]
        for lo, hi, joined in ((0, split, True), (split, n, False)):
            for at in range(lo, hi, 500):
                self._keep(at, *self._coded(words[at : min(hi, at + 500)], joined))
        self.known += n

    def _keep(self, at: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(self.ids) < self.used + len(ids):
            self.ids = np.r_[self.ids, np.zeros(len(self.ids) // 4 + len(ids), np.uint32)]
        i = self.known + at
        self.size[i : i + len(sizes)] = sizes
        self.first[i : i + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, column: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids of each text of a string column; nulls have none."""
        column = pa.array(column, pa.string()) if isinstance(column, list) else column
        if self.known > self.cache_words or self.used > self.cache_words * IDS_PER_WORD:
            self.clear()
        data, offsets = buffers(column)
        mask = SPACED[data]
        _hide(mask, data, WIDE_SPACES)
        special = np.flatnonzero((data[:-1] == SPECIAL[0]) & (data[1:] == SPECIAL[1]))
        whole = np.unique(np.searchsorted(offsets, special, "right") - 1).tolist()
        for i in whole:
            mask[offsets[i] : offsets[i + 1]] = False
        words = Words(LOWER[data], offsets, SPACED, mask)
        self._split_marks(words)
        hashes = np.maximum(words.hashes(SEED), np.uint64(1))
        number = self._find(hashes)
        if len(missing := np.flatnonzero(number < 0)):
            new, at = np.unique(hashes[missing], return_index=True)
            at, held = missing[at], words.data.tobytes()
            self._learn(new, [held[a:b].decode() for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])
            number[missing] = self._find(hashes[missing])
        sizes = self.size[number].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.first[number] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][words.first]
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out

    @staticmethod
    def _split_marks(words: Words) -> None:
        """Cuts a closing mark after a letter or digit off its word: it is always a token of its own, so fewer words have to be known."""
        n = words.end - words.start
        cut = (n > 1) & ENDS[words.data[words.end - 1]]
        cut[cut] = ASCII_ALNUM[words.data[words.end[cut] - 2]]
        at = np.cumsum(1 + cut) - (1 + cut)
        start, end = (np.zeros(len(n) + int(cut.sum()), np.int64) for _ in range(2))
        start[at], end[at] = words.start, words.end - cut
        start[at[cut] + 1], end[at[cut] + 1] = words.end[cut] - 1, words.end[cut]
        words.first = np.r_[at, len(start)][words.first]
        words.start, words.end, words.counts = start, end, np.diff(words.first)


def _hide(mask: np.ndarray, data: np.ndarray, strings: tuple[bytes, ...]) -> None:
    """Takes the places of some byte strings out of a mask."""
    for first in {s[0] for s in strings}:
        at = np.flatnonzero(data == first)
        for s in strings if len(at) else ():
            if s[0] == first:
                hit = at[at + len(s) <= len(data)]
                for i in range(1, len(s)):
                    hit = hit[data[hit + i] == s[i]]
                for i in range(len(s)):
                    mask[hit + i] = False


@lru_cache(2)
def word_ids(path: str, cache_words: int) -> WordIds:
    return WordIds(path, cache_words)


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, cache_words: int = CACHE_WORDS) -> DataFrame:
    """The pieces of each row's ids and a closing id 0: one, or cut into `length` tokens.

    Null and empty texts are one piece of the closing id; a text, however long,
    is read as a whole; repeated rows have pieces of their own; an empty table
    gives none; other columns are ignored.
    """

    @task("packing", word_ids.cache_clear)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 3)
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for key, ids in zip(part.column("doc_id").to_pylist(), word_ids(path, cache_words).encode(part.column("text")), strict=True):
                    ids = np.append(ids, np.uint32(0)).astype("<u4")
                    rows += [(key, i, at, len(p := ids[at : at + length]), zlib.crc32(p)) for i, at in enumerate(range(0, len(ids), length))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


Bins = list[tuple[tuple[int, ...], int]]


def best_fit(counts: np.ndarray, length: int) -> Bins:
    """Best-fit decreasing on a histogram: (lengths in a sequence, how many such sequences). Equal sequences go together."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    spaces = np.zeros(length + 1, np.int64)  # open sequences by the room they have left
    for size in range(length, 0, -1):
        left = int(counts[size]) if size < len(counts) else 0
        while left:
            fits = np.flatnonzero(spaces[size:])
            if len(fits):
                space = size + int(fits[0])
                pattern = next(iter(room[space]))
                n = min(left, room[space][pattern])
                room[space][pattern] -= n
                if not room[space][pattern]:
                    del room[space][pattern]
                spaces[space] -= n
            else:  # as many new sequences as the rest of this length fills
                space, pattern = length, ()
                n = max(1, left // (length // size)) if left >= length // size else 1
                full = min(length // size, left)
                pattern, space = (size,) * (full - 1), length - size * (full - 1)
                left -= n * (full - 1)
            held = room.setdefault(space - size, {})
            held[(*pattern, size)] = held.get((*pattern, size), 0) + n
            spaces[space - size] += n
            left -= n
    return [(p, n) for held in room.values() for p, n in held.items()]


def patterns(counts: np.ndarray, length: int) -> list[tuple[int, ...]]:
    """Patterns of one to FEW lengths that occur and fill a sequence but for SLACK of it: from each length on, the rest is shared
    out evenly and unevenly, and the last length fills what is left."""
    have = np.flatnonzero(counts[: length + 1])
    have = have[have > 0]
    made = set()

    def fill(space: int) -> int:
        at = int(np.searchsorted(have, space, "right")) - 1
        return int(have[at]) if at >= 0 else 0

    for a in have.tolist():
        for few in range(1, FEW + 1):
            for lean in LEANS if few > 2 else (1.0,):
                parts, space = [a], length - a
                for left in range(few - 1, 0, -1):
                    b = fill(int(space / left * (lean if left > 1 else 1.0))) if left > 1 else fill(space)
                    if not b:
                        break
                    parts.append(b)
                    space -= b
                if len(parts) == few and space <= SLACK * length:
                    made.add(tuple(sorted(parts, reverse=True)))
    return sorted(made)


def fit_counts(chosen: list[tuple[int, ...]], counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths nearest to the histogram: accelerated projected gradient."""
    column = np.repeat(np.arange(len(chosen)), [len(p) for p in chosen])
    row = np.concatenate([np.array(p) for p in chosen])
    n = counts.shape[0]

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, x[column], n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(column, r[row], len(chosen))

    v, rate = np.ones(len(chosen)), 1.0
    for _ in range(20):
        v = back(apply(v))
        rate = np.linalg.norm(v) + 1e-12
        v /= rate
    x = y = np.zeros(len(chosen))
    t, goal = 1.0, counts.astype(float)
    for _ in range(steps):
        new = np.maximum(y - back(apply(y) - goal) / (rate * 1.05), 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def plan(counts: np.ndarray, length: int = LENGTH) -> Bins:
    """Fitted patterns, their repeat counts rounded and kept within the histogram, then the residual by best fit."""
    counts = np.asarray(counts, np.int64)
    chosen = patterns(counts, length)
    left, used, carry = counts.copy(), [], 0.0
    if chosen:
        x = fit_counts(chosen, counts)
        # what rounding down takes from one pattern is carried to the next, so that as many sequences are made as were fitted
        for i in sorted(range(len(chosen)), key=lambda i: (-x[i], chosen[i])):
            sizes, times = np.unique(chosen[i], return_counts=True)
            carry += x[i]
            n = min(int(carry + 1e-6), int((left[sizes] // times).min()))
            if n > 0:
                carry -= n
                left[sizes] -= n * times
                used.append((chosen[i], n))
            carry = min(carry, 1.0)
    return used + best_fit(left, length)


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset: gapless sequences of at most `length` tokens.

    Pieces of a length are ranked by hash bucket, then doc_id, piece and
    checksum; the histogram (`length` bins) is all that the driver sees.
    Repeated rows are pieces of their own, null ids are ids like others, an
    empty table gives none, and other columns of pieces are ignored.
    """
    counts = np.zeros(length + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    slots, base = [], 0
    for pattern, n in plan(counts, length):
        offset = 0
        for size in pattern:
            slots.append((size, n, base, offset))
            offset += size
        base += n
    slots.sort(key=lambda s: s[0])
    table_ = np.array(slots, np.int64).reshape(-1, 4)
    # first rank of each slot within its length, and one sorted key of length and rank
    before = np.cumsum(table_[:, 1]) - table_[:, 1]
    at = np.searchsorted(table_[:, 0], table_[:, 0])
    rank0 = before - before[at] if len(table_) else before
    key = table_[:, 0].astype(np.float64) * 2.0**40 + rank0

    buckets = F.element_at(F.lit([1 + int(n) // ROWS_PER_BUCKET for n in counts]), F.col("length").cast("int") + 1)
    hashed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets))
    sums = hashed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    begins = sums.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("begin"))
    ranked = hashed.join(begins, ["length", "bucket"]).withColumn("rank", F.col("begin") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)

    @task("packing", word_ids.cache_clear)
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            i = np.searchsorted(key, size.astype(np.float64) * 2.0**40 + rank, "right") - 1
            yield pa.record_batch([*[batch.column(c) for c in OWN], pa.array(table_[i, 2] + rank - rank0[i]), pa.array(table_[i, 3])], [*OWN, "sequence_id", "offset"])

    OWN = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*OWN, "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Tokenises docs once, keeps the pieces (a few numbers each), and packs them; odd rows as in token_pieces and pack.

    cache_words bounds a worker's memory only.
    """
    return pack(settle(token_pieces(docs, path, length, cache_words)), length)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
