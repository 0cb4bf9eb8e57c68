"""Token counts by rank-synchronous merging of ragged symbol arrays (byte-level BPE).

Pre-tokens of a batch are laid out in one flat symbol array with sequence
bounds. In every step each sequence applies its own lowest-ranked pair at all
of its places at once; sequences without a known pair leave the array, and
what they have left is their count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import table
from .textkit import chunks, task

#: The pre-token pattern of the byte-level vocabulary (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pre-tokens of at most so many characters are remembered by a worker, and so many of them.
CACHED_CHARS, CACHE_SIZE = 64, 400_000
#: Symbols merged at once.
SYMBOLS = 1 << 20
NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class RankMerger:
    """Counts the symbols that byte-level BPE leaves of pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in spec["model"]["merges"]]
        self.width = max(vocabulary.values()) + 1
        self.bytes = np.array([vocabulary[c] for c in byte_symbols()], np.int64)
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.splitter = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.cache: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each byte string; empty ones leave none."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        left = lengths.copy()
        live = np.flatnonzero(lengths)
        symbols = self.bytes[np.frombuffer(b"".join(tokens), np.uint8)]
        sizes = lengths[live]
        ranks = np.full(len(symbols), NONE)
        if len(symbols):
            ranks[:-1] = self._rank(symbols[:-1], symbols[1:])
        while len(live):
            starts = np.cumsum(sizes) - sizes
            ranks[starts + sizes - 1] = NONE
            lowest = np.minimum.reduceat(ranks, starts)
            if (done := lowest == NONE).any():
                left[live[done]] = sizes[done]
                keep = np.repeat(~done, sizes)
                symbols, ranks = symbols[keep], ranks[keep]
                live, sizes, lowest = live[~done], sizes[~done], lowest[~done]
                if not len(live):
                    break
            hit = np.flatnonzero((ranks == np.repeat(lowest, sizes)) & (ranks != NONE))
            first = np.r_[True, np.diff(hit) != 1]  # a pair of equal symbols can overlap itself: every second place counts
            hit = hit[(np.arange(len(hit)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            owner = np.repeat(np.arange(len(live)), sizes)[hit]
            symbols[hit] = self.made[ranks[hit]]
            gone = np.zeros(len(symbols), bool)
            gone[hit + 1] = True
            kept = ~gone
            symbols, ranks = symbols[kept], ranks[kept]
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            at = hit - np.arange(len(hit))
            for near in (at, at - 1):
                near = near[(near >= 0) & (near + 1 < len(symbols))]
                ranks[near] = self._rank(symbols[near], symbols[near + 1])
            ranks[-1] = NONE
        return left

    def learn(self, tokens: list[str], into: dict[str, int]) -> None:
        at = 0
        coded = [t.encode() for t in tokens]
        while at < len(coded):
            to, size = at, 0
            while to < len(coded) and (to == at or size + len(coded[to]) <= SYMBOLS):
                size += len(coded[to])
                to += 1
            into.update(zip(tokens[at:to], self.merge(coded[at:to]).tolist(), strict=True))
            at = to

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings in it are one token each."""
        parts, extra = [], []
        for text in texts:
            pieces = self.splitter.split(text) if self.splitter else [text]
            extra.append(len(pieces) - 1)
            parts.append(self.pattern.findall(pieces[0]) if len(pieces) == 1 else list(chain.from_iterable(map(self.pattern.findall, pieces))))
        new = set().union(*parts).difference(self.cache) if parts else set()
        if len(self.cache) + len(new) > CACHE_SIZE:
            self.cache.clear()
            new = set().union(*parts)
        long = [t for t in new if len(t) > CACHED_CHARS]
        self.learn(sorted(new.difference(long)), self.cache)
        if long:
            known: dict[str, int] = {}
            self.learn(sorted(long), known)
            return [sum(known[t] if len(t) > CACHED_CHARS else self.cache[t] for t in p) + e for p, e in zip(parts, extra, strict=True)]
        get = self.cache.__getitem__
        return [sum(map(get, p)) + e for p, e in zip(parts, extra, strict=True)]


@lru_cache(2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokens of every whole text: one row per row of docs.

    Null texts count as empty (no bytes, no tokens); repeated rows give
    repeated results; an empty table gives none; other columns of docs are
    ignored. `path` is a tokenizer file that every machine has.
    """

    @task("token_counts", merger.cache_clear)
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                tokens = np.array(merger(path).count(texts), np.int64)
                sizes = [len(t.encode()) for t in texts]
                yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
