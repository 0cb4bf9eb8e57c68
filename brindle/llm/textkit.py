"""Vectorised byte-level text kernels shared by the corpus operators.

Everything works on Arrow string columns without building Python strings: a
column is a UTF-8 buffer with row offsets, words are byte ranges in it, and
words and runs of words are hashed in a few vector steps.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lanes of eight bytes up to which words are hashed as vectors, and masks of the bytes of a lane that belong to a word.
LANES = 16
MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Bytes of text handled at once: temporaries take some twenty times as much.
CHUNK_BYTES = 1 << 20

_BYTES = np.arange(256)
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, meant for lower-cased text.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: Lower-cases A-Z only.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


_held: dict[str, Callable[[], None]] = {}


def _trim() -> None:
    """Gives memory that is free in this worker back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _begin(owner: str, clear: Callable[[], None] | None) -> None:
    for name in [n for n in _held if n != owner]:
        _held.pop(name)()
    if clear:
        _held[owner] = clear


def task(owner: str, clear: Callable[[], None] | None = None) -> Callable:
    """Marks a function over batches as work of `owner`: a worker keeps the caches of one operator only, and no free memory.

    Workers outlive tasks, so what an operator has cached (`clear` empties it)
    would else stay beside what the next ones need.
    """

    def mark(work: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _begin(owner, clear)
            try:
                yield from work(batches)
            finally:
                _trim()

        return run

    return mark


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(16)
def _keys(seed: int) -> np.ndarray:
    """Odd multipliers and offsets of one hash function."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of each run of k consecutive word hashes (len - k + 1 of them, rows not told apart).

    Runs of 1, 2, 4, ... words are joined pairwise, each join ending in a
    non-linear mix, so no pattern of words collides by construction.
    """
    if len(words) < k or k < 1:
        return words[:0]
    times, made, size, held, done = _keys(seed + 1000), None, 0, words, 1
    while True:
        if k & done:
            made = held if made is None else _join(held[: len(held) - size], made[done:], times)
            size += done
        done *= 2
        if done > k:
            return mix(made ^ np.uint64(int(times[3]) * k % (1 << 64)))
        half = done // 2
        held = _join(held[: len(held) - half], held[half:], times)


def _join(a: np.ndarray, b: np.ndarray, times: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    return mix(a[:n] * times[0] + (b[:n] ^ times[1]))


class Words:
    """The words of some rows: byte ranges [start, end), and first[i]:first[i + 1] are row i's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, mask: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        mask = inside[data] if mask is None else mask
        if len(data):
            rows = offsets[:-1][offsets[:-1] < len(data)]
            begins = mask.copy()
            begins[1:] &= ~mask[:-1]
            begins[rows] = mask[rows]
            ends = mask.copy()
            ends[:-1] &= ~mask[1:]
            last = offsets[1:] - 1
            last = last[last >= 0]
            ends[last] = mask[last]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, seed: int) -> np.ndarray:
        """A hash of each word: its bytes in lanes of eight, each mixed in; blake2b of words over LANES lanes."""
        times, at = _keys(seed), self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        left = self.end - self.start
        out = mix(left.astype(np.uint64) * times[0] + times[1])
        key = int(times[2]).to_bytes(8, "little")
        for i in np.flatnonzero(left > 8 * LANES).tolist():
            out[i] = int.from_bytes(blake2b(padded[at[i] : self.end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
        live = slice(None) if len(left) == 0 or left.max() <= 8 * LANES else np.flatnonzero(left <= 8 * LANES)
        at, left, held = at[live], left[live], out[live]
        kept: list[np.ndarray] = []
        while True:
            held = mix((held ^ (lanes[at] & MASKS[np.minimum(left, 8)])) * times[2] + times[3])
            more = np.flatnonzero(left > 8)
            kept.append(held)
            if not len(more):
                break
            kept.append(more)
            at, left, held = at[more] + 8, left[more] - 8, held[more]
        held = kept.pop()
        while kept:  # later lanes' hashes go back to their words
            more, before = kept.pop(), kept.pop()
            before[more] = held
            held = before
        out[live] = held
        return out

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of k words that lie within a row, and the rows they belong to."""
        rows = np.repeat(np.arange(len(self.counts)), np.maximum(self.counts - k + 1, 0))
        before = np.cumsum(np.maximum(self.counts - k + 1, 0)) - np.maximum(self.counts - k + 1, 0)
        return np.arange(len(rows)) - before[rows] + self.first[rows], rows


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and its len + 1 row offsets; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each, and at least one row."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values (len - width + 1 of them)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    full = -(-len(values) // width) * width
    padded = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
