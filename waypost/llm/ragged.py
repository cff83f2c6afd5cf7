"""Arrays of many texts at once: bytes, words and their hashes, held as flat numpy arrays with offsets.

Work inside a task goes over blocks of a few megabytes (a longer text makes a block of its own), so that
memory follows the block and not the partition.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 3_000_000
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
#: The separators between words, and the letters that are lower-cased.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, over all its tasks.

    Task functions travel by value, so their own module's globals begin anew with each task.
    """
    return sys.modules.setdefault("_waypost_worker", types.ModuleType("_waypost_worker")).__dict__


def latest(kind: str, body: bytes, make):
    """make(body), kept in the Python worker until it needs another model or file; it holds one at a time."""
    cache, key = worker_cache(), (kind, hashlib.sha1(body).digest())
    if cache.get("latest", (None,))[0] != key:
        if cache.pop("latest", None) is not None:
            give_back()
        cache["latest"] = (key, make(body))
    return cache["latest"][1]


def give_back() -> None:
    """Return freed memory to the system; else a worker that later tasks use again keeps the largest it ever had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def tidy(function):
    """A function over batches that gives freed memory back when its task ends."""

    def run(batches):
        yield from function(batches)
        give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, n of each at least."""
    cache = worker_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 64)
        inverse = pow(MULTIPLIER, -1, 2**64)
        pair = []
        for base in (MULTIPLIER, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        have = tuple(pair)
        if size <= 2 * BLOCK_BYTES:
            cache["powers"] = have
    return have


class Hasher:
    """Hashes of any slices of an array of small integers, from one pass over it."""

    def __init__(self, values: np.ndarray):
        forward, self.inverse = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * forward[: len(values)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES):
    """Ranges of texts whose bytes stay about under `size`."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z, leaving all other bytes."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true within each text, and the text of each run."""
    n = len(mask)
    edge = np.zeros(n + 1, bool)
    inner = offsets[(offsets > 0) & (offsets < n)]
    edge[inner] = True
    begins = mask & ~np.concatenate(([False], mask[:-1])) | mask & edge[:n]
    ends = mask & ~np.concatenate((mask[1:], [False])) | mask & edge[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words between white space (the six ASCII separators) of each text."""
    is_word = np.ones(256, bool)
    is_word[list(SPACE_BYTES)] = False
    return runs(is_word[data], offsets)


def spans(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length in turn."""
    total = int(lengths.sum())
    begins = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(begins, lengths)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices [start, start + length) of an array, one after the other."""
    return values[np.repeat(starts, lengths) + spans(lengths)]


def sums_by(labels: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(labels, weights, n) if len(labels) else np.zeros(n)
