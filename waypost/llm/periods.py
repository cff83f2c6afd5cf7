"""Runs of repeated words: maximal stretches with a period, found by internal pattern matching.

A text's words become numbers. Ranks of all substrings of 1, 2, 4, 8, ... words come from prefix doubling; the last
ranks are the suffix array, and those of one length give each substring's interval in it. Every dyadic block of words
(beginning at a multiple of 2**k, with the block after it) asks for its next occurrence to the right: the range
successor of its place among the positions in its interval, from a wavelet matrix over the suffix array. Where that
lies within the block's own length the occurrences in the window are one progression, and its step is the candidate
period. A run of period q and at least four times its length holds, with 2**k <= q < 2**(k+1), a block of its first
words whose next occurrence is q words on, so no run is missed. Candidates grow to both sides by the ranks, from the
longest length down, and are kept if they are long enough; of one stretch the smallest period counts.

All texts of a block are worked on at once as numpy arrays. Texts in which no four words occur again near enough have
no run and are left out before (equal hashes of four words only let a text in). Memory is about 200 bytes for each
word of a block, and of a longer text alone.

Defined cases: a null, empty or blank text has no words and no run; a null doc_id counts as empty text in its
checksum; repeated rows are judged alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.llm.ragged import mix, spans, text_bytes

#: Words of a run at least, and how many times its period it must be long.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Bytes of texts that are worked on at once.
BLOCK = 2_000_000


class Words(dict):
    """Numbers of words, in the order of their first use."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def rank_tables(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the substrings of 1, 2, 4, ... words from each position (within its text), and the suffix array.

    A rank is the number of smaller substrings, so it is where the substring's interval begins. A level of length h is
    only made where substrings of h / 2 words are still alike.
    """
    n = len(ids)
    order = np.lexsort((ids, doc))
    rank = np.empty(n, np.int64)

    def renumber(where: np.ndarray, base: np.ndarray, second: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """New ranks of positions in the order of (base rank, second)."""
        fresh = np.append(True, (base[1:] != base[:-1]) | (second[1:] != second[:-1]))
        first = np.append(True, base[1:] != base[:-1])
        at = np.arange(len(where))
        group = np.maximum.accumulate(np.where(first, at, 0))
        rank[where] = base + np.maximum.accumulate(np.where(fresh, at, 0)) - group
        alone = fresh & np.append(fresh[1:], True)
        return where[~alone]

    change = np.append(True, (doc[order][1:] != doc[order][:-1]) | (ids[order][1:] != ids[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    active = order[~(change & np.append(change[1:], True))]
    levels, h = [rank.astype(np.int32)], 1
    while len(active):
        follow = active + h
        inside = follow < ends[active]
        second = np.where(inside, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[active] * np.int64(n + 2) + second
        by = np.argsort(key, kind="stable")
        rank = rank.copy()
        active = renumber(active[by], levels[-1][active[by]].astype(np.int64), second[by], rank)
        levels.append(rank.astype(np.int32))
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return levels, suffixes


class WaveletMatrix:
    """Bits of a sequence of distinct numbers, highest first; each level deals the numbers by its bit, keeping order."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.bits = max(1, int(n - 1).bit_length())
        self.zeros, self.ones = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def successor(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value above `bound` among places left to right - 1 of the sequence; -1 where there is none.

        The number of values up to the bound is counted level by level; the value of that rank is then looked up.
        """
        limit = bound + 1
        a, b = left.astype(np.int64), right.astype(np.int64)
        below = np.zeros(len(a), np.int64)
        over = limit >= (1 << self.bits)
        for i in range(self.bits):
            ones, zeros = self.ones[i], self.zeros[i]
            one_a, one_b = ones[a].astype(np.int64), ones[b].astype(np.int64)
            set_bit = ((limit >> (self.bits - 1 - i)) & 1) == 1
            below += np.where(set_bit, (b - a) - (one_b - one_a), 0)
            a, b = np.where(set_bit, zeros + one_a, a - one_a), np.where(set_bit, zeros + one_b, b - one_b)
        size = (right - left).astype(np.int64)
        none = over | (below >= size)
        k = np.where(none, 0, below)
        a, b = left.astype(np.int64), right.astype(np.int64)
        value = np.zeros(len(a), np.int64)
        for i in range(self.bits):
            ones, zeros = self.ones[i], self.zeros[i]
            one_a, one_b = ones[a].astype(np.int64), ones[b].astype(np.int64)
            low = (b - a) - (one_b - one_a)
            up = k >= low
            value = value * 2 + up
            k = np.where(up, k - low, k)
            a, b = np.where(up, zeros + one_a, a - one_a), np.where(up, zeros + one_b, b - one_b)
        return np.where(none, -1, value)


def extend(levels: list[np.ndarray], ends: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words the stretches from a and from b > a have in common: to the right (from a, b on), and to the left before them.

    No two positions are alike at the last level, so each level counts once at most.
    """
    right, left = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    end, start = ends[b], starts[a]
    for level in range(len(levels) - 1, -1, -1):
        rank, h = levels[level], 1 << level
        x, y = a + right, b + right
        fits = y + h <= end
        same = fits & (rank[np.where(fits, x, 0)] == rank[np.where(fits, y, 0)])
        right += np.where(same, h, 0)
        x, y = a - left - h, b - left - h
        fits = x >= start
        same = fits & (rank[np.where(fits, x, 0)] == rank[np.where(fits, y, 0)])
        left += np.where(same, h, 0)
    return right, left


def near_again(ids: np.ndarray, doc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Texts in which four words occur again within a quarter of the text: only these can hold a run."""
    n = len(ids)
    keep = np.zeros(len(lengths), bool)
    if n < LEAST_WORDS:
        return keep
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    four = h[:-3] + mix(h[1:-2] + np.uint64(11)) + mix(h[2:-1] + np.uint64(23)) + mix(h[3:] + np.uint64(37)) + mix(doc[:-3].astype(np.uint64) + np.uint64(41))
    inside = np.flatnonzero(doc[:-3] == doc[3:])
    by = inside[np.argsort(four[inside], kind="stable")]
    again = four[by][1:] == four[by][:-1]
    gap = by[1:] - by[:-1]
    owner = doc[by[1:]]
    found = again & (LEAST_TIMES * gap <= lengths[owner]) & (doc[by[:-1]] == owner)
    keep[owner[found]] = True
    return keep


def find_runs(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start (in the text), length and smallest period of all runs, by text, start and period.

    `ids` holds the words of all texts, one after the other, `lengths` their numbers.
    """
    none = np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    chosen = near_again(ids, doc, lengths)
    if not chosen.any():
        return none, none, none, none
    ids, names, lengths = ids[chosen[doc]], np.flatnonzero(chosen), lengths[chosen]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    begins = np.cumsum(lengths) - lengths
    starts, ends = np.repeat(begins, lengths), np.repeat(begins + lengths, lengths)
    levels, suffixes = rank_tables(ids, doc, ends)
    wavelet = WaveletMatrix(suffixes)
    place = spans(lengths)
    at, period = [], []
    k = 0
    while (LEAST_TIMES << k) <= int(lengths.max()):
        level = max(2, k + 1)  # blocks of at least four words
        if level >= len(levels):
            break  # all longer substrings are unlike
        size = 1 << level
        b = np.flatnonzero((place & ((1 << k) - 1)) == 0)
        b = b[(b + size <= ends[b]) & (LEAST_TIMES << k <= lengths[doc[b]])]
        left = levels[level][b].astype(np.int64)
        counts = np.bincount(levels[level], minlength=len(ids) + 1)
        right = left + counts[left]
        several = right - left > 1
        b, left, right = b[several], left[several], right[several]
        if len(b):
            following = wavelet.successor(left, right, b)
            step = following - b
            good = (following >= 0) & (step < size)
            at.append(b[good])
            period.append(step[good])
        k += 1
    if not at:
        return none, none, none, none
    at, period = np.concatenate(at), np.concatenate(period)
    more, less = extend(levels, ends, starts, at, at + period)
    first, length = at - less, less + period + more
    fit = (length >= LEAST_WORDS) & (length >= LEAST_TIMES * period)
    first, length, period = first[fit], length[fit], period[fit]
    by = np.lexsort((period, length, first))
    first, length, period = first[by], length[by], period[by]
    new = np.append(True, (first[1:] != first[:-1]) | (length[1:] != length[:-1])) if len(by) else np.zeros(0, bool)
    first, length, period = first[new], length[new], period[new]
    by = np.lexsort((period, first))
    first, length, period = first[by], length[by], period[by]
    return names[doc[first]], place[first], length, period


def best_run(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run with the greatest length / period, exactly; of equal ones the first, then that of the smallest period."""
    best = 0
    for i in range(1, len(start)):
        a, b = int(length[i]) * int(period[best]), int(length[best]) * int(period[i])
        if a > b or a == b and (start[i], period[i]) < (start[best], period[best]):
            best = i
    return best


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that some run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:-1]) > 0


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """Every tenth text by checksum, with its words from some place on replaced by repetitions of the first of them."""
    n = len(words)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def collapse(texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Per text (a list of words): its runs as (start, length, period), and the words that are kept, joined by one blank."""
    number = Words()
    lengths = np.array([len(w) for w in texts], np.int64)
    ids = np.concatenate([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in texts]) if texts else np.zeros(0, np.int64)
    doc, start, length, period = find_runs(ids, lengths)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    found = []
    for i, words in enumerate(texts):
        a, b = cuts[i], cuts[i + 1]
        runs = list(zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()))
        if runs:
            gone = dropped(len(words), start[a:b], length[a:b], period[a:b])
            words = [words[j] for j in np.flatnonzero(~gone).tolist()]
        found.append((runs, b" ".join(words)))
    return found


FIELDS = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
DIGEST = (
    "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
)


def text_ranges(sizes: np.ndarray):
    """Ranges of texts of about BLOCK bytes; a longer one is a range of its own."""
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > BLOCK:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def over_texts(docs: DataFrame, schema: str, prepare: Callable, finish: Callable) -> DataFrame:
    """doc_id and what `finish` makes of the runs of each text's words, after `prepare`."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches):
        for batch in batches:
            keys = batch.column("doc_id")
            data, offsets = text_bytes(batch.column("_text"))
            for a, b in text_ranges(np.diff(offsets)):
                ids = keys.slice(a, b - a).to_pylist()
                # bytes.split() parts at blank, tab, line feed, vertical tab, form feed and return, the six separators.
                texts = [prepare(data[offsets[i] : offsets[i + 1]].tobytes().split(), ids[i - a]) for i in range(a, b)]
                columns = finish(collapse(texts))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), *columns], ["doc_id", *[f.split(" ")[0] for f in schema.split(", ")]])

    return docs.select("doc_id", F.col("text").cast("string").alias("_text")).mapInArrow(work, f"doc_id {kind}, {schema}")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and the text without repetitions, for every row."""

    def finish(found):
        runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r, _ in found]
        return [pa.array(runs, pa.list_(RUN)), pa.array([text.decode() for _, text in found], pa.string())]

    return over_texts(docs, FIELDS, lambda words, _: words, finish)


def run_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and the digests of all runs and of the collapsed text, with planted runs."""

    def finish(found):
        rows = []
        for runs, text in found:
            best = (None, None, None, None)
            if runs:
                s, n, p = runs[best_run(*np.array(runs, np.int64).T)]
                best = (s, n, p, 1000 * n // p)
            lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            rows.append((len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
        columns = list(zip(*rows))
        return [pa.array(c, pa.string() if i > 4 else pa.int64()) for i, c in enumerate(columns)]

    return over_texts(docs, DIGEST, planted, finish)
