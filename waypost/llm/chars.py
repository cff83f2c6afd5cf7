"""Characters of many texts at once: classes, words and pre-tokens over flat arrays of code points."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import regex

from waypost.llm.ragged import Hasher, runs, worker_cache

OTHER, LETTER, NUMBER, SPACE, MARK = 0, 1, 2, 3, 4
#: The characters with the White_Space property.
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe as a contraction.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


def class_table() -> np.ndarray:
    """The class of every code point: letter, number, white space, combining mark or other."""
    cache = worker_cache()
    if "classes" not in cache:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{M}", MARK)):
            found = np.array([ord(c) for c in regex.findall(pattern, every)])
            # Beyond plane 1 the two libraries' tables differ in code points that Python's leave unassigned.
            known = [i < 0x20000 or unicodedata.category(chr(i)) != "Cn" for i in found]
            table[found[known]] = kind
        table[list(WHITE)] = SPACE
        cache["classes"] = table
    return cache["classes"]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the offsets of the texts."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def text_blocks(texts: list[str], size: int = 2_000_000):
    """Ranges of texts of about `size` characters; a longer text makes a block of its own."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


def pre_tokens(cp: np.ndarray, offsets: np.ndarray, *, lead_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the pre-tokens.

    With `lead_space`, as the byte-level pattern splits: a blank goes with what follows it, runs of numbers stay
    together and the rest of the white space is kept. Without, white space is dropped and each number stands alone.
    """
    n = len(cp)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    kind = class_table()[cp]
    kind = np.where(kind == MARK, OTHER, kind).astype(np.uint8)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first[:n]
    last = np.append(change[1:], True)  # the last character of a run

    start = change.copy()
    attached = np.zeros(n, bool)  # a blank stands before this run and goes with it
    if lead_space:
        tail = np.flatnonzero((kind == SPACE) & last & ~first[1 : n + 1])  # white space before something else
        start[tail] = True
        blank = tail[cp[tail] == 0x20]
        start[blank + 1] = False
        attached[blank + 1] = True
    else:
        start |= kind == NUMBER
    quote = np.flatnonzero((cp == 0x27) & change & last & ~attached & ~first[1 : n + 1])
    quote = quote[kind[quote + 1] == LETTER]
    after = quote + 1
    short = np.isin(cp[after], [ord(c) for c in SHORT_ENDINGS])
    second = np.minimum(after + 1, n - 1)
    joined = (after + 1 < n) & ~change[second]
    long = np.zeros(len(after), bool)
    for a, b in LONG_ENDINGS:
        long |= (cp[after] == ord(a)) & (cp[second] == ord(b)) & joined
    size = np.where(short, 1, np.where(long, 2, 0))
    hit = size > 0
    start[after[hit]] = False
    rest = after[hit] + size[hit]
    start[rest[rest < n]] = True

    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    if not lead_space:
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def letter_words(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the runs of letters and the marks on them that hold a letter."""
    kind = class_table()[cp]
    starts, ends, text = runs((kind == LETTER) | (kind == MARK), offsets)
    letters = np.concatenate(([0], np.cumsum(kind == LETTER)))
    keep = letters[ends] > letters[starts]
    return starts[keep], ends[keep], text[keep]


def distinct(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For slices of an array: the code of each, the hash of each distinct one and where it first stands."""
    codes, found = pd.factorize(Hasher(cp)(starts, ends))
    where = np.full(len(found), len(codes), np.int64)
    np.minimum.at(where, codes, np.arange(len(codes)))
    return codes, np.asarray(found, np.uint64), where
