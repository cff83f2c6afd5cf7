"""Token counts of a BPE tokenizer with word ends, by merging many words at once.

The distinct pre-tokens of a block of texts are cut where no merge can span (between two bytes that no merge has as the
last of its left and the first of its right part); the pieces are held as one ragged array of symbols. In every round
all occurrences of each piece's lowest rank (from the left, without overlap) are merged in one step over the whole
array, and the ranks beside them are looked up again; pieces without a pair drop out. This equals merging one pair at a time
because a merge only makes pairs of higher rank, which is checked when the file is read; for a file where that
fails each word merges its leftmost pair alone.

Defined cases: a null or empty text has no tokens; strings of special tokens inside a text count as one token each;
rows that repeat are counted alike; other columns are ignored unless carried; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.llm.bpe_files import byte_symbols, read_file
from waypost.llm.chars import code_points, distinct, pre_tokens, text_blocks
from waypost.llm.common import in_batches
from waypost.llm.ragged import gather, latest, spans, sums_by

LIMIT = 2048
#: Lower case of letters newer than Python's tables, and sigma, whose form at a word's end is not taken.
LOWER = {"\ua7cb": "\u0264", "\ua7dc": "\u019b", "\u03a3": "\u03c3"}


class MergeTable:
    """Ranks and results of symbol pairs, sorted by the pair."""

    def __init__(self, body: bytes):
        spec = json.loads(body)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        known = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and self.suffix
        plain = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
        if model["type"] != "BPE" or not known or not plain:
            raise ValueError("the file is not a lower-casing BPE vocabulary with word ends")
        vocab = model["vocab"]
        symbols = {b: c for c, b in byte_symbols().items()}
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[symbols[b] + self.suffix] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = len(vocab) + 1
        ranks = np.arange(len(pairs))
        order = np.argsort(left * self.size + right)
        self.keys, self.ranks, self.made = (left * self.size + right)[order], ranks[order], made[order]
        latest_making = np.full(self.size, -1, np.int64)
        np.maximum.at(latest_making, made, ranks)
        self.rising = bool(np.all(ranks > latest_making[left]) and np.all(ranks > latest_making[right]))
        self.spanned = np.zeros((256, 256), bool)
        byte = byte_symbols()
        for a, b in pairs:
            self.spanned[byte[a[-1]], byte[b[0]]] = True
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def look(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        hit = self.keys[at] == pairs
        return np.where(hit, self.ranks[at], np.iinfo(np.int64).max), at

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols that survive in each word, a slice of UTF-8 bytes of at least one byte."""
        sizes = ends - starts
        body = gather(data, starts, sizes)
        symbols = self.inner[body]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[body[last]]
        first = np.zeros(len(body), bool)
        first[1:] = ~self.spanned[body[:-1], body[1:]]
        first[np.cumsum(sizes) - sizes] = True
        cuts = np.flatnonzero(first)
        lengths = np.diff(np.append(cuts, len(body)))
        found = self.merged(symbols, lengths)
        return np.add.reduceat(found, np.searchsorted(cuts, np.cumsum(sizes) - sizes))

    def merged(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols that survive in each of consecutive pieces."""
        result = lengths.astype(np.int64).copy()
        pieces = np.flatnonzero(lengths > 1)
        symbols, lengths = symbols[np.repeat(lengths > 1, lengths)], lengths[pieces]
        never = np.iinfo(np.int64).max
        rank, at = self.look(symbols * self.size + np.append(symbols[1:], 0)) if len(symbols) else (symbols, symbols)
        rank[np.cumsum(lengths) - 1] = never  # no pair goes over a piece's end
        while len(pieces):
            begins = np.cumsum(lengths) - lengths
            low = np.minimum.reduceat(rank, begins)
            go = low < never
            result[pieces[~go]] = lengths[~go]
            if not go.all():
                keep = np.repeat(go, lengths)
                symbols, rank, at = symbols[keep], rank[keep], at[keep]
                pieces, lengths, low = pieces[go], lengths[go], low[go]
                begins = np.cumsum(lengths) - lengths
            if not len(pieces):
                break
            where = np.flatnonzero(rank == np.repeat(low, lengths))
            if self.rising:
                fresh = np.append(True, np.diff(where) > 1)
                where = where[(spans(np.diff(np.append(np.flatnonzero(fresh), len(where)))) & 1) == 0]
            else:
                piece = np.searchsorted(begins, where, side="right") - 1
                where = where[np.append(True, np.diff(piece) > 0)]
            symbols[where] = self.made[at[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            lengths = lengths - np.bincount(np.searchsorted(begins, where, side="right") - 1, minlength=len(lengths))
            symbols, rank, at = symbols[keep], rank[keep], at[keep]
            now = where - np.arange(len(where))  # where the merged symbols stand now
            changed = np.concatenate((now, np.maximum(now - 1, 0)))
            after = symbols[np.minimum(changed + 1, len(symbols) - 1)]
            rank[changed], at[changed] = self.look(symbols[changed] * self.size + after)
            rank[np.cumsum(lengths) - 1] = never
        return result


def segments(texts: list[str], table: MergeTable) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Normalised pieces between special tokens, the text of each, and the special tokens in each text."""
    parts, owner, special = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        pieces = [text]
        if table.pattern is not None and any(s in text for s in table.special):
            pieces = table.pattern.split(text)
            special[i] = len(pieces) - 1
        for piece in pieces:
            piece = unicodedata.normalize("NFC", piece)
            if not piece.isascii():
                for upper, lower in LOWER.items():
                    piece = piece.replace(upper, lower)
            parts.append(piece.lower())
            owner.append(i)
    return parts, np.array(owner, np.int64), special


def count_block(texts: list[str], table: MergeTable) -> np.ndarray:
    parts, owner, totals = segments(texts, table)
    cp, offsets = code_points(parts)
    starts, ends, part = pre_tokens(cp, offsets, lead_space=False)
    if not len(starts):
        return totals
    codes, _, where = distinct(cp, starts, ends)
    starts, ends = starts[where], ends[where]
    body = gather(cp, starts, ends - starts)
    wide = 1 + (body > 0x7F).astype(np.int64) + (body > 0x7FF) + (body > 0xFFFF)
    cuts = np.concatenate(([0], np.cumsum(np.add.reduceat(wide, np.cumsum(ends - starts) - (ends - starts)))))
    data = np.frombuffer(body.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    counts = table.counts(data, cuts[:-1], cuts[1:])
    return totals + sums_by(owner[part], counts[codes], len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, tokenizer: str, *, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the carried columns and n_tokens for every row (doc_id, text)."""
    body = read_file(tokenizer)
    kept = list(dict.fromkeys(["doc_id", *carry]))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def count(batches):
        for batch in batches:
            table = latest("merges", body, MergeTable)
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            found = [count_block(texts[a:b], table) for a, b in text_blocks(texts)]
            n = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(n, pa.int64())], [*kept, "n_tokens"])

    schema = ", ".join(f"`{c}` {fields[c]}" for c in kept) + ", n_tokens bigint"
    return in_batches(docs.select(*kept, F.col("text").cast("string").alias("_text"))).mapInArrow(count, schema)
