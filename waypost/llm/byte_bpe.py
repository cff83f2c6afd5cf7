"""Byte-level BPE encoding and decoding by DuckDB queries inside each task.

The distinct pre-tokens of a block of texts become rows (word, start, end, symbol); places are counted over all words
of a query, with a gap after each word. A recursive query joins each symbol and its follower with the merge table,
finds every word's leftmost pair of minimum rank and contracts it, until no word has a pair left; ordered aggregation
turns the last rows of a word into its ids and, joined with the vocabulary, back into its bytes. Spark spreads the
texts over tasks; a worker keeps what it has encoded up to a bounded number of words.

A word of more than LONG_WORD bytes (a run without white space) would take a round per contraction. It is cut where no
merge can span: between two bytes that no merge has as the last of its left and the first of its right part. The
pieces are words of their own, whose ids are joined. A piece that is still longer (a letter repeated, or long text of
a script without blanks) goes through a loop over one table, which contracts all occurrences of the minimum rank at
once wherever no pair that this makes could come before them, and the leftmost alone otherwise; the ids are the same.

Defined cases: a null or empty text has no ids and decodes to nothing; strings of special tokens are plain text;
rows that repeat are encoded alike; other columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.llm.bpe_files import read_file, read_ranks
from waypost.llm.chars import code_points, distinct, pre_tokens, text_blocks
from waypost.llm.common import in_batches
from waypost.llm.ragged import latest, spans

LONG_WORD = 200
#: Words in one query, and words that a worker remembers.
CHUNK, REMEMBERED = 20_000, 400_000

RECURSION = """
WITH RECURSIVE sym(w, s, e, id, step) AS (
  SELECT w, s, s + 1, id, 0 FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT a.w, a.s, a.e, b.e AS e2, m.made, (m.made::BIGINT << 32) + a.s AS rank
     FROM sym a JOIN sym b ON a.e = b.s JOIN merges m ON m.l = a.id AND m.r = b.id),
   first AS (SELECT w, min(rank) & 4294967295 AS s, (min(rank) >> 32)::INT AS id, arg_min(e, rank) AS gone, arg_min(e2, rank) AS e FROM pairs GROUP BY w)
   SELECT a.w, a.s, CASE WHEN a.s = f.s THEN f.e ELSE a.e END, CASE WHEN a.s = f.s THEN f.id ELSE a.id END, a.step + 1
   FROM sym a JOIN first f ON a.w = f.w WHERE a.s <> f.gone)),
done AS (SELECT w, s, id FROM sym JOIN (SELECT w, max(step) AS step FROM sym GROUP BY w) USING (w, step))
SELECT w, string_agg(id::VARCHAR, ',' ORDER BY s) AS ids, count(*) AS n, string_agg(hex, '' ORDER BY s) AS bytes
FROM done JOIN vocabulary USING (id) GROUP BY w ORDER BY w"""

#: One round over the table `sym` of long words: all contractions that are sure, per word.
ROUND = """
CREATE OR REPLACE TEMP TABLE hits AS
WITH pairs AS (
  SELECT a.w, a.s, a.e, b.e AS e2, m.made
  FROM sym a JOIN sym b ON a.w = b.w AND a.e = b.s JOIN merges m ON m.l = a.id AND m.r = b.id),
low AS (SELECT w, min(made) AS made FROM pairs GROUP BY w),
same AS (
  SELECT p.*, coalesce(lag(p.e) OVER (PARTITION BY p.w ORDER BY p.s), -1) <> p.s AS fresh FROM pairs p JOIN low USING (w, made)),
turns AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY w ORDER BY s) AS island FROM same),
chosen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, island ORDER BY s) AS turn FROM turns) WHERE turn % 2 = 1),
early AS (
  SELECT DISTINCT c.w
  FROM chosen c
  LEFT JOIN sym p ON p.w = c.w AND p.e = c.s LEFT JOIN merges x ON x.l = p.id AND x.r = c.made
  LEFT JOIN sym n ON n.w = c.w AND n.s = c.e2 LEFT JOIN merges y ON y.l = c.made AND y.r = n.id
  LEFT JOIN merges z ON z.l = c.made AND z.r = c.made
  WHERE x.made < c.made OR y.made < c.made OR z.made < c.made)
SELECT w, s, e AS gone, e2 AS e, made AS id FROM chosen
WHERE w NOT IN (SELECT w FROM early) OR s = (SELECT min(s) FROM chosen k WHERE k.w = chosen.w)"""
APPLY = """
CREATE OR REPLACE TEMP TABLE sym AS
SELECT a.w, a.s, coalesce(h.e, a.e) AS e, coalesce(h.id, a.id) AS id
FROM sym a LEFT JOIN hits h ON h.w = a.w AND h.s = a.s
WHERE NOT EXISTS (SELECT 1 FROM hits g WHERE g.w = a.w AND g.gone = a.s)"""
LONG_RESULT = """
SELECT w, string_agg(id::VARCHAR, ',' ORDER BY s) AS ids, count(*) AS n, string_agg(hex, '' ORDER BY s) AS bytes
FROM sym JOIN vocabulary USING (id) GROUP BY w ORDER BY w"""


class Encoder:
    """A DuckDB session with a vocabulary's tables, and the words it has encoded."""

    def __init__(self, body: bytes):
        import duckdb

        ranks = read_ranks(body)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.spanned = np.zeros((256, 256), bool)
        for token in ranks:
            for i in range(1, len(token)):
                if token[:i] in ranks and token[i:] in ranks:
                    self.spanned[token[i - 1], token[i]] = True
        self.ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        l, r, made = (pa.array(x, pa.int32()) for x in zip(*pairs))  # noqa: E741
        self.fill("merges", {"l": l, "r": r, "made": made})
        tokens = list(ranks.items())
        self.fill("vocabulary", {"id": pa.array([i for _, i in tokens], pa.int32()), "hex": pa.array([t.hex() for t, _ in tokens], pa.string())})
        self.known: dict[int, tuple[str, int, bytes]] = {}

    def fill(self, name: str, columns: dict) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def encode(self, words: list[bytes]) -> list[tuple[str, int, bytes]]:
        """Ids (decimal, joined by commas), their number and their bytes, for each word."""
        whole = [w for w in words if len(w) <= LONG_WORD]
        cut = {w: self.pieces(w) for w in words if len(w) > LONG_WORD}
        parts = list(dict.fromkeys(p for pieces in cut.values() for p in pieces))
        every = [*whole, *parts]
        found: list = [None] * len(every)
        short = [i for i, w in enumerate(every) if len(w) <= LONG_WORD]
        for a in range(0, len(short), CHUNK):
            self.run(every, short[a : a + CHUNK], found, looped=False)
        long = [i for i, w in enumerate(every) if len(w) > LONG_WORD]
        if long:
            self.run(every, long, found, looped=True)
        if not cut:
            return found
        of_part, in_order = dict(zip(parts, found[len(whole) :])), iter(found)
        return [joined([of_part[p] for p in cut[w]]) if len(w) > LONG_WORD else next(in_order) for w in words]

    def pieces(self, word: bytes) -> list[bytes]:
        """A word cut at every place that no merge spans."""
        data = np.frombuffer(word, np.uint8)
        at = [0, *(np.flatnonzero(~self.spanned[data[:-1], data[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])]

    def run(self, words, chosen, found, *, looped: bool) -> None:
        lengths = np.array([len(words[i]) for i in chosen], np.int64)
        data = np.frombuffer(b"".join(words[i] for i in chosen), np.uint8)
        s = spans(lengths)
        w = np.repeat(np.arange(len(chosen), dtype=np.int32), lengths)
        columns = {"w": w, "id": self.ids[data]}
        if looped:
            self.fill("sym", columns | {"s": s.astype(np.int32), "e": (s + 1).astype(np.int32)})
            while True:
                self.con.execute(ROUND)
                if not self.con.execute("SELECT count(*) FROM hits").fetchone()[0]:
                    break
                self.con.execute(APPLY)
            rows = self.con.execute(LONG_RESULT).fetchall()
        else:
            self.fill("start", columns | {"s": (np.arange(len(data)) + w).astype(np.int32)})
            rows = self.con.execute(RECURSION).fetchall()
        for w, ids, n, coded in rows:
            found[chosen[w]] = (ids, n, bytes.fromhex(coded))

    def words(self, hashes: np.ndarray, bodies) -> list[tuple[str, int, bytes]]:
        """Results for distinct words by hash; bodies(i) gives the bytes of a word that is not remembered."""
        keys = hashes.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(range(len(keys)))
        for i, result in zip(new, self.encode([bodies(i) for i in new])):
            self.known[keys[i]] = result
        return [self.known[k] for k in keys]


def joined(results: list[tuple[str, int, bytes]]) -> tuple[str, int, bytes]:
    """The result of a word from those of its pieces."""
    ids, numbers, bodies = zip(*results)
    return ",".join(ids), sum(numbers), b"".join(bodies)


def encode_block(texts: list[str], encoder: Encoder) -> tuple[np.ndarray, list[str], list[bytes]]:
    """Per text: the number of ids, the ids joined by commas, and the bytes that they decode to."""
    cp, offsets = code_points(texts)
    starts, ends, doc = pre_tokens(cp, offsets, lead_space=True)
    if not len(starts):
        return np.zeros(len(texts), np.int64), [""] * len(texts), [b""] * len(texts)
    codes, hashes, where = distinct(cp, starts, ends)
    whole = "".join(texts)
    results = encoder.words(hashes, lambda i: whole[starts[where[i]] : ends[where[i]]].encode())
    sizes = np.array([r[1] for r in results])
    ids, coded = np.empty(len(results), object), np.empty(len(results), object)
    ids[:], coded[:] = [r[0] for r in results], [r[2] for r in results]
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    parts = [codes[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
    counts = np.array([int(sizes[p].sum()) for p in parts], np.int64)
    return counts, [",".join(ids[p]) for p in parts], [b"".join(coded[p]) for p in parts]


def encode_decode(docs: DataFrame, rank_file: str, *, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the carried columns, n_tokens, ids (decimal, joined by commas), decoded (bytes) for every row."""
    body = read_file(rank_file)
    kept = list(dict.fromkeys(["doc_id", *carry]))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def code(batches):
        for batch in batches:
            encoder = latest("byte_bpe", body, Encoder)
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            for a, b in text_blocks(texts):
                n, ids, decoded = encode_block(texts[a:b], encoder)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in kept], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.binary())],
                    [*kept, "n_tokens", "ids", "decoded"],
                )

    schema = ", ".join(f"`{c}` {fields[c]}" for c in kept) + ", n_tokens bigint, ids string, decoded binary"
    return in_batches(docs.select(*kept, F.col("text").cast("string").alias("_text"))).mapInArrow(code, schema)
