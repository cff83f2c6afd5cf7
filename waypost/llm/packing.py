"""Packing of token sequences into windows of a fixed capacity by minimum bin slack.

Documents become token ids with an end id; full windows are cut off first, and what remains of each document
is one piece. The lengths of the pieces form a histogram of at most `capacity` numbers, whatever the number of
documents. The planner fills one window at a time over that histogram: the longest piece is fixed, a subset-sum
program over a bitset (an integer whose bit s says that s can be reached, copies in binary chunks) finds the
multiset of remaining lengths that comes closest to the capacity, and walking back through the stored bitsets
gives its counts. A pattern is used as often as the counts allow, so the plan stays a short table of rank
intervals. Every piece then finds its window from its rank among the pieces of its length.

Defined cases: a null or empty text is the end id alone; a null id is kept; repeated rows are packed as often as
they occur; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waypost.llm.bpe_files import json_encoder, read_file
from waypost.llm.common import in_batches, settled
from waypost.llm.ragged import latest, tidy

CAPACITY = 2048
END_ID = 1


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of the documents (doc_id, text): doc_id, start, length, doc_tokens, ids (uint32, little-endian)."""
    body = read_file(tokenizer)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        encode = latest("json", body, json_encoder)
        for batch in batches:
            keys = batch.column(0)
            rows, starts, lengths, totals, ids = [], [], [], [], []
            held = 0
            for i, text in enumerate(batch.column(1)):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(tokens), capacity):
                    part = tokens[start : start + capacity]
                    rows.append(i)
                    starts.append(start)
                    lengths.append(len(part))
                    totals.append(len(tokens))
                    ids.append(part.tobytes())
                held += tokens.nbytes
                if held > 8_000_000 or i + 1 == len(keys):
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary())],
                        ["doc_id", "start", "length", "doc_tokens", "ids"],
                    )
                    rows, starts, lengths, totals, ids, held = [], [], [], [], [], 0

    return in_batches(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(
        tidy(cut), f"doc_id {id_type}, start bigint, length bigint, doc_tokens bigint, ids binary"
    )


def padding(filled: int, capacity: int) -> int:
    """Padding of a window: none at a power of two, else up to the capacity."""
    return 0 if filled & (filled - 1) == 0 else capacity - filled


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of available lengths that holds the longest one and pads the window least."""
    longest = max(counts)
    room = capacity - longest
    bits, levels = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        free = min(counts[length] - (length == longest), room // length)
        chunk = 1
        while free > 0 and not bits >> room & 1:
            take = min(chunk, free)
            levels.append((length, take, bits))
            bits = (bits | bits << length * take) & ((1 << room + 1) - 1)
            free -= take
            chunk *= 2
        if bits >> room & 1:
            break
    best = bits.bit_length() - 1
    if padding(longest + best, capacity):
        whole = 1 << (longest - 1).bit_length()
        while whole < capacity:
            if bits >> whole - longest & 1:
                best = whole - longest
            whole *= 2
    used = {longest: 1}
    for length, take, before in reversed(levels):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + take
            best -= length * take
    return used


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, copies, first window, first offset) that place every piece."""
    left = {length: n for length, n in histogram.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    plan, window = [], 0
    while left:
        used = fill_window(left, capacity)
        times = min(left[length] // n for length, n in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            plan.append((length, taken[length], taken[length] + n * times, n, window, offset))
            taken[length] += n * times
            left[length] -= n * times
            offset += n * length
            if not left[length]:
                del left[length]
        window += times
    return plan


PLAN = "length bigint, first_rank bigint, end_rank bigint, copies bigint, first_window bigint, first_offset bigint"


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length and any other columns).

    The pieces should be settled: they are read once for the histogram and once for the placement. The rank of a
    piece among those of its length comes from buckets, so a length that a third of all pieces share is
    numbered by many tasks.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("a piece is empty or longer than the capacity")
    plan = spark.createDataFrame(plan_windows(histogram, capacity), PLAN)
    buckets = max(64, sum(histogram.values()) // 50_000)
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start")
    ranked = (
        keyed.withColumn("_row", F.row_number().over(within) - 1)
        .join(firsts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_row") + F.col("_first"))
    )
    # A plan has a few rows for each length up to the capacity, whatever the number of pieces.
    placed = ranked.join(
        F.broadcast(plan.withColumnRenamed("length", "_length")),
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("end_rank")),
    )
    turn = F.col("_rank") - F.col("first_rank")
    return placed.select(
        *pieces.columns,
        (F.col("first_window") + F.floor(turn / F.col("copies"))).cast("bigint").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(turn, F.col("copies")) * F.col("length")).cast("bigint").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed windows themselves: sequence_id, length, ids (uint32, little-endian), in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def packed_digest(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their place and the checksum of their ids, without the ids."""
    pieces = token_pieces(docs, tokenizer, capacity=capacity)
    narrow = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    placed = pack(settled(narrow, "pieces"), capacity=capacity)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
