"""Rendezvous hashing of record keys over weighted shards.

Every shard draws a number for a record from the MD5 of key and shard; the record goes to the shard with the best
draw, -weight / ln(u), so a shard's share follows its weight. A shard that is added draws for itself only:
records move into it and nowhere else, and the others stay.

Defined cases: a null key is the empty key, a null text has no bytes, rows with equal keys go to one shard and
get slots of their own, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 13 hexadecimal digits: whole numbers that a double holds exactly.
DRAW_DIGITS = 13


def draw(key: Column, shard: int, weight: float) -> Column:
    """The score of a shard for a key: higher wins."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, DRAW_DIGITS)
    number = F.conv(digits, 16, 10).cast("double")
    return F.lit(-float(weight)) / F.ln((number + 0.5) / float(16**DRAW_DIGITS))


def rendezvous(key: Column, weights: Sequence[float]) -> tuple[Column, Column]:
    """(shard, best score) of a key; equal scores go to the smaller shard."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    draws = F.array(*[F.struct(draw(text, i, w).alias("score"), F.lit(-i).alias("back")) for i, w in enumerate(weights)])
    best = F.array_max(draws)
    return (-best["back"]).cast("int"), best["score"]


def assign_shards(docs: DataFrame, key: str, weights: Sequence[float], *, added_weight: float = 1.0) -> DataFrame:
    """Add shard and grown_shard (the shard once one more of `added_weight` stands beside them)."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a weight above zero")
    names = docs.columns
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    shard, score = rendezvous(F.col(key), weights)
    found = docs.select(*names, F.struct(shard.alias("shard"), score.alias("score")).alias("_found"))
    grown = F.when(draw(text, len(weights), added_weight) > F.col("_found.score"), F.lit(len(weights))).otherwise(F.col("_found.shard"))
    return found.select(*names, F.col("_found.shard").alias("shard"), grown.cast("int").alias("grown_shard"))


def add_slots(rows: DataFrame, key: str, *, buckets: int = 256) -> DataFrame:
    """Number the rows of each shard without gaps from 0.

    Each bucket of a shard numbers its own rows and starts after the buckets before it, so no shard is one task.
    """
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), "text_crc32").cast("binary"))
    keyed = rows.withColumn("_bucket", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)))
    sizes = keyed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order = [F.col(c) for c in (key, "text_crc32", "size")]
    ranked = keyed.withColumn("_row", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*order)) - 1)
    # shards x buckets rows, both parameters: a fixed size.
    joined = ranked.join(F.broadcast(firsts), ["shard", "_bucket"])
    return joined.select(*rows.columns, (F.col("_row") + F.col("_first")).cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.col("text").cast("string")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = add_slots(assign_shards(narrow, "doc_id", weights), "doc_id")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
