"""Exact deduplication by progressive refinement, in DataFrame operations alone.

Texts are first grouped by length, the survivors by the hash of a prefix, and only texts whose length and prefix
occur twice have their full content hashed. What survives a step reaches the next scan as a bitmap of fixed size:
a false positive there costs one needless hash and never a wrong answer, since groups form on length, prefix and
full hash. No text is shuffled.

Defined cases: null counts as empty; runs of white space are equal to one space; a null id comes last among the
ids of a group; of rows that repeat an id within a group one stays; other columns are ignored unless carried;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.llm.common import attach_groups, settled

#: Fixed value: what counts as white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
PREFIX_CHARS = 64
#: Bits of a survivors' bitmap: 2 MB.
FILTER_BITS = 1 << 24


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " ")


def _slot(bits: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def survivors_filter(survivors: DataFrame, bits: int, *columns: str) -> DataFrame:
    """A bitmap over hashed keys: rows (_block, _bitmap), bits / 32768 of them at most."""
    slot = _slot(bits, *columns)
    return (
        survivors.select(F.bitmap_bucket_number(slot).alias("_block"), F.bitmap_bit_position(slot).alias("_bit"))
        .groupBy("_block")
        .agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    )


def with_flag(rows: DataFrame, bitmap: DataFrame, bits: int, name: str, *columns: str) -> DataFrame:
    """Add a boolean: whether the hashed key of a row is in the bitmap."""
    slot = _slot(bits, *columns)
    keyed = rows.withColumn("_block", F.bitmap_bucket_number(slot)).withColumn("_bit", F.bitmap_bit_position(slot))
    # The bitmap has bits / 8 bytes, a parameter, whatever the number of rows.
    joined = keyed.join(F.broadcast(bitmap), "_block", "left")
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(pmod(_bit, 8) as int)) & 1") == 1
    return joined.withColumn("_byte", byte).withColumn(name, F.coalesce(bit, F.lit(False))).drop("_block", "_bit", "_bitmap", "_byte")


def exact_dedup(docs: DataFrame, *, carry: Sequence[Column] = (), bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, the carried columns, keep_id, group_size and kept for every row.

    Carried columns are computed beside doc_id in the scan that also hashes the survivors' contents, from doc_id
    and the normalised text, `_text`.
    """
    text = docs.select("doc_id", normalised(F.col("text")).alias("_text")).withColumn("_length", F.length("_text"))
    prefix = F.xxhash64(F.substring("_text", 1, PREFIX_CHARS))
    keys = settled(text.select("_length", prefix.alias("_prefix")), "lengths")

    by_length = keys.groupBy("_length").agg(F.count("*").alias("n")).where("n > 1")
    same_length = with_flag(keys, survivors_filter(by_length, bits, "_length"), bits, "_again", "_length").where("_again").drop("_again")
    by_prefix = same_length.groupBy("_length", "_prefix").agg(F.count("*").alias("n")).where("n > 1")
    to_hash = survivors_filter(by_prefix, bits, "_length", "_prefix")

    flagged = with_flag(text.withColumn("_prefix", prefix), to_hash, bits, "_again", "_length", "_prefix")
    full = F.when(F.col("_again"), F.concat_ws(":", "_length", F.sha2(F.col("_text").cast("binary"), 256)))
    rows = settled(flagged.select("doc_id", *carry, full.alias("_full"), F.monotonically_increasing_id().alias("_row")), "contents")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    groups = (
        rows.where(F.col("_full").isNotNull())
        .groupBy("_full")
        .agg(first.alias("_first"), F.count("*").alias("_size"))
        .where("_size > 1")
    )
    joined = attach_groups(rows, groups, "_full", "_size", rows.count(), F.col("_row"))
    lone = F.col("_size").isNull()
    return joined.select(
        *[c for c in rows.columns if c not in ("_full", "_row")],
        F.when(lone, F.col("doc_id")).otherwise(F.col("_first.id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        (lone | (F.col("_first.row") == F.col("_row"))).alias("kept"),
    )


def without(docs: DataFrame, key: Column, gone: DataFrame, repeated: DataFrame | None = None, *, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of docs whose key is not among `gone` (_key), and one of the rows of each key in `repeated`.

    A bitmap of the keys lets all other rows pass where they are; only rows that may go meet the keys in a join.
    """
    gone = gone.select("_key")
    listed = settled(gone.union(repeated.select("_key")) if repeated is not None else gone, "keys")
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_key"))
    flagged = with_flag(rows, survivors_filter(listed, bits, "_key"), bits, "_maybe", "_key")
    doubtful = flagged.where("_maybe").join(gone, "_key", "left_anti")
    if repeated is not None:
        doubtful = doubtful.dropDuplicates(["_key"])
    return flagged.where(~F.col("_maybe")).select("_row.*").union(doubtful.select("_row.*"))


def row_key(text: Column) -> Column:
    """A key of a document and its normalised text."""
    return F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"), 256)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each group of equal texts, with all their columns."""
    found = settled(exact_dedup(docs, carry=[row_key(F.col("_text")).alias("_key")]), "equal")
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return without(docs, row_key(normalised(F.col("text"))), found.where(~F.col("kept") & ~own), found.where(~F.col("kept") & own))
