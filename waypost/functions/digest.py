"""Content digests of rows and of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8


def row_json(*names: str) -> Column:
    """Canonical JSON of the named columns: sorted keys, compact, nulls kept."""
    return F.to_json(F.struct(*[F.col(name) for name in sorted(names)]), {"ignoreNullFields": "false"})


def row_digest(*names: str) -> Column:
    """SHA-256 of the canonical JSON of a row."""
    return F.sha2(row_json(*names), 256)


def text_hash(text: Column) -> Column:
    """SHA-256 of the canonical JSON of {"text": text}."""
    return F.sha2(F.to_json(F.struct(text.alias("text"))), 256)


def table_digest(df: DataFrame, *names: str) -> DataFrame:
    """Digest of a table that does not depend on row order or partitioning.

    Each row digest is cut into eight 32-bit lanes; lane sums and the row count are
    hashed. Sums combine map-side, so the shuffle carries one row per task.
    """
    columns = names or df.columns
    digests = df.select(row_digest(*columns).alias("d"))
    lanes = [
        F.coalesce(
            F.sum(F.conv(F.substring("d", 1 + 8 * lane, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)
        ).alias(f"lane{lane}")
        for lane in range(LANES)
    ]
    totals = digests.agg(F.count(F.lit(1)).alias("n_rows"), *lanes)
    joined = F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(f"lane{i}").cast("string") for i in range(LANES)])
    return totals.select("n_rows", F.sha2(joined, 256).alias("digest"))
