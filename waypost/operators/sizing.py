"""Size checks that decide whether a table may be broadcast or taken to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.schema import MAX_POOL


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table proven to hold at most `limit` of them."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def broadcast_if_small(df: DataFrame, limit: int = MAX_POOL) -> DataFrame:
    """Broadcast hint where a count proves the side small; otherwise Catalyst decides."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def broadcast_as(df: DataFrame, counted: DataFrame, limit: int = MAX_POOL) -> DataFrame:
    """Broadcast hint for a table with at most a row per row of `counted`, which alone is counted."""
    return F.broadcast(df) if counted.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that Spark splits into fewer tasks than there are cores.

    The scan's tasks follow its bytes, so a table of a few large files is left alone, as is one of many.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
