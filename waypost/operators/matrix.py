"""Long (request, model) rows to one row per request with arrays in pool order.

All later work is per request, so a request keeps one row and a pool-sized array per
quantity. The text of a complete matrix is read from the rows of one model; the other
cells are shuffled without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pool_literal(models: list[str]) -> Column:
    return F.array(*[F.lit(model) for model in models])


def requests_of(matrix: DataFrame, models: list[str], *extra: str) -> DataFrame:
    """(request_id, text, …) of a validated complete matrix, without a shuffle."""
    return matrix.filter(F.col("model") == models[0]).select("request_id", "text", *extra)


def cell_arrays(matrix: DataFrame, models: list[str], columns: list[str]) -> DataFrame:
    """(request_id, one array per column) in pool order.

    A validated matrix has exactly one row per pool model, so each slot has one value.
    One plain aggregate per slot stays a hash aggregate that combines map-side.
    """
    slots = [
        F.max(F.when(F.col("model") == model, F.col(name))).alias(f"__{name}_{i}")
        for name in columns
        for i, model in enumerate(models)
    ]
    grouped = matrix.filter(F.col("model").isin(models)).groupBy("request_id").agg(*slots)
    return grouped.select(
        "request_id",
        *[F.array(*[F.col(f"__{name}_{i}") for i in range(len(models))]).alias(name) for name in columns],
    )


def rows_of(df: DataFrame, keys: list, cells) -> DataFrame:
    """One row per element of an array of structs that is never empty.

    The outer form is meant: the plain one lets the optimizer add a filter on the array's
    size, which evaluates everything behind the array a second time.
    """
    return df.select(*keys, F.inline_outer(cells))


def to_long(wide: DataFrame, models: list[str], columns: dict[str, str], *keys: str) -> DataFrame:
    """Arrays in pool order back to one row per (request, model). No shuffle."""
    zipped = F.arrays_zip(pool_literal(models).alias("model"), *[F.col(c).alias(c) for c in columns])
    cells = F.transform(
        zipped,
        lambda z: F.struct(z["model"].alias("model"), *[z[src].alias(name) for src, name in columns.items()]),
    )
    return rows_of(wide, list(keys), cells).filter(F.col("model").isNotNull())
