"""Policy calibration: a grid of (method, lambda) behind a non-inferiority gate.

Input is one row per calibration request and method: `success` and `acceptable` are
arrays in pool order, `group` is the request's group. The grid is one pass: each row
picks a model per lambda, and only sums per (method, lambda[, group]) are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.operators.heads import INDEPENDENT

MICRO = "micro"
MACRO = "macro_group"

# The lambda grid, the margin and the one-sided normal quantile.
LAMBDAS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8)
MARGIN = 0.01
ONE_SIDED_95 = 1.645


def even_mean(value: Column) -> Column:
    """Mean whose sum is exact, so equal choices give equal means in any partitioning.

    Policies are ranked by these means; with sums of doubles the order of merging would
    decide between equals.
    """
    return F.sum(value.cast("decimal(38,18)")).cast("double") / F.count(value)


def policy_mean(df: DataFrame, keys: list[str], values: dict[str, Column], aggregation: str) -> DataFrame:
    """Mean of each value per key: over rows (micro) or over group means (macro)."""
    if aggregation == MICRO:
        return df.groupBy(*keys).agg(*[F.avg(v).alias(name) for name, v in values.items()])
    means = df.groupBy(*keys, "group").agg(*[F.avg(v).alias(name) for name, v in values.items()])
    return means.groupBy(*keys).agg(*[even_mean(F.col(name)).alias(name) for name in values])


def fixed_rates(labels: DataFrame, models: list[str], aggregation: str) -> DataFrame:
    """Success rate of always choosing one model, in one pass over the requests."""
    columns = {f"m{i}": F.get("acceptable", F.lit(i)).cast("double") for i in range(len(models))}
    row = policy_mean(labels.withColumn("__all", F.lit(1)), ["__all"], columns, aggregation)
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"m{i}").alias("success_rate")) for i, m in enumerate(models)]))
    )


def best_fixed(rates: DataFrame, costs: DataFrame) -> DataFrame:
    """The one best row by (rate, cheaper, name)."""
    best = rates.join(costs, "model").agg(
        F.max(F.struct("success_rate", (-F.col("mean_cost_usd")).alias("saving"), "model")).alias("best")
    )
    return best.select(
        F.col("best.model").alias("best_model"), F.col("best.success_rate").alias("best_rate")
    )


def policy_grid(
    scored: DataFrame,
    models: list[str],
    costs: list[float],
    best_model: str,
    *,
    lambdas=LAMBDAS,
    margin: float = MARGIN,
    aggregation: str = MICRO,
) -> DataFrame:
    """One row per (method, lambda): rates, cost, paired difference, bound and gate."""
    scale = max(costs, default=1.0) or 1.0
    best = models.index(best_model)
    pool = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(float(c)).alias("cost")) for m, c in zip(models, costs)]
    )
    grid = F.array(*[F.lit(float(weight)) for weight in lambdas])
    cells = F.zip_with(
        F.arrays_zip(F.col("success").alias("p"), F.col("acceptable").alias("ok")),
        pool,
        lambda s, c: F.struct(s["p"].alias("p"), s["ok"].cast("double").alias("ok"), c["cost"].alias("cost"), c["model"].alias("model")),
    )
    # Later steps read `cells` more than once, so the optimizer keeps it computed.
    rows = scored.select("method", "group", cells.alias("cells"))
    picks = F.transform(
        grid,
        lambda weight: F.struct(
            weight.alias("lambda"),
            F.array_max(
                F.transform(
                    "cells",
                    lambda c: F.struct(
                        (c["p"] - weight * c["cost"] / F.lit(float(scale))).alias("u"),
                        c["p"].alias("p"),
                        (-c["cost"]).alias("saving"),
                        c["model"].alias("model"),
                        c["ok"].alias("ok"),
                    ),
                )
            ).alias("pick"),
        ),
    )
    picked = rows.select(
        "method", "group", F.get("cells", F.lit(best))["ok"].alias("base"), F.inline_outer(picks)
    ).select(
        "method",
        "lambda",
        "group",
        F.col("pick.ok").alias("ok"),
        (-F.col("pick.saving")).alias("cost"),
        (F.col("pick.ok") - F.col("base")).alias("difference"),
    )
    measures = [
        F.avg("ok").alias("ok"),
        even_mean(F.col("cost")).alias("cost"),
        F.avg("difference").alias("difference"),
        (F.coalesce(F.var_samp("difference"), F.lit(0.0)) / F.count(F.lit(1))).alias("se2"),
    ]
    if aggregation == MICRO:
        folded = picked.groupBy("method", "lambda").agg(*measures)
    else:
        folded = (
            picked.groupBy("method", "lambda", "group").agg(*measures).groupBy("method", "lambda").agg(
                even_mean(F.col("ok")).alias("ok"),
                even_mean(F.col("cost")).alias("cost"),
                even_mean(F.col("difference")).alias("difference"),
                (F.sum("se2") / (F.count(F.lit(1)) * F.count(F.lit(1)))).alias("se2"),
            )
        )
    lower = F.col("difference") - ONE_SIDED_95 * F.sqrt("se2")
    return folded.select(
        "method",
        "lambda",
        F.col("ok").alias("success_rate"),
        F.col("cost").alias("mean_expected_cost_usd"),
        F.col("difference").alias("difference_vs_best_fixed"),
        lower.alias("one_sided_95_lower_difference"),
        (lower >= -margin).alias("passes_noninferiority"),
    )


def select_policy(grid: DataFrame) -> DataFrame:
    """Cheapest passing row; if none passes, the most successful row and a failed gate."""
    independent = F.when(F.col("method") == INDEPENDENT, 0).otherwise(1)
    cheapest = F.min(
        F.when(
            F.col("passes_noninferiority"),
            F.struct("mean_expected_cost_usd", (-F.col("success_rate")).alias("miss"), independent.alias("order"), "lambda", "method"),
        )
    )
    strongest = F.max(
        F.struct("success_rate", (-F.col("mean_expected_cost_usd")).alias("saving"), (-independent).alias("order"), (-F.col("lambda")).alias("neg"), "method", "lambda")
    )
    return grid.agg(cheapest.alias("passing"), strongest.alias("any")).select(
        F.coalesce("passing.method", "any.method").alias("default_method"),
        F.coalesce("passing.lambda", "any.lambda").alias("default_lambda"),
        F.col("passing").isNotNull().alias("gate_passed"),
    )
