"""Probability calibration: isotonic fits, logistic fits and their application."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions.mathx import clipped_logit
from waypost.operators.barrier import barrier_tasks, descend
from waypost.operators.sizing import bounded_rows

STEP = "step"
LINEAR = "linear"

# Points one task pools in a pass of the isotonic fit.
POINTS_PER_TASK = 200_000
# Fitted points of a pool of calibrators that may be taken to the driver.
MAX_CALIBRATOR_POINTS = 2_000_000

# The descent of the logistic calibrator.
PLATT_ITERATIONS = 300
PLATT_RATE = 0.05
# Distinct points of a logistic calibration that one task may hold.
PLATT_TASK_POINTS = 200_000
MAX_KEYS = 10_000


@dataclass
class Calibrator:
    """Monotone map from raw to calibrated probability."""

    kind: str
    thresholds: list[float]
    values: list[float]

    def __post_init__(self) -> None:
        if self.kind not in (STEP, LINEAR):
            raise ValueError("unsupported calibrator kind")
        if not self.thresholds or len(self.thresholds) != len(self.values):
            raise ValueError("invalid calibrator")


# ---------------------------------------------------------------- isotonic fit


def tied_points(df: DataFrame, by: list[str], score: str, outcome: str, weight: str | None = None) -> DataFrame:
    """One weighted point per distinct score: (by…, score, w, y)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*by, F.col(score).cast("double").alias("score"), F.col(outcome).cast("int").cast("double").alias("y0"), w.alias("w0"))
    return rows.groupBy(*by, "score").agg(
        F.sum("w0").alias("w"), F.sum(F.col("w0") * F.col("y0")).alias("wy"), F.min("w0").alias("w_min")
    )


def _pool_blocks(frame: pd.DataFrame, by: list[str], carry):
    """Pool adjacent violators over sorted rows. `carry` is (key, blocks) from before."""
    key, blocks = carry
    finished = []
    columns = [frame[name].tolist() for name in (*by, "lo", "hi", "w", "wy")]
    for row in zip(*columns):
        row_key, (lo, hi, w, wy) = row[: len(by)], row[len(by) :]
        if row_key != key:
            finished.append((key, blocks))
            key, blocks = row_key, []
        while blocks and blocks[-1][3] * w > wy * blocks[-1][2]:
            left = blocks.pop()
            lo, w, wy = left[0], left[2] + w, left[3] + wy
        blocks.append((lo, hi, w, wy))
    return finished, (key, blocks)


def _pool_task(by: list[str]):
    def rows_of(parts):
        data = [(*key, *block) for key, blocks in parts if key is not None for block in blocks]
        return pd.DataFrame(data, columns=[*by, "lo", "hi", "w", "wy"]) if data else None

    def run(frames):
        carry = (None, [])
        for frame in frames:
            finished, carry = _pool_blocks(frame, by, carry)
            out = rows_of(finished)
            if out is not None:
                yield out
        out = rows_of([carry])
        if out is not None:
            yield out

    return run


def _still_falling(blocks: DataFrame, by: list[str]) -> bool:
    """Whether a task's first block of a key lies below the last block before it.

    Reads one row per (task, key), not the blocks.
    """
    edges = (
        blocks.withColumn("task", F.spark_partition_id())
        .groupBy(*by, "task")
        .agg(
            F.min(F.struct("lo", (F.col("wy") / F.col("w")).alias("v")))["v"].alias("first"),
            F.max(F.struct("lo", (F.col("wy") / F.col("w")).alias("v")))["v"].alias("last"),
            F.min("lo").alias("lo"),
        )
        .orderBy(*by, "lo")
        .toPandas()
    )
    previous = edges.groupby(by, dropna=False)["last"].shift() if by else edges["last"].shift()
    return bool((previous > edges["first"]).any())


def isotonic_blocks(points: DataFrame, by: list[str]) -> DataFrame:
    """Non-decreasing weighted fit per key: (by…, lo, hi, w, wy), value = wy / w.

    Pooling adjacent violators gives the same fit in whatever order neighbours are
    pooled. Each pass range-partitions by key and score, so one hot key spreads over
    many tasks, and pools inside tasks; passes repeat over fewer tasks until no
    violator is left across a task boundary.
    """
    spark = points.sparkSession
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema if f.name in by] + ["lo double", "hi double", "w double", "wy double"])
    keyless = not by
    current = points.select(*by, F.col("score").alias("lo"), F.col("score").alias("hi"), "w", "wy").persist(
        StorageLevel.MEMORY_AND_DISK
    )
    tasks = max(1, math.ceil(current.count() / POINTS_PER_TASK))
    while True:
        ranged = current.repartitionByRange(tasks, *by, "lo") if not keyless else current.repartitionByRange(tasks, "lo")
        pooled = ranged.sortWithinPartitions(*by, "lo").mapInPandas(_pool_task(by), schema)
        if tasks == 1:
            return pooled
        kept = pooled.persist(StorageLevel.MEMORY_AND_DISK)
        left = kept.count()
        if not _still_falling(kept, by):
            return kept
        current = kept
        tasks = max(1, min(tasks // 2, math.ceil(left / POINTS_PER_TASK)))


def fit_isotonic(
    df: DataFrame,
    *,
    by: list[str] | str = (),
    score: str = "score",
    outcome: str = "outcome",
    weight: str | None = None,
    kind: str = STEP,
) -> DataFrame:
    """Calibrator points per key: (by…, threshold, value), values clipped to [0, 1].

    A block appears as its first and last score, which is all a lookup needs. Both kinds
    share the fit and differ in the lookup.
    """
    if kind not in (STEP, LINEAR):
        raise ValueError("kind must be step or linear")
    keys = [by] if isinstance(by, str) else list(by)
    points = tied_points(df, keys, score, outcome, weight)
    if weight and not points.filter(F.col("w_min") <= 0).isEmpty():
        raise ValueError("sample weights must be positive")
    blocks = isotonic_blocks(points, keys)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("wy") / F.col("w")))
    ends = F.array_distinct(F.array("lo", "hi"))
    return blocks.select(*keys, F.explode(ends).alias("threshold"), value.alias("value"))


def budget_curve(
    df: DataFrame, *, budget: str = "budget", outcome: str = "outcome", weight: str | None = None, by=()
) -> DataFrame:
    """P(success within a budget), non-decreasing in the budget."""
    keys = [by] if isinstance(by, str) else list(by)
    return fit_isotonic(df, by=keys, score=budget, outcome=outcome, weight=weight).select(
        *keys, F.col("threshold").alias("budget"), F.col("value").alias("probability")
    )


def collect_calibrators(points: DataFrame, by: list[str], kind: str) -> dict[tuple, Calibrator]:
    """Fitted points as calibrators, by key. Their number is checked."""
    rows = bounded_rows(points.select(*by, "threshold", "value"), MAX_CALIBRATOR_POINTS, "calibration")
    grouped: dict[tuple, list] = {}
    for row in rows:
        grouped.setdefault(tuple(row[name] for name in by), []).append((row["threshold"], row["value"]))
    return {
        key: Calibrator(kind, [t for t, _ in sorted(pairs)], [v for _, v in sorted(pairs)])
        for key, pairs in grouped.items()
    }


# ---------------------------------------------------------------- lookup


def as_of_step(score: Column, thresholds: Column, values: Column) -> Column:
    """Value at the last threshold not above the score, clamped at both ends."""
    at_or_below = F.size(F.filter(thresholds, lambda t: t <= score))
    return F.get(values, F.greatest(F.lit(1), at_or_below) - 1)


def as_of_linear(score: Column, thresholds: Column, values: Column) -> Column:
    """Linear interpolation between neighbouring thresholds, clamped at both ends."""
    position = F.size(F.filter(thresholds, lambda t: t <= score))
    left = F.greatest(F.lit(1), position) - 1
    right = F.least(position, F.size(thresholds) - 1)
    t0, t1, v0, v1 = F.get(thresholds, left), F.get(thresholds, right), F.get(values, left), F.get(values, right)
    return F.when((position == 0) | (t1 <= t0), v0).otherwise(v0 + (score - t0) / (t1 - t0) * (v1 - v0))


def _literal_doubles(numbers: list[float]) -> Column:
    # One folded literal; an array of thousands of literal children is slow to analyse.
    return F.split(F.lit(",".join(repr(float(x)) for x in numbers)), ",").cast("array<double>")


def calibrate(raw: Column, calibrators: list[Calibrator]) -> Column:
    """Calibrate an array of raw probabilities, one calibrator per pool position."""
    fitted = []
    for i, calibrator in enumerate(calibrators):
        lookup = as_of_step if calibrator.kind == STEP else as_of_linear
        fitted.append(
            lookup(F.get(raw, F.lit(i)), _literal_doubles(calibrator.thresholds), _literal_doubles(calibrator.values))
        )
    return F.array(*fitted)


def calibrate_long(df: DataFrame, points: DataFrame, *, by: list[str], score: str = "score", kind: str = STEP) -> DataFrame:
    """Calibrate rows of any number of keys: points folded to arrays and joined by key.

    A row whose key has no points stays, with a null.
    """
    folded = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("threshold", "value"))).alias("__points"))
    lookup = as_of_step if kind == STEP else as_of_linear
    thresholds, values = F.col("__points.threshold"), F.col("__points.value")
    return df.join(folded, by, "left").withColumn("calibrated", lookup(F.col(score), thresholds, values)).drop("__points")


# ---------------------------------------------------------------- logistic calibration


def _platt_descent(frame: pd.DataFrame, iterations: int, rate: float) -> tuple[float, float]:
    x, n, pos = (frame[name].to_numpy(float) for name in ("x", "n", "pos"))
    slope, intercept, total = 1.0, 0.0, n.sum()
    for _ in range(iterations):
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * x + intercept, -30.0, 30.0)))
        error = n * p - pos
        slope, intercept = slope - rate * (error * x).sum() / total, intercept - rate * error.sum() / total
    return slope, intercept


def fit_platt(
    df: DataFrame,
    *,
    by: list[str] | str = (),
    probability: str = "probability",
    outcome: str = "outcome",
    iterations: int = PLATT_ITERATIONS,
    learning_rate: float = PLATT_RATE,
    exchange: bool = False,
) -> DataFrame:
    """Slope and intercept per key by a fixed number of descent steps.

    Equal probabilities are merged map-side first. Keys whose merged points fit one task
    are descended there; larger ones take one aggregate per step or, with `exchange`, tasks
    that hold a part of the points each and add up their gradients in one job, so no key is
    ever gathered whole.
    """
    keys = [by] if isinstance(by, str) else list(by)
    keyed = df if keys else df.withColumn("__all", F.lit(0))
    group = keys or ["__all"]
    points = (
        keyed.groupBy(*group, F.col(probability).cast("double").alias("p"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(outcome).cast("int")).cast("double").alias("pos"))
        .select(*group, clipped_logit(F.col("p")).alias("x"), "n", "pos")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    sizes = points.groupBy(*group).count()
    if sizes.isEmpty():
        raise ValueError("nothing to calibrate: the table is empty")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema if f.name in group)
    schema = f"{types}, slope double, intercept double"

    def fit(key, frame):
        slope, intercept = _platt_descent(frame, iterations, learning_rate)
        return pd.DataFrame([(*key, slope, intercept)], columns=[*group, "slope", "intercept"])

    # Each key by its own size: only keys too large for a task take an aggregate per step.
    large = sizes.filter(F.col("count") > PLATT_TASK_POINTS).select(*group)
    found = bounded_rows(large, MAX_KEYS, "calibration keys beyond one task")
    if not found:
        fitted = points.groupBy(*group).applyInPandas(fit, schema)
    else:
        big = F.broadcast(points.sparkSession.createDataFrame([tuple(row) for row in found], large.schema))
        same = [points[name].eqNullSafe(big[name]) for name in group]
        own = points.join(big, same, "left_anti").groupBy(*group).applyInPandas(fit, schema)
        descend_large = _platt_together if exchange else _platt_by_aggregates
        fitted = own.unionByName(descend_large(points.join(big, same, "left_semi"), group, schema, iterations, learning_rate))
    return fitted if keys else fitted.drop("__all")


def _platt_together(points, group, schema, iterations, rate) -> DataFrame:
    """All steps of large keys in one job, if their points fit bounded tasks; else one aggregate per step."""
    spark = points.sparkSession
    sums = points.groupBy(*group).agg(F.count(F.lit(1)).alias("points"), F.sum("n").alias("n")).collect()
    number = sum(row["points"] for row in sums)
    tasks = barrier_tasks(spark, 32 * number, 16 * len(sums), math.ceil(number / PLATT_TASK_POINTS), exchange=True)
    if not tasks:
        return _platt_by_aggregates(points, group, schema, iterations, rate)
    keys = [tuple(row[name] for name in group) for row in sums]
    totals = np.array([row["n"] for row in sums], float)
    types = schema.replace(", slope double, intercept double", ", __number int")
    numbered = F.broadcast(spark.createDataFrame([(*key, k) for k, key in enumerate(keys)], types))
    same = [points[name].eqNullSafe(numbered[name]) for name in group]
    held = points.join(numbered, same).select(F.col("__number").alias("k"), "x", "n", "pos").repartition(tasks)

    def gradient(batches, state):
        total = np.zeros_like(state)
        for batch in batches:
            k, x, n, pos = (batch.column(i).to_numpy() for i in range(4))
            p = 1.0 / (1.0 + np.exp(-np.clip(state[k, 0] * x + state[k, 1], -30.0, 30.0)))
            error = n * p - pos
            total[:, 0] += np.bincount(k, weights=error * x, minlength=len(total))
            total[:, 1] += np.bincount(k, weights=error, minlength=len(total))
        return total

    def update(state, total, _):
        return state - rate * total / totals[:, None]

    start = np.tile([1.0, 0.0], (len(keys), 1))
    state = descend(held, start, gradient, update, range(iterations))
    return spark.createDataFrame([(*key, float(a), float(b)) for key, (a, b) in zip(keys, state)], schema)


def _platt_by_aggregates(points, group, schema, iterations, rate) -> DataFrame:
    """One distributed aggregate per descent step; the state is two numbers per key."""
    spark = points.sparkSession
    keys = [tuple(row) for row in points.select(*group).distinct().collect()]
    state = {key: (1.0, 0.0) for key in keys}
    for _ in range(iterations):
        current = F.broadcast(spark.createDataFrame([(*key, *state[key]) for key in keys], schema))
        linear = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("slope") * F.col("x") + F.col("intercept")))
        error = F.col("n") / (1.0 + F.exp(-linear)) - F.col("pos")
        sums = (
            points.join(current, group)
            .groupBy(*group)
            .agg(F.sum(error * F.col("x")).alias("gs"), F.sum(error).alias("gi"), F.sum("n").alias("n"))
            .collect()
        )
        for row in sums:
            key = tuple(row[name] for name in group)
            slope, intercept = state[key]
            state[key] = (slope - rate * row["gs"] / row["n"], intercept - rate * row["gi"] / row["n"])
    return spark.createDataFrame([(*key, *state[key]) for key in keys], schema)
