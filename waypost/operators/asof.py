"""As-of lookup for long curves: points and scores in one sorted order over all partitions.

A curve may have as many points as there are scores, and one key may hold most of both. Points and rows are ordered
together by key and threshold or score, so the last point before a row, and the next after it, lie in its own
partition or are the last or first point of another; those are one row for each partition.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.operators.calibrate import LINEAR, STEP
from waypost.session import ensure_checkpoint_dir

#: Rows of a partition of the common order, about.
RANGE_ROWS = 200_000


def _filled(at: np.ndarray, values: np.ndarray, start: float) -> np.ndarray:
    """The value at the last marked place up to each place (`at`: that place, or -1), else `start`."""
    last = np.maximum.accumulate(at)
    return np.where(last >= 0, values[np.maximum(last, 0)], start)


def _interpolated(x, t0, v0, t1, v1):
    """Between the neighbouring points; the only neighbour where one is missing (NaN), the left where they coincide."""
    with np.errstate(invalid="ignore", divide="ignore"):
        between = v0 + (x - t0) / (t1 - t0) * (v1 - v0)
    return np.where(np.isnan(t0), v1, np.where(np.isnan(t1) | (t1 <= t0), v0, between))


def calibrate_as_of(
    df: DataFrame, points: DataFrame, *, by: list[str], score: str = "score", kind: str = STEP, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Rows with `calibrated`, from the points (by, threshold, value) of their key; the same as `calibrate_long`.

    A score below all thresholds, or null, takes the first value. A row whose key has no points, or a null in it, stays
    with a null. NaN is above all thresholds.
    """
    if kind not in (STEP, LINEAR):
        raise ValueError("unsupported calibrator kind")
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    rows = df.select(
        key.alias("key"), F.col(score).cast("double").alias("x"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("v"), F.struct(*df.columns).alias("row")
    )
    whole = [F.col(c).isNotNull() for c in by]
    known = points.where(all_of(whole)).select(
        key.alias("key"), F.col("threshold").cast("double").alias("x"), F.lit(0).alias("side"), F.col("value").cast("double").alias("v"), F.lit(None).cast(rows.schema["row"].dataType).alias("row")
    )
    # Equal rows may lie anywhere among themselves, so that a score that a third of the rows have is spread.
    # Read three times: to count, to find the borders of the ranges, and to sort.
    both = rows.unionByName(known).withColumn("spread", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(both.count() / range_rows))
        order = ["key", "x", "side", "v", "spread"]
        held = both.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("spread").checkpoint()
    finally:
        both.unpersist()
    held = held.withColumn("part", F.spark_partition_id())
    point = F.when(F.col("side") == 0, F.struct("key", "x", "v"))
    edges = held.groupBy("part").agg(F.min(point).alias("first"), F.max(point).alias("last")).orderBy("part").collect()
    before, after, carried = {}, {}, None
    for edge in edges:
        before[edge["part"]] = carried
        carried = tuple(edge["last"]) if edge["last"] else carried
    carried = None
    for edge in reversed(edges):
        after[edge["part"]] = carried
        carried = tuple(edge["first"]) if edge["first"] else carried
    names = df.columns

    def look_up(batches):
        parts = [b for b in batches if b.num_rows]  # one partition, of about RANGE_ROWS
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        part = table["part"][0].as_py()
        keys = table["key"].combine_chunks().dictionary_encode()
        codes, named = keys.indices.to_numpy(), keys.dictionary.to_pylist()
        x = table["x"].to_numpy().astype(float)
        v = table["v"].to_numpy().astype(float)
        is_point = table["side"].to_numpy() == 0
        n = len(x)

        def neighbours(reverse: bool, outside):
            way = slice(None, None, -1) if reverse else slice(None)
            marks, own = is_point[way], codes[way]
            at = np.where(marks, np.arange(n), -1)
            t, value = _filled(at, x[way], np.nan), _filled(at, v[way], np.nan)
            last = np.maximum.accumulate(at)
            same = (last >= 0) & (own[np.maximum(last, 0)] == own)
            t, value = np.where(same, t, np.nan), np.where(same, value, np.nan)
            if outside is not None and outside[0] in named:
                # Places before the first point here, of the key that goes on over the border.
                reach = (last < 0) & (own == named.index(outside[0]))
                t, value, same = np.where(reach, outside[1], t), np.where(reach, outside[2], value), same | reach
            return t[way], value[way], same[way]

        t0, v0, has0 = neighbours(False, before[part])
        t1, v1, has1 = neighbours(True, after[part])
        if kind == STEP:
            found = np.where(has0, v0, v1)
        else:
            found = _interpolated(x, np.where(has0, t0, np.nan), v0, np.where(has1, t1, np.nan), v1)
            found = np.where(has0 & ~has1, v0, np.where(~has0, v1, found))
        wanted = ~is_point
        result = pa.array(found[wanted], mask=~(has0 | has1)[wanted])
        taken = table["row"].combine_chunks().filter(pa.array(wanted))
        columns = taken.flatten()
        yield pa.RecordBatch.from_arrays([*columns, result], [*names, "calibrated"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return held.mapInArrow(look_up, f"{fields}, calibrated double")


def all_of(conditions):
    """All conditions together."""
    total = F.lit(True)
    for condition in conditions:
        total = total & condition
    return total
