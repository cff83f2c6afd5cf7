"""Descent in one job: tasks that run at once keep their rows and exchange what each step needs.

Every task sums its part of the gradient, all tasks get all parts and add them in the order of tasks, and so each
makes the same step. The parts pass through the driver's coordinator to every task, which bounds their number and size.
Spark looks once a second whether all tasks have answered, so an exchange costs about a second whatever its size (20
took 17 to 19 s on one machine, 20 small jobs 6 s): it is for clusters on which a job costs more. Rows that one
task can hold need no exchange; they are descended in one job, without that wait, wherever they are small enough.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that one task descends alone; tasks that exchange at most, bytes of rows that each may keep then, and
#: bytes that all parts of one step may have.
ALONE_BYTES = 32 << 20
MAX_TASKS, TASK_BYTES, STEP_BYTES = 64, 512 << 20, 64 << 20


def barrier_tasks(spark: SparkSession, row_bytes: int, state_bytes: int, wanted: int, *, exchange: bool) -> int:
    """How many tasks descend in one job over rows of this size: one, several if they may exchange, or 0 if they do not fit."""
    if not exchange:
        return 1 if row_bytes <= ALONE_BYTES else 0
    slots = min(spark.sparkContext.defaultParallelism, MAX_TASKS)
    tasks = max(1, min(slots, wanted))
    if row_bytes > slots * TASK_BYTES:
        return 0
    tasks = max(tasks, -(-row_bytes // TASK_BYTES))
    return tasks if tasks * state_bytes * 4 // 3 <= STEP_BYTES else 0


def together(rows: DataFrame, program: Callable[[list[pa.RecordBatch], Callable[[np.ndarray], np.ndarray]], np.ndarray]) -> np.ndarray:
    """The result of a program that all tasks of one barrier stage run alike over their own rows.

    `program(batches, exchange)` calls `exchange(part)` as often as it likes and gets the sum of all tasks' parts each
    time. If a task is lost, Spark runs the stage again.
    """

    def run(batches):
        context = BarrierTaskContext.get()
        alone = len(context.getTaskInfos()) == 1

        def exchange(part: np.ndarray) -> np.ndarray:
            if alone:
                return part
            parts = context.allGather(base64.b64encode(np.ascontiguousarray(part).tobytes()).decode())
            return np.sum([np.frombuffer(base64.b64decode(x)).reshape(part.shape) for x in parts], axis=0)

        result = np.ascontiguousarray(program(list(batches), exchange))
        if context.partitionId() == 0:
            yield pa.record_batch({"shape": pa.array([list(result.shape)]), "result": pa.array([result.tobytes()], pa.binary())})

    found = rows.mapInArrow(run, "shape array<bigint>, result binary", barrier=True).collect()[0]
    return np.frombuffer(found["result"]).reshape(found["shape"]).copy()


def descend(
    rows: DataFrame,
    state: np.ndarray,
    gradient: Callable[[list[pa.RecordBatch], np.ndarray], np.ndarray],
    update: Callable[[np.ndarray, np.ndarray, int], np.ndarray],
    steps: range,
) -> np.ndarray:
    """The state after the steps: `gradient(batches, state)` is a task's part, `update(state, sum of parts, step)` the next state."""

    def program(own, exchange):
        now = state
        for number in steps:
            now = update(now, exchange(gradient(own, now)), number)
        return now

    return together(rows, program)


def lbfgs(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, *, iterations: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """The minimum of a convex function (value and gradient) by limited-memory BFGS with backtracking.

    Ends when a step lowers the value by less than `tolerance` of it.
    """
    x, (value, slope) = start, objective(start)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(iterations):
        direction, kept = -slope, []
        for s, y, r in reversed(pairs):
            a = r * np.vdot(s, direction)
            kept.append(a)
            direction = direction - a * y
        if pairs:
            s, y, r = pairs[-1]
            direction = direction / (r * np.vdot(y, y))
        for (s, y, r), a in zip(pairs, reversed(kept)):
            direction = direction + (a - r * np.vdot(y, direction)) * s
        along = np.vdot(slope, direction)
        if along >= 0:
            direction, along, pairs = -slope, -np.vdot(slope, slope), []
        if along == 0:
            return x
        length = 1.0 if pairs else min(1.0, 1.0 / np.sqrt(-along))
        for _ in range(40):
            after, slope_after = objective(x + length * direction)
            if after <= value + 1e-4 * length * along:
                break
            length /= 2
        else:
            return x
        s, y = length * direction, slope_after - slope
        if np.vdot(s, y) > 1e-300:
            pairs = [*pairs[-(memory - 1) :], (s, y, 1.0 / np.vdot(s, y))]
        done = value - after <= tolerance * max(abs(value), abs(after), 1.0)
        x, value, slope = x + s, after, slope_after
        if done:
            return x
    return x
