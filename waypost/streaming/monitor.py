"""Windows over a stream of decisions: how often each model is taken, what it costs, how often conversations switch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waypost.schema import MAX_POOL


def _measures(cost: str) -> list:
    return [
        F.count(F.lit(1)).alias("decisions"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost_usd"),
        F.count_if(F.col(cost).isNull()).alias("unpriced"),
        F.count_if("switched").alias("switches"),
    ]


def window_monitor(
    decisions: DataFrame, models: list[str], *, size: str, slide: str | None = None, delay: str = "10 minutes", time: str = "ts", cost: str = "cost_usd"
) -> DataFrame:
    """Per window: decisions, cost, decisions without a cost, switches and their rate, and how many and what share of them took each model.

    `decisions` has model, switched, a cost and an event time, as a stream or as a table. Windows tumble, or slide by
    `slide`. A stream's window is given out once, when the watermark, `delay` behind the newest event, has passed its
    end; rows behind the watermark are counted by `late_rows`. A row without a model counts in all but the routes, one
    whose model is not among `models` under `other`. The state is one row per open window, whatever the traffic.
    """
    if not models or len(models) > MAX_POOL or len(set(models)) != len(models):
        raise ValueError("a monitor needs some distinct models")
    taken = [F.count_if(F.col("model") == name).alias(f"m{i}") for i, name in enumerate(models)]
    other = F.count_if(F.col("model").isNotNull() & ~F.col("model").isin(models)).alias("other")
    span = F.window(time, size, slide) if slide else F.window(time, size)
    timed = decisions.withWatermark(time, delay) if decisions.isStreaming else decisions
    found = timed.where(F.col(time).isNotNull()).groupBy(span.alias("w")).agg(*_measures(cost), *taken, other)
    routes = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.col(f"m{i}").alias("routes"), (F.col(f"m{i}") / F.col("decisions")).alias("share"))
            for i, name in enumerate(models)
        ]
    )
    return found.select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "decisions", "cost_usd", "unpriced", "switches",
        (F.col("switches") / F.col("decisions")).alias("switch_rate"), "other", routes.alias("routes"),
    )


def session_monitor(decisions: DataFrame, *, gap: str, delay: str = "10 minutes", time: str = "ts", cost: str = "cost_usd") -> DataFrame:
    """Per conversation and session (events less than `gap` apart): start, end of the session, decisions, cost, switches."""
    timed = decisions.withWatermark(time, delay) if decisions.isStreaming else decisions
    known = timed.where(F.col("conv_id").isNotNull() & F.col(time).isNotNull())
    found = known.groupBy("conv_id", F.session_window(time, gap).alias("w")).agg(*_measures(cost))
    return found.select("conv_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "decisions", "cost_usd", "unpriced", "switches")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's windows have left out so far because they came behind the watermark."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])
