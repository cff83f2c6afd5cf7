"""Routing of request and payload streams with a frozen model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from waypost.plans.model import RouterModel
from waypost.plans.payloads import route_payloads
from waypost.plans.route import route


def route_stream(requests: DataFrame, model: RouterModel, *, text: str = "text", **options) -> DataFrame:
    """A routed stream. Routing is a projection, so a stream needs no state or watermark."""
    return route(requests, model, text=text, **options)


def route_payload_stream(payloads: DataFrame, model: RouterModel, *, payload: str = "payload", **options) -> DataFrame:
    return route_payloads(payloads, model, payload=payload, **options)


def write_decisions(routed: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Append decisions as Parquet with the exactly-once file sink."""
    return (
        routed.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def for_each_batch(
    routed: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, trigger: dict | None = None
) -> StreamingQuery:
    """Hand every routed micro-batch to a function, for sinks without a streaming writer."""
    return (
        routed.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
