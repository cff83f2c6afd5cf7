"""Explicit schemas. Nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

OUTCOME_RAW = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("acceptable", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("acceptable_threshold", T.DoubleType()),
        T.StructField("split", T.StringType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("group", T.StringType()),
    ]
)

HELDOUT_RAW = T.StructType(
    [field for field in OUTCOME_RAW if field.name != "split"]
    + [
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
    ]
)

CARD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("expected_cost_usd", T.DoubleType()),
        T.StructField("input_cost_per_million_usd", T.DoubleType()),
        T.StructField("output_cost_per_million_usd", T.DoubleType()),
        T.StructField("context_tokens", T.LongType()),
        T.StructField("capabilities", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

TOOL_CALL = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]
)

# A call that is not an object counts as a call but is not rendered: a null element.
TURN = T.StructType(
    [
        T.StructField("conv_id", T.StringType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
    ]
)

# A pool is a handful of candidate models; it is the only table assumed small, and the
# size is checked wherever a pool is taken to the driver.
MAX_POOL = 1000
