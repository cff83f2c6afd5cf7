"""Chat payload logs: routable text, token counts and routing options of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions.text import is_blank

# Content part types that carry text, and defaults of a payload.
TEXT_PARTS = ("text", "input_text")
AUTO = "auto"
DEFAULT_OUTPUT_TOKENS = 1024
CHARS_PER_TOKEN = 4


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _is_null(v: Column) -> Column:
    """Key present with an explicit JSON null."""
    return v.isNotNull() & F.coalesce(F.is_variant_null(v), F.lit(False))


def message_parts(message: Column) -> Column:
    """Text parts of one message: its string content, or the text items of a list."""
    content = _at(message, "$.content")
    items = F.filter(
        _at(message, "$.content", "array<variant>"), lambda item: _at(item, "$.type", "string").isin(*TEXT_PARTS)
    )
    return (
        F.when(_kind(content) == "STRING", F.array(_at(message, "$.content", "string")))
        .when(
            F.startswith(_kind(content), F.lit("ARRAY")),
            F.transform(items, lambda item: F.coalesce(_at(item, "$.text", "string"), F.lit(""))),
        )
        .otherwise(F.array().cast("array<string>"))
    )


def payload_text(df: DataFrame, payload: str = "payload", out: str = "text") -> DataFrame:
    """Add the routable text of a payload and `text_error` where it has none."""
    parsed = df.withColumn("__v", F.try_parse_json(F.col(payload)))
    messages = _at(F.col("__v"), "$.messages", "array<variant>")
    parts = F.filter(F.flatten(F.transform(messages, message_parts)), lambda part: ~is_blank(part))
    listed = F.startswith(_kind(_at(F.col("__v"), "$.messages")), F.lit("ARRAY"))
    texted = parsed.withColumn("__listed", listed).withColumn(out, F.array_join(parts, "\n"))
    error = F.when(~F.col("__listed"), "messages must be a list").when(
        F.coalesce(F.col(out), F.lit("")) == "", "messages contain no routable text"
    )
    return texted.withColumn("text_error", error).drop("__v", "__listed")


def payload_arguments(
    df: DataFrame,
    payload: str = "payload",
    *,
    text: str = "text",
    default_mode: str = "balanced",
    default_output_tokens: int = DEFAULT_OUTPUT_TOKENS,
    router_name: str = AUTO,
) -> DataFrame:
    """Add the routing options of a payload, and `option_error` where one is unusable.

    An absent key takes its default; an explicit null where a value is needed is an
    error. A pinned model becomes a one-element allow-list.
    """
    v = F.col("__v")
    parsed = df.withColumn("__v", F.try_parse_json(F.col(payload)))
    options = _at(v, "$.router")
    names = ("input_tokens", "output_tokens", "max_quality_drop", "required_capabilities", "denied_providers")
    option = {name: _at(v, f"$.router.{name}") for name in names}
    completion, maximum = _at(v, "$.max_completion_tokens"), _at(v, "$.max_tokens")
    output_source = F.coalesce(option["output_tokens"], completion, maximum)
    model = _at(v, "$.model", "string")
    pinned = model.isNotNull() & ~model.isin(router_name, AUTO)
    bad_number = (
        (option["input_tokens"].isNotNull() & _at(v, "$.router.input_tokens", "bigint").isNull())
        | (output_source.isNotNull() & F.try_variant_get(output_source, "$", "bigint").isNull())
        | (option["max_quality_drop"].isNotNull() & _at(v, "$.router.max_quality_drop", "double").isNull())
    )
    def unusable(name: str, kind: str) -> Column:
        """Given and not null, but of another type: a constraint must not fall away in silence."""
        given = _at(v, f"$.router.{name}")
        return given.isNotNull() & ~_is_null(given) & _at(v, f"$.router.{name}", kind).isNull()

    unread_number = F.lit(False)
    for name in ("max_cost_usd", "cost_weight", "quality_threshold"):
        unread_number = unread_number | unusable(name, "double")
    unread_list = F.lit(False)
    for name in ("allowed_models", "required_capabilities", "denied_providers"):
        unread_list = unread_list | unusable(name, "array<string>")
    bad_list = _is_null(option["required_capabilities"]) | _is_null(option["denied_providers"])
    not_object = options.isNotNull() & ~_is_null(options) & ~F.startswith(_kind(options), F.lit("OBJECT"))
    mode = _at(v, "$.router.mode")
    picked = parsed.select(
        *df.columns,
        F.when(not_object, "router options must be an object")
        .when(bad_number | unread_number, "router options need numbers")
        .when(bad_list | unread_list, "router options need lists")
        .alias("option_error"),
        F.when(mode.isNull(), F.lit(default_mode)).otherwise(F.coalesce(_at(v, "$.router.mode", "string"), F.lit("None"))).alias("mode"),
        F.when(pinned, F.array(model)).otherwise(_at(v, "$.router.allowed_models", "array<string>")).alias("allowed_models"),
        _at(v, "$.router.required_capabilities", "array<string>").alias("required_capabilities"),
        _at(v, "$.router.denied_providers", "array<string>").alias("denied_providers"),
        F.coalesce(
            _at(v, "$.router.input_tokens", "bigint"),
            F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("bigint"),
        ).alias("input_tokens"),
        F.coalesce(F.try_variant_get(output_source, "$", "bigint"), F.lit(default_output_tokens)).cast("bigint").alias("output_tokens"),
        _at(v, "$.router.max_cost_usd", "double").alias("max_cost_usd"),
        _at(v, "$.router.cost_weight", "double").alias("cost_weight"),
        _at(v, "$.router.quality_threshold", "double").alias("quality_threshold"),
        F.coalesce(_at(v, "$.router.max_quality_drop", "double"), F.lit(0.05)).alias("max_quality_drop"),
    )
    return picked
