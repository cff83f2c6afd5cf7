"""Conversation prefixes: what a router may see before each call of an agent.

Turns are windowed inside slices of a conversation, and what a slice must know of the
slices before it is carried in as a small summary. A conversation shorter than a slice
needs no carry, and a conversation that holds a third of all turns spreads over many
tasks. Every frame is bounded or a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypost.functions.strings import (
    CODE_HINT,
    QUESTION_HINT,
    bounded,
    nonzero_codes,
    tool_call_text,
    visible_content,
)

# Limits and buckets of the rendered prefix.
RECENT_MESSAGES = 6
RECENT_CODES = 4
CONTENT_LIMIT = 2000
CALLS_LIMIT = 1500
RECENT_LIMIT = 8000
ORIGINAL_LIMIT = 8000
CHARS_PER_TOKEN = 4

SLICE_TURNS = 1024

SUMMARY_FIELDS = (
    "step_index",
    "message_count",
    "tool_call_count",
    "tool_result_count",
    "recent_nonzero_returncodes",
    "approximate_context_tokens",
    "original_request_chars",
    "recent_visible_chars",
    "has_code_hint",
    "has_question_hint",
)


# Fixed value: how a message without a role is shown; it counts no characters and matches no role.
UNKNOWN_ROLE = "unknown"


def turn_features(turns: DataFrame) -> DataFrame:
    """Per-turn parts: visible text, rendered calls, blocks, counts, return codes."""
    shown = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("role", F.lit(UNKNOWN_ROLE)).alias("shown_role"),
        visible_content(F.col("content")).alias("visible"),
        tool_call_text(F.col("tool_calls")).alias("calls_text"),
        F.greatest(F.coalesce(F.size("tool_calls"), F.lit(0)), F.lit(0)).cast("bigint").alias("calls"),
    )
    blocks = F.filter(
        F.array(
            F.when(
                F.col("visible") != "",
                F.concat(F.lit("RECENT_ROLE_"), F.upper("shown_role"), F.lit("\n"), bounded(F.col("visible"), CONTENT_LIMIT)),
            ),
            F.when(
                F.col("calls_text") != "",
                F.concat(F.lit("RECENT_TOOL_CALL\n"), bounded(F.col("calls_text"), CALLS_LIMIT)),
            ),
        ),
        lambda b: b.isNotNull(),
    )
    codes = nonzero_codes(F.col("visible"))
    return shown.select(
        "conv_id",
        "turn",
        "role",
        "calls",
        blocks.alias("blocks"),
        F.when(
            F.col("role") == "user",
            F.struct(bounded(F.col("visible"), ORIGINAL_LIMIT).alias("text"), F.length("visible").alias("chars")),
        ).alias("user"),
        (F.length("role") + F.length("visible") + F.length("calls_text")).cast("bigint").alias("chars"),
        (F.col("role") == "tool").cast("bigint").alias("result"),
        F.slice(codes, F.greatest(F.size(codes) - RECENT_CODES + 1, F.lit(1)), RECENT_CODES).alias("codes"),
    )


def _last(array: Column, count: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - count + 1, F.lit(1)), count)


def prefix_state(features: DataFrame, *, is_step: Column | None = None, slice_turns: int = SLICE_TURNS) -> DataFrame:
    """Per turn, the state of the turns before it: counts, first request, recent parts."""
    step = (F.col("role") == "assistant") if is_step is None else is_step
    # The slice is part of the partitioning key of every window, so the one exchange
    # below serves them all.
    sliced = (
        features.withColumn("slice", F.floor(F.col("turn") / slice_turns))
        .withColumn("has_codes", F.size("codes") > 0)
        .repartition("conv_id", "slice")
    )
    w = Window.partitionBy("conv_id", "slice").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    with_codes = Window.partitionBy("conv_id", "slice", "has_codes").orderBy("turn").rowsBetween(1 - RECENT_CODES, 0)
    coded = sliced.withColumn(
        "code_tail", F.when(F.col("has_codes"), _last(F.flatten(F.collect_list("codes").over(with_codes)), RECENT_CODES))
    )
    local = coded.select(
        "conv_id",
        "turn",
        "slice",
        "role",
        F.count(F.lit(1)).over(before).alias("messages"),
        F.coalesce(F.sum("calls").over(before), F.lit(0)).alias("calls"),
        F.coalesce(F.sum("result").over(before), F.lit(0)).alias("results"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars"),
        F.first("user", ignorenulls=True).over(before).alias("user"),
        F.last("code_tail", ignorenulls=True).over(before).alias("code_tail"),
        F.collect_list("blocks").over(w.rowsBetween(-RECENT_MESSAGES, -1)).alias("recent"),
    )
    # A step needs at least one earlier message. Counting is settled after the carry.
    spans = spans_slices(features, slice_turns)
    if spans:
        local = _carry_in(local, coded)
    counted = local.filter(F.col("messages") > 0).filter(step)
    return _number_steps(counted, spans)


def spans_slices(features: DataFrame, slice_turns: int) -> bool:
    """Whether any conversation reaches beyond its first slice (reads one column)."""
    bounds = features.agg(F.min("turn").alias("lo"), F.max("turn").alias("hi")).first()
    return bounds["lo"] is not None and bounds["lo"] // slice_turns != bounds["hi"] // slice_turns


def _carry_in(local: DataFrame, coded: DataFrame) -> DataFrame:
    """Add what the earlier slices of the conversation contribute."""
    tail = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("from_end") <= RECENT_MESSAGES, F.struct("turn", "blocks")))),
        lambda r: r["blocks"],
    )
    by_slice = Window.partitionBy("conv_id", "slice").orderBy(F.desc("turn"))
    summary = (
        coded.withColumn("from_end", F.row_number().over(by_slice))
        .groupBy("conv_id", "slice")
        .agg(
            F.count(F.lit(1)).alias("s_messages"),
            F.sum("calls").alias("s_calls"),
            F.sum("result").alias("s_results"),
            F.sum("chars").alias("s_chars"),
            F.min(F.when(F.col("user").isNotNull(), F.struct("turn", "user")))["user"].alias("s_user"),
            F.max(F.when(F.col("has_codes"), F.struct("turn", "code_tail")))["code_tail"].alias("s_codes"),
            tail.alias("s_tail"),
        )
        .withColumn("s_has_codes", F.col("s_codes").isNotNull())
    )
    earlier = Window.partitionBy("conv_id").orderBy("slice")
    prior = earlier.rowsBetween(Window.unboundedPreceding, -1)
    coded_only = Window.partitionBy("conv_id", "s_has_codes").orderBy("slice").rowsBetween(1 - RECENT_CODES, 0)
    joined_codes = summary.withColumn(
        "s_code_tail",
        F.when(F.col("s_has_codes"), _last(F.flatten(F.collect_list("s_codes").over(coded_only)), RECENT_CODES)),
    )
    carried = joined_codes.select(
        "conv_id",
        "slice",
        F.coalesce(F.sum("s_messages").over(prior), F.lit(0)).alias("c_messages"),
        F.coalesce(F.sum("s_calls").over(prior), F.lit(0)).alias("c_calls"),
        F.coalesce(F.sum("s_results").over(prior), F.lit(0)).alias("c_results"),
        F.coalesce(F.sum("s_chars").over(prior), F.lit(0)).alias("c_chars"),
        F.first("s_user", ignorenulls=True).over(prior).alias("c_user"),
        F.last("s_code_tail", ignorenulls=True).over(prior).alias("c_codes"),
        _last(F.flatten(F.collect_list("s_tail").over(earlier.rowsBetween(-RECENT_MESSAGES, -1))), RECENT_MESSAGES).alias("c_recent"),
    )
    none = F.array().cast("array<boolean>")
    return local.join(carried, ["conv_id", "slice"]).select(
        "conv_id",
        "turn",
        "slice",
        "role",
        (F.col("messages") + F.col("c_messages")).alias("messages"),
        (F.col("calls") + F.col("c_calls")).alias("calls"),
        (F.col("results") + F.col("c_results")).alias("results"),
        (F.col("chars") + F.col("c_chars")).alias("chars"),
        F.coalesce("c_user", "user").alias("user"),
        _last(F.concat(F.coalesce("c_codes", none), F.coalesce("code_tail", none)), RECENT_CODES).alias("code_tail"),
        _last(F.concat("c_recent", "recent"), RECENT_MESSAGES).alias("recent"),
    )


def _number_steps(steps: DataFrame, spans: bool) -> DataFrame:
    """Number the call steps of a conversation from zero, slice by slice."""
    local = Window.partitionBy("conv_id", "slice").orderBy("turn")
    numbered = steps.withColumn("local_step", F.row_number().over(local) - 1)
    if not spans:
        return numbered.withColumnRenamed("local_step", "step_index")
    sizes = steps.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return numbered.join(offsets, ["conv_id", "slice"]).withColumn(
        "step_index", (F.col("local_step") + F.col("offset")).cast("int")
    ).drop("local_step", "offset")


def render_prefixes(
    turns: DataFrame, *, is_step: Column | None = None, step_index: Column | None = None, slice_turns: int = SLICE_TURNS
) -> DataFrame:
    """One row per call step: classifier text and summary of the turns before it.

    A step is an assistant turn with an earlier turn, or any turn `is_step` marks.
    """
    state = prefix_state(turn_features(turns), is_step=is_step, slice_turns=slice_turns)
    step = F.col("step_index") if step_index is None else step_index
    settled = state.select(
        "conv_id",
        "turn",
        step.cast("bigint").alias("step_index"),
        F.col("messages").alias("message_count"),
        F.col("calls").alias("tool_call_count"),
        F.col("results").alias("tool_result_count"),
        F.size(F.filter(F.coalesce("code_tail", F.array().cast("array<boolean>")), lambda bad: bad))
        .cast("bigint")
        .alias("recent_nonzero_returncodes"),
        F.greatest(F.lit(1), F.ceil(F.col("chars") / CHARS_PER_TOKEN)).cast("bigint").alias("approximate_context_tokens"),
        F.coalesce("user.chars", F.lit(0)).cast("bigint").alias("original_request_chars"),
        F.coalesce("user.text", F.lit("")).alias("original"),
        F.array_join(F.flatten("recent"), "\n\n").alias("joined"),
    ).withColumn("recent", bounded(F.col("joined"), RECENT_LIMIT))
    hinted = settled.select(
        "*",
        F.length("recent").cast("bigint").alias("recent_visible_chars"),
        (F.col("original").rlike(CODE_HINT) | F.col("recent").rlike(CODE_HINT)).alias("has_code_hint"),
        F.col("original").rlike(QUESTION_HINT).alias("has_question_hint"),
    )
    metadata = F.concat_ws(" ", *[F.concat(F.lit(f"__{name}_"), value.cast("string")) for name, value in _buckets()])
    rendered = F.concat(
        F.lit("ROUTER_METADATA "), metadata,
        F.lit("\n\nRECENT_VISIBLE_STATE\n"), F.col("recent"),
        F.lit("\n\nORIGINAL_USER_REQUEST\n"), F.col("original"),
    )
    return hinted.select(
        "conv_id", "turn", "step_index", rendered.alias("text"), F.struct(*SUMMARY_FIELDS).alias("prefix_summary")
    )


def _buckets() -> list[tuple[str, Column]]:
    def bucket(name, width, top):
        return F.least(F.lit(top).cast("bigint"), F.floor(F.col(name) / width))

    return [
        ("step_bucket", bucket("step_index", 5, 9)),
        ("message_bucket", bucket("message_count", 5, 15)),
        ("context_bucket", bucket("approximate_context_tokens", 2000, 15)),
        ("tool_calls", bucket("tool_call_count", 1, 20)),
        ("tool_results", bucket("tool_result_count", 1, 20)),
        ("recent_failures", F.col("recent_nonzero_returncodes")),
        ("has_code", F.col("has_code_hint").cast("int")),
        ("has_question", F.col("has_question_hint").cast("int")),
    ]


def context_tokens(turns: DataFrame, *, slice_turns: int = SLICE_TURNS) -> DataFrame:
    """Token estimate of each whole conversation, combined map-side."""
    return turn_features(turns).groupBy("conv_id").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("chars") / CHARS_PER_TOKEN)).cast("bigint").alias("context_tokens")
    )
