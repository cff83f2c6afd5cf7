"""Routing every call step of every conversation."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypost.operators.prefixes import SLICE_TURNS, render_prefixes, spans_slices
from waypost.plans.model import RouterModel
from waypost.plans.route import route


def route_conversations(
    turns: DataFrame,
    model: RouterModel,
    *,
    is_step: Column | None = None,
    slice_turns: int = SLICE_TURNS,
    input_tokens: Column | int | None = None,
    **options,
) -> DataFrame:
    """One decision per call step, with the provider, the previous model and a switch flag.

    Tokens default to the estimate of the prefix. Steps that cannot be routed keep their
    error and take no part in the sequence of models.
    """
    steps = render_prefixes(turns, is_step=is_step, slice_turns=slice_turns)
    tokens = F.col("prefix_summary.approximate_context_tokens") if input_tokens is None else input_tokens
    output = options.get("output_tokens", 0)
    routed = route(steps, model, input_tokens=tokens, **options)
    providers = F.create_map(*[F.lit(x) for card in model.cards for x in (card["name"], card["provider"] or "")])
    decided = routed.select(
        "conv_id",
        "turn",
        "step_index",
        "prefix_summary",
        "decision",
        F.try_element_at(providers, F.col("decision.selected_model")).alias("selected_provider"),
        (tokens if isinstance(tokens, Column) else F.lit(tokens)).cast("bigint").alias("input_tokens_for_cost"),
        (output if isinstance(output, Column) else F.lit(output)).cast("bigint").alias("output_tokens_for_cost"),
    )
    return with_switches(decided, slice_turns=slice_turns, spans=spans_slices(turns, slice_turns))


def with_switches(decided: DataFrame, *, slice_turns: int = SLICE_TURNS, spans: bool = True) -> DataFrame:
    """Add `previous_model` and `switched` by the order of steps.

    The last model is found inside the slice, else in the summary of earlier slices, so
    no conversation is gathered into one task.
    """
    selected = F.col("decision.selected_model")
    sliced = decided.withColumn("slice", F.floor(F.col("turn") / slice_turns))
    if spans:
        # Read twice below: once per step and once per slice.
        sliced = sliced.persist(StorageLevel.MEMORY_AND_DISK)
    before = Window.partitionBy("conv_id", "slice").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn("local_previous", F.last(selected, ignorenulls=True).over(before))
    if not spans:
        return _flag(local, F.col("local_previous")).drop("slice", "local_previous")
    lasts = sliced.groupBy("conv_id", "slice").agg(
        F.max(F.when(selected.isNotNull(), F.struct("turn", selected.alias("model"))))["model"].alias("last_model")
    )
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("conv_id", "slice", F.last("last_model", ignorenulls=True).over(earlier).alias("carried"))
    joined = local.join(carried, ["conv_id", "slice"], "left")
    return _flag(joined, F.coalesce("local_previous", "carried")).drop("slice", "local_previous", "carried")


def _flag(df: DataFrame, previous: Column) -> DataFrame:
    switched = F.coalesce(F.col("previous_model") != F.col("decision.selected_model"), F.lit(False))
    return df.withColumn("previous_model", previous).withColumn("switched", switched)


def switch_counts(decided: DataFrame) -> DataFrame:
    """Steps and switches per conversation."""
    return decided.filter(F.col("decision.selected_model").isNotNull()).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if("switched").alias("switch_count")
    )


def route_counts(decided: DataFrame, models: list[str]) -> DataFrame:
    """(conv_id, model, routes) with a zero row for each model a conversation never took.

    Counts stand in one row per conversation, so the zeros need no grid join.
    """
    counts = [F.count_if(F.col("decision.selected_model") == m).alias(f"n{i}") for i, m in enumerate(models)]
    wide = decided.groupBy("conv_id").agg(*counts)
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"n{i}").alias("routes")) for i, m in enumerate(models)])
    return wide.select("conv_id", F.inline(cells))
