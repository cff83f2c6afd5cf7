"""Cost columns. Precedence differs by purpose and is spelled out in each function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions.mathx import estimate_cost
from waypost.operators.sizing import broadcast_as


def card_estimate(tokens_in: Column, tokens_out: Column) -> Column:
    """Card estimate on rows that already hold the card's columns."""
    return estimate_cost(
        tokens_in,
        tokens_out,
        F.col("input_cost_per_million_usd"),
        F.col("output_cost_per_million_usd"),
        F.col("expected_cost_usd"),
    )


def mean_costs(outcomes: DataFrame, cards: DataFrame) -> DataFrame:
    """Learned cost per model: mean observed training cost, else the card's expected cost."""
    observed = (
        outcomes.filter(F.col("split") == "train").groupBy("model").agg(F.avg("cost_usd").alias("observed"))
    )
    return cards.join(observed, cards["name"] == observed["model"], "left").select(
        F.col("name").alias("model"), F.coalesce("observed", "expected_cost_usd").alias("mean_cost_usd")
    )


def routing_costs(requests: DataFrame, cards: DataFrame, learned: DataFrame) -> DataFrame:
    """Cost per (request, model) when routing: card estimate first, learned mean last."""
    priced = cards.join(learned, cards["name"] == learned["model"], "left").drop("model")
    return requests.crossJoin(broadcast_as(priced, cards)).withColumn("model", F.col("name")).withColumn(
        "cost_usd",
        F.coalesce(card_estimate(F.col("input_tokens"), F.col("output_tokens")), "mean_cost_usd"),
    )


def observed_costs(heldout: DataFrame, cards: DataFrame, learned: DataFrame) -> DataFrame:
    """Cost per held-out cell: observed, else card estimate, else learned mean."""
    priced = cards.join(learned, cards["name"] == learned["model"], "left").select(
        F.col("name").alias("model"),
        "input_cost_per_million_usd",
        "output_cost_per_million_usd",
        "expected_cost_usd",
        "mean_cost_usd",
    )
    estimate = card_estimate(
        F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    )
    return heldout.join(broadcast_as(priced, cards), "model").withColumn(
        "request_cost_usd", F.coalesce("cost_usd", estimate, "mean_cost_usd")
    ).drop("input_cost_per_million_usd", "output_cost_per_million_usd", "expected_cost_usd", "mean_cost_usd")
