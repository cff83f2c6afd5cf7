"""Metrics of policies over a table of per-request choices.

Input: one row per (policy, request): group, selected_model, acceptable, cost_usd.
Everything is rolled up from one aggregate per (policy, group, model).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.operators.policy import even_mean


def policy_cells(choices: DataFrame) -> DataFrame:
    """(policy, group, selected_model, requests, acceptable_count, cost_usd)."""
    return choices.groupBy("policy", "group", "selected_model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.col("acceptable").cast("bigint")).alias("acceptable_count"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def group_rates(cells: DataFrame) -> DataFrame:
    """Success rate per policy and non-empty group."""
    return (
        cells.filter(F.col("group") != "")
        .groupBy("policy", "group")
        .agg(F.sum("requests").alias("requests"), F.sum("acceptable_count").alias("acceptable_count"))
        .withColumn("success_rate", F.col("acceptable_count") / F.col("requests"))
    )


def policy_metrics(cells: DataFrame) -> DataFrame:
    """One row per policy: counts, rates, costs and the route count of each chosen model."""
    # Two roll-ups share one scan of the cells through grouping sets.
    rolled = cells.groupingSets(
        [[F.col("policy"), F.col("group")], [F.col("policy"), F.col("selected_model")]],
        F.col("policy"),
        F.col("group"),
        F.col("selected_model"),
    ).agg(
        F.grouping("group").alias("is_model"),
        F.sum("requests").alias("requests"),
        F.sum("acceptable_count").alias("ok"),
        F.sum("cost_usd").alias("cost"),
    )
    by_model = F.col("is_model") == 1
    grouped = ~by_model & (F.col("group") != "")
    overall = rolled.groupBy("policy").agg(
        F.sum(F.when(by_model, F.col("requests"))).alias("requests"),
        F.sum(F.when(by_model, F.col("ok"))).alias("acceptable_count"),
        even_mean(F.when(grouped, F.col("ok") / F.col("requests"))).alias("macro_group_success_rate"),
        F.sum(F.when(by_model, F.col("cost"))).alias("total_cost_usd"),
        # One entry per model of the pool at most.
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(by_model, F.struct("selected_model", F.col("requests").alias("n")))))
        ).alias("route_counts"),
    )
    return overall.select(
        "policy",
        "requests",
        "acceptable_count",
        (F.col("acceptable_count") / F.col("requests")).alias("success_rate"),
        "macro_group_success_rate",
        "total_cost_usd",
        (F.col("total_cost_usd") / F.col("requests")).alias("mean_cost_usd"),
        "route_counts",
    )


def best_fixed_policy(metrics: DataFrame, prefix: str = "fixed:") -> DataFrame:
    """The best fixed policy by (macro rate else rate, cheaper, name)."""
    best = metrics.filter(F.startswith("policy", F.lit(prefix))).agg(
        F.max(
            F.struct(
                F.coalesce("macro_group_success_rate", "success_rate").alias("rate"),
                (-F.col("total_cost_usd")).alias("saving"),
                "policy",
                "success_rate",
            )
        ).alias("b")
    )
    return best.select(
        F.col("b.policy").alias("best_fixed_policy"),
        F.col("b.success_rate").alias("fixed_success_rate"),
        (-F.col("b.saving")).alias("fixed_total_cost_usd"),
    )


def compare_with_best_fixed(metrics: DataFrame, prefix: str = "router:") -> DataFrame:
    """Quality difference and cost saving of each routed policy against the best fixed one.

    There are as many metric rows as policies, a handful: they meet in one row instead
    of being computed once per side of a join.
    """
    order = F.struct(
        F.coalesce("macro_group_success_rate", "success_rate").alias("rate"),
        (-F.col("total_cost_usd")).alias("saving"),
        "policy",
        "success_rate",
        "total_cost_usd",
    )
    routed = F.startswith("policy", F.lit(prefix))
    gathered = metrics.agg(
        F.max(F.when(F.startswith("policy", F.lit("fixed:")), order)).alias("b"),
        F.collect_list(F.when(routed, F.struct("policy", "success_rate", "total_cost_usd"))).alias("routed"),
    )
    total = F.col("b.total_cost_usd")
    return gathered.select("b", F.inline("routed")).select(
        "policy",
        F.col("b.policy").alias("best_fixed_policy"),
        (F.col("success_rate") - F.col("b.success_rate")).alias("quality_difference"),
        F.when(total > 0, (total - F.col("total_cost_usd")) / total).alias("cost_saving_fraction"),
    )
