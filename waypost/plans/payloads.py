"""Routing of chat payload logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.plans.model import RouterModel
from waypost.plans.route import DECISION_FIELDS, route
from waypost.sources.payloads import payload_arguments, payload_text

OPTION_COLUMNS = (
    "mode",
    "allowed_models",
    "required_capabilities",
    "denied_providers",
    "input_tokens",
    "output_tokens",
    "max_cost_usd",
    "cost_weight",
    "quality_threshold",
    "max_quality_drop",
)


def route_payloads(
    df: DataFrame, model: RouterModel, *, payload: str = "payload", allow_ungated_policy: bool = False, **defaults
) -> DataFrame:
    """Add `decision` to each payload row; unusable payloads carry their error."""
    kept = df.columns
    parsed = payload_arguments(payload_text(df, payload, "__text"), payload, text="__text", **defaults)
    routed = route(
        parsed,
        model,
        text="__text",
        allow_ungated_policy=allow_ungated_policy,
        **{name: F.col(name) for name in OPTION_COLUMNS},
    )
    early = F.coalesce("option_error", "text_error")
    fields = [
        F.when(early.isNull(), F.col(f"decision.{name}")).alias(name) if name != "error" else F.coalesce(early, "decision.error").alias(name)
        for name in DECISION_FIELDS
    ]
    return routed.withColumn("decision", F.struct(*fields)).select(*kept, "decision")
