"""Routing: constraints, gate, fallback and tuple arg-max, one row in, one row out.

A request keeps its row and the pool is a literal array, so routing a table is a
projection over the scan: no join, no aggregate, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions.text import is_blank
from waypost.operators.matrix import rows_of
from waypost.operators.validate import MODES
from waypost.plans.model import RouterModel

# Rejection reasons in their order, gate scopes, error texts, and the
# utility of a model below the quality floor.
REASONS = ("not_allowed", "provider_denied", "missing_capability", "context_limit", "request_cost_limit")
BELOW_FLOOR = -1.0e300
OVERRIDE_SUFFIX = "_explicit_override"
NO_ELIGIBLE = "no model satisfies the routing constraints"
BLANK_TEXT = "routing text must not be empty"
FALLBACK_INELIGIBLE = "the policy lacks a passing gate and its fixed fallback is ineligible"

DEFAULTS = {
    "mode": "balanced",
    "allowed_models": (),
    "required_capabilities": (),
    "denied_providers": (),
    "input_tokens": 0,
    "output_tokens": 0,
    "max_cost_usd": None,
    "cost_weight": None,
    "quality_threshold": None,
    "max_quality_drop": 0.05,
    "allow_ungated_policy": False,
}
TYPES = {
    "mode": "string",
    "allowed_models": "array<string>",
    "required_capabilities": "array<string>",
    "denied_providers": "array<string>",
    "input_tokens": "bigint",
    "output_tokens": "bigint",
    "max_cost_usd": "double",
    "cost_weight": "double",
    "quality_threshold": "double",
    "max_quality_drop": "double",
    "allow_ungated_policy": "boolean",
}
DECISION_FIELDS = (
    "selected_model",
    "mode",
    "predicted_success",
    "expected_cost_usd",
    "utility",
    "rejected",
    "quality_floor",
    "policy_gate_passed",
    "policy_gate_scope",
    "fallback_applied",
    "artifact_hash",
    "error",
)


def _option_sql(name: str, value) -> str:
    """A scalar or list option as SQL; None takes the default."""
    value = DEFAULTS[name] if value is None else value
    if isinstance(value, (list, tuple, set, frozenset)):
        return f"CAST(array({', '.join(sql_text(x) for x in sorted(value))}) AS {TYPES[name]}) AS __{name}"
    return f"CAST({sql_text(value)} AS {TYPES[name]}) AS __{name}"


def _settle(df: DataFrame, options: dict) -> DataFrame:
    """Add every option as a typed column; a null in an option column takes the default."""
    named = {**DEFAULTS, **options}
    columns = {name: value for name, value in named.items() if isinstance(value, Column)}
    scalars = [_option_sql(name, value) for name, value in named.items() if name not in columns]
    settled = df.select("*", *[value.cast(TYPES[name]).alias(f"__{name}") for name, value in columns.items()])
    filled = [
        f"coalesce(__{name}, {_option_sql(name, None).rsplit(' AS __', 1)[0]}) AS __{name}"
        for name in columns
        if DEFAULTS[name] is not None
    ]
    replaced = [f"__{name}" for name in columns if DEFAULTS[name] is not None]
    star = f"* EXCEPT ({', '.join(replaced)})" if replaced else "*"
    return settled.selectExpr(star, *filled, *scalars)


def sql_text(value) -> str:
    """A scalar as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pool_sql(model: RouterModel) -> str:
    """The pool as a literal array of structs, in pool order."""
    cards = []
    for card, mean in zip(model.cards, model.mean_costs):
        expected = card["expected_cost_usd"]
        capabilities = ", ".join(sql_text(c) for c in card["capabilities"] or [])
        cards.append(
            f"struct({sql_text(card['name'])} AS model, {sql_text(card['provider'] or '')} AS provider, "
            f"CAST(array({capabilities}) AS array<string>) AS capabilities, "
            f"CAST({sql_text(card['context_tokens'])} AS bigint) AS context, "
            f"CAST({sql_text(card['input_cost_per_million_usd'])} AS double) AS price_in, "
            f"CAST({sql_text(card['output_cost_per_million_usd'])} AS double) AS price_out, "
            f"{sql_text(float(mean if expected is None else expected))} AS expected)"
        )
    return f"array({', '.join(cards)})"


def estimate_sql(card: str, tokens_in: str, tokens_out: str) -> str:
    """Token price where the card states both prices, else its expected or learned cost."""
    return (
        f"CASE WHEN {card}.price_in IS NOT NULL AND {card}.price_out IS NOT NULL "
        f"THEN ({tokens_in} * {card}.price_in + {tokens_out} * {card}.price_out) / 1000000 ELSE {card}.expected END"
    )


def candidate_cells(model: RouterModel, success: str) -> str:
    """One cell per pool model: model, p, cost and rejection reasons in their order."""
    not_allowed, denied, missing, context, expensive = (sql_text(reason) for reason in REASONS)
    return f"""
      transform(
        zip_with(`{success}`, {pool_sql(model)}, (p, card) -> struct(
          p, card, {estimate_sql("card", "__input_tokens", "__output_tokens")} AS cost)),
        c -> struct(
          c.card.model AS model, c.p AS p, c.cost AS cost,
          filter(array(
            CASE WHEN size(__allowed_models) > 0 AND NOT array_contains(__allowed_models, c.card.model) THEN {not_allowed} END,
            CASE WHEN array_contains(__denied_providers, c.card.provider) THEN {denied} END,
            CASE WHEN size(array_except(__required_capabilities, c.card.capabilities)) > 0 THEN {missing} END,
            CASE WHEN __input_tokens + __output_tokens > c.card.context THEN {context} END,
            CASE WHEN c.cost > __max_cost_usd THEN {expensive} END), r -> r IS NOT NULL) AS reasons))"""


def close_sql(a: str, b: str) -> str:
    return f"abs({a} - {b}) <= greatest(1e-9D * greatest(abs({a}), abs({b})), 1e-12D)"


def gate_sql(model: RouterModel) -> tuple[str, str]:
    """(gate, scope) of the requested policy. The gate is true, false or unknown."""
    if not model.gate_passed:
        return "false", "'default_policy_failed'"
    gates = model.gates()
    entries = ", ".join(f"struct({sql_text(weight)} AS weight, {sql_text(ok)} AS ok)" for weight, ok in gates)
    table = f"array({entries})" if gates else "CAST(array() AS array<struct<weight:double,ok:boolean>>)"
    balanced = f"get(filter({table}, g -> {close_sql('g.weight', '__cost_weight')}), 0).ok"
    quality = f"CAST({sql_text(dict(gates).get(0.0))} AS boolean)"
    gate = f"CASE __mode WHEN 'balanced' THEN {balanced} WHEN 'quality' THEN {quality} END"
    scope = f"""
      CASE WHEN __mode = 'balanced' THEN
             CASE WHEN {close_sql('__cost_weight', sql_text(float(model.default_lambda)))} THEN 'frozen_default_policy'
                  WHEN {balanced} IS NOT NULL THEN 'calibration_curve_candidate' ELSE 'unevaluated_cost_weight' END
           WHEN __mode = 'quality' THEN
             CASE WHEN {quality} IS NOT NULL THEN 'calibration_curve_candidate' ELSE 'unevaluated_quality_mode' END
           ELSE 'unevaluated_cost_mode' END"""
    return gate, scope


# Best eligible cell by (p, cheaper, name).
PREFER_SUCCESS = "array_max(transform(__eligible, c -> struct(c.p AS p, -c.cost AS saving, c.model AS model))).model"


def decide(df: DataFrame, model: RouterModel, *, success: str, text: str | None, options: dict) -> DataFrame:
    """Add `decision` to rows that hold `success`, an array in pool order.

    Each step names what later steps read more than once, so the optimizer keeps it
    computed instead of repeating it.
    """
    unknown = set(options) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown routing options: {sorted(unknown)}")
    best = sql_text(model.best_fixed)
    gate, scope = gate_sql(model)
    celled = _settle(df, options).selectExpr(
        "* EXCEPT (__cost_weight)",
        f"coalesce(__cost_weight, {sql_text(float(model.default_lambda))}) AS __cost_weight",
        f"{candidate_cells(model, success)} AS __cells",
    )
    gated = celled.selectExpr(
        "*",
        "filter(__cells, c -> size(c.reasons) = 0) AS __eligible",
        f"{gate} AS __gate",
        f"{scope} AS __scope",
    )
    blank = is_blank(F.col(text)) if text else F.lit(False)
    modes = ", ".join(sql_text(mode) for mode in MODES)
    judged = gated.withColumn("__blank", blank | F.col(success).isNull()).selectExpr(
        "*",
        "NOT (__gate <=> true) AND NOT __allow_ungated_policy AS __fallback",
        "CASE WHEN __mode = 'cost' THEN greatest(0D, coalesce(__quality_threshold, "
        "array_max(transform(__eligible, c -> c.p)) - __max_quality_drop)) END AS __floor",
        "coalesce(nullif(array_max(transform(__eligible, c -> c.cost)), 0D), 1D) AS __scale",
        f"""CASE WHEN __mode NOT IN ({modes}) THEN 'mode must be quality, balanced, or cost'
             WHEN least(__input_tokens, __output_tokens) < 0 THEN 'token estimates must be non-negative'
             WHEN NOT __max_quality_drop BETWEEN 0 AND 1 THEN 'max_quality_drop must be in [0, 1]'
             WHEN __blank THEN {sql_text(BLANK_TEXT)}
             WHEN size(__eligible) <= 0 THEN {sql_text(NO_ELIGIBLE)}
             WHEN NOT (__gate <=> true) AND NOT __allow_ungated_policy AND NOT exists(__eligible, c -> c.model = {best})
               THEN {sql_text(FALLBACK_INELIGIBLE)} END AS __error""",
    )
    valued = judged.selectExpr(
        "*",
        f"""transform(__eligible, c -> struct(
              CASE __mode WHEN 'quality' THEN c.p
                          WHEN 'balanced' THEN c.p - __cost_weight * c.cost / __scale
                          ELSE CASE WHEN c.p >= __floor THEN -c.cost ELSE {sql_text(BELOW_FLOOR)} END END AS u,
              c.p AS p, -c.cost AS saving, c.model AS model)) AS __utility""",
    )
    cheapest = (
        "array_min(transform(filter(__eligible, c -> c.p >= __floor), "
        "c -> struct(c.cost AS cost, -c.p AS miss, c.model AS model))).model"
    )
    fields = {
        "selected_model": f"""CASE WHEN __fallback THEN {best}
            WHEN __mode = 'balanced' THEN array_max(__utility).model
            WHEN __mode = 'quality' THEN {PREFER_SUCCESS}
            ELSE coalesce({cheapest}, {PREFER_SUCCESS}) END""",
        "mode": "__mode",
        "predicted_success": "map_from_entries(transform(__cells, c -> struct(c.model, c.p)))",
        "expected_cost_usd": "map_from_entries(transform(__cells, c -> struct(c.model, c.cost)))",
        "utility": f"""map_from_entries(CASE WHEN __fallback
            THEN transform(filter(__eligible, c -> c.model = {best}), c -> struct(c.model AS model, c.p AS u))
            ELSE transform(__utility, c -> struct(c.model AS model, c.u AS u)) END)""",
        "rejected": "map_from_entries(transform(filter(__cells, c -> size(c.reasons) > 0), c -> struct(c.model, c.reasons)))",
        "quality_floor": "CASE WHEN NOT __fallback THEN __floor END",
        "policy_gate_passed": "__gate",
        "policy_gate_scope": f"concat(__scope, CASE WHEN NOT (__gate <=> true) AND __allow_ungated_policy THEN '{OVERRIDE_SUFFIX}' ELSE '' END)",
        "fallback_applied": "__fallback",
        "artifact_hash": sql_text(model.artifact_hash),
    }
    parts = ", ".join(f"CASE WHEN __error IS NULL THEN {sql} END AS {name}" for name, sql in fields.items())
    kept = [f"`{name}`" for name in df.columns]
    return valued.selectExpr(*kept, f"struct({parts}, __error AS error) AS decision")


def route(requests: DataFrame, model: RouterModel, *, text: str = "text", allow_blank: bool = False, **options) -> DataFrame:
    """Route every request of a table or stream.

    Options are scalars or columns, by the names in `DEFAULTS`. A row that cannot be
    routed gets `decision.error` and null fields; the job does not fail. A blank text is
    such a row, unless `allow_blank` has it routed by what features it has.
    """
    predicted = model.predict(requests, text=text, out="__success", allow_blank=allow_blank)
    decided = decide(predicted, model, success="__success", text=None if allow_blank else text, options=options)
    return decided.drop("__success")


def decisions_long(routed: DataFrame, *keys: str) -> DataFrame:
    """One row per (request, model) of routed rows: p, cost, utility and reasons."""
    cells = F.transform(
        F.map_keys("decision.predicted_success"),
        lambda m: F.struct(
            m.alias("model"),
            F.try_element_at("decision.predicted_success", m).alias("predicted_success"),
            F.try_element_at("decision.expected_cost_usd", m).alias("expected_cost_usd"),
            F.try_element_at("decision.utility", m).alias("utility"),
            F.try_element_at("decision.rejected", m).alias("reasons"),
        ),
    )
    return rows_of(routed, list(keys), cells).filter(F.col("model").isNotNull())
