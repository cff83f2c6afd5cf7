import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypost import RouterModel, route, train_router
from waypost.operators.heads import INDEPENDENT, SHARED
from waypost.plans.route import decisions_long


def ask(spark, model, text, **options):
    row = route(spark.createDataFrame([(text,)], "text string"), model, **options).first()
    return row["decision"]


def test_modes_and_constraints(spark, model):
    quality = ask(spark, model, "prove a hard theorem", mode="quality")
    cost = ask(spark, model, "simple greeting", mode="cost", max_quality_drop=0.2)
    tools = ask(spark, model, "use a tool", required_capabilities=["tools"])
    assert quality.selected_model == "strong" and quality.error is None
    assert cost.expected_cost_usd["cheap"] < cost.expected_cost_usd["strong"]
    assert cost.fallback_applied and cost.policy_gate_scope == "unevaluated_cost_mode"
    assert tools.selected_model == "strong" and tools.rejected == {"cheap": ["missing_capability"]}
    assert tools.policy_gate_passed is True and tools.policy_gate_scope == "frozen_default_policy"
    assert tools.artifact_hash == model.artifact_hash


def test_context_provider_cost_and_allow_list(spark, model):
    context = ask(spark, model, "long request", input_tokens=5000)
    assert context.selected_model == "strong" and context.rejected["cheap"] == ["context_limit"]
    provider = ask(spark, model, "simple greeting", denied_providers=["remote"], allow_ungated_policy=True)
    assert provider.selected_model == "cheap" and provider.rejected["strong"] == ["provider_denied"]
    dear = ask(spark, model, "x", max_cost_usd=0.05, allowed_models=["cheap", "strong"])
    assert dear.rejected == {"strong": ["request_cost_limit"]}
    both = ask(spark, model, "x", input_tokens=20000, allowed_models=["strong"])
    assert both.error == "no model satisfies the routing constraints" and both.selected_model is None


def test_bad_rows_carry_an_error_and_the_job_goes_on(spark, model):
    df = spark.createDataFrame([("ok", "balanced"), (" \n", "balanced"), ("ok", "fast")], "text string, mode string")
    rows = route(df, model, mode=F.col("mode")).collect()
    assert [r.decision.error is None for r in rows] == [True, False, False]


def test_blank_texts_are_routed_when_allowed(spark, model):
    """In one pass as all others, a null text as an empty one; other errors stay."""
    df = spark.createDataFrame([("", "balanced"), (" \n", "balanced"), (None, "balanced"), ("", "fast")], "text string, mode string")
    assert all(r.decision.error for r in route(df, model, mode=F.col("mode")).collect())
    routed = route(df, model, mode=F.col("mode"), allow_blank=True)
    rows = [r.decision for r in routed.collect()]
    assert routed.columns == ["text", "mode", "decision"] and rows[0].selected_model and rows[0] == rows[1] == rows[2]
    assert rows[3].error and rows[3].selected_model is None
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_failed_gate_falls_back_closed(spark, model):
    failed = dataclasses.replace(model, gate_passed=False, best_fixed="strong")
    for mode in ("balanced", "cost", "quality"):
        decision = ask(spark, failed, "simple greeting", mode=mode)
        assert decision.selected_model == "strong" and decision.fallback_applied
        assert decision.policy_gate_passed is False and decision.quality_floor is None
        assert list(decision.utility) == ["strong"]
    override = ask(spark, failed, "simple greeting", mode="cost", allow_ungated_policy=True)
    assert not override.fallback_applied and override.policy_gate_scope.endswith("_explicit_override")
    closed = ask(spark, failed, "simple greeting", denied_providers=["remote"])
    assert "fixed fallback is ineligible" in closed.error


def test_gate_scopes_and_close_weights(spark, model):
    grid = [dict(row, passes_noninferiority=row["lambda"] != 0.8) for row in model.grid]
    gated = dataclasses.replace(model, grid=grid, default_lambda=0.1)
    assert ask(spark, gated, "x", cost_weight=0.1 + 1e-13).policy_gate_scope == "frozen_default_policy"
    assert ask(spark, gated, "x", cost_weight=0.2).policy_gate_scope == "calibration_curve_candidate"
    assert ask(spark, gated, "x", cost_weight=0.3).policy_gate_scope == "unevaluated_cost_weight"
    stopped = ask(spark, gated, "x", cost_weight=0.8)
    assert stopped.policy_gate_passed is False and stopped.fallback_applied
    no_zero = dataclasses.replace(gated, grid=[r for r in grid if r["lambda"] != 0.0])
    assert ask(spark, no_zero, "x", mode="quality").policy_gate_scope == "unevaluated_quality_mode"


def test_repeated_grid_rows_keep_the_last_gate(model):
    row = dict(model.grid[0])
    twice = dataclasses.replace(model, grid=[dict(row, passes_noninferiority=True), dict(row, passes_noninferiority=False)])
    assert twice.gates() == [(row["lambda"], False)]


def test_zero_cost_pool_and_names_break_ties(spark, model):
    cards = [dict(c, expected_cost_usd=0.0, provider="o'clock") for c in model.cards]
    calibrators = {m: [c[0]] * 2 for m, c in model.calibrators.items()}
    heads = {m: dataclasses.replace(h, weights=h.weights * 0, biases=h.biases * 0) for m, h in model.heads.items()}
    even = dataclasses.replace(model, cards=cards, calibrators=calibrators, heads=heads)
    assert ask(spark, even, "x", mode="quality").selected_model == "strong"
    assert ask(spark, even, "x", allow_ungated_policy=True).selected_model == "strong"
    assert ask(spark, even, "x", mode="cost", allow_ungated_policy=True).selected_model == "cheap"


def test_learned_mean_prices_a_card_without_costs(spark, model):
    cards = [dict(c, expected_cost_usd=None) for c in model.cards]
    bare = dataclasses.replace(model, cards=cards)
    decision = ask(spark, bare, "x")
    assert decision.expected_cost_usd == dict(zip(model.models, model.mean_costs))


def test_long_form(spark, model):
    routed = route(spark.createDataFrame([("a", "hello")], "id string, text string"), model)
    rows = decisions_long(routed, "id").collect()
    assert {r.model for r in rows} == {"cheap", "strong"}


def test_routing_is_one_pass(spark, model):
    df = spark.createDataFrame([("a", "hello")], "id string, text string")
    plan = route(df, model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_save_load_round_trip_and_tampering(spark, model, tmp_path):
    path = str(tmp_path / "router")
    model.save(spark, path)
    loaded = RouterModel.load(spark, path)
    assert loaded.content_hash() == model.content_hash()
    assert ask(spark, loaded, "prove a hard theorem") == ask(spark, model, "prove a hard theorem")
    costs = spark.read.parquet(f"{path}/mean_cost").withColumn("mean_cost_usd", F.col("mean_cost_usd") + 1).collect()
    spark.createDataFrame(costs, "model string, mean_cost_usd double").write.mode("overwrite").parquet(f"{path}/mean_cost")
    with pytest.raises(ValueError, match="hash mismatch"):
        RouterModel.load(spark, path)


def test_model_parts_must_fit_together(model):
    with pytest.raises(ValueError):
        dataclasses.replace(model, best_fixed="ghost")
    with pytest.raises(ValueError):
        dataclasses.replace(model, cards=model.cards[:1])


def test_logistic_backend_fits_both_heads(spark, outcomes, cards):
    fitted = train_router(outcomes, cards, dimension=128, backend="logistic")
    assert set(fitted.heads) == {INDEPENDENT, SHARED}
    assert {c.kind for c in fitted.calibrators[fitted.default_method]} == {"linear"}
    assert len(fitted.grid) == 14 and fitted.gate_passed
    # The strong model always succeeds: one class only, so it has a prior and no weights.
    head = fitted.heads[INDEPENDENT]
    strong = head.models.index("strong")
    assert not head.weights[:, strong].any() and abs(head.biases[strong] - np.log(12.5 / 0.5)) < 1e-9
    rows = fitted.predict(spark.createDataFrame([("simple greeting",), ("prove a hard theorem",)], "text string")).collect()
    cheap = fitted.models.index("cheap")
    assert rows[0].success[cheap] > rows[1].success[cheap]


def test_training_rejects_bad_input(spark, outcomes, cards):
    with pytest.raises(ValueError, match="backend"):
        train_router(outcomes, cards, backend="other")
    with pytest.raises(ValueError, match="aggregation"):
        train_router(outcomes, cards, aggregation="other")
    with pytest.raises(ValueError, match="macro_group"):
        train_router(outcomes, cards, aggregation="macro_group")
    with pytest.raises(ValueError, match="train matrix"):
        train_router(outcomes.filter("not (request_id = 'train-1' and model = 'cheap')"), cards)
    with pytest.raises(ValueError, match="calibration"):
        train_router(outcomes.filter("split = 'train'"), cards)
