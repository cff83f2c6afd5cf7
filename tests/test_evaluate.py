import dataclasses
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypost import evaluate_router, paired_bootstrap
from waypost.operators.bootstrap import _log_factorials, binomial, exact_samples, multinomial_samples, poisson_samples, tied_groups


def test_report_compares_modes_with_every_fixed_model(spark, model, heldout):
    report = evaluate_router(
        model, heldout, modes=("quality", "balanced", "cost"), allow_ungated_policy=True, bootstrap_samples=50
    )
    metrics = {r.policy: r for r in report.policy_metrics.collect()}
    assert set(metrics) == {"fixed:cheap", "fixed:strong", "router:quality", "router:balanced", "router:cost"}
    assert all(r.requests == 2 for r in metrics.values())
    assert metrics["fixed:cheap"].acceptable_count == 1 and metrics["fixed:strong"].acceptable_count == 2
    assert metrics["fixed:strong"].total_cost_usd == pytest.approx(0.4)
    assert metrics["fixed:cheap"].macro_group_success_rate == 0.5 and metrics["fixed:cheap"].route_counts == {"cheap": 2}
    assert len(report.held) == 2 and all(table.is_cached for table in report.held)
    report.release()
    assert not any(table.is_cached for table in report.held)
    groups = {(r.policy, r.group): r.success_rate for r in report.group_success_rate.collect()}
    assert groups[("fixed:cheap", "easy")] == 1.0 and groups[("fixed:cheap", "hard")] == 0.0
    comparison = {r.policy: r for r in report.policy_comparison.collect()}
    assert set(comparison) == {"router:quality", "router:balanced", "router:cost"}
    for row in comparison.values():
        assert row.best_fixed_policy == "fixed:strong"
        assert row.quality_low <= row.quality_difference <= row.quality_high
    decisions = report.task_decision.collect()
    assert len(decisions) == 10 and len({r.request_id for r in decisions}) == 2
    fixed = [r for r in decisions if r.policy.startswith("fixed:")]
    assert all(r.policy_gate_scope is None and r.fallback_applied is None for r in fixed)
    config = report.report.first()
    assert config.artifact_hash == model.artifact_hash and config.requests == 2
    assert config.report_hash and config.outcome_matrix_hash


def priced(model):
    cards = [
        dict(c, input_cost_per_million_usd=p_in, output_cost_per_million_usd=p_out)
        for c, (p_in, p_out) in zip(model.cards, ((1.0, 2.0), (10.0, 20.0)))
    ]
    return dataclasses.replace(model, cards=cards)


def test_token_priced_pool_needs_tokens(spark, model, heldout):
    bare = heldout.withColumn("input_tokens", F.lit(None).cast("bigint")).withColumn("output_tokens", F.lit(None).cast("bigint"))
    with pytest.raises(ValueError, match="token"):
        evaluate_router(priced(model), bare, bootstrap_samples=5)
    unpriced = evaluate_router(model, bare, bootstrap_samples=5)
    assert {r.input_tokens for r in unpriced.task_decision.collect()} == {0}


def test_token_prices_fill_missing_costs(spark, model, heldout):
    free = heldout.withColumn("cost_usd", F.lit(None).cast("double"))
    report = evaluate_router(priced(model), free, bootstrap_samples=5)
    totals = {r.policy: r.total_cost_usd for r in report.policy_metrics.collect()}
    assert totals["fixed:cheap"] == pytest.approx(0.0004) and totals["fixed:strong"] == pytest.approx(0.004)
    wide = evaluate_router(priced(model), free, input_tokens=200, output_tokens=100, bootstrap_samples=5)
    assert {r.policy: r.total_cost_usd for r in wide.policy_metrics.collect()}["fixed:cheap"] == pytest.approx(0.0008)


def test_bad_matrices_are_refused(spark, model, heldout):
    for broken in (
        heldout.filter("not (request_id = 'test-1' and model = 'cheap')"),
        heldout.unionByName(heldout.limit(1)),
        heldout.withColumn("text", F.concat("text", "model")),
        heldout.withColumn("group", F.col("model")),
        heldout.limit(0),
    ):
        with pytest.raises(ValueError):
            evaluate_router(model, broken, bootstrap_samples=5)


def test_unroutable_requests_stop_the_evaluation(spark, model, heldout):
    with pytest.raises(ValueError, match="cannot be routed"):
        evaluate_router(model, heldout, input_tokens=10**9, output_tokens=0, bootstrap_samples=5)


def test_free_fixed_policy_has_no_saving(spark, model, heldout):
    report = evaluate_router(model, heldout.withColumn("cost_usd", F.lit(0.0)), bootstrap_samples=5)
    for row in report.policy_comparison.collect():
        assert row.cost_saving_fraction is None and row.saving_low is None


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(3)
    rows = [
        (f"r{i:04d}", p, k, float(rng.randrange(-1, 2)), rng.random(), 1 + rng.random())
        for i in range(400)
        for k, p in enumerate(("router:a", "router:b"))
    ]
    schema = "request_id string, policy string, policy_index int, quality_diff double, routed_cost double, fixed_cost double"
    return spark.createDataFrame(rows, schema).persist()


def test_bootstrap_methods_agree(pairs):
    exact = {r.policy: r for r in paired_bootstrap(pairs, samples=400, method="exact").collect()}
    for method in ("poisson", "multinomial"):
        other = {r.policy: r for r in paired_bootstrap(pairs, samples=400, method=method).collect()}
        assert exact.keys() == other.keys() == {"router:a", "router:b"}
        for policy in exact:
            for name in ("quality_low", "quality_high", "saving_low", "saving_high"):
                assert abs(exact[policy][name] - other[policy][name]) < 0.03


@pytest.mark.parametrize("draw", [poisson_samples, multinomial_samples])
def test_bootstrap_is_reproducible_in_any_partitioning(pairs, draw):
    def run(df):
        return {(r.policy, r.sample): round(r.quality, 9) for r in draw(df, samples=20, seed=5).collect()}

    assert run(pairs.coalesce(1)) == run(pairs.repartition(5))
    exact = exact_samples(pairs, samples=20, seed=5, requests=400)
    assert exact.count() == 40


def test_exact_draws_of_many_requests_join_instead(pairs, monkeypatch):
    def run(df):
        return {(r.policy, r.sample): (round(r.quality, 9), round(r.saving, 9)) for r in exact_samples(df, samples=20, seed=5, requests=400).collect()}

    few = run(pairs.coalesce(1))
    by_hand = {r.request_id: r.quality_diff for r in pairs.filter("policy = 'router:b'").collect()}
    ordered = [by_hand[k] for k in sorted(by_hand)]
    picked = [ordered[int(hashlib.md5(f"{5 + 1}:3:{d}".encode()).hexdigest()[:8], 16) % 400] for d in range(400)]
    assert few["router:b", 3][0] == round(sum(picked) / 400, 9)
    monkeypatch.setattr("waypost.operators.bootstrap.EXACT_REQUESTS", 100)
    monkeypatch.setattr("waypost.operators.bootstrap.DRAWS_PER_TASK", 1000, raising=False)
    assert run(pairs.repartition(5)) == few


def test_bootstrap_arguments(pairs):
    with pytest.raises(ValueError):
        paired_bootstrap(pairs, samples=0)
    with pytest.raises(ValueError):
        paired_bootstrap(pairs, method="other")
    with pytest.raises(ValueError, match="lacks a policy"):
        paired_bootstrap(pairs.filter("not (policy = 'router:a' and request_id = 'r0001')"), samples=5)


def test_binomial_draws_invert_the_distribution():
    """The outcomes' shares of the unit interval are their probabilities, in the order of their distance from the mode."""
    table, steps = _log_factorials(), 20_000
    u = (np.arange(steps) + 0.5) / steps
    for n, p in ((1, 0.5), (7, 0.3), (40, 0.01), (1000, 0.5), (300, 0.999)):
        drawn = binomial(np.full(steps, n), p, u, table)
        masses = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        shares = np.bincount(drawn, minlength=n + 1) / steps
        assert np.abs(shares - masses).max() < 2 / steps
    assert binomial(np.array([5, 0, 9]), 0.0, u[:3], table).tolist() == [0, 0, 0]
    assert binomial(np.array([5, 0, 9]), 1.0, u[:3], table).tolist() == [5, 0, 9]
    large = binomial(np.full(2000, 10**9), 0.25, (np.arange(2000) + 0.5) / 2000, table)
    assert abs(large.mean() - 2.5e8) < 1500 and abs(large.std() - math.sqrt(1e9 * 0.1875)) < 500


def test_multinomial_takes_every_draw_and_costs_by_groups(spark):
    """Requests that are alike make one group, and each sample takes as many requests as there are."""
    rows = spark.range(60_000).selectExpr(
        "cast(id as string) AS request_id", "'router:a' AS policy", "0 AS policy_index", "double(id % 3 - 1) AS quality_diff",
        "0.1D + 0.1D * (id % 2) AS routed_cost", "0.4D AS fixed_cost",
    )
    assert tied_groups(rows).count() == 6
    assert sum(r.requests for r in tied_groups(rows).collect()) == 60_000
    found = multinomial_samples(rows.withColumn("quality_diff", F.lit(1.0)), samples=50, seed=1).collect()
    assert len(found) == 50 and all(abs(r.quality - 1) < 1e-12 for r in found)
    one = [r.quality for r in multinomial_samples(rows, samples=600, seed=2, blocks=1).collect()]
    many = [r.quality for r in multinomial_samples(rows, samples=600, seed=2, blocks=16).collect()]
    deviation = math.sqrt((2 / 3) / 60_000)
    for values in (one, many):
        assert abs(np.mean(values)) < 5 * deviation / math.sqrt(600) and 0.85 < np.std(values) / deviation < 1.15
