import statistics

import pytest

from waypost.operators.policy import MACRO, MICRO, fixed_rates, policy_grid, select_policy

MODELS = ["a", "b"]
COSTS = [0.1, 0.4]
# success a/b, label a/b, group
ROWS = [(0.9, 0.95, 1, 1, "x"), (0.2, 0.9, 0, 1, "x"), (0.6, 0.7, 1, 1, "y"), (0.5, 0.55, 0, 1, "y"), (0.8, 0.3, 1, 0, "z")]


@pytest.fixture(scope="module")
def scored(spark):
    data = [("m", g, [pa, pb], [bool(la), bool(lb)]) for pa, pb, la, lb, g in ROWS]
    return spark.createDataFrame(data, "method string, `group` string, success array<double>, acceptable array<boolean>")


def by_hand(weight, aggregation):
    picks = []
    for pa, pb, la, lb, g in ROWS:
        options = [(pa - weight * 0.1 / 0.4, pa, -0.1, "a", la), (pb - weight * 0.4 / 0.4, pb, -0.4, "b", lb)]
        u, p, saving, name, label = max(options)
        picks.append((g, label, -saving, label - lb))
    if aggregation == MICRO:
        diff = [d for *_, d in picks]
        se2 = statistics.variance(diff) / len(diff)
        mean = statistics.fmean
        return mean(l for _, l, _, _ in picks), mean(c for _, _, c, _ in picks), mean(diff), mean(diff) - 1.645 * se2**0.5
    parts = []
    for g in ("x", "y", "z"):
        own = [r for r in picks if r[0] == g]
        diff = [r[3] for r in own]
        var = statistics.variance(diff) if len(diff) > 1 else 0.0
        parts.append((statistics.fmean(r[1] for r in own), statistics.fmean(r[2] for r in own), statistics.fmean(diff), var / len(own)))
    ok, cost, diff = (statistics.fmean(p[i] for p in parts) for i in range(3))
    return ok, cost, diff, diff - 1.645 * (sum(p[3] for p in parts) / 9) ** 0.5


@pytest.mark.parametrize("aggregation", [MICRO, MACRO])
def test_grid_matches_a_plain_computation(scored, aggregation):
    grid = policy_grid(scored, MODELS, COSTS, "b", lambdas=(0.0, 0.2, 0.8), aggregation=aggregation, margin=0.3)
    for row in grid.collect():
        want = by_hand(row["lambda"], aggregation)
        got = (row.success_rate, row.mean_expected_cost_usd, row.difference_vs_best_fixed, row.one_sided_95_lower_difference)
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))
        assert row.passes_noninferiority == (want[3] >= -0.3)


def test_fixed_rates(scored):
    micro = {r.model: r.success_rate for r in fixed_rates(scored, MODELS, MICRO).collect()}
    macro = {r.model: r.success_rate for r in fixed_rates(scored, MODELS, MACRO).collect()}
    assert micro == {"a": 0.6, "b": 0.8}
    assert macro["a"] == pytest.approx((0.5 + 0.5 + 1) / 3) and macro["b"] == pytest.approx(2 / 3)


GRID = "method string, lambda double, success_rate double, mean_expected_cost_usd double, passes_noninferiority boolean"


def test_select_policy_takes_the_cheapest_passing_row(spark):
    rows = [
        ("shared_task_model_hashed_classifier", 0.1, 0.9, 0.2, True),
        ("independent_hashed_logistic", 0.2, 0.9, 0.2, True),
        ("independent_hashed_logistic", 0.4, 0.9, 0.1, False),
    ]
    chosen = select_policy(spark.createDataFrame(rows, GRID)).first()
    assert (chosen.default_method, chosen.default_lambda, chosen.gate_passed) == ("independent_hashed_logistic", 0.2, True)


def test_select_policy_without_a_passing_row(spark):
    rows = [
        ("independent_hashed_logistic", 0.2, 0.9, 0.2, False),
        ("independent_hashed_logistic", 0.0, 0.9, 0.2, False),
        ("shared_task_model_hashed_classifier", 0.0, 0.9, 0.2, False),
    ]
    chosen = select_policy(spark.createDataFrame(rows, GRID)).first()
    assert (chosen.default_method, chosen.default_lambda, chosen.gate_passed) == ("independent_hashed_logistic", 0.0, False)
