import random

import pytest

from waypost.operators import calibrate as C
from waypost.operators.asof import calibrate_as_of
from waypost.functions.mathx import ipcw_weight
from pyspark.sql import functions as F


def max_min_fit(points):
    """Isotonic fit by its max–min formula: points are (weight, weighted sum) in order."""
    n = len(points)

    def mean(i, j):
        part = points[i : j + 1]
        return sum(s for _, s in part) / sum(w for w, _ in part)

    return [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def rows(seed, n, keys, bins):
    rng = random.Random(seed)
    out = []
    for key in keys:
        for _ in range(n):
            score = rng.randrange(bins) / bins
            out.append((key, score, rng.random() < 0.2 + 0.6 * score * rng.random(), rng.choice([1.0, 2.0, 0.5])))
    return out


def expected(data, key):
    totals = {}
    for k, score, y, w in data:
        if k == key:
            a, b = totals.get(score, (0.0, 0.0))
            totals[score] = (a + w, b + w * y)
    scores = sorted(totals)
    return dict(zip(scores, max_min_fit([totals[s] for s in scores])))


@pytest.mark.parametrize("per_task", [200_000, 7])
def test_isotonic_fit_in_one_and_many_tasks(spark, monkeypatch, per_task):
    """Many small tasks with a hot key give the same fit as one task."""
    monkeypatch.setattr(C, "POINTS_PER_TASK", per_task)
    data = rows(1, 300, ["hot"], 60) + rows(2, 12, ["a", "b"], 9)
    df = spark.createDataFrame(data, "k string, score double, outcome boolean, w double")
    points = C.fit_isotonic(df, by="k", weight="w")
    got = C.calibrate_long(df.select("k", "score").distinct(), points, by=["k"]).collect()
    for key in ("hot", "a", "b"):
        want = expected(data, key)
        mine = {r.score: r.calibrated for r in got if r.k == key}
        assert mine.keys() == want.keys()
        assert all(abs(mine[s] - want[s]) < 1e-9 for s in want)
        ordered = [mine[s] for s in sorted(mine)]
        assert ordered == sorted(ordered)


def test_falling_outcomes_pool_across_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "POINTS_PER_TASK", 3)
    data = [(i / 40, i < 20) for i in range(40)]
    df = spark.createDataFrame(data, "score double, outcome boolean")
    points = C.fit_isotonic(df).collect()
    assert {round(p.value, 9) for p in points} == {0.5}


def test_lookups_clamp_step_and_interpolate(spark):
    df = spark.createDataFrame([(-1.0,), (0.2,), (0.3,), (0.5,), (2.0,)], "s double")
    t, v = F.array(F.lit(0.2), F.lit(0.4), F.lit(0.8)), F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))
    got = df.select(C.as_of_step(F.col("s"), t, v).alias("a"), C.as_of_linear(F.col("s"), t, v).alias("b")).collect()
    assert [r.a for r in got] == [0.0, 0.0, 0.0, 0.5, 1.0]
    assert [round(r.b, 9) for r in got] == [0.0, 0.0, 0.25, 0.625, 1.0]


def test_weights_must_be_positive(spark):
    df = spark.createDataFrame([(0.1, True, 0.0)], "score double, outcome boolean, w double")
    with pytest.raises(ValueError, match="positive"):
        C.fit_isotonic(df, weight="w")


def test_budget_curve_never_falls(spark):
    df = spark.createDataFrame([(float(b), b % 3 != 0) for b in range(30)], "budget double, outcome boolean")
    curve = sorted((r.budget, r.probability) for r in C.budget_curve(df).collect())
    assert [p for _, p in curve] == sorted(p for _, p in curve)


def test_platt_paths_agree(spark, monkeypatch):
    df = spark.createDataFrame([("k", (i % 10) / 10, i % 10 > 4 + i % 3) for i in range(100)], "k string, probability double, outcome boolean")
    small = C.fit_platt(df, by="k", iterations=8).first()
    monkeypatch.setattr(C, "PLATT_TASK_POINTS", 1)
    stepwise = C.fit_platt(df, by="k", iterations=8).first()
    together = C.fit_platt(df, by="k", iterations=8, exchange=True).first()
    monkeypatch.setattr(C, "barrier_tasks", lambda *_, **__: 0)
    fallen_back = C.fit_platt(df, by="k", iterations=8, exchange=True).first()
    for other in (stepwise, together, fallen_back):
        assert abs(small.slope - other.slope) < 1e-9 and abs(small.intercept - other.intercept) < 1e-9
    assert C.fit_platt(df, iterations=1).columns == ["slope", "intercept"]


def test_censoring_weights(spark):
    df = spark.createDataFrame([(0.0, False), (0.5, False), (0.99, False), (0.5, True), (1.0, False)], "p double, c boolean")
    assert [r[0] for r in df.select(ipcw_weight(F.col("p"), F.col("c"))).collect()] == [1.0, 2.0, 10.0, 0.0, None]


def test_calibrator_checks():
    with pytest.raises(ValueError):
        C.Calibrator("other", [0.0], [0.0])
    with pytest.raises(ValueError):
        C.Calibrator("step", [], [])


@pytest.mark.parametrize("kind", ["step", "linear"])
@pytest.mark.parametrize("range_rows", [25, 100_000])
def test_as_of_in_one_order_equals_arrays(spark, kind, range_rows):
    """Curves with ties, keys without points, null keys, null and NaN scores, and a score that many rows share."""
    rng = random.Random(4)
    points = [(k, round(rng.random(), 2), rng.random()) for k in "abc" for _ in range({"a": 120, "b": 1, "c": 3}[k])] + [("d", 0.5, 0.1), (None, 0.5, 0.9)]
    scores = [(i, rng.choice("aaabce"), rng.choice([0.5, 0.5, rng.random(), -1.0, 2.0])) for i in range(400)]
    scores += [(1000, "a", None), (1001, "a", float("nan")), (1002, None, 0.5), (1003, "c", None), (1004, "b", 0.0)] + scores[:5]
    table = spark.createDataFrame(points, "key string, threshold double, value double")
    rows = spark.createDataFrame(scores, "id int, key string, score double").repartition(4)

    def found(df):
        plain = df.filter("score IS NULL OR NOT isnan(score)").collect()
        return sorted(((r.id, r.key, r.score, None if r.calibrated is None else round(r.calibrated, 12)) for r in plain), key=str)

    wanted = found(C.calibrate_long(rows, table, by=["key"], kind=kind))
    got = calibrate_as_of(rows, table, by=["key"], kind=kind, range_rows=range_rows)
    assert got.columns == ["id", "key", "score", "calibrated"]
    assert found(got) == wanted
    last = max((t, v) for k, t, v in points if k == "a")[1]
    assert got.filter("id = 1001").first().calibrated == pytest.approx(last)


def test_as_of_with_a_point_for_each_score(spark):
    points = spark.range(20_000).selectExpr("'k' AS key", "id / 20000D AS threshold", "id * 1D AS value")
    rows = spark.range(30_000).selectExpr("id", "'k' AS key", "(id % 20000) / 20000D AS score")
    got = calibrate_as_of(rows, points, by=["key"], range_rows=3000)
    assert got.filter("calibrated <> id % 20000").count() == 0 and got.count() == 30_000
    none = calibrate_as_of(rows.limit(5), points.limit(0), by=["key"])
    assert [r.calibrated for r in none.collect()] == [None] * 5
    assert calibrate_as_of(rows.limit(0), points, by=["key"]).count() == 0
    with pytest.raises(ValueError):
        calibrate_as_of(rows, points, by=["key"], kind="other")
