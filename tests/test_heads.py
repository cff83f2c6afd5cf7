import numpy as np
import pytest

from waypost.operators import barrier as B
from waypost.operators import heads as H
from waypost.operators.matrix import to_long
from waypost.sources.heads import artifact_digest, import_artifact, import_head

EXAMPLES = [
    ("parser json token wrapper", [True, False]),
    ("parser yaml token wrapper", [True, False]),
    ("symbolic integration theorem", [False, True]),
    ("symbolic algebra theorem", [False, True]),
]


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame(EXAMPLES, "text string, acceptable array<boolean>")


def test_head_learns_different_preferences(spark, examples, monkeypatch):
    monkeypatch.setattr(H, "ROWS_PER_GRADIENT_TASK", 1)
    monkeypatch.setattr(H, "PARTIAL_FAN_IN", 1)
    head = H.fit_logistic_gd(examples.repartition(3), ["cheap", "strong"], dimension=128, seed="s", epochs=30)
    asked = spark.createDataFrame([("parser json wrapper",), ("symbolic theorem",)], "text string")
    parser, theorem = (r.raw for r in H.score(asked, head).collect())
    assert parser[0] > parser[1] and theorem[1] > theorem[0]


def test_gradient_head_does_not_depend_on_partitioning(examples):
    one = H.fit_logistic_gd(examples.coalesce(1), ["a", "b"], dimension=64, seed="s", epochs=5)
    many = H.fit_logistic_gd(examples.repartition(4), ["a", "b"], dimension=64, seed="s", epochs=5)
    assert np.allclose(one.weights, many.weights, atol=1e-12) and np.allclose(one.biases, many.biases)


def jobs_of(spark, group, run):
    """The result of a function and the number of Spark jobs that it takes."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = run()
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_epochs_of_one_job_equal_a_job_each(spark, examples, monkeypatch):
    """The weights are the same in one job, in parts, with tasks that exchange, and with a job per epoch."""
    monkeypatch.setattr(H, "ROWS_PER_GRADIENT_TASK", 2)

    def fit(epochs, **options):
        return H.fit_logistic_gd(examples.repartition(3), ["a", "b"], dimension=64, seed="s", epochs=epochs, **options)

    _, few = jobs_of(spark, "few", lambda: fit(2))
    one, many = jobs_of(spark, "many", lambda: fit(8))
    assert many == few  # the number of jobs does not follow the epochs
    parted = fit(8, epochs_per_job=3)
    exchanged = fit(8, exchange=True)
    monkeypatch.setattr(H, "barrier_tasks", lambda *_, **__: 0)
    each, jobs = jobs_of(spark, "each", lambda: fit(8))
    assert jobs >= 8
    for other in (one, parted, exchanged):
        assert np.allclose(other.weights, each.weights, atol=1e-12) and np.allclose(other.biases, each.biases, atol=1e-12)


def test_barrier_is_only_for_what_fits(spark):
    slots = min(spark.sparkContext.defaultParallelism, B.MAX_TASKS)

    def tasks(*arguments, exchange=True):
        return B.barrier_tasks(spark, *arguments, exchange=exchange)

    assert tasks(1000, 8, 1) == 1 and tasks(1000, 8, 10**6) == slots
    assert tasks(slots * B.TASK_BYTES + 1, 8, 1) == 0 and tasks(1000, B.STEP_BYTES, 1) == 0
    assert tasks(slots * B.TASK_BYTES, 8, 1) == slots
    assert tasks(B.ALONE_BYTES, 8, 10**6, exchange=False) == 1 and tasks(B.ALONE_BYTES + 1, 8, 1, exchange=False) == 0


def test_lbfgs_finds_the_minimum():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 12))
    matrix, target = a.T @ a + 0.01 * np.eye(12), rng.normal(size=12)
    found = B.lbfgs(lambda x: (0.5 * x @ matrix @ x - target @ x, matrix @ x - target), np.zeros(12), iterations=500, tolerance=1e-14)
    assert np.allclose(found, np.linalg.solve(matrix, target), atol=1e-5)


def test_shared_head_is_at_its_minimum(spark, monkeypatch):
    """As good as a plain fit on all requests × models with common and own columns, and the same from any number of tasks."""
    monkeypatch.setattr(H, "ROWS_PER_GRADIENT_TASK", 10)
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(" ".join(rng.choice(words, 3)), [bool(x) for x in rng.random(3) < (0.3, 0.5, 0.8)]) for _ in range(40)]
    examples = spark.createDataFrame(rows, "text string, acceptable array<boolean>").coalesce(1)
    head = H.fit_shared(examples, ["a", "b", "c"], dimension=32, l2=0.01)
    features = H.word_features(examples, 32).select("vector").collect()
    x = np.hstack([np.array([f.vector.toArray() for f in features]), np.ones((40, 1))])
    y = np.array([r[1] for r in rows], float)
    total, positive = y.size, y.sum()
    u = np.where(y > 0, total / (2 * positive), total / (2 * (total - positive))) / total
    theta = np.zeros((33, 4))
    for _ in range(20_000):
        z = x @ (theta[:, :1] + theta[:, 1:])
        g = x.T @ ((1 / (1 + np.exp(-z)) - y) * u)
        slope = np.hstack([g.sum(axis=1, keepdims=True), g]) + 0.01 * theta
        slope[32, 0] -= 0.01 * theta[32, 0]
        theta -= 0.5 * slope
    assert np.allclose(head.weights, theta[:32, :1] + theta[:32, 1:], atol=2e-3)
    assert np.allclose(head.biases, theta[32, 0] + theta[32, 1:], atol=2e-3)
    monkeypatch.setattr(H, "barrier_tasks", lambda *_, **__: 0)
    steps = [H.fit_shared(examples.repartition(n), ["a", "b", "c"], dimension=32, solver="gradient", steps=3) for n in (1, 4)]
    assert np.allclose(steps[0].weights, steps[1].weights, atol=1e-12)


@pytest.mark.parametrize("signed", [True, False])
def test_steps_read_blocks_of_rows(spark, monkeypatch, signed):
    """A step reads a few blocks, not a row per request; laid out in full or not, they give the gradient of plain sums."""
    rng = np.random.default_rng(5)
    texts = ["", *(" ".join(f"w{w}" for w in rng.integers(0, 30, n)) for n in rng.integers(1, 60, 49))]
    rows = [(text, [bool(x) for x in rng.random(2) < 0.5]) for text in texts]
    examples = spark.createDataFrame(rows, "text string, acceptable array<boolean>").coalesce(1)
    coded = H.with_codes(examples, dimension=48, seed="s") if signed else H.word_counts(examples, 48)
    monkeypatch.setattr(H, "BLOCK_ELEMENTS", 400)
    blocks = H._blocks(coded, 2, 48, signed=signed).persist()
    counts = H._counted(blocks, 2)
    assert counts["n"] == 50 and counts["positives"] == [sum(r[1][m] for r in rows) for m in range(2)]
    assert 1 < blocks.count() < 25
    x = np.zeros((50, 48))
    if signed:
        for i, row in enumerate(coded.select(H.hashed_features(H.F.col("codes"), 48).alias("f")).collect()):
            for idx, v in row.f:
                x[i, idx] = v
    else:
        x = np.array([row.vector.toArray() for row in H.word_features(examples, 48).collect()])
    y, weights, biases = np.array([r[1] for r in rows], float), rng.normal(size=(48, 2)), np.array([0.1, -0.2])
    positive, negative = np.array([1.5, 0.7]), np.array([0.6, 1.2])
    z = x @ weights + biases
    w = np.where(y > 0, positive, negative)
    error = (1 / (1 + np.exp(-z)) - y) * w
    plain = np.vstack([x.T @ error, error.sum(axis=0), (w * (np.log1p(np.exp(z)) - y * z)).sum(axis=0)])
    batches = blocks.toArrow().to_batches()
    for share in (0, 10**6):
        monkeypatch.setattr(H, "DENSE_SHARE", share)
        assert np.allclose(H._gradient_of(batches, weights, biases, positive, negative), plain, atol=1e-9)
    blocks.unpersist()


@pytest.mark.parametrize("signed", [True, False])
def test_full_blocks_hold_a_byte_a_cell(spark, monkeypatch, signed):
    """Blocks kept in full take less than their entries, list only the counts beyond a byte, and give the same gradient."""
    rng = np.random.default_rng(6)
    texts = ["", "word " * 400, "other " * 40_000, *(" ".join(f"w{w}" for w in rng.integers(0, 30, 80)) for _ in range(47))]
    rows = [(text, [bool(x) for x in rng.random(2) < 0.5]) for text in texts]
    examples = spark.createDataFrame(rows, "text string, acceptable array<boolean>").coalesce(1)
    coded = H.with_codes(examples, dimension=48, seed="s") if signed else H.word_counts(examples, 48)
    weights, ones, found = rng.normal(size=(48, 2)), np.ones(2), []
    for share in (0, H.FULL_SHARE):
        monkeypatch.setattr(H, "FULL_SHARE", share)
        table = H._blocks(coded, 2, 48, signed=signed).toArrow()
        size = sum(len(x.as_py()) for name in ("idx", "v", "full") for x in table.column(name))
        found.append((size, table.column("entries").to_pylist(), H._gradient_of(table.to_batches(), weights, ones, ones, ones)))
    assert found[1][0] < found[0][0] and found[1][1] == found[0][1]
    assert np.allclose(found[0][2], found[1][2], atol=1e-9)


def test_shared_head_of_many_models(spark):
    """A hundred models take one row per request."""
    rows = [(f"word{i % 7} text{i % 5}", [(i + m) % (2 + m % 5) == 0 for m in range(100)]) for i in range(60)]
    examples = spark.createDataFrame(rows, "text string, acceptable array<boolean>")
    head = H.fit_shared(examples, [f"m{i}" for i in range(100)], dimension=64, steps=30)
    assert head.weights.shape == (64, 100) and head.training_examples == 60
    one_class = H.fit_shared(spark.createDataFrame([("a", [True, True])], "text string, acceptable array<boolean>"), ["a", "b"], dimension=16)
    assert not one_class.weights.any() and np.allclose(one_class.biases, np.log(2.5 / 0.5))
    for bad in ({"solver": "other"}, {"steps": 0}, {"features": "other"}):
        with pytest.raises(ValueError):
            H.fit_shared(examples, ["a"], **bad)
    with pytest.raises(ValueError):
        H.fit_shared(examples, ["a"])


def test_hyper_parameters_and_labels_are_checked(spark, examples):
    with pytest.raises(ValueError):
        H.fit_logistic_gd(examples, ["a", "b"], seed="s", epochs=0)
    with pytest.raises(ValueError):
        H.fit_logistic_gd(examples, ["a", "b"], seed="s", epochs=1, epochs_per_job=0)
    with pytest.raises(ValueError):
        H.fit_logistic_gd(examples, ["a", "b", "c"], seed="s", epochs=1)
    with pytest.raises(ValueError):
        H.fit_logistic_gd(examples.limit(0), ["a", "b"], seed="s", epochs=1)


def json_head(kind, **extra):
    shared = "shared" in kind
    name = "interaction_weights" if shared else "weights"
    models = {m: {"bias": b, name: {"1": 0.5, "7": -b}} for m, b in (("strong", 0.4), ("cheap", -0.2))}
    value = {"kind": kind, "dimension": 16, "hash_seed": "s", "models": models, **extra}
    if shared:
        value.update(intercept=0.1, common_weights={"1": 1.0})
    return value


def test_import_folds_the_common_part_of_a_shared_head(spark):
    head = import_head(json_head("shared-hashed-linear-v1"))
    assert head.models == ["cheap", "strong"]
    assert np.allclose(head.biases, [-0.1, 0.5]) and np.allclose(head.weights[1], 1.5)


def test_import_rejects_unknown_shapes():
    with pytest.raises(ValueError):
        import_head({"kind": "other"})
    with pytest.raises(ValueError):
        import_head({"kind": "hashed-linear-v1", "models": {}})
    with pytest.raises(ValueError):
        import_head(json_head("sklearn-hashing-linear-v1", vectorizer={"norm": "l1"}))


def test_join_path_equals_task_path(spark):
    head = import_head(json_head("hashed-linear-v1"))
    df = spark.createDataFrame([("1", "fix the parser"), ("2", ""), ("3", "ein Satz")], "request_id string, text string")
    a = {(r.request_id, r.model): r.raw for r in to_long(H.score(df, head), head.models, {"raw": "raw"}, "request_id").collect()}
    b = {(r.request_id, r.model): r.raw for r in to_long(H.score_by_join(df, head), head.models, {"raw": "raw"}, "request_id").collect()}
    assert a.keys() == b.keys() and len(a) == 6
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_import_artifact_checks_hash_and_routes(spark):
    artifact = {
        "schema_version": "semantic-router-artifact-v1",
        "models": ["strong", "cheap"],
        "model_cards": [
            {"name": "strong", "provider": "remote", "expected_cost_usd": 0.2, "capabilities": ["tools"]},
            {"name": "cheap", "provider": "local", "expected_cost_usd": 0.01},
        ],
        "model_head": json_head("hashed-linear-v1"),
        "calibration": {
            m: {"kind": "isotonic-pava-v1", "thresholds": [0.1, 0.2, 0.3], "values": [0.2, 0.2, 0.9]} for m in ("cheap", "strong")
        },
        "expected_cost_usd": {"cheap": 0.01, "strong": 0.2},
        "selector": {
            "default_lambda": 0.1, "default_method": "independent_hashed_logistic", "gate_passed": True,
            "calibration_best_fixed": "strong",
            "calibration_candidates": [{"method": "independent_hashed_logistic", "lambda": 0.1, "passes_noninferiority": True}],
        },
    }
    with pytest.raises(ValueError, match="hash"):
        import_artifact(artifact)
    stated = dict(artifact, artifact_hash=artifact_digest(artifact))
    model = import_artifact(stated)
    assert model.calibrators[model.default_method][0].thresholds == [0.1, 0.3]
    from waypost import route

    decision = route(spark.createDataFrame([("hi",)], "text string"), model).first()["decision"]
    assert decision.selected_model == "cheap" and decision.artifact_hash == stated["artifact_hash"]


def test_word_margins_take_long_batches_in_pieces(monkeypatch):
    """The work space of a margin is that of a piece of the batch, and pieces give the same margins."""
    import tracemalloc

    import pyarrow as pa

    models = ["a", "b"]
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(300, 2))
    head = H.Head(H.INDEPENDENT, H.WORDS, 300, "", models, np.array([0.5, -0.5]), weights)
    lengths = np.concatenate(([0, 2], np.full(4000, 1000), [0, 3000]))
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    indices = rng.integers(0, 300, offsets[-1]).astype(np.int32)
    values = rng.random(offsets[-1])
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (indices, values)]
    batch = pa.StructArray.from_arrays(lists, ["indices", "values"])
    monkeypatch.setattr(H.F, "arrow_udf", lambda kind: lambda f: f)
    margins = H._vector_margins(head)
    tracemalloc.start()
    found = np.array(margins(batch).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6
    expected = np.array([[weights[indices[a:b], m] @ values[a:b] for m in range(2)] for a, b in zip(offsets, offsets[1:])]) + head.biases
    assert np.allclose(found, expected)
