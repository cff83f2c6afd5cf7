"""Success classifiers: hashed features in, one probability per model out.

A head is a (dimension × models) weight matrix and one bias per model. Its size does not
grow with the data; it is checked against `MAX_HEAD_CELLS` before it is used in a task.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions.mathx import sigmoid
from waypost.functions.text import (
    bucket_counts, check_dimension, feature_rows, hashed_features, linear_margins, list_codes, pieces, tokens, with_codes,
)
from waypost.operators.barrier import barrier_tasks, descend, lbfgs, together
from waypost.operators.sizing import broadcast_if_small
from waypost.session import ensure_checkpoint_dir

# Training constants.
PRUNE_BELOW = 1e-10
GRADIENT_RATE = 0.5
GRADIENT_L2 = 0.01
GRADIENT_EPOCHS = 200
RATE_DECAY_EPOCHS = 20
LOGISTIC_L2 = 1e-4
LOGISTIC_ITERATIONS = 2000
LOGISTIC_TOLERANCE = 1e-4

INDEPENDENT = "independent_hashed_logistic"
SHARED = "shared_task_model_hashed_classifier"

LBFGS, PLAIN = "lbfgs", "gradient"
# A step of the shared fit that lowers the loss by less than this share of it is the last.
SHARED_TOLERANCE = 1e-9

SIGNED = "signed"  # SHA-256 buckets with a sign
WORDS = "words"  # term-frequency buckets of word 1- and 2-grams

MAX_HEAD_CELLS = 64_000_000
PARTIAL_FAN_IN = 64
# Rows a training task should have at least: below that, job overhead outweighs the work.
ROWS_PER_GRADIENT_TASK = 500
ROWS_PER_SOLVER_TASK = 5000
# Training rows lie in blocks of so many codes or entries at most, or of one row: a block is one row of a table.
BLOCK_ELEMENTS = 1 << 18
# Blocks with at least an entry in so many cells are kept in full, a byte a cell, which is less than their entries take.
FULL_SHARE = 4
# Other blocks with at least an entry in so many cells are laid out in full by a step, for products of matrices.
DENSE_SHARE = 16
# Epochs of one job: after a lost executor so many are done again at most.
EPOCHS_PER_JOB = 200


@dataclass
class Head:
    """Linear head in pool order. A shared head is stored with its common part added in."""

    method: str
    features: str
    dimension: int
    seed: str
    models: list[str]
    biases: np.ndarray
    weights: np.ndarray
    training_examples: int = 0
    token_limit: int | None = None  # tokens of a text that count; None: all

    def __post_init__(self) -> None:
        check_dimension(self.dimension)
        if self.weights.shape != (self.dimension, len(self.models)) or len(self.biases) != len(self.models):
            raise ValueError("head shape does not match its pool")
        # One bound for training, loading and scoring: what can be trained can be loaded and scored.
        if self.weights.size > MAX_HEAD_CELLS:
            raise ValueError(f"a head holds at most {MAX_HEAD_CELLS} weights; lower the dimension")

    def pruned(self) -> "Head":
        self.weights = np.where(np.abs(self.weights) < PRUNE_BELOW, 0.0, self.weights)
        return self


# ---------------------------------------------------------------- word features


def word_counts(df: DataFrame, dimension: int, text: str = "text", out: str = "counts") -> DataFrame:
    """Hashed counts of word 1- and 2-grams, as an ML sparse vector."""
    words = RegexTokenizer(
        inputCol=text, outputCol="__words", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=True, minTokenLength=1
    )
    pairs = NGram(n=2, inputCol="__words", outputCol="__pairs")
    staged = pairs.transform(words.transform(df)).withColumn("__terms", F.concat("__words", "__pairs"))
    hashed = HashingTF(inputCol="__terms", outputCol=out, numFeatures=dimension).transform(staged)
    return hashed.drop("__words", "__pairs", "__terms")


def word_features(df: DataFrame, dimension: int, text: str = "text", out: str = "vector") -> DataFrame:
    """L2-normed hashed counts of word 1- and 2-grams, as an ML sparse vector."""
    counted = word_counts(df, dimension, text, "__tf")
    return Normalizer(p=2.0, inputCol="__tf", outputCol=out).transform(counted).drop("__tf")


# ---------------------------------------------------------------- scoring


def _vector_margins(head: Head):
    """Margins from an ML sparse vector, which Arrow carries as (type, size, indices, values)."""
    weights, biases = head.weights, head.biases
    models = len(biases)

    @F.arrow_udf("array<double>")
    def margins(vectors: pa.Array) -> pa.Array:
        indices, values = vectors.field("indices"), vectors.field("values")
        offsets = np.asarray(indices.offsets)
        idx, val = np.asarray(indices.flatten()), np.asarray(values.flatten())
        result = np.tile(biases, (len(vectors), 1))
        for first, end in pieces(offsets):
            rows = np.repeat(np.arange(end - first), np.diff(offsets[first : end + 1]))
            part = slice(offsets[first] - offsets[0], offsets[end] - offsets[0])
            for model in range(models):
                result[first:end, model] += np.bincount(rows, weights=weights[idx[part], model] * val[part], minlength=end - first)
        ends = pa.array(np.arange(0, result.size + 1, models, dtype=np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(result.ravel()))

    return margins


def _vector_entries():
    """The entries of an ML sparse vector as (idx, v)."""

    @F.arrow_udf("array<struct<idx:int,v:double>>")
    def entries(vectors: pa.Array) -> pa.Array:
        indices, values = vectors.field("indices"), vectors.field("values")
        pairs = pa.StructArray.from_arrays([indices.flatten().cast(pa.int32()), values.flatten()], ["idx", "v"])
        return pa.ListArray.from_arrays(indices.offsets, pairs)

    return entries


def score(requests: DataFrame, head: Head, *, text: str = "text", out: str = "raw") -> DataFrame:
    """Add the raw success probability per model, in pool order.

    Scoring is one pass over the requests without a shuffle, whatever the head's size.
    """
    if head.features == SIGNED:
        coded = with_codes(requests, text, "__codes", dimension=head.dimension, seed=head.seed, limit=head.token_limit)
        margins = coded.withColumn("__z", linear_margins(F.col("__codes"), head.weights, head.biases)).drop("__codes")
    else:
        vectors = word_features(requests, head.dimension, text, "__vector")
        margins = vectors.withColumn("__z", _vector_margins(head)(F.col("__vector"))).drop("__vector")
    return margins.withColumn(out, F.transform("__z", lambda z: sigmoid(z))).drop("__z")


def weight_table(spark, head: Head) -> DataFrame:
    """(model, idx, w) of the non-zero weights."""
    idx, model = np.nonzero(head.weights)
    table = pa.table(
        {
            "model": pa.array([head.models[m] for m in model], pa.string()),
            "idx": pa.array(idx.astype(np.int32)),
            "w": pa.array(head.weights[idx, model]),
        }
    )
    return spark.createDataFrame(table)


def bias_table(spark, head: Head) -> DataFrame:
    return spark.createDataFrame(
        [(m, i, float(b)) for i, (m, b) in enumerate(zip(head.models, head.biases))], "model string, pos int, bias double"
    )


def score_by_join(requests: DataFrame, head: Head, *, text: str = "text", out: str = "raw") -> DataFrame:
    """The same probabilities by joining features with a weight table, where a caller asks for it.

    Rows are keyed by a number of their own, fixed by a checkpoint, so any key columns pass through and rows that
    repeat stay apart. Requests × models are laid out first, so a cell none of whose features has a weight keeps
    its bias.
    """
    spark = requests.sparkSession
    ensure_checkpoint_dir(spark)
    rows = requests.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    weights, biases = weight_table(spark, head), bias_table(spark, head)
    if head.features == SIGNED:
        coded = with_codes(rows.select("__row", text), text, "__codes", dimension=head.dimension, seed=head.seed, limit=head.token_limit)
        features = feature_rows(coded.select("__row", hashed_features(F.col("__codes"), head.dimension).alias("features")), ["__row"])
    else:
        vectors = word_features(rows.select("__row", text), head.dimension, text, "__vector")
        features = vectors.select("__row", F.inline(_vector_entries()(F.col("__vector"))))
    sums = features.join(weights, "idx").groupBy("__row", "model").agg(F.sum(F.col("v") * F.col("w")).alias("z"))
    grid = rows.select("__row").crossJoin(broadcast_if_small(biases))
    cells = grid.join(sums, ["__row", "model"], "left").select(
        "__row", "pos", sigmoid(F.col("bias") + F.coalesce("z", F.lit(0.0))).alias("p")
    )
    # One cell per pool model and request: the list is as long as the pool.
    arrays = cells.groupBy("__row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda c: c["p"]).alias(out)
    )
    return rows.join(arrays, "__row").drop("__row")


# ---------------------------------------------------------------- training


def _sum_partials(partials: DataFrame, partitions: int) -> np.ndarray:
    """Add one float64 vector per task. Beyond 64 tasks they are first added in groups,
    so the driver receives a few vectors whatever the number of tasks."""
    if partitions > PARTIAL_FAN_IN:

        def add(batches):
            total = None
            for batch in batches:
                for value in batch.column(0):
                    part = np.frombuffer(value.as_buffer(), dtype=np.float64)
                    total = part.copy() if total is None else total + part
            if total is not None:
                yield pa.record_batch({"g": pa.array([total.tobytes()], pa.binary())})

        partials = partials.repartition(max(1, math.isqrt(partitions))).mapInArrow(add, "g binary")
    rows = partials.collect()
    return np.sum([np.frombuffer(row["g"], dtype=np.float64) for row in rows], axis=0)


BLOCK_SCHEMA = (
    "n bigint, short bigint, entries bigint, positives array<bigint>, labels binary, norms binary, ends binary, idx binary, v binary, full binary"
)
BLOCK_ARRAYS = ("labels", "norms", "ends", "idx", "v", "full")
COUNT_TYPES = {kind().itemsize: kind for kind in (np.int16, np.int64)}


def _index_type(dimension: int):
    return np.uint16 if dimension <= 1 << 16 else np.int32


def _blocks(rows: DataFrame, models: int, dimension: int, *, signed: bool, seed: str | None = None) -> DataFrame:
    """Training rows (`codes` or `counts`, and `acceptable`) in blocks of sparse rows, which are read at every step.

    With a seed the rows bring `tokens`, which are hashed here: their codes need not go through another worker.
    A block holds its arrays as bytes, which a step moves as they are, not entry by entry: whole counts of two bytes
    wherever they fit, and the norm of each row. A block full enough is a table of one byte a cell, and only the
    counts that no byte holds are listed beside it.
    """
    short = (F.size("acceptable") != models) | F.exists("acceptable", lambda x: x.isNull())
    given = rows.select(
        F.col("counts" if not signed else "codes" if seed is None else "tokens").alias("given"),
        F.col("acceptable").cast("array<int>").alias("labels"),
        F.coalesce(short, F.lit(True)).alias("short"),
    )

    def pack(batches):
        for batch in batches:
            column = batch.column("given")
            if seed is not None:
                column = list_codes(column, dimension, seed)
            offsets = np.asarray((column if signed else column.field("indices")).offsets)
            for first, end in pieces(offsets, BLOCK_ELEMENTS):
                part, size = batch.slice(first, end - first), end - first
                if signed:
                    row, idx, val, norms = bucket_counts(column.slice(first, size), dimension)
                    ends = np.searchsorted(row, np.arange(size + 1))
                else:
                    ends = offsets[first : end + 1] - offsets[first]
                    held = slice(offsets[first], offsets[end])
                    idx, val = np.asarray(column.field("indices").values)[held], np.asarray(column.field("values").values)[held]
                    norms = np.sqrt(np.bincount(np.repeat(np.arange(size), np.diff(ends)), weights=val * val, minlength=size))
                wrong = int(np.count_nonzero(part.column("short")))
                if wrong:
                    labels = np.zeros((size, models), np.int8)
                else:
                    labels = np.asarray(part.column("labels").flatten()).astype(np.int8).reshape(size, models)
                entries, full = len(idx), np.zeros(0, np.int8)
                if size * dimension <= FULL_SHARE * entries:
                    rows, large = np.repeat(np.arange(size), np.diff(ends)), np.abs(val) > np.iinfo(np.int8).max
                    full = np.zeros((size, dimension), np.int8)
                    full[rows, idx] = np.where(large, 0, val)
                    idx, val, ends = idx[large], val[large], np.searchsorted(rows[large], np.arange(size + 1))
                small = np.abs(val).max(initial=0) <= np.iinfo(np.int16).max
                arrays = (
                    labels, norms + (norms == 0), ends.astype(np.int32), idx.astype(_index_type(dimension)),
                    val.astype(np.int16 if small else np.int64), full,
                )
                yield pa.record_batch(
                    {
                        "n": pa.array([size]),
                        "short": pa.array([wrong]),
                        "entries": pa.array([entries]),
                        "positives": pa.array([labels.sum(axis=0, dtype=np.int64)], pa.list_(pa.int64())),
                        **{name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(BLOCK_ARRAYS, arrays)},
                    }
                )

    return given.mapInArrow(pack, BLOCK_SCHEMA)


def _counted(blocks: DataFrame, models: int) -> dict:
    """Rows, bytes (12 an entry) and positives per model of the blocks, which it checks."""
    counts = blocks.agg(
        F.sum("n").alias("n"),
        F.sum("short").alias("short"),
        F.sum(12 * F.col("entries") + F.length("labels")).alias("bytes"),
        *[F.sum(F.get("positives", F.lit(m))).alias(f"p{m}") for m in range(models)],
    ).first()
    if not counts["n"]:
        raise ValueError("training needs examples and models")
    if counts["short"]:
        raise ValueError("every example must have a label for every model")
    return {"n": counts["n"], "bytes": counts["bytes"], "positives": [counts[f"p{m}"] for m in range(models)]}


def _gradient_of(batches, weights: np.ndarray, biases: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Sums over some blocks for every model: the logistic gradient of its weights, of its bias, and the loss."""
    dimension, models = weights.shape
    gradient = np.zeros((dimension + 2, models))
    for batch in batches:
        for *arrays, n in zip(*[batch.column(name) for name in BLOCK_ARRAYS], batch.column("n").to_pylist()):
            labels, norms, ends, idx, val, full = [x.as_buffer() for x in arrays]
            y = np.frombuffer(labels, np.int8).reshape(n, models)
            norms = np.frombuffer(norms)[:, None]
            rows = np.repeat(np.arange(n), np.diff(np.frombuffer(ends, np.int32)))
            idx = np.frombuffer(idx, _index_type(dimension))
            val = np.frombuffer(val, COUNT_TYPES[val.size // len(idx)]) if len(idx) else np.zeros(0)
            dense = None
            if full.size:
                dense = np.frombuffer(full, np.int8).reshape(n, dimension).astype(np.float64)
            elif n * dimension <= DENSE_SHARE * len(idx):
                dense = np.zeros((n, dimension))
            if dense is not None:
                dense[rows, idx] = val
                z = dense @ weights
            else:
                z = np.column_stack([np.bincount(rows, weights=weights[idx, m] * val, minlength=n) for m in range(models)])
            z = z / norms + biases
            small = np.exp(-np.abs(z))
            p = np.where(z >= 0, 1.0 / (1.0 + small), small / (1.0 + small))
            weight = np.where(y > 0, positive, negative)
            error = (p - y) * weight
            gradient[dimension] += error.sum(axis=0)
            gradient[dimension + 1] += (weight * (np.log1p(small) + np.maximum(z, 0.0) - y * z)).sum(axis=0)
            error = error / norms
            if dense is not None:
                gradient[:dimension] += (error.T @ dense).T
            else:
                for m in range(models):
                    gradient[:dimension, m] += np.bincount(idx, weights=error[rows, m] * val, minlength=dimension)
    return gradient


def _gradient_task(weights: np.ndarray, biases: np.ndarray, positive: np.ndarray, negative: np.ndarray):
    """Per-task sum of the gradient."""

    def run(batches):
        gradient = _gradient_of(batches, weights, biases, positive, negative)
        yield pa.record_batch({"g": pa.array([gradient.tobytes()], pa.binary())})

    return run


def _stepped(weights, biases, gradient, epoch: int, learning_rate: float, l2: float):
    """Weights and biases after one epoch with the mean gradient."""
    dimension = len(weights)
    rate = learning_rate / math.sqrt(1.0 + epoch / RATE_DECAY_EPOCHS)
    biases = biases - rate * gradient[dimension]
    weights = weights - rate * (gradient[:dimension] + l2 * weights)
    weights[np.abs(weights) < PRUNE_BELOW] = 0.0
    return weights, biases


def _descend_together(held: DataFrame, weights, biases, positive, negative, n: int, steps: range, step):
    """Weights and biases after some epochs in one job over rows that lie in as many partitions as tasks run at once."""
    dimension, models = weights.shape

    def gradient(batches, state):
        return _gradient_of(batches, state[:dimension], state[dimension], positive, negative)

    def update(state, total, epoch):
        return np.vstack(step(state[:dimension], state[dimension], total / n, epoch))

    state = descend(held, np.vstack([weights, biases]), gradient, update, steps)
    return state[:dimension], state[dimension]


def fit_logistic_gd(
    examples: DataFrame,
    models: list[str],
    *,
    dimension: int = 1024,
    seed: str,
    learning_rate: float = GRADIENT_RATE,
    l2: float = GRADIENT_L2,
    epochs: int = GRADIENT_EPOCHS,
    epochs_per_job: int = EPOCHS_PER_JOB,
    exchange: bool = False,
) -> Head:
    """Independent logistic heads by full-batch gradient descent, all models in one pass.

    `examples` has one row per request: text and `acceptable`, an array in pool order.
    Features are computed once and cached. Where their counted size fits one task, or with
    `exchange` the memory of a bounded number of tasks that exchange gradients, `epochs_per_job`
    epochs are one job; a lost executor repeats that job from the weights before it.
    Otherwise an epoch is one job, and only the summed gradient reaches the driver.
    """
    check_dimension(dimension)
    if learning_rate <= 0 or l2 < 0 or epochs <= 0 or epochs_per_job <= 0:
        raise ValueError("invalid training hyperparameters")
    if not models:
        raise ValueError("training needs examples and models")
    listed = examples.select(tokens(F.col("text")).alias("tokens"), "acceptable")
    features = _blocks(listed, len(models), dimension, signed=True, seed=seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = _counted(features, len(models))
        n, positives = counts["n"], np.array(counts["positives"], float)
        prior = (positives + 0.5) / (n + 1.0)
        biases = np.log(prior / (1.0 - prior))
        weights = np.zeros((dimension, len(models)))
        with np.errstate(divide="ignore"):
            positive = np.where(positives > 0, n / (2.0 * positives), 1.0)
            negative = np.where(n - positives > 0, n / (2.0 * (n - positives)), 1.0)
        step = functools.partial(_stepped, learning_rate=learning_rate, l2=l2)
        tasks = barrier_tasks(features.sparkSession, counts["bytes"], weights.nbytes + biases.nbytes, math.ceil(n / ROWS_PER_GRADIENT_TASK), exchange=exchange)
        if tasks:
            held = features.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                for first in range(0, epochs, epochs_per_job):
                    steps = range(first, min(first + epochs_per_job, epochs))
                    weights, biases = _descend_together(held, weights, biases, positive, negative, int(n), steps, step)
            finally:
                held.unpersist()
        else:
            partitions = min(features.rdd.getNumPartitions(), math.ceil(n / ROWS_PER_GRADIENT_TASK))
            packed = features.coalesce(partitions)
            for epoch in range(epochs):
                task = _gradient_task(weights, biases, positive, negative)
                total = _sum_partials(packed.mapInArrow(task, "g binary"), partitions)
                weights, biases = step(weights, biases, total.reshape(dimension + 2, len(models)) / n, epoch)
    finally:
        features.unpersist()
    return Head(INDEPENDENT, SIGNED, dimension, seed, list(models), biases, weights, int(n))


def _balanced(frame: DataFrame, label: str, positives: float, total: float) -> DataFrame:
    up, down = total / (2.0 * positives), total / (2.0 * (total - positives))
    return frame.withColumn("weight", F.when(F.col(label) == 1.0, up).otherwise(down))


def _logistic() -> LogisticRegression:
    return LogisticRegression(
        featuresCol="vector",
        labelCol="label",
        weightCol="weight",
        regParam=LOGISTIC_L2,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=LOGISTIC_ITERATIONS,
        tol=LOGISTIC_TOLERANCE,
        family="binomial",
    )


def fit_logistic(
    examples: DataFrame, models: list[str], *, dimension: int = 4096, method: str = INDEPENDENT
) -> Head:
    """Balanced L2 logistic regression on word features.

    `independent` fits one classifier per model by Spark ML; `shared` fits one on
    [text | model | text × model] from a row per request.
    """
    check_dimension(dimension)
    if method == SHARED:
        return fit_shared(examples, models, dimension=dimension)
    vectors = (
        word_features(examples.select("text", "acceptable"), dimension)
        .select("vector", "acceptable")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        counts = vectors.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(F.get("acceptable", F.lit(m)).cast("bigint")).alias(f"p{m}") for m in range(len(models))],
        ).first()
        n = counts["n"]
        if not n or not models:
            raise ValueError("training needs examples and models")
        positives = [counts[f"p{m}"] for m in range(len(models))]
        tasks = min(vectors.rdd.getNumPartitions(), math.ceil(n / ROWS_PER_SOLVER_TASK))
        biases, weights = _fit_independent(vectors.coalesce(tasks), len(models), dimension, n, positives)
    finally:
        vectors.unpersist()
    return Head(method, WORDS, dimension, "", list(models), biases, weights, int(n)).pruned()


def _fit_independent(vectors, models, dimension, n, positives):
    biases, weights = np.zeros(models), np.zeros((dimension, models))
    for m in range(models):
        if positives[m] in (0, n):
            # One class only: the prior log-odds, no weights.
            prior = (positives[m] + 0.5) / (n + 1.0)
            biases[m] = math.log(prior / (1.0 - prior))
            continue
        rows = vectors.select("vector", F.get("acceptable", F.lit(m)).cast("double").alias("label"))
        fitted = _logistic().fit(_balanced(rows, "label", positives[m], n))
        biases[m] = fitted.intercept
        weights[:, m] = fitted.coefficients.toArray()
    return biases, weights


def fit_shared(
    examples: DataFrame,
    models: list[str],
    *,
    dimension: int = 4096,
    features: str = WORDS,
    seed: str = "",
    l2: float = LOGISTIC_L2,
    solver: str = LBFGS,
    steps: int = LOGISTIC_ITERATIONS,
    learning_rate: float = GRADIENT_RATE,
    exchange: bool = False,
) -> Head:
    """One balanced L2 logistic regression on [text | model | text × model], from one row per request.

    The weights of a model are a common part and its own, so the gradient of all models' margins is all that is
    gathered: dimension × models numbers, whatever the number of requests. `lbfgs` runs to its minimum, `gradient`
    takes `steps` plain steps. All is one job where the features fit one task, or with `exchange` bounded tasks that
    exchange gradients; else each evaluation is a job.
    """
    check_dimension(dimension)
    if solver not in (LBFGS, PLAIN) or features not in (WORDS, SIGNED) or learning_rate <= 0 or l2 < 0 or steps <= 0:
        raise ValueError("invalid training hyperparameters")
    if not models:
        raise ValueError("training needs examples and models")
    size = len(models)
    plain = examples.select("text", "acceptable")
    if features == WORDS:
        rows = _blocks(word_counts(plain, dimension), size, dimension, signed=False)
    else:
        rows = _blocks(plain.select(tokens(F.col("text")).alias("tokens"), "acceptable"), size, dimension, signed=True, seed=seed)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = _counted(rows, size)
        total, positive = counts["n"] * size, sum(counts["positives"])
        if positive in (0, total):
            prior = (positive + 0.5) / (total + 1.0)
            biases, weights = np.full(size, math.log(prior / (1.0 - prior))), np.zeros((dimension, size))
        else:
            up, down = np.full(size, total / (2.0 * positive)), np.full(size, total / (2.0 * (total - positive)))
            minimise = functools.partial(_minimise, dimension=dimension, models=size, total=total, l2=l2, solver=solver, steps=steps, rate=learning_rate)
            wanted = math.ceil(counts["n"] / ROWS_PER_GRADIENT_TASK)
            tasks = barrier_tasks(rows.sparkSession, counts["bytes"], 8 * (dimension + 2) * size, wanted, exchange=exchange)
            if tasks:
                found = together(rows.repartition(tasks), lambda own, summed: minimise(lambda w, b: summed(_gradient_of(own, w, b, up, down))))
            else:
                packed = rows.coalesce(min(rows.rdd.getNumPartitions(), wanted))

                def sums(weights, biases):
                    partials = packed.mapInArrow(_gradient_task(weights, biases, up, down), "g binary")
                    return _sum_partials(partials, packed.rdd.getNumPartitions()).reshape(dimension + 2, size)

                found = minimise(sums)
            biases, weights = found[dimension, 0] + found[dimension, 1:], found[:dimension, :1] + found[:dimension, 1:]
    finally:
        rows.unpersist()
    return Head(SHARED, features, dimension, seed, list(models), biases, weights, int(counts["n"])).pruned()


def _minimise(sums, *, dimension: int, models: int, total: int, l2: float, solver: str, steps: int, rate: float) -> np.ndarray:
    """Parameters of a shared head: the common part and the intercept in column 0, each model's own part and bias after it.

    `sums(weights, biases)` gives the models' gradient and loss sums. All but the intercept are penalised.
    """
    penalty = np.full((dimension + 1, models + 1), l2)
    penalty[dimension, 0] = 0.0

    def objective(theta):
        gathered = sums(theta[:dimension, :1] + theta[:dimension, 1:], theta[dimension, 0] + theta[dimension, 1:]) / total
        own = gathered[: dimension + 1]
        slope = np.hstack([own.sum(axis=1, keepdims=True), own]) + penalty * theta
        return gathered[dimension + 1].sum() + 0.5 * (penalty * theta * theta).sum(), slope

    theta = np.zeros((dimension + 1, models + 1))
    if solver == LBFGS:
        return lbfgs(objective, theta, iterations=steps, tolerance=SHARED_TOLERANCE)
    for _ in range(steps):
        theta = theta - rate * objective(theta)[1]
    return theta
