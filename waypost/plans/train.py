"""Training: checks, features, heads, calibration, policy grid, model."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.functions.text import DEFAULT_DIMENSION, DEFAULT_SEED
from waypost.operators.calibrate import LINEAR, STEP, calibrate, collect_calibrators, fit_isotonic
from waypost.operators.costs import mean_costs
from waypost.operators.heads import GRADIENT_EPOCHS, INDEPENDENT, SHARED, Head, fit_logistic, fit_logistic_gd, score
from waypost.operators.matrix import cell_arrays, requests_of, to_long
from waypost.operators.policy import LAMBDAS, MACRO, MARGIN, MICRO, fixed_rates, policy_grid, select_policy
from waypost.operators.validate import card_violations, missing_groups, require, row_violations, split_matrix, validate_matrix
from waypost.plans.model import MAX_GRID, RouterModel, card_rows
from waypost.sources.readers import normalize_cards

GRADIENT = "gradient"
LOGISTIC = "logistic"
# The names other tools give the two solvers.
BACKENDS = {"auto": LOGISTIC, GRADIENT: GRADIENT, LOGISTIC: LOGISTIC, "stdlib": GRADIENT, "sklearn": LOGISTIC}
METHODS = (INDEPENDENT, SHARED)
POOLED = "\x00pooled"


def split_examples(outcomes: DataFrame, models: list[str], split: str, *extra: str) -> DataFrame:
    """One row per request of a split: text and labels in pool order."""
    rows = split_matrix(outcomes, split)
    return requests_of(rows, models, *extra).join(cell_arrays(rows, models, ["acceptable"]), "request_id")


def calibration_fits(raw: DataFrame, models: list[str], kind: str) -> DataFrame:
    """Points per (method, model), and per method pooled over all models, in one fit.

    `raw` has method, raw and acceptable (arrays in pool order).
    """
    cells = to_long(raw, models, {"raw": "score", "acceptable": "outcome"}, "method")
    both = cells.select("method", F.explode(F.array("model", F.lit(POOLED))).alias("model"), "score", "outcome")
    return fit_isotonic(both, by=["method", "model"], score="score", outcome="outcome", kind=kind)


def own_calibrators(raw: DataFrame, models: list[str]) -> DataFrame:
    """(method, model, own): whether a model has two labels and two scores of its own."""
    cells = to_long(raw, models, {"raw": "score", "acceptable": "outcome"}, "method")
    return cells.groupBy("method", "model").agg(
        ((F.min("score") < F.max("score")) & (F.min("outcome") != F.max("outcome"))).alias("own")
    )


def train_router(
    outcomes: DataFrame,
    cards: DataFrame,
    *,
    dimension: int = DEFAULT_DIMENSION,
    hash_seed: str = DEFAULT_SEED,
    lambdas=LAMBDAS,
    noninferiority_margin: float = MARGIN,
    backend: str = "auto",
    aggregation: str = "auto",
    gradient_epochs: int = GRADIENT_EPOCHS,
    validate: bool = True,
    allow_blank: bool = False,
) -> RouterModel:
    """Fit, calibrate and gate a router on a complete outcome matrix.

    Requests with a blank text are violations; with `allow_blank` they are examples like all others, by what features
    they have, and a null text is read as an empty one.
    """
    if backend not in BACKENDS:
        raise ValueError("backend must be auto, gradient, or logistic")
    if len(lambdas) * len(METHODS) > MAX_GRID:
        raise ValueError(f"a policy grid holds at most {MAX_GRID} rows; give fewer lambdas")
    if aggregation not in ("auto", MICRO, MACRO):
        raise ValueError("aggregation must be auto, micro, or macro_group")
    solver = BACKENDS[backend]
    cards = normalize_cards(cards)
    require(card_violations(cards), "invalid model cards")
    pool = card_rows(cards)
    if not pool:
        raise ValueError("model cards must be non-empty and uniquely named")
    models = [card["name"] for card in pool]
    if allow_blank:
        outcomes = outcomes.withColumn("text", F.coalesce("text", F.lit("")))
    if validate:
        # Before the split: a row of neither split must not fall away.
        require(row_violations(outcomes, heldout=False, allow_blank=allow_blank), "invalid outcome rows")
        for split in ("train", "calibration"):
            rows = split_matrix(outcomes, split)
            if rows.isEmpty():
                raise ValueError(f"no complete {split} examples")
            require(validate_matrix(rows, cards, rows_checked=True), f"invalid {split} matrix")
    grouped = missing_groups(outcomes).isEmpty()
    if aggregation == "auto":
        aggregation = MACRO if grouped else MICRO
    if aggregation == MACRO and not grouped:
        raise ValueError("macro_group aggregation needs a group on every calibration request")

    learned = {row["model"]: row["mean_cost_usd"] for row in mean_costs(outcomes, cards).collect()}
    lacking = [m for m in models if learned[m] is None]
    if lacking:
        raise ValueError(f"models need training costs or expected_cost_usd: {lacking}")
    costs = [float(learned[m]) for m in models]

    train = split_examples(outcomes, models, "train")
    heads: dict[str, Head]
    if solver == GRADIENT:
        heads = {
            INDEPENDENT: fit_logistic_gd(train, models, dimension=dimension, seed=hash_seed, epochs=gradient_epochs)
        }
    else:
        heads = {method: fit_logistic(train, models, dimension=dimension, method=method) for method in (INDEPENDENT, SHARED)}

    calibration = split_examples(outcomes, models, "calibration", "group")
    parts = [
        score(calibration, head).select("request_id", "group", F.lit(method).alias("method"), "raw", "acceptable")
        for method, head in heads.items()
    ]
    raw = parts[0]
    for part in parts[1:]:
        raw = raw.unionByName(part)
    raw = raw.persist(StorageLevel.MEMORY_AND_DISK)
    kind = STEP if solver == GRADIENT else LINEAR
    try:
        fitted = collect_calibrators(calibration_fits(raw, models, kind), ["method", "model"], kind)
        own = {(r["method"], r["model"]): r["own"] for r in own_calibrators(raw, models).collect()}
        calibrators = {
            method: [fitted[(method, m if own[(method, m)] else POOLED)] for m in models] for method in heads
        }
        scored = None
        for method in heads:
            part = raw.filter(F.col("method") == method).withColumn("success", calibrate(F.col("raw"), calibrators[method]))
            scored = part if scored is None else scored.unionByName(part)
        labels = raw.filter(F.col("method") == INDEPENDENT)
        rates = {r["model"]: r["success_rate"] for r in fixed_rates(labels, models, aggregation).collect()}
        best = max(models, key=lambda m: (rates[m], -learned[m], m))
        grid = policy_grid(
            scored, models, costs, best, lambdas=lambdas, margin=noninferiority_margin, aggregation=aggregation
        ).persist()
        rows = [row.asDict() for row in grid.collect()]
        chosen = select_policy(grid).first()
        grid.unpersist()
        counted = labels.count()
    finally:
        raw.unpersist()
    return RouterModel(
        cards=pool,
        heads=heads,
        calibrators=calibrators,
        mean_costs=costs,
        grid=sorted(rows, key=lambda r: (r["method"], r["lambda"])),
        default_method=chosen["default_method"],
        default_lambda=chosen["default_lambda"],
        gate_passed=chosen["gate_passed"],
        best_fixed=best,
        aggregation=aggregation,
        margin=noninferiority_margin,
        training={
            "train_requests": heads[INDEPENDENT].training_examples,
            "calibration_requests": counted,
            "complete_matrix_required": True,
            "online_learning": False,
            "backend": solver,
        },
    )
