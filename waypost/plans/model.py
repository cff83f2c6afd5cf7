"""RouterModel: the parameters of a trained router, saved as a folder of small tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.functions.text import is_blank
from waypost.operators.calibrate import LINEAR, STEP, Calibrator, calibrate
from waypost.operators.heads import Head, score
from waypost.operators.sizing import bounded_rows
from waypost.schema import CARD, MAX_POOL

SCHEMA_VERSION = "waypost-router-1"
MAX_GRID = 10_000

HEAD_SCHEMA = "method string, features string, dimension int, seed string, training_examples bigint, token_limit int"
BIAS_SCHEMA = "method string, model string, pos int, bias double"
CALIBRATOR_SCHEMA = "method string, model string, kind string, thresholds array<double>, `values` array<double>"
GRID_SCHEMA = (
    "method string, lambda double, success_rate double, mean_expected_cost_usd double, "
    "difference_vs_best_fixed double, one_sided_95_lower_difference double, passes_noninferiority boolean"
)
SELECTOR_SCHEMA = (
    "schema_version string, default_method string, default_lambda double, gate_passed boolean, "
    "best_fixed string, aggregation string, margin double, training string, content_hash string"
)


def card_rows(cards: DataFrame) -> list[dict]:
    """Cards on the driver, in name order. The pool's size is checked."""
    names = [f.name for f in CARD]
    rows = bounded_rows(cards.select(*names), MAX_POOL, "model pool")
    return sorted((row.asDict(recursive=True) for row in rows), key=lambda card: card["name"])


@dataclass
class RouterModel:
    cards: list[dict]
    heads: dict[str, Head]
    calibrators: dict[str, list[Calibrator]]
    mean_costs: list[float]
    grid: list[dict]
    default_method: str
    default_lambda: float
    gate_passed: bool
    best_fixed: str
    aggregation: str = "micro"
    margin: float = 0.01
    training: dict = field(default_factory=dict)
    imported_hash: str = ""

    def __post_init__(self) -> None:
        self.validate()

    @property
    def models(self) -> list[str]:
        return [card["name"] for card in self.cards]

    @property
    def head(self) -> Head:
        return self.heads[self.default_method]

    @property
    def artifact_hash(self) -> str:
        return self.imported_hash or self.content_hash()

    def validate(self) -> None:
        if self.default_method not in self.heads:
            raise ValueError("default method has no head")
        if set(self.models) != set(self.head.models) or len(set(self.models)) != len(self.models):
            raise ValueError("model cards do not match the head")
        if self.head.models != self.models:
            raise ValueError("head is not in pool order")
        if len(self.mean_costs) != len(self.models) or len(self.calibrators[self.default_method]) != len(self.models):
            raise ValueError("costs or calibrators do not match the pool")
        if self.best_fixed not in self.models:
            raise ValueError("fallback model is not in the pool")

    def gates(self) -> list[tuple[float, bool]]:
        """(lambda, passes) of the default method; a repeated lambda keeps its last gate."""
        found: dict[float, bool] = {}
        for row in self.grid:
            if row["method"] == self.default_method:
                found[float(row["lambda"])] = bool(row["passes_noninferiority"])
        return list(found.items())

    def content_hash(self) -> str:
        """SHA-256 over every parameter, independent of how the tables are stored."""
        digest = hashlib.sha256()
        plain = {
            "cards": self.cards,
            "mean_costs": self.mean_costs,
            "grid": sorted(self.grid, key=lambda r: (r["method"], r["lambda"])),
            "selector": [self.default_method, self.default_lambda, self.gate_passed, self.best_fixed, self.aggregation, self.margin],
            "training": self.training,
            "calibrators": {
                method: [[c.kind, c.thresholds, c.values] for c in fitted] for method, fitted in self.calibrators.items()
            },
            "heads": {
                method: [h.features, h.dimension, h.seed, h.models, h.training_examples, *([h.token_limit] if h.token_limit else [])] for method, h in self.heads.items()
            },
        }
        digest.update(json.dumps(plain, sort_keys=True, ensure_ascii=False).encode())
        for method in sorted(self.heads):
            head = self.heads[method]
            # Adding 0.0 folds negative zero, which a sparse table does not keep.
            digest.update(np.ascontiguousarray(head.biases + 0.0, dtype="<f8").tobytes())
            digest.update(np.ascontiguousarray(head.weights + 0.0, dtype="<f8").tobytes())
        return digest.hexdigest()

    # ------------------------------------------------------------ tables

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet table per part. Weights pruned to zero are not stored."""
        weights = []
        for method, head in self.heads.items():
            idx, pos = np.nonzero(head.weights)
            weights.append(
                pa.table(
                    {
                        "method": pa.array([method] * len(idx), pa.string()),
                        "pos": pa.array(pos.astype(np.int32)),
                        "idx": pa.array(idx.astype(np.int32)),
                        "w": pa.array(head.weights[idx, pos]),
                    }
                )
            )
        tables = {
            "cards": spark.createDataFrame([tuple(card[f.name] for f in CARD) for card in self.cards], CARD),
            "head": spark.createDataFrame(
                [(m, h.features, h.dimension, h.seed, h.training_examples, h.token_limit) for m, h in self.heads.items()], HEAD_SCHEMA
            ),
            "head_bias": spark.createDataFrame(
                [(m, name, i, float(h.biases[i])) for m, h in self.heads.items() for i, name in enumerate(h.models)], BIAS_SCHEMA
            ),
            "head_weight": spark.createDataFrame(pa.concat_tables(weights)),
            "calibrator": spark.createDataFrame(
                [
                    (m, name, c.kind, c.thresholds, c.values)
                    for m, fitted in self.calibrators.items()
                    for name, c in zip(self.heads[m].models, fitted)
                ],
                CALIBRATOR_SCHEMA,
            ),
            "mean_cost": spark.createDataFrame(list(zip(self.models, map(float, self.mean_costs))), "model string, mean_cost_usd double"),
            "policy_grid": spark.createDataFrame([tuple(r.values()) for r in map(_grid_row, self.grid)], GRID_SCHEMA),
        }
        for name, table in tables.items():
            table.write.mode("errorifexists").parquet(f"{path}/{name}")
        # The selector goes last: a folder without it is an unfinished save.
        spark.createDataFrame(
            [
                (
                    SCHEMA_VERSION,
                    self.default_method,
                    float(self.default_lambda),
                    bool(self.gate_passed),
                    self.best_fixed,
                    self.aggregation,
                    float(self.margin),
                    json.dumps(self.training, sort_keys=True),
                    self.content_hash(),
                )
            ],
            SELECTOR_SCHEMA,
        ).write.mode("errorifexists").parquet(f"{path}/selector")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RouterModel":
        """Read a saved model and check version, shape and content hash."""

        def rows(name, limit):
            return [r.asDict(recursive=True) for r in bounded_rows(spark.read.parquet(f"{path}/{name}"), limit, name)]

        selector = rows("selector", 1)[0]
        if selector["schema_version"] != SCHEMA_VERSION:
            raise ValueError("unsupported router model")
        cards = card_rows(spark.read.parquet(f"{path}/cards"))
        # Bounded when the heads were made: every head checks its number of weights.
        frame = spark.read.parquet(f"{path}/head_weight").toPandas()
        biases, fitted = rows("head_bias", MAX_GRID), rows("calibrator", MAX_GRID)
        heads, calibrators = {}, {}
        for meta in rows("head", MAX_POOL):
            method = meta["method"]
            ordered = sorted((r for r in biases if r["method"] == method), key=lambda r: r["pos"])
            weights = np.zeros((meta["dimension"], len(ordered)))
            own = frame[frame["method"] == method]
            weights[own["idx"].to_numpy(), own["pos"].to_numpy()] = own["w"].to_numpy()
            names = [r["model"] for r in ordered]
            heads[method] = Head(
                method, meta["features"], meta["dimension"], meta["seed"], names,
                np.array([r["bias"] for r in ordered]), weights, meta["training_examples"], meta.get("token_limit"),
            )
            by_model = {r["model"]: Calibrator(r["kind"], r["thresholds"], r["values"]) for r in fitted if r["method"] == method}
            calibrators[method] = [by_model[name] for name in names]
        costs = {r["model"]: r["mean_cost_usd"] for r in rows("mean_cost", MAX_POOL)}
        model = cls(
            cards=cards, heads=heads, calibrators=calibrators,
            mean_costs=[costs[card["name"]] for card in cards],
            grid=rows("policy_grid", MAX_GRID),
            default_method=selector["default_method"], default_lambda=selector["default_lambda"],
            gate_passed=selector["gate_passed"], best_fixed=selector["best_fixed"],
            aggregation=selector["aggregation"], margin=selector["margin"],
            training=json.loads(selector["training"]),
        )
        if model.content_hash() != selector["content_hash"]:
            raise ValueError("router model content hash mismatch")
        return model

    # ------------------------------------------------------------ prediction

    def predict(self, requests: DataFrame, *, text: str = "text", out: str = "success", allow_blank: bool = False) -> DataFrame:
        """Add the calibrated success per model, in pool order; null for a blank text.

        With `allow_blank` blank texts are scored by what features they have, and a null one as an empty one.
        """
        given = requests.withColumn("__given", F.coalesce(F.col(text), F.lit(""))) if allow_blank else requests
        scored = score(given, self.head, text="__given" if allow_blank else text, out="__raw")
        success = calibrate(F.col("__raw"), self.calibrators[self.default_method])
        return scored.withColumn(out, success if allow_blank else F.when(~is_blank(F.col(text)), success)).drop("__raw", "__given")


def _grid_row(row: dict) -> dict:
    names = [part.strip().split(" ")[0] for part in GRID_SCHEMA.split(",")]
    return {name: row.get(name) for name in names}


def compact_step(thresholds: list[float], values: list[float]) -> tuple[list[float], list[float]]:
    """Drop thresholds that repeat the value before them; step lookups do not change."""
    kept = [(t, v) for i, (t, v) in enumerate(zip(thresholds, values)) if i == 0 or v != values[i - 1]]
    return [t for t, _ in kept], [v for _, v in kept]


def calibrator_from_json(value: dict) -> Calibrator:
    kinds = {"isotonic-pava-v1": STEP, "isotonic-linear-v1": LINEAR}
    if value.get("kind") not in kinds:
        raise ValueError("unsupported calibrator")
    kind = kinds[value["kind"]]
    thresholds, values = [float(x) for x in value["thresholds"]], [float(x) for x in value["values"]]
    Calibrator(kind, thresholds, values)
    if kind == STEP:
        thresholds, values = compact_step(thresholds, values)
    return Calibrator(kind, thresholds, values)
