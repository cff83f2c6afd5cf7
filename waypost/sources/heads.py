"""Import of JSON heads and JSON router artifacts.

These are parameter files of bounded size, read whole; the data they are applied to is not.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import SparkSession

from waypost.functions.text import TOKEN_LIMIT
from waypost.operators.heads import INDEPENDENT, SHARED, SIGNED, WORDS, Head
from waypost.plans.model import RouterModel, calibrator_from_json

# Head kinds, the artifact version and the one vectoriser setting accepted.
SIGNED_KIND = "hashed-linear-v1"
SIGNED_SHARED_KIND = "shared-hashed-linear-v1"
WORDS_KIND = "sklearn-hashing-linear-v1"
WORDS_SHARED_KIND = "sklearn-shared-hashing-linear-v1"
ARTIFACT_VERSION = "semantic-router-artifact-v1"
VECTORIZER = {"alternate_sign": False, "lowercase": True, "ngram_range": [1, 2], "norm": "l2"}


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def import_head(value: dict, models: list[str] | None = None) -> Head:
    """A JSON head of any of the four kinds, in pool order.

    The two word kinds come from a vectoriser whose buckets differ from ours: they load,
    but `score` results would not match, so `RouterModel` takes only the signed kinds.
    """
    kind = value.get("kind")
    if kind not in (SIGNED_KIND, SIGNED_SHARED_KIND, WORDS_KIND, WORDS_SHARED_KIND):
        raise ValueError("unsupported model head")
    if kind in (WORDS_KIND, WORDS_SHARED_KIND) and value.get("vectorizer") != VECTORIZER:
        raise ValueError("unsupported hashing configuration")
    rows = value.get("models") or {}
    if not rows:
        raise ValueError("model head has no models")
    names = models or sorted(rows)
    if set(names) != set(rows):
        raise ValueError("model cards do not match the head")
    shared = kind in (SIGNED_SHARED_KIND, WORDS_SHARED_KIND)
    dimension = int(value["dimension"])
    weights = np.zeros((dimension, len(names)))
    biases = np.zeros(len(names))
    for column, name in enumerate(names):
        own = rows[name]["interaction_weights" if shared else "weights"]
        for index, weight in own.items():
            weights[int(index), column] = float(weight)
        biases[column] = float(rows[name]["bias"])
    if shared:
        biases += float(value["intercept"])
        for index, weight in value["common_weights"].items():
            weights[int(index), :] += float(weight)
    return Head(
        SHARED if shared else INDEPENDENT,
        SIGNED if kind in (SIGNED_KIND, SIGNED_SHARED_KIND) else WORDS,
        dimension,
        str(value.get("hash_seed", "")),
        list(names),
        biases,
        weights,
        int(value.get("training_examples", 0)),
        TOKEN_LIMIT if kind in (SIGNED_KIND, SIGNED_SHARED_KIND) else None,
    )


def artifact_digest(artifact: dict) -> str:
    """SHA-256 of the canonical JSON of an artifact without its own hash."""
    body = {key: value for key, value in artifact.items() if key != "artifact_hash"}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def import_artifact(artifact: dict) -> RouterModel:
    """A frozen JSON artifact with a signed head as a RouterModel, hash checked."""
    stated = str(artifact.get("artifact_hash", ""))
    if not stated or artifact_digest(artifact) != stated:
        raise ValueError("router artifact hash mismatch")
    if artifact.get("schema_version") != ARTIFACT_VERSION:
        raise ValueError("unsupported router artifact")
    cards = sorted((_card(card) for card in artifact["model_cards"]), key=lambda card: card["name"])
    names = [card["name"] for card in cards]
    if set(names) != set(artifact["models"]):
        raise ValueError("artifact model cards do not match model head")
    head = import_head(artifact["model_head"], names)
    if head.features != SIGNED:
        raise ValueError("word-feature heads use other buckets here: train again instead")
    selector = artifact["selector"]
    method = str(selector["default_method"])
    head.method = method
    return RouterModel(
        cards=cards,
        heads={method: head},
        calibrators={method: [calibrator_from_json(artifact["calibration"][name]) for name in names]},
        mean_costs=[float(artifact["expected_cost_usd"][name]) for name in names],
        grid=[dict(row) for row in selector.get("calibration_candidates", ())],
        default_method=method,
        default_lambda=float(selector["default_lambda"]),
        gate_passed=bool(selector.get("gate_passed", False)),
        best_fixed=str(selector["calibration_best_fixed"]),
        aggregation=str(selector.get("aggregation", "micro")),
        margin=float(selector.get("noninferiority_margin", 0.01)),
        training=dict(artifact.get("training", {})),
        imported_hash=stated,
    )


def _card(value: dict) -> dict:
    def number(name, cast):
        return cast(value[name]) if value.get(name) is not None else None

    return {
        "name": str(value["name"]),
        "provider": str(value.get("provider", "")),
        "expected_cost_usd": number("expected_cost_usd", float),
        "input_cost_per_million_usd": number("input_cost_per_million_usd", float),
        "output_cost_per_million_usd": number("output_cost_per_million_usd", float),
        "context_tokens": number("context_tokens", int),
        "capabilities": sorted({str(item) for item in value.get("capabilities", ())}),
        "metadata": {str(k): str(v) for k, v in value.get("metadata", {}).items()},
    }
