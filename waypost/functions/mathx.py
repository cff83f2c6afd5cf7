"""Scalar column functions: sigmoid, logit, closeness, censoring weights, cost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Probability clip and linear-part clip of the logistic calibrator.
PROBABILITY_CLIP = 1e-6
LINEAR_CLIP = 30.0


def sigmoid(z: Column) -> Column:
    """Logistic function that never takes exp of a positive number."""
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def clipped_logit(p: Column) -> Column:
    clipped = F.greatest(F.lit(PROBABILITY_CLIP), F.least(F.lit(1.0 - PROBABILITY_CLIP), p))
    return F.ln(clipped) - F.log1p(-clipped)


def platt(p: Column, slope: Column, intercept: Column) -> Column:
    """Probability after a fitted logistic calibration of the logit."""
    linear = slope * clipped_logit(p) + intercept
    bounded = F.greatest(F.lit(-LINEAR_CLIP), F.least(F.lit(LINEAR_CLIP), linear))
    return 1.0 / (1.0 + F.exp(-bounded))


def is_finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def ipcw_weight(p: Column, censored: Column, clip: float = 10.0) -> Column:
    """Inverse-probability-of-censoring weight; null where p is outside [0, 1)."""
    valid = (p >= 0) & (p < 1)
    weight = F.when(censored, F.lit(0.0)).otherwise(F.least(F.lit(clip), 1.0 / (1.0 - p)))
    return F.when(valid, weight)


def token_price(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Price of a call from prices per million tokens; null unless both are known."""
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1_000_000)


def estimate_cost(
    tokens_in: Column,
    tokens_out: Column,
    price_in: Column,
    price_out: Column,
    expected: Column,
) -> Column:
    """Token price where both prices are known, else the card's expected cost."""
    return F.when(
        price_in.isNotNull() & price_out.isNotNull(),
        token_price(tokens_in, tokens_out, price_in, price_out),
    ).otherwise(expected)


def shannon_entropy(text: Column) -> Column:
    """Bits per character. `text` must be a plain column or a lambda variable."""
    length = F.length(text)
    chars = F.filter(F.split(text, ""), lambda ch: ch != "")
    return F.when(length <= 0, F.lit(0.0)).otherwise(
        -F.aggregate(
            F.array_distinct(chars),
            F.lit(0.0),
            lambda total, ch: total + _plogp((length - F.length(F.replace(text, ch, F.lit("")))) / length),
        )
    )


def text_entropy(text: Column) -> Column:
    """Bits per character of whole texts, by one count of their characters; `shannon_entropy` is for lambdas.

    An expression on strings passes over the text once for each of its distinct characters.
    """

    @F.arrow_udf("double")
    def entropies(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _entropy(t) for t in (value.as_py() for value in texts)], pa.float64())

    return entropies(text)


def _entropy(text: str) -> float:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return 0.0
    # Only texts of few scripts are counted in a table as long as their highest character.
    counts = np.bincount(points) if points.max() < len(points) + 1024 else np.unique(points, return_counts=True)[1]
    shares = counts[counts > 0] / len(points)
    return float(-(shares * np.log2(shares)).sum()) + 0.0


def _plogp(share: Column) -> Column:
    return share * F.log2(share)
