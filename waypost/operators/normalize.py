"""Raw records to typed outcome rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions.digest import row_digest

# Fixed value: the threshold used when a scored record names none.
DEFAULT_THRESHOLD = 0.5

HELDOUT_FIELDS = [
    "acceptable",
    "cost_usd",
    "group",
    "input_tokens",
    "model",
    "output_tokens",
    "request_id",
    "text",
]


def _label(value: Column) -> Column:
    """Boolean from a boolean or number held as text; any other text is no label."""
    number = value.try_cast("double")
    return F.when(F.lower(value).isin("true", "false"), F.lower(value) == "true").otherwise(number != 0)


def outcome_label(df: DataFrame) -> Column:
    """`acceptable`, or `score >= acceptable_threshold` where it is missing."""
    have = set(df.columns)
    parts = []
    if "acceptable" in have:
        column = F.col("acceptable")
        parts.append(column if df.schema["acceptable"].dataType.simpleString() == "boolean" else _label(column.cast("string")))
    if "score" in have:
        limit = F.col("acceptable_threshold") if "acceptable_threshold" in have else F.lit(None).cast("double")
        parts.append(F.col("score") >= F.coalesce(limit, F.lit(DEFAULT_THRESHOLD)))
    return F.coalesce(*parts)


def _text(df: DataFrame) -> Column:
    names = [name for name in ("text", "prompt") if name in df.columns]
    return F.coalesce(*[F.col(name) for name in names], F.lit(""))


def _common(df: DataFrame) -> list[Column]:
    have = set(df.columns)
    return [
        F.col("request_id").cast("string").alias("request_id"),
        _text(df).alias("text"),
        F.col("model").cast("string").alias("model"),
        outcome_label(df).alias("acceptable"),
        (F.col("cost_usd") if "cost_usd" in have else F.lit(None)).cast("double").alias("cost_usd"),
        F.coalesce(F.col("group") if "group" in have else F.lit(None), F.lit("")).cast("string").alias("group"),
    ]


def _require_label(rows: DataFrame, strict: bool) -> DataFrame:
    if strict and not rows.filter(F.col("acceptable").isNull()).isEmpty():
        raise ValueError("a row has neither a label nor a score to take it from")
    return rows


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised rows with a label and, apart from them, those without."""
    return rows.filter(F.col("acceptable").isNotNull()), rows.filter(F.col("acceptable").isNull())


def normalize_outcomes(df: DataFrame, *, strict: bool = True) -> DataFrame:
    """Training and calibration rows with their label, text and group settled.

    `strict` raises on a row without a label; else such rows stay, with a null label, for `quarantine`.
    """
    return _require_label(df.select(*_common(df), F.col("split").cast("string").alias("split")), strict)


def normalize_heldout(df: DataFrame, *, strict: bool = True) -> DataFrame:
    """Held-out rows: the same, with token counts and without a split."""
    have = set(df.columns)
    tokens = [
        (F.col(name) if name in have else F.lit(None)).cast("bigint").alias(name)
        for name in ("input_tokens", "output_tokens")
    ]
    return _require_label(df.select(*_common(df), *tokens), strict)


def heldout_record(df: DataFrame, out: str = "record") -> DataFrame:
    """Add the canonical eight-field record of a held-out row, fields in sorted order."""
    return df.withColumn(out, F.struct(*[F.col(name) for name in HELDOUT_FIELDS]))


def heldout_digest(df: DataFrame) -> DataFrame:
    """Add the digest of the canonical record."""
    return df.withColumn("row_digest", row_digest(*HELDOUT_FIELDS))
