"""Redaction and secret scan of whole tables, by a walk over their schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions.redaction import REDACTED, finding_paths, is_sensitive_name, redact_value


def redact(df: DataFrame, *, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Every string of a table redacted, structure kept. Columns in `keep` pass unchanged."""
    return df.select(
        *[
            F.col(f.name)
            if f.name in keep
            else (F.lit(REDACTED) if is_sensitive_name(f.name) else redact_value(F.col(f.name), f.dataType)).alias(f.name)
            for f in df.schema
        ]
    )


def scan_for_secrets(df: DataFrame, key: str, *, root: str = "$") -> DataFrame:
    """Unique (key, path) of values that may hold a credential, in any column; the key labels the finding."""
    record = F.struct(*[F.col(f.name) for f in df.schema])
    kind = df.select(record.alias("r")).schema["r"].dataType
    paths = finding_paths(record, kind, F.lit(root))
    if paths is None:
        return df.select(key, F.lit(None).cast("string").alias("path")).limit(0)
    found = F.array_distinct(F.filter(paths, lambda p: p.isNotNull()))
    return df.select(key, F.explode(found).alias("path"))


def may_hold_secret(df: DataFrame) -> Column:
    """Whether any value of a row may hold a credential."""
    record = F.struct(*[F.col(f.name) for f in df.schema])
    kind = df.select(record.alias("r")).schema["r"].dataType
    paths = finding_paths(record, kind, F.lit("$"))
    return F.lit(False) if paths is None else F.exists(paths, lambda p: p.isNotNull())
