"""Redaction and secret detection on strings, and the walk over nested schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypost.functions.mathx import shannon_entropy
from waypost.functions.strings import replace_private_blocks
from waypost.functions.text import WHITE_SPACE

# Replacement texts, sensitive names, credential shapes and opaque runs.
REDACTED = "[REDACTED]"
HIDDEN = "[HIDDEN_REASONING_REMOVED]"
SENSITIVE_NAME = r"(api[_-]?key|authorization|password|passwd|secret|access[_-]?token|private[_-]?key)"
SECRET_SHAPES = (
    r"(?U)\b(?:sk[-_]|tk[-_]|ghp_|github_pat_|tml-)[A-Za-z0-9_-]{16,}\b",
    r"(?iU)\bBearer[" + WHITE_SPACE + r"]+[A-Za-z0-9._~+/=-]{12,}\b",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"(?iU)\bTINKER_API_KEY[" + WHITE_SPACE + r"]*=[" + WHITE_SPACE + r"]*[^" + WHITE_SPACE + r"]+",
)
OPAQUE_CHARS = "A-Za-z0-9_+/=-"
OPAQUE_LENGTH = 32
OPAQUE_RUN = f"[{OPAQUE_CHARS}]{{{OPAQUE_LENGTH},}}"
HEX_RUN = r"^[0-9a-fA-F]+$"
HEX_LENGTHS = (40, 64)
ENTROPY_LIMIT = 4.2


def is_sensitive_name(name: str) -> bool:
    return re.search(SENSITIVE_NAME, name, re.IGNORECASE) is not None


def sensitive_name(name: Column) -> Column:
    return name.rlike("(?iu)" + SENSITIVE_NAME)


def looks_opaque(run: Column) -> Column:
    """Whether a long run may be an unknown secret. `run` is read several times."""
    is_path = F.contains(run, F.lit("/"))
    is_hash = F.length(run).isin(*HEX_LENGTHS) & run.rlike(HEX_RUN)
    return ~is_path & ~is_hash & (shannon_entropy(run) >= ENTROPY_LIMIT)


def redact_shapes(text: Column) -> Column:
    """Private blocks and known credential shapes replaced."""
    text = replace_private_blocks(text, HIDDEN)
    for shape in SECRET_SHAPES:
        text = F.regexp_replace(text, shape, REDACTED)
    return text


def redact_runs(text: Column) -> Column:
    """Suspicious long runs replaced. The text is cut into runs of opaque and other
    characters, so each long run is judged whole; texts without one are left alone."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{OPAQUE_CHARS}]+|[^{OPAQUE_CHARS}]+"), F.lit(0))
    rebuilt = F.array_join(
        F.transform(
            pieces,
            lambda piece: F.when(
                (F.length(piece) >= OPAQUE_LENGTH) & piece.rlike(f"^[{OPAQUE_CHARS}]") & looks_opaque(piece),
                F.lit(REDACTED),
            ).otherwise(piece),
        ),
        "",
    )
    return F.when(text.rlike(OPAQUE_RUN), rebuilt).otherwise(text)


def redact_text(text: Column) -> Column:
    """Blocks first, then shapes, then opaque runs.

    The shapes are computed once, as a one-element array whose element the second step
    reads; a plain nesting would evaluate them again at each mention.
    """
    return F.get(F.transform(F.array(redact_shapes(text)), lambda clean: redact_runs(clean)), F.lit(0))


def text_is_suspicious(text: Column) -> Column:
    known = F.lit(False)
    for shape in SECRET_SHAPES:
        known = known | text.rlike(shape)
    runs = F.regexp_extract_all(text, F.lit(OPAQUE_RUN), F.lit(0))
    return F.coalesce(known | F.exists(runs, lambda run: looks_opaque(run)), F.lit(False))


def redact_value(value: Column, kind: T.DataType) -> Column:
    """Redact a value of any type, keeping its structure.

    A field with a sensitive name becomes the replacement text whatever it held.
    """
    if isinstance(kind, T.StringType):
        return redact_text(value)
    if isinstance(kind, T.StructType):
        fields = [
            (F.lit(REDACTED) if is_sensitive_name(f.name) else redact_value(value[f.name], f.dataType)).alias(f.name)
            for f in kind
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: redact_value(item, kind.elementType)) if _has_text(kind) else value
    if isinstance(kind, T.MapType):
        # A map has one value type: text can be replaced, another type can only be dropped.
        hidden = F.lit(REDACTED) if isinstance(kind.valueType, T.StringType) else F.lit(None)
        return F.transform_values(
            value,
            lambda k, v: F.when(sensitive_name(k.cast("string")), hidden).otherwise(redact_value(v, kind.valueType)),
        )
    return value


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StringType | T.MapType):
        return True
    if isinstance(kind, T.StructType):
        return any(is_sensitive_name(f.name) or _has_text(f.dataType) for f in kind)
    return isinstance(kind, T.ArrayType) and _has_text(kind.elementType)


def _named(name_hit: Column | None, value: Column, kind: T.DataType, path: Column) -> Column | None:
    if name_hit is None:
        return None
    holds = value.isNotNull()
    if isinstance(kind, T.StringType):
        holds = holds & ~value.isin("", REDACTED)
    return F.array(F.when(name_hit & holds, path))


def finding_paths(value: Column, kind: T.DataType, path: Column) -> Column | None:
    """Array of paths at which a value may hold a secret (with nulls), or None if it cannot."""
    if isinstance(kind, T.StringType):
        return F.array(F.when(text_is_suspicious(value), path))
    if isinstance(kind, T.StructType):
        parts = []
        for field in kind:
            inner, where = value[field.name], F.concat(path, F.lit(f".{field.name}"))
            hit = F.lit(True) if is_sensitive_name(field.name) else None
            parts += [_named(hit, inner, field.dataType, where), finding_paths(inner, field.dataType, where)]
        parts = [part for part in parts if part is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.ArrayType):
        if not _has_text(kind.elementType):
            return None
        items = F.coalesce(value, F.array().cast(kind))
        return F.flatten(
            F.transform(
                items,
                lambda item, i: finding_paths(
                    item, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
                ),
            )
        )
    if isinstance(kind, T.MapType):
        entries = F.coalesce(F.map_entries(value), F.array().cast(T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))))

        def entry(e):
            where = F.concat(path, F.lit("."), e["key"].cast("string"))
            named = _named(sensitive_name(e["key"].cast("string")), e["value"], kind.valueType, where)
            inner = finding_paths(e["value"], kind.valueType, where)
            return named if inner is None else F.concat(named, inner)

        return F.flatten(F.transform(entries, entry))
    return None
