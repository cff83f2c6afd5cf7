"""Matrix checks. Each finds its violations as rows; strict mode raises on any.

No check moves text: agreement on text is decided on its SHA-256, taken map-side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions.mathx import is_finite
from waypost.functions.text import is_blank
from waypost.operators.sizing import broadcast_if_small

SPLITS = ("train", "calibration")
MODES = ("quality", "balanced", "cost")


def _bad_cost(cost: Column) -> Column:
    return cost.isNotNull() & (~is_finite(cost) | (cost < 0))


def _cells(df: DataFrame, rule: str, condition: Column) -> DataFrame:
    return df.filter(condition).select(
        F.lit(rule).alias("rule"), F.col("request_id"), F.col("model")
    )


def row_violations(df: DataFrame, *, heldout: bool, allow_blank: bool = False) -> DataFrame:
    """Rows that break a rule on their own. With `allow_blank` a blank text breaks none."""
    missing = F.coalesce(F.col("request_id"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("model"), F.lit("")).eqNullSafe("")
    if not allow_blank:
        missing = missing | is_blank(F.col("text"))
    checks = [("missing_field", missing), ("bad_cost", _bad_cost(F.col("cost_usd")))]
    if heldout:
        one_sided = F.col("input_tokens").isNull() != F.col("output_tokens").isNull()
        negative = F.least("input_tokens", "output_tokens") < 0
        checks += [("token_pair", one_sided), ("negative_tokens", F.coalesce(negative, F.lit(False)))]
    else:
        checks.append(("bad_split", ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))))
    broken = F.filter(
        F.array(*[F.when(condition, F.lit(rule)) for rule, condition in checks]), lambda rule: rule.isNotNull()
    )
    # One pass over the rows: a row lists every rule it breaks.
    return df.select(F.explode(broken).alias("rule"), "request_id", "model")


def card_violations(cards: DataFrame) -> DataFrame:
    """Cards that break a rule, and names used twice."""
    costs = ["expected_cost_usd", "input_cost_per_million_usd", "output_cost_per_million_usd"]
    checks = [
        ("card_name", is_blank(F.col("name"))),
        ("card_context", F.coalesce(F.col("context_tokens") <= 0, F.lit(False))),
        ("card_cost", reduce(lambda a, b: a | b, [_bad_cost(F.col(name)) for name in costs])),
    ]
    broken = F.filter(
        F.array(*[F.when(condition, F.lit(rule)) for rule, condition in checks]), lambda rule: rule.isNotNull()
    )
    own = cards.select(F.explode(broken).alias("rule"), F.col("name").alias("model"))
    twice = (
        cards.groupBy("name").count().filter("count > 1").select(F.lit("card_duplicate").alias("rule"), F.col("name").alias("model"))
    )
    return own.unionByName(twice)


def unknown_models(df: DataFrame, cards: DataFrame) -> DataFrame:
    """Outcome rows whose model has no card."""
    known = broadcast_if_small(cards.select(F.col("name").alias("model")))
    return df.join(known, "model", "left_anti").select(
        F.lit("unknown_model").alias("rule"), "request_id", "model"
    )


def unused_cards(df: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards no outcome row mentions. Distinct names combine map-side before the join."""
    seen = df.select("model").distinct()
    return cards.select(F.col("name").alias("model")).join(seen, "model", "left_anti").select(
        F.lit("unused_card").alias("rule"), F.lit(None).cast("string").alias("request_id"), "model"
    )


def _fingerprint(text: Column) -> list[Column]:
    """120 bits of the SHA-256 of a text as two numbers, which aggregate by hash."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return [F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint") for start in (1, 16)]


# Fields that must agree within a request, and the numbers that stand for each.
AGREEMENT = {"text": ("text_a", "text_b"), "group": ("group_a", "group_b"), "tokens": ("tokens_in", "tokens_out")}
ABSENT = -(1 << 62)


def cell_summary(df: DataFrame, *, heldout: bool) -> DataFrame:
    """One row per (request, model): row count and the range of the fields that must agree."""
    def tokens(name):
        return F.coalesce(F.col(name), F.lit(ABSENT)) if heldout else F.lit(ABSENT)

    numbers = [
        *_fingerprint(F.col("text")), *_fingerprint(F.col("group")), tokens("input_tokens"), tokens("output_tokens")
    ]
    names = [name for pair in AGREEMENT.values() for name in pair]
    picked = df.select("request_id", "model", *[n.cast("bigint").alias(name) for n, name in zip(numbers, names)])
    bounds = [f(name).alias(f"{name}_{end}") for name in names for f, end in ((F.min, "lo"), (F.max, "hi"))]
    return picked.groupBy("request_id", "model").agg(F.count(F.lit(1)).alias("n"), *bounds)


def duplicate_cells(cells: DataFrame) -> DataFrame:
    return _cells(cells, "duplicate_cell", F.col("n") > 1)


def request_violations(cells: DataFrame, *, check_group: bool = True) -> DataFrame:
    """Requests whose rows disagree on text, group or tokens."""
    names = [name for pair in AGREEMENT.values() for name in pair]
    bounds = [F.min(f"{name}_lo").alias(f"{name}_lo") for name in names]
    bounds += [F.max(f"{name}_hi").alias(f"{name}_hi") for name in names]
    per_request = cells.groupBy("request_id").agg(*bounds)
    checks = [("text_disagrees", "text"), ("tokens_disagree", "tokens")]
    if check_group:
        checks.insert(1, ("group_disagrees", "group"))

    def differs(field):
        first, second = AGREEMENT[field]
        return (F.col(f"{first}_lo") != F.col(f"{first}_hi")) | (F.col(f"{second}_lo") != F.col(f"{second}_hi"))

    broken = F.filter(
        F.array(*[F.when(differs(field), F.lit(rule)) for rule, field in checks]),
        lambda rule: rule.isNotNull(),
    )
    return per_request.select(
        F.explode(broken).alias("rule"), "request_id", F.lit(None).cast("string").alias("model")
    )


def missing_cells(cells: DataFrame, cards: DataFrame) -> DataFrame:
    """(request, model) pairs the matrix lacks.

    One grouped pass: what each request has is taken from the pool, and the rest is laid out.
    """
    # One row, whatever the data; a request's set is cut to the pool before it is gathered.
    pool = F.broadcast(cards.agg(F.collect_set("name").alias("pool")))
    known = F.when(F.array_contains("pool", F.col("model")), F.col("model"))
    seen = (
        cells.select("request_id", "model").crossJoin(pool)
        .groupBy("request_id").agg(F.collect_set(known).alias("seen"), F.first("pool").alias("pool"))
    )
    return seen.select(
        F.lit("missing_cell").alias("rule"), "request_id", F.explode(F.array_except("pool", "seen")).alias("model")
    )


def missing_groups(df: DataFrame) -> DataFrame:
    """Calibration requests without a group (macro aggregation needs one on each)."""
    return (
        df.filter((F.col("split") == "calibration") & (F.coalesce(F.col("group"), F.lit("")) == ""))
        .select("request_id").distinct()
        .select(F.lit("missing_group").alias("rule"), "request_id", F.lit(None).cast("string").alias("model"))
    )


def unpriced_requests(df: DataFrame, cards: DataFrame, *, input_tokens: int | None = None) -> DataFrame:
    """Requests without tokens in a pool that is priced by tokens."""
    priced = cards.filter("input_cost_per_million_usd is not null and output_cost_per_million_usd is not null").limit(1)
    lacking = df.filter((F.col("input_tokens").isNull() | F.col("output_tokens").isNull()) & F.lit(input_tokens is None))
    return (
        lacking.select("request_id").distinct().crossJoin(priced.select(F.lit(1).alias("one"))).select(
            F.lit("tokens_needed").alias("rule"), "request_id", F.lit(None).cast("string").alias("model")
        )
    )


def split_matrix(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split. The filter reaches the scan."""
    return df.filter(F.col("split") == split)


def validate_matrix(
    df: DataFrame, cards: DataFrame, *, heldout: bool = False, cells: DataFrame | None = None, rows_checked: bool = False
) -> DataFrame:
    """All violations of a matrix: (rule, request_id, model).

    With `rows_checked` the caller has found no `row_violations`, and their pass over the texts is not repeated.
    """
    summary = cell_summary(df, heldout=heldout) if cells is None else cells
    parts = [] if rows_checked else [row_violations(df, heldout=heldout)]
    parts += [
        unknown_models(df, cards),
        duplicate_cells(summary),
        request_violations(summary),
        missing_cells(summary, cards),
    ]
    if not heldout:
        parts.append(unused_cards(df, cards))
    return reduce(DataFrame.unionByName, parts)


def require(violations: DataFrame, what: str) -> None:
    """Raise with a few examples when there is any violation."""
    found = violations.head(5)
    if found:
        raise ValueError(f"{what}: " + "; ".join(str(tuple(row)) for row in found))


def refuse(rules: list[tuple[bool, str]]) -> None:
    """Raise the message of the first rule that is broken."""
    for broken, message in rules:
        if broken:
            raise ValueError(message)


def token_rules(*counts: int | None) -> list[tuple[bool, str]]:
    return [(any(n is not None and n < 0 for n in counts), "a token count is below zero")]


def mode_rules(modes) -> list[tuple[bool, str]]:
    unknown = sorted(set(modes) - set(MODES))
    return [(bool(unknown), f"unknown routing mode {', '.join(unknown)}; known are {', '.join(MODES)}")]


def check_route_arguments(
    *, mode: str = "balanced", input_tokens: int | None = 0, output_tokens: int | None = 0, max_quality_drop: float = 0.05
) -> None:
    """Scalar arguments of a routing job. Per-row values become an error column instead."""
    drop = [(not 0.0 <= max_quality_drop <= 1.0, "the quality drop is a share between 0 and 1")]
    refuse(mode_rules([mode]) + token_rules(input_tokens, output_tokens) + drop)


def check_evaluation_arguments(
    modes, *, input_tokens: int | None, output_tokens: int | None, bootstrap_samples: int
) -> list[str]:
    """Arguments of an evaluation; returns the modes, each once."""
    refuse(
        [(not modes, "an evaluation needs a routing mode")]
        + mode_rules(modes)
        + [(bootstrap_samples < 1, "a bootstrap needs samples")]
        + [((input_tokens is None) != (output_tokens is None), "give both token counts for all requests, or neither")]
        + token_rules(input_tokens, output_tokens)
    )
    return list(dict.fromkeys(modes))
