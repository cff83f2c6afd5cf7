"""String functions over conversation turns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waypost.functions.text import WHITE_SPACE

# Private blocks, the elision marker, return codes and hints.
PRIVATE_BLOCKS = (
    r"(?isu)<think>.*?</think>",
    r"(?isu)<(?:reasoning|analysis)>.*?</(?:reasoning|analysis)>",
    r"(?isu)<(?:think|reasoning|analysis)>.*\z",
)
ELIDED = "\n[ROUTER INPUT ELIDED]\n"
RETURN_CODE = r"(?iu)<returncode>[" + WHITE_SPACE + r"]*(-?\p{Nd}+)[" + WHITE_SPACE + r"]*</returncode>"
CODE_HINT = (
    r"(?iU)(```|traceback|exception|error|def |class |function|test_|pytest|"
    r"\.py\b|\.js\b|\.ts\b|git diff|/testbed)"
)
QUESTION_HINT = r"(?iU)\b(what|why|how|when|where|which|who)\b|\?"
ARGUMENTS_LIMIT = 1200


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\\z", "")


def replace_private_blocks(text: Column, replacement: str) -> Column:
    for pattern in PRIVATE_BLOCKS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def visible_content(content: Column) -> Column:
    """Content without private reasoning; a null content reads as the JSON word `null`."""
    return strip(replace_private_blocks(F.coalesce(content, F.lit("null")), ""))


def bounded(value: Column, limit: int) -> Column:
    """Head, marker and tail of a text longer than the limit.

    `value` must be a plain column or a lambda variable: it is read several times.
    """
    available = max(0, limit - len(ELIDED))
    left = available // 2
    return F.when(F.length(value) <= limit, value).otherwise(
        F.concat(F.substring(value, 1, left), F.lit(ELIDED), F.right(value, F.lit(available - left)))
    )


def tool_call_text(calls: Column) -> Column:
    """`name(arguments)` per call, one per line; calls that are not objects are skipped."""
    known = F.filter(F.coalesce(calls, F.array().cast("array<struct<name:string,arguments:string>>")), lambda c: c.isNotNull())
    return F.array_join(
        F.transform(
            known,
            lambda c: F.concat(
                F.coalesce(c["name"], F.lit("")),
                F.lit("("),
                bounded(F.coalesce(c["arguments"], F.lit("")), ARGUMENTS_LIMIT),
                F.lit(")"),
            ),
        ),
        "\n",
    )


def nonzero_codes(visible: Column) -> Column:
    """Per return code in a text, whether it is not zero."""
    return F.transform(
        F.regexp_extract_all(visible, F.lit(RETURN_CODE), F.lit(1)),
        lambda code: F.regexp_replace(code, "[-0]", "") != "",
    )
