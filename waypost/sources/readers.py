"""Readers for outcomes, held-out outcomes, model cards and conversations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypost.functions.text import is_blank
from waypost.operators.normalize import normalize_heldout, normalize_outcomes
from waypost.schema import CARD, HELDOUT_RAW, OUTCOME_RAW

CORRUPT = "_corrupt"


def read_json_lines(
    spark: SparkSession, path: str, schema: T.StructType, *, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON Lines folder and, apart from them, its unreadable lines.

    Blank lines are skipped. A bad line (line, _file, number) is reported with its number in its file. `strict` raises
    when there is one.
    """
    places = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select("value", *places)
    rows, bad = parse_json_lines(lines, schema)
    if not strict:
        return rows, numbered_bad_lines(lines, schema)
    # Lines are only counted where there is a bad one.
    if bad.head(1):
        first = numbered_bad_lines(lines, schema).orderBy("_file", "number").first()
        raise ValueError(f"invalid JSON line {first['number']} in {first['_file']}: {first['line'][:200]}")
    return rows, bad.withColumn("number", F.lit(None).cast("bigint"))


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    wanted = T.StructType(list(schema) + [T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.withColumn("row", F.from_json("value", wanted, options)).withColumn(
        "bad", ~F.startswith(F.ltrim("value"), F.lit("{")) | F.col(f"row.{CORRUPT}").isNotNull()
    )


def numbered_bad_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """(line, _file, number) of the unreadable lines of (value, _file, _block), numbered from 1 in each file.

    A task counts the lines of each block of a file that it reads, and numbers the bad ones within it; the lines of
    earlier blocks are added from one row per block.
    """
    marked = _parsed(lines, schema).select("_file", "_block", F.when(F.col("bad") & ~is_blank(F.col("value")), F.col("value")).alias("line"))

    def count(batches):
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for file, block, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                number = seen[file, block] = seen.get((file, block), 0) + 1
                if line is not None:
                    rows.append((file, block, line, number))
            yield _as_batch(rows)
        yield _as_batch([(file, block, None, n) for (file, block), n in seen.items()])

    counted = marked.mapInArrow(count, "_file string, _block bigint, line string, n bigint")
    blocks = counted.filter("line IS NULL").select("_file", "_block", "n")
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("_file", "_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    bad = counted.filter("line IS NOT NULL").join(before, ["_file", "_block"])
    return bad.select("line", "_file", (F.col("before") + F.col("n")).alias("number"))


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_file", "_block", "line", "n"])


def parse_json_lines(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines held as text (value, _file) and, apart from them, the unreadable ones (line, _file)."""
    parsed = _parsed(lines.filter(~is_blank(F.col("value"))), schema)
    bad = parsed.filter("bad").select(F.col("value").alias("line"), "_file")
    return parsed.filter("not bad").select("row.*").drop(CORRUPT), bad


def read_outcomes(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Training and calibration outcomes, normalised."""
    rows, _ = read_json_lines(spark, path, OUTCOME_RAW, strict=strict)
    return normalize_outcomes(rows, strict=strict)


def read_heldout(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Held-out outcomes, normalised. They carry no split, so they cannot be trained on."""
    rows, _ = read_json_lines(spark, path, HELDOUT_RAW, strict=strict)
    return normalize_heldout(rows, strict=strict)


def read_model_cards(spark: SparkSession, path: str) -> DataFrame:
    """Model cards from a JSON list or from an object with a `models` list."""
    wanted = T.StructType(list(CARD) + [T.StructField("models", T.ArrayType(CARD))])
    raw = spark.read.schema(wanted).option("multiLine", True).option("mode", "FAILFAST").json(path)
    own = F.array(F.struct(*[F.col(field.name) for field in CARD]))
    return normalize_cards(raw.select(F.inline(F.coalesce("models", own))))


def normalize_cards(cards: DataFrame) -> DataFrame:
    """Cards with the optional fields filled in and duplicate capabilities removed."""
    have = set(cards.columns)

    def column(name, default):
        value = F.col(name) if name in have else F.lit(None)
        return F.coalesce(value, default) if default is not None else value

    return cards.select(
        F.col("name").cast("string").alias("name"),
        column("provider", F.lit("")).cast("string").alias("provider"),
        column("expected_cost_usd", None).cast("double").alias("expected_cost_usd"),
        column("input_cost_per_million_usd", None).cast("double").alias("input_cost_per_million_usd"),
        column("output_cost_per_million_usd", None).cast("double").alias("output_cost_per_million_usd"),
        column("context_tokens", None).cast("bigint").alias("context_tokens"),
        F.array_sort(F.array_distinct(column("capabilities", F.array().cast("array<string>")))).alias("capabilities"),
        column("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def explode_messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, messages array) to one row per turn."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.posexplode("messages").alias("turn", "m")
    ).select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.col("m.role").alias("role"),
        F.col("m.content").alias("content"),
        F.col("m.tool_calls").alias("tool_calls"),
    )


def turns_from_columns(df: DataFrame, *, content: str = "text") -> DataFrame:
    """A turn table (conv_id, turn, role, text) in the turn schema."""
    calls = F.col("tool_calls") if "tool_calls" in df.columns else F.lit(None).cast(
        "array<struct<name:string,arguments:string>>"
    )
    return df.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        "role",
        F.col(content).alias("content"),
        calls.alias("tool_calls"),
    )


def read_conversations(spark: SparkSession, path: str, *, format: str = "json") -> DataFrame:
    """Turn table from JSON conversations or from a Parquet turn table.

    `json`: one object or list per file, on any number of lines; `jsonl`: one per line; `parquet`: turns. JSON
    objects hold `messages` (and `conv_id`, else the file name is used; lines need it). A message without a role
    has a null role. Content that is not a string keeps its JSON text; so does a null content, as `null`.
    """
    if format == "parquet":
        return turns_from_columns(spark.read.parquet(path))
    if format not in ("json", "jsonl"):
        raise ValueError("format must be json, jsonl or parquet")
    lines = spark.read.text(path, wholetext=format == "json").select("value", F.col("_metadata.file_name").alias("file"))
    return conversation_turns(lines.filter(~is_blank(F.col("value"))), lines_need_id=format == "jsonl")


def conversation_turns(lines: DataFrame, *, lines_need_id: bool = False) -> DataFrame:
    """Turns of JSON conversations held as text (`value`), with a fallback id (`file`)."""
    lines = lines.select(F.from_json("value", "variant").alias("v"), F.lit(None).cast("string").alias("file") if lines_need_id else F.col("file"))
    listed = lines.select(
        F.coalesce(F.try_variant_get("v", "$.conv_id", "string"), "file").alias("conv_id"),
        F.coalesce(
            F.try_variant_get("v", "$.messages", "array<variant>"), F.try_variant_get("v", "$", "array<variant>")
        ).alias("messages"),
    )
    if not listed.filter(F.coalesce(F.size("messages"), F.lit(0)) <= 0).isEmpty():
        raise ValueError("a conversation holds no list of messages")
    if lines_need_id and not listed.filter(F.col("conv_id").isNull()).isEmpty():
        raise ValueError("a conversation line needs a conv_id")
    message = F.col("m")
    content = F.try_variant_get(message, "$.content", "variant")
    is_text = F.schema_of_variant(content) == "STRING"
    calls = F.try_variant_get(message, "$.tool_calls", "array<variant>")
    return listed.select("conv_id", F.posexplode("messages").alias("turn", "m")).select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.try_variant_get(message, "$.role", "string").alias("role"),
        F.when(content.isNull(), F.lit(""))
        .when(is_text, F.try_variant_get(message, "$.content", "string"))
        .otherwise(F.to_json(content))
        .alias("content"),
        F.transform(
            calls,
            lambda call: F.when(
                F.startswith(F.coalesce(F.schema_of_variant(call), F.lit("")), F.lit("OBJECT")),
                F.struct(
                    F.coalesce(F.try_variant_get(call, "$.function.name", "string"), F.lit("")).alias("name"),
                    F.coalesce(F.try_variant_get(call, "$.function.arguments", "string"), F.lit("")).alias(
                        "arguments"
                    ),
                ),
            ),
        ).alias("tool_calls"),
    )
