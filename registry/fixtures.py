"""Tables derived from the given data, so that every operator can be checked on it.

Outcomes lay every document out against a pool of four cards, with labels and costs from
integer arithmetic that Spark and SQL compute alike. Texts are whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.operators.calibrate import STEP, Calibrator
from waypost.operators.costs import mean_costs
from waypost.operators.heads import INDEPENDENT, SHARED, SIGNED, Head
from waypost.operators.policy import LAMBDAS
from waypost.operators.sizing import spread
from waypost.plans.model import RouterModel
from waypost.schema import CARD

DIMENSION = 256
SEED = "fx"

# m, name, provider, expected, price in, price out, context, unit, base, capabilities
POOL = (
    (0, "small/alpha", "local", 0.002, 0.05, 0.15, 32768, 1, 45, ("text", "json")),
    (1, "mid/beta", "cloud_a", None, 0.5, 2.0, 131072, 8, 65, ("text", "json", "tools")),
    (2, "large/gamma", "cloud_b", 0.05, 2.0, 8.0, 131072, 40, 85, ("text", "json", "tools")),
    (3, "flat/delta", "local", 0.01, None, None, 2000, 3, 55, ("text",)),
)
ORDERED = sorted(POOL, key=lambda card: card[1])
MODELS = [card[1] for card in ORDERED]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def cards(spark: SparkSession) -> DataFrame:
    rows = [(n, p, e, i, o, c, list(caps), {}) for _, n, p, e, i, o, c, _, _, caps in POOL]
    return spark.createDataFrame(rows, CARD)


def pool(spark: SparkSession) -> DataFrame:
    rows = [(m, n, unit, base) for m, n, _, _, _, _, _, unit, base, _ in POOL]
    return F.broadcast(spark.createDataFrame(rows, "m int, model string, unit int, base int"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents × pool with every column any outcome table needs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    d, m = F.col("doc_id"), F.col("m")
    bar = (
        F.col("base")
        - F.when(F.col("lang") != "en", 15).otherwise(0)
        - F.when(F.col("n_chars") > 2000, 10 * (3 - m)).otherwise(0)
    )
    return docs.crossJoin(pool(spark)).select(
        "doc_id",
        "m",
        "n_chars",
        d.cast("string").alias("request_id"),
        "text",
        "model",
        ((d * 31 + m * 17) % 100 < bar).alias("acceptable"),
        F.when(d % 10 < 6, "train").when(d % 10 < 8, "calibration").otherwise("test").alias("split"),
        F.when((d + m) % 7 == 0, F.lit(None)).otherwise(F.col("n_chars") * F.col("unit") / 1e7).alias("cost_usd"),
        F.col("lang").alias("group"),
        (((d * 53 + m * 29 + F.col("n_chars")) % 50) / 50.0).alias("score"),
        F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("bigint").alias("input_tokens"),
        (50 + d % 200).alias("output_tokens"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).filter("split <> 'test'").select(
        "request_id", "text", "model", "acceptable", "split", "cost_usd", "group"
    )


def heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).filter("split = 'test'").select(
        "request_id", "text", "model", "acceptable", "cost_usd", "group", "input_tokens", "output_tokens"
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a routing request with its own options."""
    return request_columns(table(spark, sf_dir, "documents"))


def request_columns(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    docs = documents.select("doc_id", "text", "n_chars")
    none = F.lit(None)
    return docs.select(
        d.cast("string").alias("request_id"),
        "text",
        F.when(d % 3 == 0, "quality").when(d % 3 == 1, "balanced").otherwise("cost").alias("mode"),
        F.when(d % 5 == 0, F.array(F.lit("tools"))).otherwise(none).alias("required"),
        F.when(d % 7 == 0, F.array(F.lit("cloud_b"))).otherwise(none).alias("denied"),
        F.when(d % 13 == 0, F.array(F.lit("small/alpha"), F.lit("mid/beta"))).otherwise(none).alias("allowed"),
        F.when(d % 11 == 0, F.lit(0.0005)).otherwise(none).alias("max_cost"),
        F.when(d % 4 == 1, F.lit(0.2)).when(d % 4 == 2, F.lit(0.3)).otherwise(none).alias("weight"),
        (d % 2 == 0).alias("override"),
        F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("bigint").alias("input_tokens"),
        (50 + d % 200).alias("output_tokens"),
    )


ROUTE_OPTIONS = {
    "mode": "mode",
    "allowed_models": "allowed",
    "required_capabilities": "required",
    "denied_providers": "denied",
    "max_cost_usd": "max_cost",
    "cost_weight": "weight",
    "allow_ungated_policy": "override",
    "input_tokens": "input_tokens",
    "output_tokens": "output_tokens",
}


def formula_head(shared: bool = False) -> Head:
    idx = np.arange(DIMENSION)
    ms = np.array([card[0] for card in ORDERED])
    weights = ((idx[:, None] * 37 + ms[None, :] * 101) % 201 - 100) / 50.0
    biases = (ms - 1) * 0.3
    if shared:
        weights = weights + ((idx * 13) % 101 - 50)[:, None] / 50.0
        biases = biases + 0.2
    return Head(SHARED if shared else INDEPENDENT, SIGNED, DIMENSION, SEED, list(MODELS), biases, weights)


# Off the round values: a text whose features cancel has a margin of exactly the bias, and
# a threshold of 0.5 would then turn on the last bit of a sum in either engine.
THRESHOLDS = [0.0, 0.26, 0.51, 0.76]


def formula_calibrators(kind: str = STEP) -> list[Calibrator]:
    return [
        Calibrator(kind, list(THRESHOLDS), [round(base + 0.05 * m, 2) for base in (0.10, 0.30, 0.50, 0.70)])
        for m in (card[0] for card in ORDERED)
    ]


def formula_router(spark: SparkSession, sf_dir: str) -> RouterModel:
    """A router with formula weights, whose learned costs come from the outcomes."""
    learned = {r["model"]: r["mean_cost_usd"] for r in mean_costs(outcomes(spark, sf_dir), cards(spark)).collect()}
    grid = [
        {"method": INDEPENDENT, "lambda": weight, "passes_noninferiority": weight != 0.8, "success_rate": 0.0,
         "mean_expected_cost_usd": 0.0, "difference_vs_best_fixed": 0.0, "one_sided_95_lower_difference": 0.0}
        for weight in LAMBDAS
    ]
    plain = [
        {"name": n, "provider": p, "expected_cost_usd": e, "input_cost_per_million_usd": i,
         "output_cost_per_million_usd": o, "context_tokens": c, "capabilities": sorted(caps), "metadata": {}}
        for _, n, p, e, i, o, c, _, _, caps in ORDERED
    ]
    return RouterModel(
        cards=plain,
        heads={INDEPENDENT: formula_head()},
        calibrators={INDEPENDENT: formula_calibrators()},
        mean_costs=[learned[m] for m in MODELS],
        grid=grid,
        default_method=INDEPENDENT,
        default_lambda=0.1,
        gate_passed=True,
        best_fixed="mid/beta",
    )


def dirty(spark: SparkSession, sf_dir: str, *, heldout_rows: bool = False) -> DataFrame:
    """The matrix with one kind of defect in each of several residue classes of doc_id."""
    base = matrix(spark, sf_dir)
    d, m = F.col("doc_id"), F.col("m")
    r = d % 23
    twice = F.when((r == 1) & (m == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    marked = base.filter(~((r == 2) & (m == 3))).withColumn("copy", F.explode(twice))
    fixed = marked.select(
        F.when((r == 11) & (m == 2), "").otherwise(F.col("request_id")).alias("request_id"),
        F.when(r == 9, " \n ").when((r == 3) & (m == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"),
        F.when((r == 5) & (m == 1), "ghost/zeta").otherwise(F.col("model")).alias("model"),
        "acceptable",
        F.when(r == 6, -1.0).when((r == 7) & (m == 1), F.lit(float("nan"))).otherwise(F.col("cost_usd")).alias("cost_usd"),
        F.when((r == 4) & (m == 1), "xx").when(r == 12, "").otherwise(F.col("group")).alias("group"),
        F.when(r == 10, "dev").otherwise(F.col("split")).alias("split"),
        F.when((r == 13) & (m == 1), -5).otherwise(F.col("input_tokens")).alias("input_tokens"),
        F.when((r == 8) & (m == 2), F.lit(None)).otherwise(F.col("output_tokens")).alias("output_tokens"),
    )
    return fixed.drop("split") if heldout_rows else fixed.drop("input_tokens", "output_tokens")


def agent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with tool results, tool calls and private blocks worked in."""
    turns = table(spark, sf_dir, "conversations")
    c, t = F.col("conv_id"), F.col("turn")
    is_tool = (F.col("role") == "user") & (t % 4 == 2)
    content = (
        F.when(is_tool, F.concat(F.lit("<returncode>"), ((c + t) % 3).cast("string"), F.lit("</returncode>"), F.col("text")))
        .when((F.col("role") == "assistant") & (c % 5 == 0), F.concat(F.lit("<think>hidden</think>"), F.col("text")))
        .otherwise(F.col("text"))
    )
    call = F.struct(
        F.lit("bash").alias("name"), F.concat(F.lit('{"command":"run '), t.cast("string"), F.lit('"}')).alias("arguments")
    )
    calls = F.when((F.col("role") == "assistant") & ((c + t) % 3 == 0), F.array(call)).otherwise(
        F.array().cast("array<struct<name:string,arguments:string>>")
    )
    return turns.select(
        c.cast("string").alias("conv_id"),
        "turn",
        F.when(is_tool, "tool").otherwise(F.col("role")).alias("role"),
        content.alias("content"),
        calls.alias("tool_calls"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat payload per conversation with all its turns, after a system message and before a list of parts."""
    turns = table(spark, sf_dir, "conversations")
    # A payload is one row by nature: as long as its conversation.
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    c = F.col("conv_id")
    own = F.to_json(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))))
    parts = '[{"type":"text","text":" "},{"type":"image_url","image_url":"x"},{"type":"input_text","text":"Thanks."}]'
    message = F.concat(
        F.lit('{"role":"system","content":'),
        F.when(c % 4 == 3, "null").otherwise('"Be brief."'),
        F.lit("},"),
        F.expr("substring(own, 2, length(own) - 2)"),
        F.when(c % 3 == 1, F.lit(f',{{"role":"user","content":{parts}}}')).otherwise(""),
    )
    model = (
        F.when(c % 6 == 0, ',"model":"large/gamma"').when(c % 6 == 1, ',"model":"auto"').when(c % 6 == 2, ',"model":null').otherwise("")
    )
    limits = F.when(c % 2 == 0, ',"max_tokens":256').when(c % 7 == 1, ',"max_completion_tokens":512').otherwise("")
    options = F.when(c % 4 == 0, ',"router":{"mode":"quality"}').when(c % 4 == 1, ',"router":{"mode":"cost","max_quality_drop":0.2,"input_tokens":300}').otherwise("")
    text = F.concat(F.lit('{"messages":['), message, F.lit("]"), model, limits, options, F.lit("}"))
    return listed.withColumn("own", own).select(c.cast("string").alias("conv_id"), text.alias("payload"))
