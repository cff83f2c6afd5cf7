"""Registered queries of this subpackage: each operator over the whole `documents` table, with its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.llm import hidden_markov, langid, toxicity
from waypost.llm import sql as S
from waypost.llm.bpe_files import tokenizer_path
from waypost.llm.byte_bpe import encode_decode
from waypost.llm.common import bucket_of, documents
from waypost.llm.exact_dedup import exact_dedup
from waypost.llm.near_dedup import near_duplicates
from waypost.llm.packing import packed_digest
from waypost.llm.periods import run_digest
from waypost.llm.prefix_trie import prefix_trie
from waypost.llm.quality import judge
from waypost.llm.sharding import shard_documents
from waypost.llm.token_counts import LIMIT, count_tokens
from waypost.llm.warc import round_trip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHARDS = 24


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_packing")
def op1(spark, sf):
    return packed_digest(documents(spark, sf), tokenizer_path("byte_bpe_50k.json"))


@query("op2_toxicity")
def op2(spark, sf):
    docs = documents(spark, sf)
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op3_sharding", S.SHARDING)
def op3(spark, sf):
    return shard_documents(documents(spark, sf), [1.0] * SHARDS)


@query("op4_language_id")
def op4(spark, sf):
    docs = documents(spark, sf)
    held_out = bucket_of(F.col("doc_id"), 3) == 1
    found = langid.predict(docs, langid.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@query("op5_exact_dedup", S.EXACT_DEDUP)
def op5(spark, sf):
    digest = F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")
    found = exact_dedup(documents(spark, sf), carry=[digest])
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op6_hidden_markov")
def op6(spark, sf):
    docs = documents(spark, sf)
    held_out = bucket_of(F.col("doc_id"), 5) == 1
    counts, model = hidden_markov.train(docs, ~held_out)
    scored = hidden_markov.score(docs, counts, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op7_quality_rules", S.QUALITY)
def op7(spark, sf):
    return judge(documents(spark, sf)).drop("class_distance", "word_distance")


@query("op8_byte_bpe")
def op8(spark, sf):
    coded = encode_decode(documents(spark, sf), tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return coded.select(
        "doc_id", "n_tokens",
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_near_dedup", S.NEAR_DEDUP)
def op9(spark, sf):
    return near_duplicates(documents(spark, sf), words=4).drop("_key")


@query("op10_token_counts")
def op10(spark, sf):
    docs = documents(spark, sf).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    counted = count_tokens(docs, tokenizer_path("word_bpe_49k.json"), carry=["n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


@query("op11_prefix_trie", S.PREFIX_TRIE)
def op11(spark, sf):
    return prefix_trie(spark.read.parquet(f"{sf}/conversations.parquet"))


@query("op12_periodic_runs")
def op12(spark, sf):
    return run_digest(documents(spark, sf))


@query("op13_warc", S.WARC)
def op13(spark, sf):
    return round_trip(spark.read.parquet(f"{sf}/pages.parquet"))
