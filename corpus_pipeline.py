"""A corpus pipeline: language, toxicity, exact copies, near copies, packing; each stage by its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.llm import exact_dedup, langid, near_dedup, toxicity
from waypost.llm.bpe_files import tokenizer_path
from waypost.llm.common import documents, settled
from waypost.llm.packing import packed_digest


def whole_rows(docs: DataFrame) -> DataFrame:
    """The columns that an operator reads, with the whole row beside them under one name."""
    return docs.select("doc_id", "text", F.struct("*").alias("_row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that some language's model accepts; those without a letter go."""
    found = langid.predict(whole_rows(docs), langid.train(docs), carry=["_row"])
    return found.where(~F.col("rejected")).select("_row.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents below the toxicity threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(whole_rows(docs), model, carry=["_row"])
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("_row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: five-word shingles, similarity 0.8."""
    return near_dedup.keep_one(docs, words=SHINGLE_WORDS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packed_digest(docs, tokenizer_path("byte_bpe_50k.json"))


#: Words of a shingle where no query's contract says otherwise.
SHINGLE_WORDS = 5

STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("packing", packing),
]

#: The learned stages are not expressible in SQL; tests/llm compares the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each one's rows are written and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
