"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups that a hot-group broadcast may hold: a group in it has at least total / HOT_GROUPS rows.
HOT_GROUPS = 1000
#: Rows of texts that travel to Python at once.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_batches(df: DataFrame) -> DataFrame:
    """Texts on their way to Python: at most BATCH_ROWS rows at a time, whose bytes bound a task's memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session without one gets none made up on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        from waypost.session import ensure_checkpoint_dir

        folder = ensure_checkpoint_dir(spark)
    return folder.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Later steps read the same rows whatever is recomputed, and a lost executor costs no more than a reread.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/waypost-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(id_text: Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo a number; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_text.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join of rows with the one row of their group, even where a group holds a third of all rows.

    Groups of at least total / HOT_GROUPS rows, HOT_GROUPS of them at most, are broadcast. Their rows, and rows
    without a key, go to the other join under a key of their own and so spread evenly.
    """
    limit = max(1, total // HOT_GROUPS)
    values = [c for c in groups.columns if c != key]
    hot = F.broadcast(groups.where(F.col(size) >= max(limit, 2)).select(F.col(key), F.struct(*values).alias("_hot")))
    cold = groups.where(F.col(size) < max(limit, 2)).select(F.col(key).cast("string").alias("_spread_key"), F.struct(*values).alias("_cold"))
    marked = rows.join(hot, key, "left")
    lone = F.concat(F.lit("~"), spread.cast("string"))
    marked = marked.withColumn("_spread_key", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(lone))
    joined = marked.join(cold, "_spread_key", "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in values])
