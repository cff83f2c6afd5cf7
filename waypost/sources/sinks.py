"""Sinks: canonical JSON lines and writes guarded by a secret scan."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypost.functions.digest import row_json
from waypost.operators.secrets import may_hold_secret


def _sorted_fields(value: Column, kind: T.DataType) -> Column:
    """Struct fields in name order at every depth, as canonical JSON wants them."""
    if isinstance(kind, T.StructType):
        fields = [_sorted_fields(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _sorted_fields(item, kind.elementType))
    return value


def canonical_json(df: DataFrame, out: str = "value") -> DataFrame:
    """One canonical JSON text per row: sorted keys, compact, nulls kept."""
    ordered = df.select(*[_sorted_fields(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])
    return ordered.select(row_json(*df.columns).alias(out))


def write_jsonl(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Write canonical JSON lines."""
    canonical_json(df).write.mode(mode).text(path)


def write_checked(df: DataFrame, path: str, *, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a table unless any value may hold a credential.

    The table is evaluated once: what is scanned is what is written. It goes to a folder beside the path, which takes
    the path's place (or adds its files to it, with `append`) only if nothing was found, and is removed otherwise.
    """
    if mode not in ("errorifexists", "overwrite", "append", "ignore"):
        raise ValueError("mode must be errorifexists, overwrite, append or ignore")
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    exists = files.exists(target)
    if exists and mode == "ignore":
        return
    if exists and mode == "errorifexists":
        raise ValueError(f"{path} exists already")
    staging = hadoop.Path(target.getParent(), f"._{target.getName()}-{uuid.uuid4().hex}")
    seen = Observation()
    scanned = df.observe(seen, F.count_if(may_hold_secret(df)).alias("found"), F.count(F.lit(1)).alias("rows"))
    try:
        if format == "jsonl":
            write_jsonl(scanned, staging.toString())
        else:
            scanned.write.format(format).save(staging.toString())
        if seen.get["found"]:
            raise ValueError("refusing to write output that may contain a credential")
        if exists and mode == "append":
            for status in files.listStatus(staging):
                name = status.getPath().getName()
                if not name.startswith(("_", ".")) and not files.rename(status.getPath(), hadoop.Path(target, name)):
                    raise OSError(f"{name} could not be moved to {path}")
        else:
            if exists:
                files.delete(target, True)
            if not files.rename(staging, target):
                raise OSError(f"the staging folder could not be moved to {path}")
    finally:
        files.delete(staging, True)
