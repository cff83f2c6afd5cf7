"""A tree of digests over a table's rows, and the rows in which two tables differ.

A row's place is the beginning of its digest, so leaves are of even size whatever the keys are; equal rows are counted
first and make one entry. A leaf is the digest of its entries in order, a node that of its at most 256 children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions.digest import row_digest

#: Hex digits that a level adds to a node's prefix, and the levels below the root.
DIGITS, LEVELS = 2, 2


def digest_entries(df: DataFrame, *names: str) -> DataFrame:
    """(digest, n): the distinct digests of the rows and how many rows have each."""
    return df.select(row_digest(*(names or df.columns)).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))


def _joined(parts: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(parts)), ","), 256)


def digest_tree(entries: DataFrame, *, levels: int = LEVELS) -> DataFrame:
    """(prefix, n_rows, digest) of every node, leaves to root; the root has the empty prefix, also for an empty table.

    A leaf has 1 / 256**levels of the distinct rows: take another level for every 256 times as many rows.
    """
    if levels < 1:
        raise ValueError("a tree has at least one level below its root")
    prefix = F.substring("digest", 1, DIGITS * levels)
    line = F.concat("digest", F.lit(":"), F.col("n").cast("string"))
    nodes = entries.groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("n_rows"), _joined(line).alias("digest"))
    found = nodes
    for level in range(levels - 1, -1, -1):
        line = F.concat("prefix", F.lit(":"), "digest")
        sums = [F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), _joined(line).alias("digest")]
        if level:
            nodes = nodes.groupBy(F.substring("prefix", 1, DIGITS * level).alias("prefix")).agg(*sums)
        else:
            nodes = nodes.agg(*sums).select(F.lit("").alias("prefix"), "n_rows", "digest")
        found = found.unionByName(nodes)
    return found


def changed_leaves(left: DataFrame, right: DataFrame, *, levels: int = LEVELS) -> DataFrame:
    """The prefixes of leaves that differ, found from the root down: a level's nodes are only read below differing ones."""
    below = None
    for level in range(levels + 1):
        size = F.length("prefix") == DIGITS * level
        a, b = (tree.where(size).select("prefix", F.col("digest").alias(name)) for tree, name in ((left, "a"), (right, "b")))
        if below is not None:
            up = F.substring("prefix", 1, DIGITS * (level - 1))
            a, b = (side.withColumn("up", up).join(below, "up", "left_semi").drop("up") for side in (a, b))
        differ = a.join(b, "prefix", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix")
        below = differ.select(F.col("prefix").alias("up"))
    return differ


def digest_diff(left: DataFrame, right: DataFrame, *names: str, levels: int = LEVELS) -> DataFrame:
    """Rows of two tables that differ in the named columns: those columns, n_left and n_right (how many each has).

    Trees are compared from the root down, and only rows of differing leaves are compared themselves.
    """
    columns = names or tuple(left.columns)
    sides = [(left, "n_left"), (right, "n_right")]
    counted = [df.select(*columns, row_digest(*columns).alias("digest")).groupBy("digest", *columns).agg(F.count("*").alias("n")) for df, _ in sides]
    trees = [digest_tree(rows.select("digest", "n"), levels=levels) for rows in counted]
    leaves = changed_leaves(*trees, levels=levels).withColumnRenamed("prefix", "leaf")
    leaf = F.substring("digest", 1, DIGITS * levels)
    found = [
        rows.withColumn("leaf", leaf).join(leaves, "leaf", "left_semi").select("digest", F.struct(*columns).alias(f"row_{name}"), F.col("n").alias(name))
        for rows, (_, name) in zip(counted, sides)
    ]
    both = found[0].join(found[1], "digest", "full").where(~F.col("n_left").eqNullSafe(F.col("n_right")))
    row = F.coalesce("row_n_left", "row_n_right")
    zero = F.lit(0).cast("bigint")
    return both.select(*[row[c].alias(c) for c in columns], F.coalesce("n_left", zero).alias("n_left"), F.coalesce("n_right", zero).alias("n_right"))
