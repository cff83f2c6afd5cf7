"""Paired bootstrap of quality difference and cost saving.

Input: one row per request and routed policy: quality_diff, routed_cost, fixed_cost.
`multinomial`, the default, merges requests with equal pairs of outcomes and draws how often a sample
takes each group, from a tree of conditional binomials: its cost is groups × samples.
`exact` draws request numbers from a keyed hash: n × samples draws, each joined with its request.
`poisson` gives each request a Poisson(1) count per sample in one pass over the rows and
shuffles only one sum vector per task and policy.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.session import ensure_checkpoint_dir

MULTINOMIAL = "multinomial"
EXACT = "exact"
POISSON = "poisson"
#: Costs are compared in millionths of a dollar: requests that differ by less are one group, with its mean cost.
COST_UNIT = 1e-6
#: Blocks of groups at least, and groups that a block holds on average at most; a block is one row of work.
BLOCKS, BLOCK_GROUPS = 64, 4096
#: Digits of a hash that make a uniform number.
HASH_DIGITS = 13
#: Requests that exact draws broadcast at most, and draws of each policy that one task makes.
EXACT_REQUESTS, DRAWS_PER_TASK = 100_000, 1_000_000

# The bounds of a 95 % interval and the default number of samples.
LOW, HIGH = 0.025, 0.975
SAMPLES = 5000


def _numbered(paired: DataFrame) -> DataFrame:
    """Pairs with `n_`, their number in the order of request_id within their policy, from 0: sorted in ranges, not in one task."""
    spark, order = paired.sparkSession, ["policy_index", "request_id"]
    ensure_checkpoint_dir(spark)
    rows = paired.select("policy", *order, "quality_diff", "routed_cost", "fixed_cost")
    held = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    held = held.withColumn("part_", F.spark_partition_id()).withColumn("place_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    bases, total, first = [], {}, {}
    # A number per range and policy: what to add to a row's place in its range.
    for row in held.groupBy("part_", "policy_index").count().orderBy("part_", "policy_index").collect():
        index, before = row["policy_index"], first.get(row["part_"], 0)
        bases.append((row["part_"], index, total.get(index, 0) - before))
        total[index], first[row["part_"]] = total.get(index, 0) + row["count"], before + row["count"]
    table = spark.createDataFrame(bases, "part_ int, policy_index int, base_ bigint")
    joined = held.join(F.broadcast(table), ["part_", "policy_index"])
    return joined.select("policy", "policy_index", (F.col("place_") + F.col("base_")).alias("n_"), "quality_diff", "routed_cost", "fixed_cost")


def exact_samples(paired: DataFrame, *, samples: int, seed: int, requests: int) -> DataFrame:
    """(policy, sample, quality, saving) by drawing with replacement.

    Requests are numbered in order, and every draw finds its request by number: up to EXACT_REQUESTS of them are
    broadcast, more are joined by a shuffle of the draws, samples × requests for each policy.
    """
    spark = paired.sparkSession
    # A policy's seed is the base seed plus its position among the routed policies.
    policies = paired.select("policy_index").distinct()
    numbered = _numbered(paired)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(samples * requests / DRAWS_PER_TASK))
    draws = (
        spark.range(0, samples * requests, 1, tasks)
        .select(F.floor(F.col("id") / requests).alias("sample"), (F.col("id") % requests).alias("draw"))
        .crossJoin(F.broadcast(policies))
    )
    key = F.concat_ws(":", (F.col("policy_index") + seed).cast("string"), F.col("sample").cast("string"), F.col("draw").cast("string"))
    hashed = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % requests
    known = F.broadcast(numbered) if requests <= EXACT_REQUESTS else numbered.hint("shuffle_hash")
    drawn = draws.select("policy_index", "sample", hashed.alias("n_")).join(known, ["policy_index", "n_"])
    return drawn.groupBy("policy", "sample").agg(
        F.avg("quality_diff").alias("quality"),
        F.sum("routed_cost").alias("routed"),
        F.sum("fixed_cost").alias("fixed"),
    ).select("policy", "sample", "quality", _saving().alias("saving"))


def _saving():
    return F.when(F.col("fixed") > 0, (F.col("fixed") - F.col("routed")) / F.col("fixed"))


def _poisson_table() -> np.ndarray:
    """Upper edges of the Poisson(1) distribution as unsigned 64-bit numbers."""
    masses = np.array([math.exp(-1) / math.factorial(k) for k in range(20)])
    return (np.cumsum(masses) * 2.0**53).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer of 64-bit keys (the public SplitMix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_samples(paired: DataFrame, *, samples: int, seed: int) -> DataFrame:
    """(policy, sample, quality, saving) by Poisson counts keyed on request and sample.

    A count depends on the request, the sample and the seed alone, so a retried task or
    another partitioning gives the same result.
    """
    edges = _poisson_table()
    rows_at_once = max(1, 2_000_000 // samples)

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        sample_key = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            policy = batch.column("policy_index").to_numpy(zero_copy_only=False)
            values = np.stack(
                [np.ones(len(keys))]
                + [batch.column(c).to_numpy(zero_copy_only=False) for c in ("quality_diff", "routed_cost", "fixed_cost")]
            )
            for index in np.unique(policy):
                chosen = np.flatnonzero(policy == index)
                total = totals.setdefault(int(index), np.zeros((4, samples)))
                offset = np.uint64((seed + int(index)) % (1 << 63))
                for start in range(0, len(chosen), rows_at_once):
                    part = chosen[start : start + rows_at_once]
                    mixed = _mix(_mix(keys[part] + offset)[:, None] + sample_key[None, :]) >> np.uint64(11)
                    counts = np.searchsorted(edges, mixed.ravel(), side="right").reshape(mixed.shape)
                    total += values[:, part] @ counts
        for index, total in totals.items():
            yield pa.record_batch(
                {
                    "policy_index": pa.array(np.full(samples, index, dtype=np.int32)),
                    "sample": pa.array(np.arange(samples, dtype=np.int32)),
                    "n": pa.array(total[0]),
                    "quality": pa.array(total[1]),
                    "routed": pa.array(total[2]),
                    "fixed": pa.array(total[3]),
                }
            )

    keyed = paired.select(
        "policy_index", F.xxhash64("request_id").alias("key"), "quality_diff", "routed_cost", "fixed_cost"
    )
    partials = keyed.mapInArrow(run, "policy_index int, sample int, n double, quality double, routed double, fixed double")
    summed = partials.groupBy("policy_index", "sample").agg(
        F.sum("n").alias("n"), F.sum("quality").alias("quality"), F.sum("routed").alias("routed"), F.sum("fixed").alias("fixed")
    )
    names = paired.select("policy", "policy_index").distinct()
    return (
        summed.filter(F.col("n") > 0)
        .join(F.broadcast(names), "policy_index")
        .select("policy", "sample", (F.col("quality") / F.col("n")).alias("quality"), _saving().alias("saving"))
    )


def tied_groups(paired: DataFrame, *, cost_unit: float = COST_UNIT) -> DataFrame:
    """(policy, policy_index, key, requests, quality, routed, fixed) of requests that are alike: sums over each group."""

    def units(name: str) -> Column:
        return F.round(F.col(name) / cost_unit).cast("bigint").cast("string")

    key = F.concat_ws(":", F.round(F.col("quality_diff") * 1e6).cast("bigint").cast("string"), units("routed_cost"), units("fixed_cost"))
    return paired.groupBy("policy", "policy_index", key.alias("key")).agg(
        F.count("*").alias("requests"), F.sum("quality_diff").alias("quality"), F.sum("routed_cost").alias("routed"), F.sum("fixed_cost").alias("fixed")
    )


def _log_factorials() -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 256)))))


def log_factorial(n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Logarithms of factorials: a table of the first, Stirling's series beyond."""
    x = np.maximum(n, 1).astype(float)
    series = x * np.log(x) - x + 0.5 * np.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1)], series)


def binomial(n: np.ndarray, p: float, u: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Exact binomial draws from uniform numbers.

    Outcomes are taken in the order mode, mode + 1, mode - 1, mode + 2, ..., so a draw takes about as many steps as
    its distance from the mode. The first outcome at which the sum of probabilities is above u is drawn.
    """
    if p <= 0:
        return np.zeros(len(n), np.int64)
    if p >= 1:
        return n.copy()
    mode = np.floor((n + 1) * p).astype(np.int64)
    odds = p / (1 - p)
    mass = np.exp(
        log_factorial(n, table) - log_factorial(mode, table) - log_factorial(n - mode, table) + mode * math.log(p) + (n - mode) * math.log1p(-p)
    )
    result, total = mode.copy(), mass.copy()
    left = np.flatnonzero(u >= total)
    up, down, high, low = mass[left], mass[left], mode[left], mode[left]
    n, u, total = n[left], u[left], total[left]
    while len(left):
        up = up * ((n - high) / (high + 1.0)) * odds
        high = high + 1
        total = total + up
        hit_high = (u < total) & (high <= n)
        down = down * (low / (n - low + 1.0)) / odds
        low = low - 1
        after = total + down
        # Where rounding leaves the sum of all probabilities below u, the mode stays drawn.
        hit_low = ~hit_high & (u < after) & (low >= 0)
        result[left[hit_high]], result[left[hit_low]] = high[hit_high], low[hit_low]
        go = ~(hit_high | hit_low) & ((high < n) | (low > 0))
        left, up, down, high, low, n, u, total = left[go], up[go], down[go], high[go], low[go], n[go], u[go], after[go]
    return result


def uniforms(seed: int, node: str, samples: int) -> np.ndarray:
    """A number from 0 to 1 for each sample, from the MD5 of seed, node and sample."""
    import hashlib

    start = hashlib.md5(f"{seed}:{node}:".encode())
    found = np.empty(samples)
    for s in range(samples):
        digest = start.copy()
        digest.update(b"%d" % s)
        found[s] = int(digest.hexdigest()[:HASH_DIGITS], 16)
    return (found + 0.5) / 16.0**HASH_DIGITS


class _Tree:
    """How often each leaf of a tree of weights is drawn in every sample, for n draws in all.

    The node of leaves lo to hi - 1 deals its draws to its halves; the name of a node is part of its random numbers.
    """

    def __init__(self, seed: int, name: str, weights: list[int], samples: int):
        self.seed, self.name, self.samples = seed, name, samples
        self.sums = np.concatenate(([0], np.cumsum(np.array(weights, dtype=object)))) if weights else np.zeros(1, object)
        self.table = _log_factorials()

    def split(self, lo: int, hi: int, n: np.ndarray) -> tuple[int, np.ndarray]:
        """The middle of a node, and the draws of its left half."""
        middle = (lo + hi) // 2
        whole, part = int(self.sums[hi] - self.sums[lo]), int(self.sums[middle] - self.sums[lo])
        if part == 0 or part == whole or not n.any():
            return middle, np.zeros(self.samples, np.int64) if part == 0 else n.copy()
        return middle, binomial(n, part / whole, uniforms(self.seed, f"{self.name}:{lo}:{hi}", self.samples), self.table)

    def leaf(self, index: int, n: np.ndarray) -> np.ndarray:
        """The draws of one leaf: a way from the root."""
        lo, hi = 0, len(self.sums) - 1
        while hi - lo > 1:
            middle, first = self.split(lo, hi, n)
            lo, hi, n = (lo, middle, first) if index < middle else (middle, hi, n - first)
        return n

    def leaves(self, n: np.ndarray):
        """(leaf, draws) of all leaves that are drawn, from left to right."""
        open_nodes = [(0, len(self.sums) - 1, n)]
        while open_nodes:
            lo, hi, n = open_nodes.pop()
            if hi - lo == 1:
                yield lo, n
            elif hi > lo and n.any():
                middle, first = self.split(lo, hi, n)
                open_nodes += [(middle, hi, n - first), (lo, middle, first)]


BLOCK_FIELDS = "policy_index int, sample int, quality double, routed double, fixed double"


def multinomial_samples(paired: DataFrame, *, samples: int, seed: int, cost_unit: float = COST_UNIT, blocks: int | None = None) -> DataFrame:
    """(policy, sample, quality, saving) of samples with replacement, by how often each takes every group of equal pairs.

    Groups lie in blocks by the hash of their key. A task learns from the blocks' sizes, which go to all, how often its
    block is drawn in each sample, and deals that to the block's groups in the order of their keys. Every draw hangs on
    the seed, the policy's position, the block and the group alone, so a retried task or another partitioning draws alike.
    """
    spark = paired.sparkSession
    groups = tied_groups(paired, cost_unit=cost_unit).persist()
    try:
        number = groups.groupBy("policy").count().agg(F.max("count")).first()[0] or 0
        blocks = blocks or max(BLOCKS, 1 << max(0, math.ceil(number / BLOCK_GROUPS) - 1).bit_length())
        placed = groups.withColumn("block", (F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("bigint") % blocks).cast("int"))
        sizes: dict[int, list[int]] = {}
        # At most one number per policy and block.
        for row in placed.groupBy("policy_index", "block").agg(F.sum("requests").alias("n")).collect():
            sizes.setdefault(row["policy_index"], [0] * blocks)[row["block"]] = row["n"]

        def draw(key, table):
            index, block = key[0].as_py(), key[1].as_py()
            table = table.sort_by("key")
            weights, own = sizes[index], table.column("requests").to_pylist()
            n = np.full(samples, sum(weights), np.int64)
            n = _Tree(seed + index, "blocks", weights, samples).leaf(block, n)
            # Of each group the mean of its requests.
            values = np.stack([table.column(c).to_numpy() for c in ("quality", "routed", "fixed")]) / np.array(own, float)
            totals = np.zeros((3, samples))
            for leaf, drawn in _Tree(seed + index, str(block), own, samples).leaves(n):
                totals += values[:, leaf, None] * drawn
            names = ["policy_index", "sample", "quality", "routed", "fixed"]
            return pa.table([pa.array(np.full(samples, index, np.int32)), pa.array(np.arange(samples, dtype=np.int32)), *map(pa.array, totals)], names)

        drawn = placed.groupBy("policy_index", "block").applyInArrow(draw, BLOCK_FIELDS)
        summed = drawn.groupBy("policy_index", "sample").agg(*[F.sum(c).alias(c) for c in ("quality", "routed", "fixed")])
        names = groups.select("policy", "policy_index").distinct().collect()
    finally:
        groups.unpersist()
    known = [(r["policy"], r["policy_index"], sum(sizes[r["policy_index"]])) for r in names]
    policies = F.broadcast(spark.createDataFrame(known, "policy string, policy_index int, n bigint"))
    return summed.join(policies, "policy_index").select("policy", "sample", (F.col("quality") / F.col("n")).alias("quality"), _saving().alias("saving"))


def intervals(samples: DataFrame) -> DataFrame:
    """95 % interval ends per policy, linearly interpolated; null where no sample has a cost."""
    def end(name, p):
        return F.percentile(name, F.lit(p))

    return samples.groupBy("policy").agg(
        end("quality", LOW).alias("quality_low"),
        end("quality", HIGH).alias("quality_high"),
        end("saving", LOW).alias("saving_low"),
        end("saving", HIGH).alias("saving_high"),
    )


def paired_bootstrap(paired: DataFrame, *, samples: int = SAMPLES, seed: int = 0, method: str = MULTINOMIAL) -> DataFrame:
    """Interval ends per routed policy, by the same method whatever the number of requests."""
    if samples <= 0:
        raise ValueError("bootstrap samples must be positive")
    if method not in (MULTINOMIAL, EXACT, POISSON):
        raise ValueError("the bootstrap method is multinomial, exact or poisson")
    counts = [row["count"] for row in paired.groupBy("policy").count().collect()]
    if not counts:
        raise ValueError("there are no paired requests")
    if len(set(counts)) > 1:
        raise ValueError("some request lacks a policy that others have")
    if method == EXACT:
        return intervals(exact_samples(paired, samples=samples, seed=seed, requests=counts[0]))
    if method == POISSON:
        return intervals(poisson_samples(paired, samples=samples, seed=seed))
    return intervals(multinomial_samples(paired, samples=samples, seed=seed))
