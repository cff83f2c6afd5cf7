"""The trie of all conversations' prefixes, built in sorted shards around a skeleton of splitter paths.

A turn is the MD5 of its role and text, a conversation the string of its turns' digests (its path), so paths sort as
the trie does. Distinct paths, with the number and the smallest of their conversations, are range-partitioned. A node
can have members in two shards only if it is a prefix of what the last path of one shard and the first of a later one
have in common; the trie of these splitter paths, the skeleton, goes to every task. A task finishes all other nodes of
its sorted shard from a stack, and hands out partial sums for the skeleton nodes it meets. Those are added by key, and
sums over subtrees of the skeleton come from every skeleton node adding its own to all its ancestors.

No row, group or task holds a whole conversation: paths are cut into segments of SEGMENT turns. A segment's path begins
with the digest of all before it, so that the segments of one number make a forest of tries. They are built from the
last number to the first, each handing what lies below its roots to the node that ends the segment before; there is one
such round unless conversations are longer than a segment. The ids that end at a node are joined to text in bounded
stretches by Spark, and one task streams a node's stretches through its digest.

Defined cases: turns are ordered by turn (null first), then role, the first 200 characters of text and the turn's MD5;
null role or text is empty; turns without conv_id belong to no conversation; repeated rows are turns of their own; a
conversation without turns ends at the root; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypost.llm.common import partitions, settled
from waypost.operators.sizing import broadcast_if_small
from waypost.session import ensure_checkpoint_dir

#: Turns of a segment, and about the turns of a shard.
SEGMENT, SHARD_TURNS = 1024, 200_000
#: Characters of a turn's digest.
STEP = 32
#: Conversations share the first turns of the one whose id is the next lower multiple of FAMILY, fewer than HEADS of them.
FAMILY, HEADS = 20, 4
#: conv_ids in a stretch of those that end at a node.
STRETCH = 65_536
#: Nodes of the skeleton that may be broadcast; with more, the parent of a node is found by a shuffled join.
MAX_SKELETON = 1_000_000
#: Rows that a task hands to Spark at once.
OUT_ROWS = 20_000
ROOT = "0" * STEP
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, the keys that order its turns, the digest of each turn and its words."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.substring(text, 1, 200).alias("head"),
        digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )


def ordered_pieces(turns: DataFrame, segment: int) -> DataFrame:
    """Stretches of at most `segment` consecutive turns: conv_id, start (number of the first turn), path, words.

    Turns are sorted over all partitions, so a conversation may lie in many; each partition but a conversation's first
    gets the number of its turns in those before, at most one number a partition.
    """
    spark = turns.sparkSession
    ensure_checkpoint_dir(spark)
    keys = ["conv_id", "turn", "role", "head", "digest", "row"]
    ranged = turns.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    held = ranged.select("conv_id", "digest", "words").checkpoint().withColumn("part", F.spark_partition_id())
    counts = held.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = {r["part"]: r["before"] for r in counts.withColumn("before", before).where("before > 0").collect()}

    def cut(batches):
        last, after = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            n = len(conv)
            if last is None:
                last, after = conv[0], offsets.get(batch.column("part")[0].as_py(), 0)
            fresh = np.append(conv[0] != last, conv[1:] != conv[:-1])
            begins = np.flatnonzero(fresh)
            at = np.arange(n)
            base = np.full(n, -after)
            run = np.searchsorted(begins, at, side="right") - 1
            base[run >= 0] = begins[run[run >= 0]]
            pos = at - base
            bounds = np.flatnonzero(fresh | (pos % segment == 0))
            bounds = np.unique(np.concatenate(([0], bounds, [n])))
            last, after = conv[-1], int(pos[-1]) + 1
            digests = "".join(batch.column("digest").to_pylist())
            paths = [digests[a * STEP : b * STEP] for a, b in zip(bounds, bounds[1:])]
            words = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), batch.column("words"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv[bounds[:-1]]), pa.array(pos[bounds[:-1]]), pa.array(paths, pa.string()), words],
                ["conv_id", "start", "path", "words"],
            )

    return held.mapInArrow(cut, "conv_id bigint, start bigint, path string, words array<bigint>")


def rebuilt_segments(pieces: DataFrame, segment: int) -> DataFrame:
    """conv_id, seg, path, words, ends (whether it is the last) of each segment of the rebuilt conversations.

    A conversation takes the first h turns of its family's first one, h from its id, and its own after its first h.
    """
    conv = F.col("conv_id")
    own = pieces.groupBy("conv_id").agg(F.max(F.col("start") + F.size("words")).alias("own"))
    first = pieces.where((conv % FAMILY == 0) & (F.col("start") < HEADS - 1))
    first = first.groupBy(conv.alias("base")).agg(F.sort_array(F.collect_list(F.struct("start", "path", "words"))).alias("s"))
    heads = first.select("base", F.array_join("s.path", "").alias("head"), F.flatten("s.words").alias("head_words"))
    h = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    taken = F.least("h", F.coalesce(F.size("head_words"), F.lit(0)))
    members = (
        own.withColumn("base", conv - conv % FAMILY).join(heads, "base", "left").withColumn("h", h).withColumn("t", F.when(F.col("head_words").isNull(), 0).otherwise(taken))
        .withColumn("total", F.col("t") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    )
    lead = members.select(
        "conv_id", F.lit(0).cast("bigint").alias("seg"), F.lit(0).cast("bigint").alias("at"), "total",
        F.coalesce(F.expr(f"substring(head, 1, t * {STEP})"), F.lit("")).alias("path"),
        F.coalesce(F.expr("slice(head_words, 1, t)"), F.array().cast("array<bigint>")).alias("words"),
    )
    moved = (
        pieces.join(members.select("conv_id", "h", "t", "total"), "conv_id")
        .withColumn("skip", F.greatest(F.col("h") - F.col("start"), F.lit(0)))
        .withColumn("length", F.size("words") - F.col("skip"))
        .where("length > 0")
        .withColumn("to", F.col("start") + F.col("skip") + F.col("t") - F.col("h"))
    )
    cut = moved.withColumn("seg", F.explode(F.expr(f"sequence(floor(to / {segment}), floor((to + length - 1) / {segment}))")))
    cut = cut.withColumn("at", F.greatest("to", F.col("seg") * segment)).withColumn(
        "size", F.least(F.col("to") + F.col("length"), (F.col("seg") + 1) * segment) - F.col("at")
    )
    cut = cut.withColumn("off", F.col("at") - F.col("to") + F.col("skip")).select(
        "conv_id", "seg", "at", "total",
        F.expr(f"substring(path, cast(off * {STEP} + 1 as int), cast(size * {STEP} as int))").alias("path"),
        F.expr("slice(words, cast(off + 1 as int), cast(size as int))").alias("words"),
    )
    both = lead.unionByName(cut).groupBy("conv_id", "seg").agg(
        F.sort_array(F.collect_list(F.struct("at", "path", "words"))).alias("s"), F.max("total").alias("total")
    )
    return both.select(
        "conv_id", "seg", F.array_join("s.path", "").alias("path"), F.flatten("s.words").alias("words"),
        (F.col("total") <= (F.col("seg") + 1) * segment).alias("ends"),
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """end_id and the SHA-256 of its conv_ids (end_id, conv_id), ascending and comma-joined.

    Spark joins the ids of a stretch of STRETCH numbers to one text; a task streams the stretches of a node, so a
    node at which a third of all conversations end costs it a row per stretch.
    """
    part = F.floor(F.col("conv_id") / STRETCH)
    listed = ends.groupBy("end_id", part.alias("part")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    listed = listed.select("end_id", "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def stream(batches):
        now, digest = None, None
        for batch in batches:
            keys, found = [], []
            for end, ids in zip(batch.column("end_id").to_pylist(), batch.column("ids").to_pylist()):
                if end == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        keys.append(now)
                        found.append(digest.hexdigest())
                    now, digest = end, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], ["end_id", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["end_id", "ends_sha256"])

    return listed.repartition("end_id").sortWithinPartitions("end_id", "part").mapInArrow(stream, "end_id string, ends_sha256 string")


def node_id(path: str) -> str:
    """A node's name in joins: the path of a root, else the digest of its path."""
    return path if len(path) == STEP else hashlib.md5(path.encode()).hexdigest()


def node_key(path: Column) -> Column:
    return F.when(F.length(path) == STEP, path).otherwise(F.md5(path.cast("binary")))


def common_path(a: str, b: str) -> str:
    n = 0
    while n < min(len(a), len(b)) and a[n : n + STEP] == b[n : n + STEP]:
        n += STEP
    return a[:n]


def splitter_trie(splitters: list[str]) -> dict:
    """The trie of the splitter paths, as dicts by turn."""
    trie: dict = {}
    for path in splitters:
        node = trie
        for i in range(0, len(path), STEP):
            node = node.setdefault(path[i : i + STEP], {})
    return trie


#: What a task makes of its shard. A skeleton node has its path; a node whose parent's owner other tasks know has a link.
SHARD_FIELDS = (
    "path string, link string, conv_id bigint, steps int, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string, shared boolean"
)
NAMES = [f.split(" ")[0] for f in SHARD_FIELDS.split(", ")]
TYPES = {"path": pa.string(), "link": pa.string(), "ends_sha256": pa.string(), "steps": pa.int32(), "shared": pa.bool_()}


class Shard:
    """The nodes of one sorted shard, in the order of their first path (parents before children)."""

    def __init__(self, skeleton: dict):
        self.skeleton = skeleton
        self.path = ""
        self.roots: dict[int, str] = {}  # the paths of the roots among the nodes
        self.stack: list[int] = []
        self.inside: list[dict | None] = []  # per node of the stack: its place in the skeleton
        self.parent, self.steps, self.words, self.own_path = [], [], [], []
        self.n, self.conv, self.children, self.leaves, self.saved, self.sha = [], [], [], [], [], []

    def add(self, path, words, n, conv, sha, below) -> None:
        keep = len(common_path(self.path, path)) // STEP
        del self.stack[keep:], self.inside[keep:]
        for i in range(keep, len(path) // STEP):
            place = self.skeleton if i == 0 else self.inside[-1]
            place = None if place is None else place.get(path[i * STEP : (i + 1) * STEP])
            parent = self.stack[-1] if i else -1
            if i and place is None:
                self.children[parent] += 1
            if not i:
                self.roots[len(self.parent)] = path[:STEP]
            self.stack.append(len(self.parent))
            self.inside.append(place)
            self.parent.append(parent)
            self.steps.append(i)
            self.words.append(words[i - 1] if i else 0)
            self.own_path.append(None if place is None else path[: (i + 1) * STEP])
            for column, zero in ((self.n, 0), (self.conv, None), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.sha, None)):
                column.append(zero)
        self.path, at = path, self.stack[-1]
        self.n[at] += n
        self.conv[at] = conv if self.conv[at] is None else min(conv, self.conv[at])
        self.sha[at] = sha
        if below is not None:
            self.children[at] += below["n_children"]
            self.leaves[at] += below["n_leaves"]
            self.saved[at] += below["saved_tokens"]

    def rows(self, level: int):
        """All nodes' rows in batches, after adding each node to its parent."""
        for i in range(len(self.parent) - 1, -1, -1):
            up = self.parent[i]
            if self.own_path[i] is None:
                self.leaves[i] += self.children[i] == 0
                self.saved[i] += (self.n[i] - 1) * self.words[i]
            if up >= 0:
                self.n[up] += self.n[i]
                self.conv[up] = self.conv[i] if self.conv[up] is None else min(self.conv[i], self.conv[up])
                if self.own_path[i] is None:
                    self.leaves[up] += self.leaves[i]
                    self.saved[up] += self.saved[i]
        out: list[tuple] = []
        for i, up in enumerate(self.parent):
            link = parent = None
            if up >= 0:
                elsewhere = self.own_path[up] is not None or (level and self.steps[i] == 1)
                if elsewhere:
                    link = node_id(self.own_path[up]) if self.own_path[up] is not None else self.roots[up]
                else:
                    parent = self.conv[up]
            shared = self.own_path[i] is not None
            path = self.own_path[i] if shared else self.roots.get(i)
            numbers = (self.n[i], self.children[i], self.leaves[i], self.saved[i], self.words[i])
            out.append((path, link, self.conv[i], self.steps[i], parent, *numbers, self.sha[i], shared))
            if len(out) == OUT_ROWS:
                yield out
                out = []
        if out:
            yield out


def shard_pass(splitters: list[str], level: int) -> Callable:
    """A task's function over its sorted paths."""

    def build(batches):
        shard = Shard(splitter_trie(splitters))
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "n", "conv_id", "ends_sha256", "below"))):
                shard.add(*row)
        for rows in shard.rows(level):
            columns = list(zip(*rows))
            types = [TYPES.get(n, pa.int64()) for n in NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], NAMES)

    return build


def skeleton_nodes(partial: DataFrame) -> DataFrame:
    """Skeleton nodes from the shards' partial sums: own sums by key, subtree sums by adding each node to its ancestors."""
    added = partial.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.max("steps").alias("steps"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("own"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("words").alias("words"), F.max("ends_sha256").alias("ends_sha256"),
    )
    added = settled(added, "trie-skeleton")
    up = F.expr(f"substring(path, 1, length(path) - {STEP})")
    below = added.where("steps > 0").groupBy(up.alias("path")).agg(F.count("*").alias("shared_children"))
    nodes = added.join(below, "path", "left").withColumn("n_children", F.col("own") + F.coalesce("shared_children", F.lit(0)))
    nodes = nodes.withColumn("leaves", F.col("leaves") + (F.col("n_children") == 0).cast("bigint"))
    nodes = nodes.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("words"))
    each = nodes.select(F.explode(F.expr(f"transform(sequence(0, steps), i -> substring(path, 1, (i + 1) * {STEP}))")).alias("path"), "leaves", "saved")
    sums = each.groupBy("path").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = added.select(F.col("path").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.withColumn("up", up).join(sums, "path").join(parents, "up", "left").select(
        "path", "conv_id", "steps", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def forest(paths: DataFrame, level: int, shard_turns: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Nodes below the roots of one segment number, the roots, and which owners linked nodes may have."""
    spark = paths.sparkSession
    turns = paths.agg(F.sum(F.size("words") + 1)).first()[0]
    shards = max(partitions(spark), math.ceil(turns / shard_turns))
    sorted_paths = paths.select(F.concat("chain", "path").alias("path"), "words", "n", "conv_id", "ends_sha256", "below")
    held = sorted_paths.repartitionByRange(shards, "path").sortWithinPartitions("path").checkpoint()
    edges = held.groupBy(F.spark_partition_id().alias("shard")).agg(F.min("path").alias("first"), F.max("path").alias("last"))
    before = F.lag("last").over(Window.orderBy("shard"))
    shared = F.udf(lambda a, b: common_path(a, b), "string")
    borders = edges.withColumn("before", before).where("before IS NOT NULL").select(shared("before", "first").alias("path"))
    splitters = sorted(r["path"] for r in borders.where("path <> ''").distinct().collect())
    made = settled(held.mapInArrow(shard_pass(splitters, level), SHARD_FIELDS), f"trie-shards-{level}")
    names = ["path", "link", "conv_id", "steps", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    local = made.where("NOT shared").select(*names)
    if not splitters:
        return local, local.where("steps = 0"), None
    skeleton = settled(skeleton_nodes(made.where("shared").drop("link")), "trie-skeleton-sums")
    nodes = local.unionByName(skeleton.withColumn("link", F.when((F.col("steps") == 1) & F.lit(level > 0), F.substring("path", 1, STEP))).select(*names))
    return nodes, nodes.where("steps = 0"), skeleton.select(node_key(F.col("path")).alias("link"), F.col("conv_id").alias("owner"))


def prefix_trie(conversations: DataFrame, *, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    if segment < HEADS:
        raise ValueError("a segment holds the shared first turns")
    ensure_checkpoint_dir(conversations.sparkSession)
    segments = settled(rebuilt_segments(ordered_pieces(turn_rows(conversations), segment), segment), "trie-segments")
    top = segments.agg(F.max("seg")).first()[0]
    ended = F.md5(F.concat("chain", "path").cast("binary"))
    levels: list[DataFrame] = []
    chains = None
    for level in range((top if top is not None else -1) + 1):
        rows = segments.where(F.col("seg") == level)
        rows = rows.withColumn("chain", F.lit(ROOT)) if chains is None else settled(rows.join(chains, "conv_id"), "trie-level")
        rows = rows.withColumn("end_id", ended)
        chains = rows.where("NOT ends").select("conv_id", F.col("end_id").alias("chain"))
        paths = rows.groupBy("chain", "path", "words").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).withColumn("end_id", ended)
        found = end_digests(rows.where("ends").select("end_id", "conv_id"))
        levels.append(settled(paths.join(found, "end_id", "left"), "trie-paths"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    result, below = None, None
    for level in reversed(range(len(levels))):
        paths = levels[level]
        if below is None:
            paths = paths.withColumn("below", F.lit(None).cast("struct<n_children:bigint,n_leaves:bigint,saved_tokens:bigint>"))
        else:
            paths = paths.join(below, "end_id", "left")
        nodes, roots, owners = forest(paths, level, shard_turns)
        below = roots.select(F.col("path").alias("end_id"), F.struct("n_children", "n_leaves", "saved_tokens").alias("below"))
        if level:
            nodes = nodes.where("steps > 0")
            lower = levels[level - 1].select(F.col("end_id").alias("link"), F.col("conv_id").alias("owner"))
            owners = lower if owners is None else owners.where(F.length("link") > 0).join(lower, "link", "left_anti").unionByName(lower)
        if owners is not None:
            nodes = nodes.join(broadcast_if_small(owners, MAX_SKELETON), "link", "left")
            nodes = nodes.withColumn("parent_conv_id", F.coalesce("owner", "parent_conv_id"))
        nodes = nodes.withColumn("depth", (F.col("steps") + level * segment).cast("bigint"))
        nodes = nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(*columns)
        result = nodes if result is None else result.unionByName(nodes)
    if result is None:
        numbers = ", ".join(f"{c} bigint" for c in columns[:-1])
        return conversations.sparkSession.createDataFrame([], numbers + ", ends_sha256 string")
    return result
