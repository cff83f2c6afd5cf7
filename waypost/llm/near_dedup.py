"""Near-duplicate groups by an LSH forest over MinHash signatures, with links confirmed on full shingle sets.

A document's set is its distinct shingles of `words` words (four unless given); equal sets count as one node from then on. Every node has a
signature for each of several trees. A tree is a sorted order: its keys are range-partitioned and sorted, and rows
that share a prefix are candidates of each other. A region (rows that share the shortest prefix that counts) goes
deeper until what shares a prefix is few enough to compare with each other; where even the whole key does not
part them, and in every large region, neighbours by longest common prefix are compared. Comparisons use sketches of
one byte per hash; what passes is confirmed on the sets.

The work is staged so that a group of many near copies costs a few confirmations per document and still loses no
link. First the best candidates of each node are confirmed and components formed. Then every other candidate pair
whose ends are in different components is confirmed, and the members of regions that were too large, or cut by a
partition's border, meet all members of their region in other components: parts of those that ask meet blocks of the
others, both of bounded size, and are compared on the sets alone. Pairs inside
a component need no check: they cannot change it.

Defined cases: a null or empty text, or one without words, is linked with nothing and kept; a document of fewer
than `words` words has the one shingle of all its words; rows that repeat an id share its fate; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypost.llm.common import attach_groups, in_batches, partitions, settled
from waypost.llm.exact_dedup import survivors_filter, with_flag, without
from waypost.llm.ragged import Hasher, blocks, gather, lower_ascii, mix, text_bytes, tidy, word_runs

WORDS, PERCENT = 4, 80
TREES, DEPTH, MIN_DEPTH = 12, 6, 2
#: Hashes in a sketch, and how many of them must agree for a pair outside the blocks to be confirmed: five standard
#: errors below what a pair at the limit shows.
SKETCH, AGREE = 128, 80
#: Rows of a region that are all compared with each other; beyond it, neighbours on each side.
SMALL, NEAR = 32, 2
#: Candidates of a node that are confirmed first.
FIRST = 2
BLOCK, BITS = 2048, 1 << 24
#: Rows of a range of the sorted orders, about.
RANGE_ROWS = 200_000
KEY_BYTES = 4 * DEPTH
#: Bytes of texts that are worked on at once.
TEXT_BYTES = 1_500_000


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the offsets of the texts' sets."""
    data = lower_ascii(data)
    starts, ends, doc = word_runs(data, offsets)
    n = len(offsets) - 1
    words = Hasher(data)(starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    windows = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(n), windows)
    at = np.repeat(first, windows) + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    last = np.repeat(first + count, windows)
    h = np.full(len(owner), 7, np.uint64)
    for i in range(size):
        part = np.where(at + i < last, words[np.minimum(at + i, max(len(words) - 1, 0))] if len(words) else np.uint64(0), np.uint64(i + 1))
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ part)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    return h, np.searchsorted(owner, np.arange(n + 1))


def set_ids(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One number per set, the same for equal sets (0 for an empty one)."""
    some = np.flatnonzero(np.diff(cuts))
    ids = np.zeros(len(cuts) - 1, np.uint64)
    if len(some):
        begins = cuts[some]
        mixed = np.bitwise_xor.reduceat(h, begins) + np.diff(cuts)[some].astype(np.uint64)
        ids[some] = mix(np.add.reduceat(mix(h), begins) + mix(mixed ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return ids.view(np.int64)


def min_hashes(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """SKETCH minimum hashes (32 bits) of each set; empty sets get zeros."""
    rng = np.random.default_rng(2024)
    factors = rng.integers(1, 2**31, SKETCH).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 2**32, SKETCH, dtype=np.uint64).astype(np.uint32)
    low = (h ^ h >> np.uint64(32)).astype(np.uint32)
    some = np.flatnonzero(np.diff(cuts))
    out = np.zeros((len(cuts) - 1, SKETCH), np.uint32)
    for k in range(SKETCH):
        if len(some):
            out[some, k] = np.minimum.reduceat((low ^ shifts[k]) * factors[k], cuts[some])
    return out


def content_key(text: Column) -> Column:
    """A key of a document and its text."""
    return F.xxhash64("doc_id", F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, set_id, keys (TREES keys in order), sketch and _key of every row (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")

    def sign(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            for a, b in blocks(offsets, TEXT_BYTES):
                h, cuts = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                minima = min_hashes(h, cuts)
                keys = minima[:, : TREES * DEPTH].astype(">u4")
                sketch = (minima >> np.uint32(8)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a), batch.column("_key").slice(a, b - a), pa.array(np.diff(cuts), pa.int64()), pa.array(set_ids(h, cuts)),
                        pa.array([row.tobytes() for row in keys], pa.binary()), pa.array([row.tobytes() for row in sketch], pa.binary()),
                    ],
                    ["doc_id", "_key", "n_shingles", "set_id", "keys", "sketch"],
                )

    return in_batches(docs.select("doc_id", text.alias("_text"), content_key(text).alias("_key"))).mapInArrow(
        tidy(sign), f"doc_id {id_type}, _key bigint, n_shingles bigint, set_id bigint, keys binary, sketch binary"
    )


def flat(column, width: int) -> np.ndarray:
    """A binary column of equal widths as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def similar(sketch: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows, which may be similar enough, and how many hashes agree."""
    fit = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
    agree = np.zeros(len(i), np.int64)
    at = np.flatnonzero(fit)
    for a in range(0, len(at), 200_000):
        part = at[a : a + 200_000]
        agree[part] = (sketch[i[part]] == sketch[j[part]]).sum(axis=1)
    return agree >= AGREE, agree


CANDIDATES = "kind int, a bigint, b bigint, agree int, tree int, region binary"


def neighbours(batches):
    """Candidate pairs of one partition of the sorted orders (kind 0), and its regions left to later (kind 1)."""
    parts = list(batches)  # one range of a sorted order, of about RANGE_ROWS
    if not parts or not sum(p.num_rows for p in parts):
        return
    table = pa.Table.from_batches(parts)
    tree = table["tree"].to_numpy()
    keys = flat(table["key"], KEY_BYTES).view(">u4")
    node, n, sketch = table["set_id"].to_numpy(), table["n_shingles"].to_numpy(), flat(table["sketch"], SKETCH)
    size = len(tree)
    shared = np.zeros(size + 1, np.int64)  # hashes that a row shares with the row before it
    equal = (keys[1:] == keys[:-1]) & (tree[1:] == tree[:-1])[:, None]
    shared[1:size] = np.cumprod(equal, axis=1).sum(axis=1)

    region = np.cumsum(shared[:size] < MIN_DEPTH) - 1
    sizes = np.bincount(region)
    left = sizes > SMALL
    left[[0, -1]] |= True  # the partition's border may cut them
    large = sizes[region] > SMALL
    group = np.where(large, -1, region)  # rows that are all compared with each other
    for depth in range(MIN_DEPTH + 1, DEPTH + 1):
        deeper = np.cumsum(shared[:size] < depth) - 1
        open_rows = (group == -1) & (np.bincount(deeper)[deeper] <= SMALL)
        group[open_rows] = depth * size + deeper[open_rows]
    for gap in range(1, SMALL):
        i = np.flatnonzero((group[:-gap] == group[gap:]) & (group[:-gap] >= 0)) if gap < size else np.zeros(0, np.int64)
        if gap <= NEAR and gap < size:
            i = np.union1d(i, np.flatnonzero((region[:-gap] == region[gap:]) & large[:-gap]))
        if not len(i):
            continue
        good, agree = similar(sketch, n, i, i + gap)
        i, agree = i[good], agree[good]
        a, b = np.minimum(node[i], node[i + gap]), np.maximum(node[i], node[i + gap])
        none = pa.nulls(len(i), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(i), np.int32)), pa.array(a), pa.array(b), pa.array(agree.astype(np.int32)), pa.array(np.zeros(len(i), np.int32)), none],
            ["kind", "a", "b", "agree", "tree", "region"],
        )
    starts = np.flatnonzero(shared[:size] < MIN_DEPTH)[left]
    prefixes = [keys[s, :MIN_DEPTH].tobytes() for s in starts]
    none = pa.nulls(len(starts), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.ones(len(starts), np.int32)), none, none, pa.array(np.zeros(len(starts), np.int32)), pa.array(tree[starts].astype(np.int32)), pa.array(prefixes, pa.binary())],
        ["kind", "a", "b", "agree", "tree", "region"],
    )


def tree_rows(nodes: DataFrame) -> DataFrame:
    """tree, key, set_id, n_shingles, sketch: a row per node and tree."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = nodes.select("set_id", "n_shingles", "sketch", "keys", tree)
    key = F.substring(F.col("keys"), F.col("tree") * KEY_BYTES + 1, F.lit(KEY_BYTES))
    return rows.select("tree", key.alias("key"), "set_id", "n_shingles", "sketch", "keys")


def shingle_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """set_id and its sorted shingle hashes for the wanted nodes (set_id), from one document of each.

    A bitmap of fixed size keeps the other documents' texts out of Python.
    """
    chosen = nodes.join(wanted, "set_id", "left_semi").select(F.col("first_doc").cast("string").alias("_id"))
    rows = docs.select(F.col("doc_id").cast("string").alias("_id"), F.col("text").cast("string").alias("_text"))
    flagged = with_flag(rows, survivors_filter(chosen, BITS, "_id"), BITS, "_take", "_id").where("_take").select("_text")

    def collect(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            for a, b in blocks(offsets, TEXT_BYTES):
                h, cuts = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                bodies = [h[cuts[i] : cuts[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(h, cuts)), pa.array(bodies, pa.binary())], ["set_id", "shingles"])

    return in_batches(flagged).mapInArrow(tidy(collect), "set_id bigint, shingles binary").join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"])


def alike(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    short, long = (p, q) if len(p) < len(q) else (q, p)
    common = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
    return 100 * common >= PERCENT * (len(p) + len(q) - common)


def confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, name: str, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    ends = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    sets = settled(shingle_sets(docs, nodes, ends, words), f"{name}-sets")
    right = pairs.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("right")), "b")
    both = right.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("left")), "a")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                keep.append(alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return settled(both.select("a", "b", "left", "right").mapInArrow(tidy(check), "a bigint, b bigint"), f"{name}-links")


def joined_locally(batches):
    """Links of one task as links to the smallest end that they reach within it."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])


def components(links: DataFrame, name: str) -> DataFrame:
    """(v, c) for every end of a link (a, b): c is the smallest end that v reaches.

    Each round takes the smallest label among neighbours and then the label of that label.
    """
    stars = links.mapInArrow(joined_locally, "a bigint, b bigint")
    edges = settled(stars.union(stars.select("b", "a")).distinct(), f"{name}-edges")
    labels = settled(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")), f"{name}-labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        lower = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("further"))
        fresh = settled(lower.join(jump, "c", "left").select("v", "old", F.least("c", "further").alias("c")), f"{name}-labels")
        moved = fresh.where("c <> old").limit(1).count()
        labels = fresh.select("v", "c")
        if not moved:
            return labels


def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the component of either end (itself where it has none)."""
    left = pairs.join(labels.select(F.col("v").alias("a"), F.col("c").alias("_a")), "a", "left")
    both = left.join(labels.select(F.col("v").alias("b"), F.col("c").alias("_b")), "b", "left")
    return both.withColumns({"ca": F.coalesce("_a", "a"), "cb": F.coalesce("_b", "b")}).drop("_a", "_b")


def groups_of(batches, keys: list[str]):
    """Tables of the rows that agree on the keys; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero(np.append(True, (columns[:, 1:] != columns[:, :-1]).any(axis=0)))
        for a, b in zip(cuts, np.append(cuts[1:], batch.num_rows)):
            key = tuple(columns[:, a])
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def shared_counts(sets: np.ndarray, owners: np.ndarray, one: np.ndarray, size: int) -> np.ndarray:
    """How many hashes of one sorted set each of `size` others holds, from their hashes in order with owners."""
    begins, ends = np.searchsorted(sets, one), np.searchsorted(sets, one, side="right")
    return np.bincount(owners[gather(np.arange(len(sets)), begins, ends - begins)], minlength=size)


def compare_block(batches):
    """Confirmed links between the askers of one part and the rows of one block of a region, on full sets.

    The sets of the block's rows are one sorted list of hashes; an asker looks all of its own up in it at once.
    """
    for table in groups_of(batches, ["region_id", "block", "part"]):
        tree, shared = table["tree"].to_numpy(), flat(table["prefixes"], 4 * TREES).view(np.uint32)
        node, comp, n = table["set_id"].to_numpy(), table["c"].to_numpy(), table["n_shingles"].to_numpy()
        minor = table["minor"].to_numpy()  # rows that ask somewhere
        asks = table["asks"].to_numpy()
        targets, askers = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(targets) or not len(askers):
            continue
        bodies = [x.as_buffer() for x in table["shingles"]]
        sets = [np.frombuffer(x, np.uint64) for x in bodies]
        hashes, owners = np.concatenate([sets[t] for t in targets]), np.repeat(np.arange(len(targets)), n[targets])
        by = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[by], owners[by]
        x, y = [], []
        for i in askers:
            common = shared_counts(hashes, owners, sets[i], len(targets))
            near = 100 * common >= PERCENT * (n[i] + n[targets] - common)
            # Of two rows that both ask, the one with the smaller number does.
            j = targets[near & (comp[targets] != comp[i]) & ~(minor[targets] & (node[targets] <= node[i]))]
            if tree[i]:  # an earlier tree where both share a region has this pair
                j = j[~(shared[j, : tree[i]] == shared[i, : tree[i]]).any(axis=1)]
            x += [node[i]] * len(j)
            y += node[j].tolist()
        if x:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def left_over(trees: DataFrame, regions: DataFrame, labels: DataFrame, docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """Links across components within the given regions (tree, region)."""
    region_id = F.xxhash64("tree", "region")
    ids = regions.select("tree", "region").distinct().select(region_id.alias("region_id"))
    rows = trees.withColumn("region", F.substring("key", 1, 4 * MIN_DEPTH)).withColumn("region_id", region_id)
    near = with_flag(rows, survivors_filter(ids, BITS, "region_id"), BITS, "_take", "region_id").where("_take")
    heads = [F.substring("keys", t * KEY_BYTES + 1, 4 * MIN_DEPTH) for t in range(TREES)]
    prefixes = F.concat(*[F.unhex(F.substring(F.lpad(F.hex(F.xxhash64(h)), 16, "0"), 1, 8)) for h in heads])
    members = near.select("region_id", "tree", "set_id", "n_shingles", "sketch", prefixes.alias("prefixes"))
    own = labels.select(F.col("v").alias("set_id"), "c")
    members = settled(members.join(own, "set_id", "left").withColumn("c", F.coalesce("c", "set_id")), "members")
    sizes = members.groupBy("region_id", "c").agg(F.count("*").alias("n"))
    regions_of = sizes.groupBy("region_id").agg(
        F.max(F.struct("n", "c"))["c"].alias("main"), F.sum("n").alias("rows"), F.count("*").alias("kinds"), (F.sum("n") - F.max("n")).alias("askers")
    )
    several = regions_of.where("kinds > 1").drop("kinds")
    open_rows = attach_groups(members, several, "region_id", "rows", members.count(), F.col("set_id")).where(F.col("rows").isNotNull())
    open_rows = settled(open_rows.withColumn("minor", F.col("c") != F.col("main")), "open")
    sets = shingle_sets(docs, nodes, open_rows.select("set_id").distinct(), words)
    marked = open_rows.join(sets, "set_id")
    count = F.ceil(F.col("rows") / BLOCK).cast("int")
    asker_parts = F.ceil(F.col("askers") / BLOCK).cast("int")
    block, part = F.pmod(F.xxhash64("set_id"), count).cast("int"), F.pmod(F.xxhash64("set_id", F.lit("part")), asker_parts).cast("int")
    # Only members outside the region's main component ask; each part of them asks every block.
    target = marked.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), asker_parts - 1)).alias("part"), F.lit(False).alias("asks"))
    asking = marked.where("minor").select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"), part.alias("part"), F.lit(True).alias("asks"))
    by_block = target.union(asking).repartition("region_id", "block", "part").sortWithinPartitions("region_id", "block", "part")
    names = ["region_id", "block", "part", "asks", "minor", "tree", "prefixes", "set_id", "n_shingles", "sketch", "shingles", "c"]
    return by_block.select(*names).mapInArrow(tidy(compare_block), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and _key (of id and text) for every row (doc_id, text)."""
    signed = settled(signatures(docs, words), "signatures")
    some = signed.where("n_shingles > 0")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "keys", "sketch")]
    nodes = settled(some.groupBy("set_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), *firsts), "nodes")

    trees = tree_rows(nodes)
    order = ["tree", "key", "set_id"]
    ranges = max(partitions(docs.sparkSession), math.ceil(TREES * nodes.count() / RANGE_ROWS))
    found = settled(trees.drop("keys").repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(tidy(neighbours), CANDIDATES), "candidates")
    pairs = settled(found.where("kind = 0").groupBy("a", "b").agg(F.max("agree").alias("agree")), "pairs")

    ends = pairs.union(pairs.select("b", "a", "agree"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("agree"), "b"))
    first = ends.withColumn("_rank", best).where(F.col("_rank") <= FIRST)
    first = settled(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first")
    labels = components(confirm(first, docs, nodes, "first", words), "first")

    across = labelled(pairs.select("a", "b"), labels).where("ca <> cb").select("a", "b")
    rest = settled(across.join(first, ["a", "b"], "left_anti"), "rest")
    later = settled(left_over(trees, found.where("kind = 1"), labels, docs, nodes, words), "later")
    links = labelled(confirm(rest, docs, nodes, "rest", words).union(later), labels)
    merged = components(links.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")), "rest")

    one = labels.select(F.col("v").alias("set_id"), "c")
    with_one = nodes.select("set_id", "first_doc", "copies").join(one, "set_id", "left").withColumn("c", F.coalesce("c", "set_id"))
    into = merged.select(F.col("v").alias("c"), F.col("c").alias("further"))
    grouped = settled(with_one.join(into, "c", "left").select("set_id", "first_doc", "copies", F.coalesce("further", "c").alias("c")), "grouped")
    heads = grouped.groupBy("c").agg(F.min("first_doc").alias("component_id"), F.sum("copies").alias("_members"))
    known = attach_groups(grouped, heads.where("_members > 1"), "c", "_members", nodes.count(), F.col("set_id"))
    known = known.where(F.col("component_id").isNotNull()).select("set_id", "component_id", "copies")

    narrow = signed.select("doc_id", "_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id"), F.monotonically_increasing_id().alias("_row"))
    joined = attach_groups(narrow, known, "set_id", "copies", signed.count(), F.col("_row"))
    result = joined.select("doc_id", "_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """The rows of the documents that stay, one document of each group, with all their columns."""
    found = settled(near_duplicates(docs, words=words), "near")
    return without(docs, content_key(F.col("text").cast("string")), found.where(~F.col("kept")))
