"""A hidden Markov language model: Baum-Welch over partitions, exact scaled forward likelihood.

Tokens are lower-cased words and one end per text. The model's alphabet are classes of tokens: the most frequent
words and the end are classes of their own, every other word belongs to a class by its last letters, and within a class a
word has its smoothed share. A hidden Markov chain emits the classes, so that

    log P(text) = log P(classes) + sum of log P(word | class)

is a proper distribution over texts (all unseen words of a class share one place, as in the base model). Its states
learn what a word says about those around it, such as the language of the text.

Token counts cover all training texts: tasks count, numbers per word meet in buckets by hash. The frequent words (at
most `frequent`, by a threshold on counts) are broadcast; the rest of each text's words meets its counts in the same
buckets, as arrays. Baum-Welch first takes a step over each of SLICE_STEPS slices, into which the training texts are
drawn by a hash of their words, then one pass over all of them, whose summed expected counts give the final parameters.
Training cuts texts of more than SEGMENT tokens: only a text's first segment counts as a start, later ones begin with
the chain's own distribution after SEGMENT tokens, and the move over a cut is not counted. Scoring runs the recursion
over whole texts.

Defined cases: a null or empty text is its end alone; without training texts every token is unseen and the chain is
uniform; repeated rows count and score alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.llm.common import in_batches, partitions, settled
from waypost.llm.ragged import Hasher, blocks, lower_ascii, mix, spans, sums_by, text_bytes, word_runs

STATES, OWN_CLASSES, SHAPES, FREQUENT = 8, 4096, 1024, 400_000
SEGMENT, SLICE_STEPS, SEED = 1024, 6, 5
ENDING = 3
#: Code of the end among word hashes.
END = np.uint64(0xE0D)
PSEUDO = 0.05
LOG10 = float(np.log(10.0))


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their shape classes and the text of each word; ends are not among them."""
    data = lower_ascii(data)
    starts, ends, doc = word_runs(data, offsets)
    hasher = Hasher(data)
    tail = np.maximum(starts, ends - ENDING)
    shape = (hasher(tail, ends) % np.uint64(SHAPES)).astype(np.int32)
    return hasher(starts, ends), shape, doc


def packed(bucket: np.ndarray, columns: list[np.ndarray], buckets: int) -> list[tuple[int, list[bytes]]]:
    """Rows of parallel arrays as one blob per column and bucket."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    parts = [c[order] for c in columns]
    return [(k, [p[cuts[k] : cuts[k + 1]].tobytes() for p in parts]) for k in range(buckets) if cuts[k] < cuts[k + 1]]


def bucket_count(docs: DataFrame) -> int:
    return max(16, partitions(docs.sparkSession))


def count_words(docs: DataFrame, training: Column, buckets: int) -> DataFrame:
    """(bucket, hashes, counts, shapes) of the training texts: one row per bucket, hashes in order."""
    rows = docs.where(training).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))

    def count(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            for a, b in blocks(offsets, 8_000_000):
                h, shape, _ = token_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                codes, found = pd.factorize(h)
                found = np.asarray(found, np.uint64)
                first = np.full(len(found), len(h), np.int64)
                np.minimum.at(first, codes, np.arange(len(h)))
                counts, shapes = np.bincount(codes, minlength=len(found)).astype(np.int64), shape[first] if len(h) else shape
                found, counts, shapes = np.append(found, END), np.append(counts, b - a), np.append(shapes, 0).astype(np.int32)
                rows = packed((found % np.uint64(buckets)).astype(np.int64), [found, counts.astype(np.int64), shapes], buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], pa.int32()), *[pa.array([c[i] for _, c in rows], pa.binary()) for i in range(3)]],
                    ["bucket", "hashes", "counts", "shapes"],
                )

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(frame["hashes"]), np.uint64)
        n, s = np.frombuffer(b"".join(frame["counts"]), np.int64), np.frombuffer(b"".join(frame["shapes"]), np.int32)
        keys, first, codes = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(codes, n).astype(np.int64)
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "hashes": [keys.tobytes()], "counts": [total.tobytes()], "shapes": [s[first].tobytes()]})

    schema = "bucket int, hashes binary, counts binary, shapes binary"
    return in_batches(rows).mapInArrow(count, schema).groupBy("bucket").applyInPandas(lambda frame: merge(frame), schema)


def corpus_figures(counts: DataFrame, frequent: int) -> dict:
    """Totals, the mass of each shape class, and the words above the count that `frequent` words reach."""

    def sums(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                n, s = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["shapes"], np.int32)
                level = np.floor(8 * np.log2(n)).astype(np.int64)
                levels = np.bincount(level)
                yield pd.DataFrame({"kind": 0, "key": np.flatnonzero(levels), "value": levels[levels > 0].astype(float)})
                yield pd.DataFrame({"kind": [1, 2], "key": 0, "value": [float(n.sum()), float(len(n))]})

    figures = counts.mapInPandas(sums, "kind int, key bigint, value double").groupBy("kind", "key").agg(F.sum("value").alias("value")).collect()
    totals = {r["kind"]: int(r["value"]) for r in figures if r["kind"] > 0}
    levels = sorted(((r["key"], r["value"]) for r in figures if r["kind"] == 0), reverse=True)
    cut, held = 0, 0
    for level, n in levels:  # at most some 8 x 60 levels
        if held + n > frequent:
            cut = level + 1
            break
        held += n

    def top(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                h, n, s = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["shapes"], np.int32)
                keep = (np.floor(8 * np.log2(n)).astype(np.int64) >= cut) | (h == END)
                mass = np.bincount(s[~keep], n[~keep] + 0.5, SHAPES)
                yield pd.DataFrame({"hashes": [h[keep].tobytes()], "counts": [n[keep].tobytes()], "shapes": [s[keep].tobytes()], "mass": [mass.tobytes()]})

    rows = counts.mapInPandas(top, "hashes binary, counts binary, shapes binary, mass binary").toPandas()  # `frequent` words at most
    h, n = np.frombuffer(b"".join(rows["hashes"]), np.uint64), np.frombuffer(b"".join(rows["counts"]), np.int64)
    s = np.frombuffer(b"".join(rows["shapes"]), np.int32)
    mass = np.sum([np.frombuffer(x, float) for x in rows["mass"]], axis=0) if len(rows) else np.zeros(SHAPES)
    own = np.lexsort((h, -n, h != END))[:OWN_CLASSES]
    label = s.astype(np.int32).copy()
    label[own] = SHAPES + np.arange(len(own), dtype=np.int32)
    rest = label < SHAPES
    mass = mass + 0.5 + np.bincount(label[rest], n[rest] + 0.5, SHAPES)  # and the place of the unseen
    order = np.argsort(h)
    return {"n": totals.get(1, 0), "v": totals.get(2, 0), "hashes": h[order], "counts": n[order], "labels": label[order], "mass": mass, "classes": SHAPES + len(own)}


def classes_of(h: np.ndarray, shape: np.ndarray, table: dict) -> tuple[np.ndarray, np.ndarray]:
    """The class of each token and where it stands in the frequent table (-1: not there)."""
    keys = table["hashes"]
    if not len(keys):
        return shape.astype(np.int32), np.full(len(h), -1)
    codes, found = pd.factorize(h)
    found = np.asarray(found, np.uint64)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    at = np.where(keys[at] == found, at, -1)[codes]
    return np.where(at >= 0, table["labels"][at], shape).astype(np.int32), at


def start_parameters(classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
    b = rng.uniform(0.5, 1.5, (STATES, classes))
    return np.full(STATES, 1.0 / STATES), a / a.sum(axis=1, keepdims=True), b / b.sum(axis=1, keepdims=True)


def expected_counts(seqs: list[np.ndarray], parameters, later: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions of the sequences (forward-backward, side by side).

    `later` marks the segments of a text after its first; they do not count as starts.
    """
    pi, a, b = parameters
    inner = pi @ np.linalg.matrix_power(a, SEGMENT)
    first_of = np.ones(len(seqs), bool) if later is None else ~np.array(later, bool)
    emissions, starts, moves = np.zeros((b.shape[1], STATES)), np.zeros(STATES), np.zeros((STATES, STATES))
    bt = b.T.copy()
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    for first in range(0, len(order), 2048):
        chosen = order[first : first + 2048]
        part, opens = [seqs[i] for i in chosen], first_of[chosen]
        sizes = np.array([len(x) for x in part])
        longest = sizes[0]
        alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]
        grid = np.zeros((longest, len(part)), np.int32)
        columns = np.repeat(np.arange(len(part)), sizes)
        grid[spans(sizes), columns] = np.concatenate(part)
        alpha, emit, scale = [], [], []
        for t in range(longest):
            k = alive[t]
            e = bt[grid[t, :k]]
            x = e * np.where(opens[:, None], pi, inner) if t == 0 else e * (alpha[-1][:k] @ a)
            c = x.sum(axis=1, keepdims=True)
            alpha.append(x / c)
            emit.append(e)
            scale.append(c)
        beta = np.ones((0, STATES))
        for t in range(longest - 1, -1, -1):
            k = alive[t]
            now = np.ones((k, STATES))
            if t + 1 < longest:
                m = alive[t + 1]
                ahead = emit[t + 1] * beta / scale[t + 1]
                moves += alpha[t][:m].T @ ahead * a
                now[:m] = ahead @ a.T
            gamma = alpha[t] * now
            alpha[t] = gamma / gamma.sum(axis=1, keepdims=True)
            beta = now
        starts += alpha[0][opens].sum(axis=0)
        where, weight = np.concatenate([grid[t, : alive[t]] for t in range(longest)]), np.concatenate(alpha)
        for s in range(STATES):
            emissions[:, s] += np.bincount(where, weight[:, s], b.shape[1])
    return starts, moves, emissions


def maximise(counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, moves, emissions = counts
    pi = starts + PSEUDO
    a = moves + PSEUDO
    total = emissions.sum(axis=1)
    b = emissions.T + PSEUDO * (total + 1) / (total + 1).mean()
    return pi / pi.sum(), a / a.sum(axis=1, keepdims=True), b / b.sum(axis=1, keepdims=True)


def coded(docs: DataFrame, training: Column, table: dict) -> DataFrame:
    """Class sequences of the training texts: (part, codes, sizes), a row per block of texts and slice."""
    rows = docs.where(training).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    end = int(table["labels"][np.searchsorted(table["hashes"], END)]) if END in table["hashes"] else 0

    def code(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            for a, b in blocks(offsets, 250_000 * SLICE_STEPS):
                h, shape, doc = token_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                label, _ = classes_of(h, shape, shared.value)
                sizes = np.bincount(doc, minlength=b - a)
                flat = np.insert(label, np.cumsum(sizes), end).astype(np.uint16)
                sizes = (sizes + 1).astype(np.int32)
                sums = sizes.astype(np.uint64)
                np.add.at(sums, doc, h)
                part = (mix(sums) % np.uint64(SLICE_STEPS)).astype(np.int32)
                present = np.unique(part)
                codes = [flat[np.repeat(part == p, sizes)].tobytes() for p in present]
                lengths = [sizes[part == p].tobytes() for p in present]
                yield pa.RecordBatch.from_arrays([pa.array(present), pa.array(codes, pa.binary()), pa.array(lengths, pa.binary())], ["part", "codes", "sizes"])

    return in_batches(rows).mapInArrow(code, "part int, codes binary, sizes binary")


def expect(rows: DataFrame, parameters):
    """Expected counts over all rows: tasks sum their own, and the sums meet by class."""
    shared = rows.sparkSession.sparkContext.broadcast(parameters)
    names = [f"s{i}" for i in range(STATES)]

    def run(frames):
        sums, seqs, later, held = None, [], [], 0
        rows = (row for frame in frames for row in zip(frame["codes"], frame["sizes"]))
        for codes, sizes in chain(rows, [(None, None)]):
            if codes is not None:
                flat, lengths = np.frombuffer(codes, np.uint16), np.frombuffer(sizes, np.int32)
                begins = np.cumsum(lengths) - lengths
                seqs += [flat[b + i : min(b + i + SEGMENT, b + n)] for b, n in zip(begins, lengths) for i in range(0, n, SEGMENT)]
                later += [i > 0 for n in lengths for i in range(0, n, SEGMENT)]
                held += len(flat)
            if seqs and (codes is None or held > 500_000):
                got = expected_counts(seqs, shared.value, later)
                sums = got if sums is None else tuple(x + y for x, y in zip(sums, got))
                seqs, later, held = [], [], 0
        if sums is not None:
            every = np.concatenate([sums[0][None, :], sums[1], sums[2]])
            yield pd.DataFrame(every, columns=names).assign(row=np.arange(len(every)))

    schema = ", ".join(f"{n} double" for n in names) + ", row int"
    total = rows.mapInPandas(run, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # a row per class
    if not len(total):
        return None
    every = np.zeros((1 + STATES + parameters[2].shape[1], STATES))
    every[total["row"]] = total[names].to_numpy()
    return every[0], every[1 : 1 + STATES], every[1 + STATES :]


def train(docs: DataFrame, training: Column, *, frequent: int = FREQUENT) -> tuple[DataFrame, dict]:
    """Counts of all training words (settled, by bucket) and the model."""
    counts = settled(count_words(docs, training, bucket_count(docs)), "word-counts")
    table = corpus_figures(counts, frequent)
    parameters = start_parameters(table["classes"])
    rows = settled(coded(docs, training, table), "classes")
    kept = None
    for step in range(SLICE_STEPS):
        got = expect(rows.where(F.col("part") == step), parameters)
        if got is not None:
            rate = (step + 1) ** -0.7
            kept = got if kept is None else tuple((1 - rate) * x + rate * y for x, y in zip(kept, got))
            parameters = maximise(kept)
    got = expect(rows, parameters)
    if got is not None:
        parameters = maximise(got)
    return counts, table | {"parameters": parameters}


def forward(labels: np.ndarray, sizes: np.ndarray, parameters) -> np.ndarray:
    """log10 probability of each class sequence, over its whole length."""
    pi, a, b = parameters
    bt = b.T.copy()
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    total = np.zeros(len(sizes))
    x = np.zeros((0, STATES))
    for t in range(int(lengths[0]) if len(lengths) else 0):
        k = int(np.searchsorted(-lengths, -t, side="left"))
        e = bt[labels[begins[:k] + t]]
        x = e * pi if t == 0 else e * (x[:k] @ a)
        c = x.sum(axis=1)
        x /= c[:, None]
        total[:k] += np.log10(c)
    out = np.zeros(len(sizes))
    out[order] = total
    return out


def score(docs: DataFrame, counts: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row (doc_id, text)."""
    buckets = bucket_count(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n, v = model["n"], model["v"]
    base = float(np.log10(n + 0.5 * (v + 1)))
    mass = np.log10(model["mass"])

    def scan(batches):
        table = shared.value
        end_at = int(np.searchsorted(table["hashes"], END)) if END in table["hashes"] else -1
        end = int(table["labels"][end_at]) if end_at >= 0 else 0
        logs = np.log10(table["counts"] + 0.5)
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            for a, b in blocks(offsets, 6_000_000):
                m = b - a
                h, shape, doc = token_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                label, at = classes_of(h, shape, table)
                sizes = np.bincount(doc, minlength=m)
                flat = np.insert(label, np.cumsum(sizes), end)
                path = forward(flat, sizes + 1, table["parameters"])
                hit = at >= 0
                # What the frequent words and the end add; the others follow from their buckets.
                known = np.bincount(doc[hit], minlength=m) + (end_at >= 0)
                sums = sums_by(doc[hit], logs[at[hit]], m) + (logs[end_at] if end_at >= 0 else np.log10(0.5))
                in_class = label < SHAPES
                inner = sums_by(doc[hit & in_class], logs[at[hit & in_class]], m) - sums_by(doc[in_class], mass[label[in_class]], m)
                if end < SHAPES:
                    inner += (logs[end_at] if end_at >= 0 else np.log10(0.5)) - mass[end]
                rare_doc, rare = doc[~hit], h[~hit]
                keys = pd.DataFrame({"h": rare, "d": rare_doc}).groupby(["h", "d"], sort=False).size().reset_index(name="n") if len(rare) else pd.DataFrame({"h": np.zeros(0, np.uint64), "d": [], "n": []})
                hashes = keys["h"].to_numpy(np.uint64)
                parts = packed((hashes % np.uint64(buckets)).astype(np.int64), [hashes, keys["d"].to_numpy(np.int32), keys["n"].to_numpy(np.int32)], buckets)
                key = int.from_bytes(os.urandom(7), "big")  # names the block; the rows are settled before they are used
                rows = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, key)), pa.array(np.full(m, -1, np.int32)), pa.array(np.arange(m, dtype=np.int32)), batch.column("doc_id").slice(a, m),
                        pa.array(sizes + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(sums), pa.array(path + inner), *[pa.nulls(m, pa.binary())] * 3,
                    ],
                    names,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, key)), pa.array([k for k, _ in parts], pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, batch.column("doc_id").type),
                        *[pa.nulls(rows, pa.int64())] * 2, *[pa.nulls(rows, pa.float64())] * 2, *[pa.array([c[i] for _, c in parts], pa.binary()) for i in range(3)],
                    ],
                    names,
                )

    names = ["block", "bucket", "place", "doc_id", "n_tokens", "n_known", "sums", "chain", "hashes", "docs", "times"]
    schema = f"block bigint, bucket int, place int, doc_id {id_type}, n_tokens bigint, n_known bigint, sums double, chain double, hashes binary, docs binary, times binary"
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = settled(in_batches(text).mapInArrow(scan, schema), "scored")

    def meet(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        """Counts of one bucket's words, added up for each text of each block."""
        keys = np.frombuffer(theirs["hashes"].iloc[0], np.uint64) if len(theirs) else np.zeros(0, np.uint64)
        found = np.frombuffer(theirs["counts"].iloc[0], np.int64) if len(theirs) else np.zeros(0, np.int64)
        out = []
        for block, h, d, t in zip(mine["block"], mine["hashes"], mine["docs"], mine["times"]):
            h, d, t = np.frombuffer(h, np.uint64), np.frombuffer(d, np.int32), np.frombuffer(t, np.int32)
            c = np.zeros(len(h), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                c = np.where(keys[at] == h, found[at], 0)
            texts, place = np.unique(d, return_inverse=True)
            logs, hits = np.bincount(place, t * np.log10(c + 0.5)), np.bincount(place, t * (c > 0)).astype(np.int32)
            out.append((block, texts.tobytes(), logs.tobytes(), hits.tobytes()))
        return pd.DataFrame(out, columns=["block", "docs", "logs", "hits"])

    rare = rows.where("bucket >= 0").select("block", "bucket", "hashes", "docs", "times")
    met = rare.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInPandas(lambda k, x, y: meet(k, x, y), "block bigint, docs binary, logs binary, hits binary")

    def finish(key, texts: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        size = len(texts)
        extra, hits = np.zeros(size), np.zeros(size, np.int64)
        for d, x, n in zip(parts["docs"], parts["logs"], parts["hits"]):
            d = np.frombuffer(d, np.int32)
            extra[d] += np.frombuffer(x, np.float64)
            hits[d] += np.frombuffer(n, np.int32)
        texts = texts.sort_values("place")
        return pd.DataFrame({
            "doc_id": texts["doc_id"], "n_tokens": texts["n_tokens"], "n_known": texts["n_known"].to_numpy() + hits, "train_tokens": v_tokens,
            "base_score": texts["sums"].to_numpy() + extra - texts["n_tokens"].to_numpy() * base, "score": texts["chain"].to_numpy() + extra,
        })

    v_tokens = n
    heads = rows.where("bucket < 0").select("block", "place", "doc_id", "n_tokens", "n_known", "sums", "chain")
    done = heads.groupBy("block").cogroup(met.groupBy("block"))
    return done.applyInPandas(
        lambda k, x, y: finish(k, x, y),
        f"doc_id {id_type}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
