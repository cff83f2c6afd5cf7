"""Toxicity by a factorisation machine over hashed terms.

A document's terms are its words and the beginnings of its longer words, each hashed to one of 2**32 buckets, and
count once per document. The machine scores w0 + sum w_i + sum over pairs <v_i, v_j>: the pairwise part lets two
terms mean together what neither means alone. It is fitted by minibatches on a bounded sample of labelled documents,
with weights that undo the sample's balance; buckets enter the model where their frequency differs between the
labels beyond chance, or where the
toxic share of the documents that hold two of them differs beyond chance from the share of either one: such pairs may
be balanced alone. The model is an array of buckets in order with a row of parameters each.

Scoring covers every whole text: a long document is judged by all its words.

Defined cases: a null or empty text scores as the model's bias; without any labelled row all documents score 0;
a document with several labels counts once for each; other columns are ignored unless carried.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.llm.common import in_batches
from waypost.llm.ragged import Hasher, blocks, give_back, latest, lower_ascii, runs, text_bytes, tidy
from waypost.operators.sizing import broadcast_if_small

THRESHOLD = 0.3
#: Bytes of texts that are worked on at once.
TEXT_BYTES = 1_000_000
#: Bounds of the training sample, per label.
POSITIVES, NEGATIVES = 3000, 5000
#: Beginnings of words that are terms of their own, in bytes.
BEGINNINGS = (4, 5, 6, 7)
#: A bucket enters the model with this many documents and this many standard errors between the labels.
LEAST_DOCS, LEAST_Z = 5, 3.0
#: Standard errors for a pair (chance alone reaches it about once in 10**10 pairs), and buckets compared at a time.
PAIR_Z, PAIR_BLOCK = 6.5, 1000
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 4, 25, 128, 0.03, 1e-4, 17


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the terms of each text, with repetition, and the text of each."""
    data = lower_ascii(data)
    letter = np.zeros(256, bool)
    letter[97:123] = letter[128:] = True
    starts, ends, doc = runs(letter[data], offsets)
    hasher = Hasher(data)
    found, owner = [hasher(starts, ends)], [doc]
    for size in BEGINNINGS:
        long = ends - starts > size
        found.append(hasher(starts[long], starts[long] + size) ^ np.uint64(size))
        owner.append(doc[long])
    return (np.concatenate(found) >> np.uint64(32)).astype(np.uint32), np.concatenate(owner)


def pairs_of(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs in order."""
    keys = np.unique(docs.astype(np.uint64) << np.uint64(32) | values.astype(np.uint64))
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Machine:
    """Bias, linear weights and factors of the buckets in `buckets` (sorted)."""

    def __init__(self, buckets: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.buckets, self.bias, self.linear, self.factors = buckets, bias, linear, factors
        self.marks = np.zeros(1 << 20, bool)  # most terms are in no bucket of the model: one look rules them out
        self.marks[buckets & np.uint32((1 << 20) - 1)] = True

    def known(self, docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, model row) pairs of the terms that the model knows."""
        if not len(self.buckets):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        maybe = self.marks[values & np.uint32((1 << 20) - 1)]
        docs, values = docs[maybe], values[maybe]
        at = np.minimum(np.searchsorted(self.buckets, values), len(self.buckets) - 1)
        hit = self.buckets[at] == values
        return pairs_of(docs[hit], at[hit])

    def margins(self, docs: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        sums = np.stack([np.bincount(docs, self.factors[rows, k], n) for k in range(self.factors.shape[1])], axis=1)
        squares = np.bincount(docs, np.square(self.factors[rows]).sum(axis=1), n)
        return self.bias + np.bincount(docs, self.linear[rows], n) + 0.5 * (np.square(sums).sum(axis=1) - squares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def choose_buckets(features: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets whose share of documents differs between the labels by LEAST_Z standard errors, in order."""
    values = np.concatenate(features) if features else np.zeros(0, np.uint32)
    sizes = np.array([len(f) for f in features])
    found, count = np.unique(values, return_counts=True)
    toxic = np.concatenate([f for f, y in zip(features, labels) if y]) if labels.any() else np.zeros(0, np.uint32)
    in_toxic, toxic_count = np.unique(toxic, return_counts=True)
    hits = np.zeros(len(found))
    hits[np.searchsorted(found, in_toxic)] = toxic_count
    n1, n0 = max(labels.sum(), 1), max((~labels).sum(), 1)
    p1, p0, p = hits / n1, (count - hits) / n0, count / max(len(sizes), 1)
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    chosen = (count >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)
    # What even all its toxic or all its clean documents could not lift to PAIR_Z is in no such pair.
    share = (hits + 1) / (count + 2)
    reach = np.maximum(hits * (1 - share) / share, (count - hits) * share / (1 - share))
    able = np.flatnonzero((count >= LEAST_DOCS) & (reach >= PAIR_Z**2))
    chosen[able[in_pairs(features, labels, found[able], share[able])]] = True
    return found[chosen]


def in_pairs(features: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Which buckets stand in a pair whose toxic share differs from that of both its ends, to the same side, by PAIR_Z."""
    order = np.argsort(~labels, kind="stable")  # toxic documents first
    n, toxic = len(order), int(labels.sum())
    rows = [np.flatnonzero(np.isin(buckets, features[i], assume_unique=True)) for i in order]
    doc, at = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows])

    def table(a):
        out, here = np.zeros((n, min(PAIR_BLOCK, len(buckets) - a)), np.float32), (at >= a) & (at < a + PAIR_BLOCK)
        out[doc[here], at[here] - a] = 1
        return out

    hit = np.zeros(len(buckets), bool)
    for a in range(0, len(buckets), PAIR_BLOCK):
        left = table(a)
        for b in range(a, len(buckets), PAIR_BLOCK):
            right = left if a == b else table(b)
            h = left[:toxic].T @ right[:toxic]
            c = h + left[toxic:].T @ right[toxic:]
            p, q = share[a : a + PAIR_BLOCK, None], share[None, b : b + PAIR_BLOCK]
            x = (h - c * p) / np.sqrt(c * p * (1 - p) + 1e-9)
            y = (h - c * q) / np.sqrt(c * q * (1 - q) + 1e-9)
            good = (c >= LEAST_DOCS) & (x * y > 0) & (np.minimum(np.abs(x), np.abs(y)) >= PAIR_Z)
            hit[a : a + PAIR_BLOCK] |= good.any(axis=1)
            hit[b : b + PAIR_BLOCK] |= good.any(axis=0)
    return hit


def fit_machine(features: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> Machine:
    """Weighted logistic loss by Adam over minibatches; features: distinct buckets of each document."""
    rng = np.random.default_rng(SEED)
    buckets = choose_buckets(features, labels)
    prior = float(np.clip((weights * labels).sum() / max(weights.sum(), 1e-9), 1e-4, 1 - 1e-4))
    bias = np.log(prior / (1 - prior))
    machine = Machine(buckets, bias, np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), FACTORS)))
    if not len(buckets):
        return machine
    rows = [np.flatnonzero(np.isin(buckets, f, assume_unique=True)) for f in features]
    weights = weights / weights.mean()
    parameters = [np.array([bias]), machine.linear, machine.factors]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            docs = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            idx = np.concatenate([rows[i] for i in batch])
            machine.bias, machine.linear, machine.factors = float(parameters[0][0]), parameters[1], parameters[2]
            error = weights[batch] * (sigmoid(machine.margins(docs, idx, len(batch))) - labels[batch]) / len(batch)
            per_row = error[docs]
            v = machine.factors[idx]
            sums = np.stack([np.bincount(docs, v[:, k], len(batch)) for k in range(FACTORS)], axis=1)
            push = per_row[:, None] * (sums[docs] - v)
            gradients = [
                np.array([error.sum()]),
                np.bincount(idx, per_row, len(buckets)) + DECAY * parameters[1],
                np.stack([np.bincount(idx, push[:, k], len(buckets)) for k in range(FACTORS)], axis=1) + DECAY * parameters[2],
            ]
            step += 1
            for p, g, (m, s) in zip(parameters, gradients, moments):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    machine.bias = float(parameters[0][0])
    return machine


def train(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, negatives: int = NEGATIVES) -> bytes:
    """Fit on about `positives` and `negatives` documents of each label. docs: doc_id, text; labels: doc_id, toxic.

    The sample is drawn from the labels alone, so the texts are scanned with it and not shuffled.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rates = {1: min(1.0, positives / max(sizes.get(1, 0), 1)), 0: min(1.0, negatives / max(sizes.get(0, 0), 1))}
    if not sizes:
        return pickle.dumps(None)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(draw < F.when(F.col("toxic") == 1, F.lit(rates[1])).otherwise(F.lit(rates[0])))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = texts.join(broadcast_if_small(drawn, 2 * (positives + negatives)), "doc_id")

    def extract(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            bodies = []
            for a, b in blocks(offsets, TEXT_BYTES):
                values, owner = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0:2]
                owner, values = pairs_of(owner, values)
                cuts = np.searchsorted(owner, np.arange(b - a + 1))
                bodies += [values[cuts[i] : cuts[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("toxic"), pa.array(bodies, pa.binary())], ["id", "toxic", "body"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "toxic"])
        labels = frame["toxic"].to_numpy() == 1
        weights = np.where(labels, 1 / rates[1], 1 / rates[0])
        features = [np.frombuffer(x, np.uint32) for x in frame["body"]]
        m = fit_machine(features, labels, weights)
        give_back()
        return pd.DataFrame({"body": [pickle.dumps((m.buckets, m.bias, m.linear, m.factors))]})

    # The sample is bounded by its parameters, so one task can hold it.
    sample = in_batches(chosen).mapInArrow(tidy(extract), "id string, toxic int, body binary")
    fitted = sample.groupBy(F.lit(0).alias("all")).applyInPandas(lambda frame: fit(frame), "body binary").collect()
    return bytes(fitted[0]["body"]) if fitted else pickle.dumps(None)


def ready(body: bytes) -> Machine | None:
    parts = pickle.loads(body)
    return None if parts is None else Machine(*parts)


def score(docs: DataFrame, model: bytes, *, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the carried columns and score (0 to 1) for every row (doc_id, text)."""
    kept = list(dict.fromkeys(["doc_id", *carry]))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in kept) + ", score double"
    body = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            machine = latest("toxicity", body.value, ready)
            data, offsets = text_bytes(batch.column("_text"))
            scores = np.zeros(batch.num_rows)
            if machine is not None:
                for a, b in blocks(offsets, TEXT_BYTES):
                    values, owner = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    doc, rows = machine.known(owner, values)
                    scores[a:b] = sigmoid(machine.margins(doc, rows.astype(np.int64), b - a))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(scores)], [*kept, "score"])

    return in_batches(docs.select(*kept, F.col("text").cast("string").alias("_text"))).mapInArrow(tidy(judge), schema)
