"""Language identification by interpolated Kneser-Ney language models over characters.

Each language has a model of its words' characters: a symbol depends on up to three before it within the word, the
ends of words are symbols too. Highest-order counts and continuation counts below are discounted and interpolated
down to a uniform share. All models lie in common arrays sorted by the hash of an n-gram, with a column per
language. A document takes the language of the lowest cross-entropy per symbol, and is rejected where even that
one is beyond what held-back training documents of the language show: their median deviation and a multiple of its
spread (median absolute deviation), which a few junk or mislabelled documents do not move.

Training takes a bounded sample of labelled documents, about `per_language` for each language, chosen by hash;
prediction covers every whole text.

Defined cases: a null text or one without a letter is `und` with score 0 and rejected; without any labelled row
every document is `und`; a language of few documents holds each back in turn and takes the limit of all languages;
where no language has two documents, nothing is known of deviations and only texts without a letter are rejected;
repeated rows are predicted alike; other columns are ignored unless carried.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.llm.chars import code_points, distinct, letter_words, text_blocks
from waypost.llm.common import in_batches
from waypost.llm.ragged import gather, latest, mix, spans, sums_by, tidy
from waypost.operators.sizing import broadcast_if_small

ORDER = 4
#: Languages whose row counts may be broadcast.
MAX_LANGUAGES = 1000
PER_LANGUAGE = 1500
BEGIN, END = 1, 2
UNKNOWN = "und"
#: Characters that are worked on at once.
BLOCK_CHARS = 700_000
#: Every fifth sampled document sets the limits of rejection instead of counting.
HELD_BACK = 5
#: The limit in standard deviations (from the median absolute one) above the median deviation of held-back documents,
#: the least such deviation, and the fewest documents for a limit of a language's own.
SPREADS, LEAST_SPREAD, LEAST_HELD = 10.0, 0.1, 20
#: Symbols beyond which a longer text is no surer evidence of a strange language: texts repeat themselves.
ENOUGH = 100
#: Nats per symbol above the language's mean that are never strange, however even its training documents are.
LEAST_EXCESS = 0.75
#: Symbols whose evidence counts as one in the confidence.
EVIDENCE = 8.0


def word_symbols(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (a row of ORDER symbols each) that end at each symbol of the words, and the word of each."""
    lengths = ends - starts
    padded = lengths + ORDER
    flat = np.full(int(padded.sum()), BEGIN, np.uint32)
    begins = np.cumsum(padded) - padded
    flat[np.repeat(begins + ORDER - 1, lengths) + spans(lengths)] = gather(cp, starts, lengths)
    flat[begins + padded - 1] = END
    word = np.repeat(np.arange(len(lengths)), lengths + 1)
    at = np.repeat(begins + ORDER - 1, lengths + 1) + spans(lengths + 1)
    return np.stack([flat[at - back] for back in range(ORDER - 1, -1, -1)], axis=1), word


def gram_hash(grams: np.ndarray) -> np.ndarray:
    h = np.full(len(grams), grams.shape[1] + 1, np.uint64)
    for column in grams.T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ column.astype(np.uint64))
    return h


def count_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct highest-order n-grams of the texts and their counts."""
    parts, weights = [], []
    for a, b in text_blocks(texts, BLOCK_CHARS):
        cp, offsets = code_points(texts[a:b])
        starts, ends, _ = letter_words(cp, offsets)
        if len(starts):
            codes, _, where = distinct(cp, starts, ends)
            grams, word = word_symbols(cp, starts[where], ends[where])
            parts.append(grams)
            weights.append(np.bincount(codes)[word])
    if not parts:
        return np.zeros((0, ORDER), np.uint32), np.zeros(0)
    return merged(np.concatenate(parts), np.concatenate(weights))


def merged(grams: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, _ = pd.factorize(gram_hash(grams))
    first = np.unique(codes, return_index=True)[1]
    return grams[first], np.bincount(codes, weights)


class KneserNey:
    """One language's model: for each order the seen n-grams, their probabilities, and the weight left by contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        levels = []
        for order in range(ORDER, 0, -1):
            levels.append((grams, counts))
            if order > 1:
                grams, counts = merged(grams[:, 1:], np.ones(len(grams)))  # how many symbols precede it
        self.symbols = len(levels[-1][0]) + 1
        self.keys, self.probs, self.contexts, self.weights = {}, {}, {}, {}
        for order in range(1, ORDER + 1):
            grams, counts = levels[ORDER - order]
            ones, twos = np.sum(counts == 1), np.sum(counts == 2)
            discount = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.5
            context, known = pd.factorize(gram_hash(grams[:, :-1]))
            total, kinds = np.bincount(context, counts), np.bincount(context)
            left = discount * kinds / total
            lower = self.look(grams[:, 1:])
            probs = (counts - discount) / total[context] + left[context] * lower
            for store, hashes, values in ((("keys", "probs"), gram_hash(grams), probs), (("contexts", "weights"), np.asarray(known), left)):
                rank = np.argsort(hashes)
                getattr(self, store[0])[order], getattr(self, store[1])[order] = hashes[rank], values[rank]
        self.top = levels[0][0]

    def look(self, grams: np.ndarray) -> np.ndarray:
        """Probability of the last symbol of each n-gram after the others."""
        order = grams.shape[1]
        if not order:
            return np.full(len(grams), 1.0 / self.symbols)
        found, at = search(self.keys[order], gram_hash(grams))
        probs = np.zeros(len(grams))
        probs[found] = self.probs[order][at[found]]
        miss = np.flatnonzero(~found)
        if len(miss):
            seen, place = search(self.contexts[order], gram_hash(grams[miss, :-1]))
            left = np.ones(len(miss))
            left[seen] = self.weights[order][place[seen]]
            probs[miss] = left * self.look(grams[miss, 1:])
        return probs


def search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether and where each wanted hash stands in a sorted array."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


class Models:
    """All languages over one sorted array of n-grams: what any of them has seen, each has a logarithm for."""

    def __init__(self, models: list[KneserNey]):
        self.models = models
        top = np.concatenate([m.top for m in models])
        hashes, first = np.unique(gram_hash(top), return_index=True)
        self.keys = hashes
        self.logs = np.stack([np.log(m.look(top[first])) for m in models], axis=1).astype(np.float32)

    def score(self, grams: np.ndarray) -> np.ndarray:
        found, at = search(self.keys, gram_hash(grams))
        logs = np.empty((len(grams), len(self.models)), np.float32)
        logs[found] = self.logs[at[found]]
        miss = np.flatnonzero(~found)
        if len(miss):
            logs[miss] = np.stack([np.log(m.look(grams[miss])) for m in self.models], axis=1)
        return logs


def text_scores(texts: list[str], models: Models) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each text under each language, and its number of symbols."""
    totals, sizes = np.zeros((len(texts), len(models.models))), np.zeros(len(texts))
    for a, b in text_blocks(texts, BLOCK_CHARS):
        cp, offsets = code_points(texts[a:b])
        starts, ends, doc = letter_words(cp, offsets)
        if not len(starts):
            continue
        codes, _, where = distinct(cp, starts, ends)
        grams, word = word_symbols(cp, starts[where], ends[where])
        logs = models.score(grams)
        per_word = np.stack([sums_by(word, logs[:, k], len(where)) for k in range(logs.shape[1])], axis=1)
        for k in range(logs.shape[1]):
            totals[a:b, k] = sums_by(doc, per_word[codes, k], b - a)
        sizes[a:b] = sums_by(doc, ends - starts + 1, b - a)
    return totals, sizes


def held_back(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts to count, and the entropy and weight (root of the symbols that count) of each held-back one.

    Few texts are all counted, and each fifth of them is held back from a model of the others.
    """
    many = len(texts) >= HELD_BACK * LEAST_HELD
    entropies, roots = [np.zeros(0)], [np.zeros(0)]
    for fold in range(1 if many else min(HELD_BACK, len(texts))):
        kept = [t for i, t in enumerate(texts) if i % HELD_BACK != fold]
        grams, counts = count_grams(kept)
        if len(grams):
            totals, sizes = text_scores(texts[fold::HELD_BACK], Models([KneserNey(grams, counts)]))
            some = sizes > 0
            entropies.append(-totals[some, 0] / sizes[some])
            roots.append(np.sqrt(np.minimum(sizes[some], ENOUGH)))
    return kept if many else texts, np.concatenate(entropies), np.concatenate(roots)


def limit_of(deviations: np.ndarray) -> float:
    """The deviation beyond which a text is rejected; infinite where none is known."""
    if not len(deviations):
        return float("inf")
    middle = float(np.median(deviations))
    spread = 1.4826 * float(np.median(np.abs(deviations - middle)))
    return middle + SPREADS * max(spread, LEAST_SPREAD)


def train(labelled: DataFrame, *, per_language: int = PER_LANGUAGE) -> list[dict]:
    """One entry per language: its model and its limits of rejection. labelled: doc_id, text, lang."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(broadcast_if_small(sizes, MAX_LANGUAGES), "lang").where(draw < F.lit(float(per_language)) / F.col("n")).select("lang", "text")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        texts, entropies, roots = held_back(sorted(frame["text"].str.lower()))
        grams, counts = count_grams(texts)
        if not len(grams):
            return pd.DataFrame({"lang": [], "body": []})
        mean = float(np.median(entropies)) if len(entropies) else None
        deviations = (entropies - (mean or 0.0)) * roots
        body = pickle.dumps({"lang": frame["lang"].iloc[0], "model": (grams, counts), "mean": mean, "deviations": deviations})
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "body": [body]})

    fitted = chosen.groupBy("lang").applyInPandas(fit, "lang string, body binary").collect()
    entries = [pickle.loads(r["body"]) for r in sorted(fitted, key=lambda r: r["lang"])]
    pooled = limit_of(np.concatenate([np.zeros(0), *[e["deviations"] for e in entries]]))
    middle = float(np.median([e["mean"] for e in entries if e["mean"] is not None] or [0.0]))
    for e in entries:
        deviations = e.pop("deviations")
        e["limit"] = limit_of(deviations) if len(deviations) >= LEAST_HELD else pooled
        e["mean"] = middle if e["mean"] is None else e["mean"]
    return entries


def ready(body: bytes) -> tuple[list[dict], Models]:
    entries = pickle.loads(body)
    return entries, Models([KneserNey(*e["model"]) for e in entries])


def predict(docs: DataFrame, trained: list[dict], *, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the carried columns, lang_pred, score, cross_entropy, rejected for every row (doc_id, text)."""
    kept = list(dict.fromkeys(["doc_id", *carry]))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in kept) + ", lang_pred string, score double, cross_entropy double, rejected boolean"
    names = [t["lang"] for t in trained]
    body = docs.sparkSession.sparkContext.broadcast(pickle.dumps(trained))

    def judge(batches):
        models = None
        for batch in batches:
            if models is None and names:
                entries, models = latest("langid", body.value, ready)
                means = np.array([e["mean"] for e in entries])
                limits = np.array([e["limit"] for e in entries])
            texts = [(t or "").lower() for t in batch.column("_text").to_pylist()]
            label, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            entropy, out = np.full(len(texts), np.nan), np.ones(len(texts), bool)
            if names:
                totals, sizes = text_scores(texts, models)
                some = np.flatnonzero(sizes > 0)
                cross = -totals[some] / sizes[some, None]
                best = cross.argmin(axis=1)
                low = cross[np.arange(len(some)), best]
                odds = np.exp(-(cross - low[:, None]) * sizes[some, None] / EVIDENCE)
                label[some], score[some] = np.array(names, object)[best], 1 / odds.sum(axis=1)
                excess = low - means[best]
                entropy[some], out[some] = low, (excess > LEAST_EXCESS) & (excess * np.sqrt(np.minimum(sizes[some], ENOUGH)) > limits[best])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(label, pa.string()), pa.array(score), pa.array(entropy, pa.float64(), from_pandas=True), pa.array(out)],
                [*kept, "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return in_batches(docs.select(*kept, F.col("text").cast("string").alias("_text"))).mapInArrow(tidy(judge), schema)
