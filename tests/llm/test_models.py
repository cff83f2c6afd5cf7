"""Trained operators: held-out accuracy, exact likelihoods against plain versions, defined odd cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypost.llm import hidden_markov, langid, toxicity
from waypost.llm.common import bucket_of

from .conftest import BASE, rows

SYLLABLES = {"aa": "ka ri to mu ne sa".split(), "bb": "schl ein och ung ver icht".split(), "cc": "eau oux tion que les ais".split()}


def words_of(lang, rng, n):
    return ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)]


# ---------------------------------------------------------------- language


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(1)
    out = [(i, " ".join(words_of(lang, rng, rng.randint(8, 60))), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]
    return spark.createDataFrame(out, "doc_id bigint, text string, lang string").repartition(3)


def test_language_held_out(spark, tongues):
    held = bucket_of(F.col("doc_id"), 3) == 1
    found = langid.predict(tongues, langid.train(tongues.where(~held)), carry=["lang"]).where(held).collect()
    assert len(found) > 100 and sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.98
    assert sum(r["rejected"] for r in found) <= len(found) * 0.01 and all(0 <= r["score"] <= 1 for r in found)


def test_language_rejects_what_no_model_knows(spark, tongues):
    trained = langid.train(tongues)
    odd = spark.createDataFrame([(1, "zqx wvjq xkcd qzzw vvkx " * 30), (2, None), (3, "123 !!"), (4, "karito munesa " * 20)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in langid.predict(odd, trained).collect()}
    assert [found[i]["rejected"] for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert found[2]["lang_pred"] == found[3]["lang_pred"] == "und" and found[2]["score"] == 0


def test_language_limits_survive_junk_and_few_rows(spark, tongues):
    rng = random.Random(7)
    junk = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(40))
    rare = lambda: " ".join("".join(rng.choices("ка ри то му не са".split(), k=rng.randint(1, 3))) for _ in range(40))
    latin, cyrillic = "bcdfghjklmnpqrstvwxz", "каритомунес"
    planted = [(9000 + i, junk(latin), "aa") for i in range(12)] + [(9100 + i, rare(), "dd") for i in range(12)]
    trained = langid.train(tongues.union(spark.createDataFrame(planted, tongues.schema)))
    assert all(np.isfinite(t["limit"]) for t in trained)
    new = [(i, junk(latin)) for i in range(20)] + [(100 + i, junk(cyrillic)) for i in range(20)] + [(200 + i, rare()) for i in range(20)]
    found = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(new, "doc_id bigint, text string"), trained).collect()}
    assert all(found[i]["rejected"] and found[100 + i]["rejected"] for i in range(20))
    assert not any(found[200 + i]["rejected"] for i in range(20)) and {found[200 + i]["lang_pred"] for i in range(20)} == {"dd"}
    known = langid.predict(tongues, trained).collect()
    assert sum(r["rejected"] for r in known) <= len(known) * 0.01


def test_kneser_ney_sums_to_one_and_matches_counts():
    texts = [" ".join(words_of("aa", random.Random(3), 80))]
    grams, counts = langid.count_grams(texts)
    model = langid.KneserNey(grams, counts)
    plain = Counter()
    for word in texts[0].split():
        padded = "\x01\x01\x01" + word + "\x02"
        plain.update(padded[i : i + 4] for i in range(len(word) + 1))
    assert {"".join(map(chr, g)): c for g, c in zip(grams, counts)} == plain
    alphabet = sorted({g[-1] for g in plain}) + ["?"]
    for context in ("\x01\x01\x01", "\x01ka", "zzz", "rit"):
        rows_ = np.array([[*map(ord, context), ord(c)] for c in alphabet], np.uint32)
        assert abs(model.look(rows_).sum() - 1) < 1e-9
        assert np.allclose(langid.Models([model]).score(rows_)[:, 0], np.log(model.look(rows_)), atol=1e-5)


def test_language_without_training_rows(spark, docs, empty):
    found = langid.predict(docs, langid.train(empty)).collect()
    assert len(found) == len(rows()) and {r["lang_pred"] for r in found} == {"und"}


# ---------------------------------------------------------------- toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic where an insult meets a group's name; either alone is clean."""
    rng, out = random.Random(2), []
    for i in range(1500):
        words = [rng.choice(BASE) + rng.choice(BASE) for _ in range(rng.randint(10, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["wretch"] * insult + ["gardeners"] * group
        rng.shuffle(words)
        out.append((i, " ".join(words), int(insult and group)))
    return spark.createDataFrame(out, "doc_id bigint, text string, toxic int").repartition(3)


def test_toxicity_learns_pairs(spark, labelled):
    held = bucket_of(F.col("doc_id"), 4) == 2
    model = toxicity.train(labelled, labelled.where(~held))
    found = toxicity.score(labelled, model, carry=["toxic"]).where(held).collect()
    right = [(r["score"] >= 0.3) == bool(r["toxic"]) for r in found]
    assert len(found) > 200 and sum(right) / len(right) > 0.97
    machine = toxicity.ready(model)
    plain = toxicity.Machine(machine.buckets, machine.bias, machine.linear, np.zeros_like(machine.factors))
    docs_, rows_ = machine.known(*toxicity.terms(np.frombuffer(b"wretch gardeners", np.uint8), np.array([0, 16]))[::-1])
    assert machine.margins(docs_, rows_.astype(int), 1)[0] > plain.margins(docs_, rows_.astype(int), 1)[0]


def test_toxicity_learns_pairs_that_are_balanced_alone(spark):
    """Toxic where both words or neither stand: each is as frequent in clean as in toxic texts."""
    rng, out = random.Random(5), []
    for i in range(1500):
        words = [rng.choice(BASE) + rng.choice(BASE) for _ in range(rng.randint(10, 60))]
        one, two = i % 2 == 0, i // 2 % 2 == 0
        words += ["wretch"] * one + ["gardeners"] * two
        rng.shuffle(words)
        out.append((i, " ".join(words), int(one == two)))
    df = spark.createDataFrame(out, "doc_id bigint, text string, toxic int").repartition(3)
    held = bucket_of(F.col("doc_id"), 4) == 2
    found = toxicity.score(df, toxicity.train(df, df.where(~held)), carry=["toxic"]).where(held).collect()
    right = [(r["score"] >= 0.3) == bool(r["toxic"]) for r in found]
    assert len(found) > 200 and sum(right) / len(right) > 0.95


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(6, dtype=np.uint32), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows_ = np.array([0, 2, 5])
    plain = 0.3 + m.linear[rows_].sum() + sum(m.factors[a] @ m.factors[b] for a, b in itertools.combinations(rows_, 2))
    assert abs(m.margins(np.zeros(3, int), rows_, 1)[0] - plain) < 1e-9


def test_toxicity_odd_cases(spark, docs, labelled, empty):
    scored = toxicity.score(docs, toxicity.train(labelled, labelled)).collect()
    assert len(scored) == len(rows()) and all(0 <= r["score"] <= 1 for r in scored)
    none = toxicity.train(labelled, labelled.where("false"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty, none).count() == 0


# ---------------------------------------------------------------- hidden Markov model


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def check_base(found, docs_rows):
    train = Counter()
    for i, t, *_ in docs_rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            train.update([*tokens(t), None])
    n, v = sum(train.values()), len(train)
    plain = {}
    for i, t, *_ in docs_rows:
        own = [*tokens(t), None]
        plain[i] = (len(own), sum(train[w] > 0 for w in own), n, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
    for r in found:
        want = plain[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3] and abs(r["base_score"] - want[3]) < 1e-6 * max(1, abs(want[3]))


def test_markov_base_counts(spark, docs):
    held = bucket_of(F.col("doc_id"), 5) == 1
    counts, model = hidden_markov.train(docs, ~held)
    check_base(hidden_markov.score(docs, counts, model).collect(), rows())


def test_markov_rare_words_meet_their_counts(spark, docs):
    held = bucket_of(F.col("doc_id"), 5) == 1
    counts, model = hidden_markov.train(docs, ~held, frequent=5)
    check_base(hidden_markov.score(docs, counts, model).collect(), rows())


def test_markov_beats_the_base_on_held_out_texts(spark, tongues):
    held = bucket_of(F.col("doc_id"), 5) == 1
    counts, model = hidden_markov.train(tongues, ~held)
    scored = hidden_markov.score(tongues, counts, model).where(held).agg(F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > scored[1]


def small_chain():
    rng = np.random.default_rng(3)
    s = hidden_markov.STATES
    return tuple(x / x.sum(axis=-1, keepdims=True) for x in (rng.random(s), rng.random((s, s)), rng.random((s, 7))))


def test_forward_is_the_sum_over_state_paths():
    pi, a, b = small_chain()
    seqs = [np.array([1, 4, 2]), np.array([6]), np.array([0, 0])]
    got = hidden_markov.forward(np.concatenate(seqs), np.array([len(x) for x in seqs]), (pi, a, b))
    for seq, value in zip(seqs, got):
        total = 0.0
        for path in itertools.product(range(hidden_markov.STATES), repeat=len(seq)):
            p = pi[path[0]] * b[path[0], seq[0]]
            for t in range(1, len(seq)):
                p *= a[path[t - 1], path[t]] * b[path[t], seq[t]]
            total += p
        assert abs(value - math.log10(total)) < 1e-9


def test_baum_welch_counts_and_ascent():
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, 7, n) for n in (5, 1, 12, 12, 3)]
    parameters = small_chain()
    starts, moves, emissions = hidden_markov.expected_counts(seqs, parameters)
    assert abs(starts.sum() - 5) < 1e-9 and abs(moves.sum() - sum(len(x) - 1 for x in seqs)) < 1e-9
    assert np.allclose(emissions.sum(axis=1), np.bincount(np.concatenate(seqs), minlength=7))
    sizes, flat = np.array([len(x) for x in seqs]), np.concatenate(seqs)
    last = -np.inf
    for _ in range(5):
        now = hidden_markov.forward(flat, sizes, parameters).sum()
        assert now >= last - 1e-6
        last = now
        s, m, e = hidden_markov.expected_counts(seqs, parameters)
        parameters = (s / s.sum(), m / m.sum(axis=1, keepdims=True), (e / e.sum(axis=0)).T)


def test_markov_without_training_rows(spark, docs, empty):
    counts, model = hidden_markov.train(empty, F.lit(True))
    assert hidden_markov.score(empty, counts, model).count() == 0
    found = hidden_markov.score(docs, counts, model).collect()
    assert len(found) == len(rows()) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in found)


def test_hidden_markov_score_equals_the_plain_formula(spark, docs):
    """Classes by the recursion over single tokens, words by their share of their class's counts."""
    held = bucket_of(F.col("doc_id"), 5) == 1
    counts, model = hidden_markov.train(docs, ~held, frequent=5)
    trained = docs.where(~held).select("text").collect()
    split = re.compile(r"[^\x20\x09-\x0D]+")

    def words(text):
        return split.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))

    seen = Counter(w for r in trained for w in [*words(r.text), None])

    def label(word):
        if word is None:
            h, shape = np.array([hidden_markov.END], np.uint64), np.array([hidden_markov.END % np.uint64(hidden_markov.SHAPES)], np.int32)
        else:
            body = np.frombuffer(word.encode(), np.uint8)
            h, shape, _ = hidden_markov.token_hashes(body, np.array([0, len(body)]))
        return int(hidden_markov.classes_of(h, shape, model)[0][0])

    labels = {w: label(w) for w in seen}
    mass = Counter()
    for w, n in seen.items():
        mass[labels[w]] += n + 0.5
    pi, a, b = model["parameters"]
    for row in hidden_markov.score(docs, counts, model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        state, total = None, 0.0
        for w in [*words(row.text), None]:
            k = labels[w] if w in labels else label(w)
            state = (pi if state is None else state @ a) * b[:, k]
            total += math.log10(state.sum())
            state = state / state.sum()
            if k < hidden_markov.SHAPES:
                total += math.log10(seen[w] + 0.5) - math.log10(mass[k] + 0.5)
        assert abs(row.score - total) < 1e-6 * max(1.0, abs(total))


def test_hidden_markov_steps_see_every_training_text(spark, docs):
    """The slices part the texts, and each text's tokens are in one of them."""
    counts = hidden_markov.count_words(docs, F.lit(True), 16)
    table = hidden_markov.corpus_figures(counts, 1000)
    rows = hidden_markov.coded(docs, F.lit(True), table).collect()
    assert {r.part for r in rows} <= set(range(hidden_markov.SLICE_STEPS)) and len({r.part for r in rows}) > 1
    assert sum(len(r.sizes) // 4 for r in rows) == docs.count()
    assert sum(len(r.codes) // 2 for r in rows) == table["n"]


def test_later_segments_are_no_starts():
    rng = np.random.default_rng(2)
    parameters = hidden_markov.start_parameters(10)
    seqs = [rng.integers(0, 10, n).astype(np.uint16) for n in (5, 3, 8)]
    starts, _, emissions = hidden_markov.expected_counts(seqs, parameters, [False, True, False])
    assert abs(starts.sum() - 2) < 1e-9 and abs(emissions.sum() - 16) < 1e-9
