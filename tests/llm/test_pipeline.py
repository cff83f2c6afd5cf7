"""The pipeline against plain versions of its stages, on planted cases."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from waypost.llm import near_dedup
from waypost.llm.bpe_files import tokenizer_path

from .test_exact_operators import plain_components
from .test_models import words_of

INSULTS = ("wretchik", "vermino")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out, labels = random.Random(9), [], []
    for i in range(700):
        lang = rng.choice(["aa", "bb", "cc"])
        words = words_of(lang, rng, rng.randint(12, 60))
        toxic = rng.random() < 0.25
        if toxic:
            for word in INSULTS:
                words.insert(rng.randrange(len(words)), word)
        out.append((i, " ".join(words), lang, "s", 1))
        labels.append((i, 1, int(toxic)))
    clean = [i for i, _, t in labels if not t]
    for k in range(40):
        base = out[clean[k]][1]
        out.append((1000 + k, base.replace(" ", "  ", 3) + "\n", "aa", "s", 1))  # equal but for white space
        words = out[clean[50 + k]][1].split()
        out.append((2000 + k, " ".join([*words, "tail"]), "bb", "s", 1))
    out += [(3000, None, "aa", "s", 1), (3001, "123 !!!", "aa", "s", 1), (3002, "", None, "s", None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(out, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r for r in out}, {i for i, _, t in labels if t}


def test_stages_and_run(spark, folder):
    path, rows, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = docs.columns, set(rows)
    expected = {}
    left = {i for i in left if re.search(r"[^\W\d_]", rows[i][1] or "")}
    expected["language_id"] = set(left)
    left -= {i for i in left if any(w in (rows[i][1]).split() for w in INSULTS)}
    assert not left & toxic
    expected["toxicity"] = set(left)
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i][1]), i)
    left = set(first.values())
    expected["exact_dedup"] = set(left)
    _, reach = plain_components([(i, rows[i][1]) for i in left])
    left = {i for i in left if reach[i] == i}
    expected["near_dedup"] = set(left)
    assert [name for name, _ in corpus_pipeline.STAGES] == [*expected, "packing"]

    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, path)
        if name == "packing":
            break
        assert got.columns == columns
        got.write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        ids = [r[0] for r in docs.select("doc_id").collect()]
        missing, extra = expected[name] - set(ids), set(ids) - expected[name]
        assert len(ids) == len(set(ids)) and not missing and not extra, (name, sorted(missing)[:9], sorted(extra)[:9])

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    totals = {i: len(tokenizer.encode(rows[i][1], add_special_tokens=False).ids) + 1 for i in left}
    packed = corpus_pipeline.run(spark, path).collect()
    size = Counter()
    for r in packed:
        size[r["doc_id"]] += r["length"]
    assert dict(size) == totals
    assert max(Counter({s: sum(r["length"] for r in packed if r["sequence_id"] == s) for s in {r["sequence_id"] for r in packed}}).values()) <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_takes_five_words(spark):
    """Five changed words: 181 of 221 four-word shingles are shared (0.82), 175 of 225 five-word ones (0.78)."""
    words = [f"w{i}" for i in range(204)]
    changed = [f"x{i}" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed))], "doc_id bigint, text string")
    assert near_dedup.keep_one(docs, words=4).count() == 1
    assert corpus_pipeline.near_copies(spark, docs, "").count() == 2
