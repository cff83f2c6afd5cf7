import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waypost.functions.mathx import shannon_entropy, sigmoid, text_entropy
from waypost.functions.text import (
    bucket_counts, check_dimension, feature_rows, hashed_features, is_blank, linear_margins, list_codes, net_counts, terms, tokens,
    with_codes,
)


def by_hand(text, dimension, seed):
    """The features of one text, spelled out."""
    words = [w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_./-]*|\d+|\S", text)]
    listed = ["u:" + w for w in words]
    listed += ["b:" + words[i] + "\x1f" + words[i + 1] for i in range(len(words) - 1)]
    listed.append("length:%d" % min(15, len(words) // 64))
    total = {}
    for term in listed:
        digest = hashlib.sha256((seed + ":" + term).encode()).hexdigest()
        bucket = int(digest[:16], 16) % dimension
        total[bucket] = total.get(bucket, 0) + (1 if int(digest[16:18], 16) % 2 else -1)
    norm = sum(v * v for v in total.values()) ** 0.5
    return {k: v / norm for k, v in total.items() if v}


TEXTS = ["", "fix parser timeout", "Été à Paris, 12٣  x y 😀", "a" * 10, "word " * 9000, "\x1c\x1f tab\tend"]


@pytest.mark.parametrize("dimension", [64, 1000])
def test_features_match_a_plain_computation(spark, dimension):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    coded = with_codes(df, dimension=dimension, seed="seed")
    rows = feature_rows(coded.select("id", hashed_features(F.col("codes"), dimension).alias("features")), ["id"]).collect()
    for i, text in enumerate(TEXTS):
        mine = {r.idx: r.v for r in rows if r.id == i}
        want = by_hand(text, dimension, "seed")
        assert mine.keys() == want.keys()
        assert all(abs(mine[k] - want[k]) < 1e-12 for k in want)


def test_features_have_unit_norm(spark):
    df = spark.createDataFrame([("fix parser timeout",)], "text string")
    coded = with_codes(df, dimension=64, seed="s").select(hashed_features(F.col("codes"), 64).alias("f"))
    assert abs(sum(c.v**2 for c in coded.first().f) - 1) < 1e-9


def test_tokens_and_blank(spark):
    df = spark.createDataFrame([("Foo_1.py  é9 --x",), ("  \n",), (None,)], "text string")
    rows = df.select(tokens(F.col("text")).alias("t"), is_blank(F.col("text")).alias("b")).collect()
    assert rows[0].t == ["foo_1.py", "é", "9", "-", "-", "x"]
    assert [r.b for r in rows] == [False, True, True]


def test_tokens_are_limited_on_request_only(spark):
    df = spark.createDataFrame([("word " * 9000,)], "text string")
    row = df.select(F.size(tokens(F.col("text"))), F.size(tokens(F.col("text"), 4000))).first()
    assert tuple(row) == (9000, 4000)


def test_kernels_take_long_batches_in_pieces(monkeypatch):
    """A batch of three million codes needs the work space of one piece; short pieces give the same features."""
    lengths = np.concatenate(([0, 3, 0], np.full(3000, 1000), [5000, 0]))
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    codes = np.random.default_rng(3).integers(0, 600, offsets[-1]).astype(np.int32)
    batch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes))
    weights, biases = np.arange(900.0).reshape(300, 3) % 7, np.array([0.5, 0.0, -1.0])

    def kernel(make):
        """The function behind an Arrow UDF, without a session."""
        seen = []
        monkeypatch.setattr("waypost.functions.text.F.arrow_udf", lambda kind: lambda f: lambda column: seen.append(f))
        make()
        return seen[0]

    features, margins = kernel(lambda: hashed_features(None, 300)), kernel(lambda: linear_margins(None, weights, biases))
    tracemalloc.start()
    built, scored = features(batch), margins(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    monkeypatch.setattr("waypost.functions.text.ELEMENTS_AT_ONCE", 2500, raising=False)
    assert features(batch).equals(built) and margins(batch).to_pylist() == scored.to_pylist()
    assert features(batch.slice(2, 50)).equals(built.slice(2, 50))
    row, bucket, value = net_counts(batch, 300)
    assert built.flatten().field("idx").to_pylist() == bucket.tolist() and built.value_lengths().to_pylist() == np.bincount(row, minlength=len(batch)).tolist()
    assert np.array_equal(built.flatten().field("v").to_numpy(), value)


@pytest.mark.parametrize("dimension", [64, 1000, 1 << 30])
def test_recurring_terms_are_hashed_once(spark, monkeypatch, dimension):
    """The codes of every term, in the order of `terms`, from a digest for each distinct word, pair and length bucket."""
    rng = np.random.default_rng(7)
    lists = [[], ["one"], None, ["a", "b", "a", "b"], ["é", "\U0001f600", "x\x1fy"], *(rng.choice(["a", "b", "été", "9"], n).tolist() for n in rng.integers(0, 1300, 40))]
    batch = pa.array(lists, pa.list_(pa.string()))

    def code(term):
        digest = hashlib.sha256(("s:" + term).encode()).digest()
        return int.from_bytes(digest[:8], "big") % dimension * 2 + digest[8] % 2

    frame = spark.createDataFrame([(t,) for t in lists], "t array<string>").coalesce(1)
    listed = [row[0] for row in frame.select(terms(F.col("t"))).collect()]
    want = [None if found is None else [code(term) for term in found] for found in listed]
    seen = []
    monkeypatch.setattr("waypost.functions.text.sha256", lambda term: seen.append(term) or hashlib.sha256(term))
    assert list_codes(batch, dimension, "s").to_pylist() == want
    assert len(seen) == len(set(seen)) < 60
    monkeypatch.setattr("waypost.functions.text.ELEMENTS_AT_ONCE", 700)
    monkeypatch.setattr("waypost.functions.text.PAIRS_AT_ONCE", 3)
    assert list_codes(batch, dimension, "s").to_pylist() == want
    assert list_codes(batch.slice(3, 9), dimension, "s").to_pylist() == want[3:12]


def test_null_texts_have_no_codes(spark):
    """A null list takes no place among the codes of a batch, which the next kernel reads as they are."""
    lists = [None, ["a", "b"], None, [], ["a"], None]
    codes = list_codes(pa.array(lists, pa.list_(pa.string())), 64, "s")
    assert np.diff(np.asarray(codes.offsets)).tolist() == [0, 4, 0, 1, 2, 0] and codes.null_count == 3
    # As from a writer that leaves elements behind a null.
    hidden = pa.ListArray.from_arrays(pa.array([0, 2, 3], pa.int32()), pa.array([1, 3, 5], pa.int32()), mask=pa.array([True, False]))
    assert [x.tolist() for x in bucket_counts(hidden, 4)] == [[1], [2], [1.0], [0.0, 1.0]]
    weights, biases = np.ones((64, 2)), np.array([0.5, -1.0])
    df = with_codes(spark.createDataFrame([(None,), ("a b",), ("",)], "text string").coalesce(1), dimension=64, seed="s")
    found = df.select(hashed_features(F.col("codes"), 64).alias("f"), linear_margins(F.col("codes"), weights, biases).alias("z")).collect()
    assert len(found[0].f) == 0 and found[0].z == [0.5, -1.0] and len(found[1].f) > 0 and len(found[2].f) == 1


def test_counts_by_cell_are_those_by_sorting(monkeypatch):
    codes = pa.array([[], [3, 3, 2], [2, 3], [9, 1, 9], []], pa.list_(pa.int32()))
    by_cell = bucket_counts(codes, 5)
    monkeypatch.setattr("waypost.functions.text.CELLS_PER_CODE", 0)
    assert all(np.array_equal(x, y) for x, y in zip(by_cell, bucket_counts(codes, 5)))
    assert [x.tolist() for x in by_cell[:3]] == [[1, 3, 3], [1, 0, 4], [1.0, 1.0, 2.0]]


def test_dimension_is_checked():
    for bad in (0, -1, 1 << 31):
        with pytest.raises(ValueError):
            check_dimension(bad)


def test_sigmoid_does_not_overflow(spark):
    df = spark.createDataFrame([(-1000.0,), (0.0,), (1000.0,)], "z double")
    assert [r[0] for r in df.select(sigmoid(F.col("z"))).collect()] == [0.0, 0.5, 1.0]


def test_entropy(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("日本",)], "s string")
    assert [r[0] for r in df.select(shannon_entropy(F.col("s"))).collect()] == [0.0, 0.0, 1.0, 1.0]


def test_entropy_of_texts_counts_their_characters_once(spark):
    """The same numbers as by replacing each distinct character, from a plan without a pass for each."""
    texts = ["", "aaaa", "abab", "日本", "a😀b😀", "word " * 500 + "é", None, "".join(map(chr, range(40, 4000)))]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    found = df.select(text_entropy("s").alias("counted"), shannon_entropy(F.col("s")).alias("replaced"))
    for row in found.collect():
        assert (row.counted is None) == (row.replaced is None) and abs((row.counted or 0) - (row.replaced or 0)) < 1e-9
    from registry.queries import QUERIES

    df.selectExpr("monotonically_increasing_id() AS doc_id", "s AS text").createOrReplaceTempView("entropy_documents")
    table = spark.table("entropy_documents")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("registry.fixtures.table", lambda spark, sf, name: table)
        plan = QUERIES["red03_entropy"](spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in plan
