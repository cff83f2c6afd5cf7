import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

BASE = ("the quick brown fox jumps over a lazy dog while seven wizards mix strange potions under the old stone bridge "
        "and nobody in town knows why their lanterns glow green every winter evening until the river freezes again").split()  # fmt: skip


def rows():
    """Small documents with every odd case: null, empty, blank, short, long, equal, nearly equal, repeated."""
    long = " ".join(f"{w}{i}" for i in range(400) for w in BASE[:6])
    swapped = [*BASE[:-1], "soon"]
    texts = {
        1: " ".join(BASE), 2: " ".join(BASE), 3: "  ".join(BASE) + "\n", 4: " ".join(swapped), 5: " ".join(BASE[::-1]),
        6: None, 7: "", 8: " \t\n", 9: "one two", 10: "One  two", 11: "***%%% $$$ 123", 12: long, 13: long + " tail", 14: "x" * 3000,
        15: "Ünï ß 日本語 don't we'll 's <|endoftext|> <|startoftext|> é  end", 16: "a b c a b c a b c a b c",
        17: "line one here\nline two\nline one here\n\n \nline two", 18: "UPPER lower UPPER", 19: " ".join(BASE[:20] * 6), 20: "\u0000﻿odd",
    }
    out = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in texts.items()]
    return [*out, out[0], (None, "no id here", "en", None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same rows with further columns, named as the operators' own results and helpers."""
    from pyspark.sql import functions as F

    names = ("score", "kept", "_text", "_row", "shard", "length", "rejected", "lang_pred", "component_id", "n_tokens", "_bucket", "ids")
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
