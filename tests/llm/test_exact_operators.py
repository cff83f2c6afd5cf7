"""Operators whose results are determined, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypost.llm import exact_dedup, near_dedup, packing, quality, sharding
from waypost.llm.bpe_files import json_encoder, read_file, read_ranks, tokenizer_path
from waypost.llm.byte_bpe import Encoder, encode_block, encode_decode
from waypost.llm.token_counts import MergeTable, count_block, count_tokens

from .conftest import BASE, DOCS, rows

WORD = r"[^\x20\x09-\x0D]+"


def as_rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- packing


@pytest.fixture(scope="module")
def gpt():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_packing_places_every_id_once(spark, docs, gpt):
    pieces = packing.token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), capacity=64)
    placed = packing.pack(pieces, capacity=64).collect()
    ids = defaultdict(list)
    for r in placed:
        got = np.frombuffer(r["ids"], "<u4")
        assert len(got) == r["length"] <= 64
        ids[r["doc_id"], r["doc_tokens"]].append((r["start"], got.tolist()))
    for doc_id, text, *_ in set(rows()):
        expected = [*gpt.encode(text or "", add_special_tokens=False).ids, 1]
        times = rows().count(next(x for x in rows() if x[0] == doc_id))
        pieces_of = sorted(ids[doc_id, len(expected)])
        joined = [t for _, part in pieces_of[:: times] for t in part]
        assert joined == expected
    windows = defaultdict(list)
    for r in placed:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_sequences_hold_the_ids(spark, docs):
    pieces = packing.token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), capacity=64)
    placed = packing.pack(pieces, capacity=64)
    total = placed.agg(F.sum("length")).first()[0]
    built = packing.sequences(placed).collect()
    assert sum(len(r["ids"]) // 4 for r in built) == total and all(len(r["ids"]) == 4 * r["length"] for r in built)


def best_fill(counts, capacity):
    """Least padding of a window that holds the longest piece, by trying all sums."""
    longest = max(counts)
    sums = {0}
    for length, n in counts.items():
        for _ in range(n - (length == longest)):
            sums |= {s + length for s in sums if s + length <= capacity - longest}
    return min(packing.padding(longest + s, capacity) for s in sums)


def test_window_is_the_fullest_possible():
    rng = random.Random(3)
    for _ in range(200):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 9)))
        used = packing.fill_window(dict(counts), 40)
        assert all(n <= counts[length] for length, n in used.items()) and max(counts) in used
        filled = sum(length * n for length, n in used.items())
        assert filled <= 40 and packing.padding(filled, 40) == best_fill(counts, 40)


def test_plan_covers_the_histogram():
    histogram = {2048: 1000, 7: 13, 100: 999_999, 1500: 3, 1: 2}
    spans = defaultdict(list)
    for length, first, end, copies, _, _ in packing.plan_windows(histogram):
        assert (end - first) % copies == 0
        spans[length].append((first, end))
    for length, parts in spans.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == histogram[length]
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_rank_encoder_equals_the_library(gpt):
    encode = json_encoder(read_file(tokenizer_path("byte_bpe_50k.json")))
    for _, text, *_ in rows():
        assert encode(text or "").tolist() == gpt.encode(text or "", add_special_tokens=False).ids


# ---------------------------------------------------------------- sharding


def test_sharding(spark, docs):
    found = sharding.shard_documents(docs, [1.0] * 24).collect()
    assert len(found) == len(rows())
    by_key, slots = defaultdict(set), defaultdict(list)
    for r in found:
        by_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(len(x) == 1 for x in by_key.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    plain = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == plain


def test_shards_follow_weights_and_growth(spark):
    keys = spark.range(20000).select(F.col("id").alias("doc_id"))
    shares = Counter(r[0] for r in sharding.assign_shards(keys, "doc_id", [1.0, 2.0, 1.0]).select("shard").collect())
    assert abs(shares[1] / 20000 - 0.5) < 0.02
    four = {r[0]: r[1] for r in sharding.assign_shards(keys, "doc_id", [1.0] * 4).select("doc_id", "grown_shard").collect()}
    five = {r[0]: r[1] for r in sharding.assign_shards(keys, "doc_id", [1.0] * 5).select("doc_id", "shard").collect()}
    assert four == five


# ---------------------------------------------------------------- exact dedup


def plain_groups():
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return groups


def test_exact_dedup(spark, docs):
    digest = F.sha2(F.col("_text").cast("binary"), 256).alias("sha")
    found = exact_dedup.exact_dedup(docs, carry=[digest]).collect()
    groups = plain_groups()
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(found) == len(rows())
    for r in found:
        ids = by_sha[r["sha"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in found) == len(groups)


def test_exact_dedup_with_a_tiny_filter_is_the_same(spark, docs):
    names = ("doc_id", "keep_id", "group_size", "kept")
    assert as_rows(exact_dedup.exact_dedup(docs, bits=8), *names[:3]) == as_rows(exact_dedup.exact_dedup(docs), *names[:3])


def test_exact_dedup_keep_one(spark, docs):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept.collect()]
    assert sorted(texts) == sorted(plain_groups())


# ---------------------------------------------------------------- near dedup


def shingle_set(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def plain_components(pairs):
    """(id, text) pairs to {id: smallest id reachable}; ids must differ."""
    sets = {i: shingle_set(t) for i, t in pairs}
    reach = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 80 * len(x | y) and reach[b] < reach[a]:
                    reach[a], changed = reach[b], True
    return sets, reach


def check_near(df, pairs):
    sets, reach = plain_components(pairs)
    for r in df.collect():
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), reach[r["doc_id"]], reach[r["doc_id"]] == r["doc_id"]), r


def test_near_dedup_odd_cases(spark, docs):
    check_near(near_dedup.near_duplicates(docs), [(i, t) for i, t, *_ in rows() if i is not None])


def variants(n, seed, changes):
    rng = random.Random(seed)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(160)]
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(len(own))] = f"c{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def test_near_dedup_large_group_with_borderline_links(spark):
    texts = variants(150, 1, 7) + variants(40, 2, 9) + [" ".join(f"u{i}x{j}" for j in range(60)) for i in range(100)]
    random.Random(5).shuffle(texts)
    pairs = list(enumerate(texts))
    df = spark.createDataFrame(pairs, "doc_id bigint, text string").repartition(4)
    check_near(near_dedup.near_duplicates(df), pairs)


def test_near_dedup_keep_one(spark, docs):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    _, reach = plain_components([(i, t) for i, t, *_ in rows() if i is not None])
    expected = [r for r in rows() if r[0] is None or reach[r[0]] == r[0]]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in expected)


# ---------------------------------------------------------------- quality rules


def plain_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base(spark, docs):
    found = quality.judge(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in found) == Counter((i, *plain_counts(t)) for i, t, *_ in rows())
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_quality_rejects_odd_characters_and_guards_short_texts(spark):
    rng = random.Random(2)
    plain = [(i, " ".join(rng.choice(BASE) + str(rng.random())[2:4] * (rng.random() < 0.02) for _ in range(90)), "en") for i in range(60)]
    noisy = " ".join(f"{rng.choice(BASE)}***" for _ in range(90))
    shout = " ".join(w.upper() + "!!" for w in rng.choices(BASE, k=90))
    df = spark.createDataFrame([*plain, (100, noisy, "en"), (101, shout, "en"), (102, "***", "en")], "doc_id bigint, text string, lang string")
    kept = {r["doc_id"]: (r["kept"], r["class_distance"]) for r in quality.judge(df).collect()}
    assert not kept[100][0] and not kept[101][0] and not kept[102][0]
    assert all(kept[i][0] for i, *_ in plain)


def test_quality_rejects_long_texts_without_common_words(spark):
    rng = random.Random(12)
    common = "because therefore the of and with between through".split()
    rare = lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(5, 9))) for _ in range(n)]
    plain = lambda n: " ".join(w for r in rare(n) for w in (r, rng.choice(common)))
    data = [(i, plain(100), "en") for i in range(200)] + [(900 + i, " ".join(rare(400)), "en") for i in range(5)]
    found = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(3)).collect()}
    assert all(found[i]["kept"] for i in range(200)) and not any(found[900 + i]["kept"] for i in range(5))
    long_only = " ".join(w for r in rare(100) for w in (r, rng.choice(["because", "therefore", "between", "through"])))
    again = quality.judge(spark.createDataFrame([*data, (999, long_only, "en")], "doc_id bigint, text string, lang string"))
    assert again.where("doc_id = 999").first()["word_distance"] < min(found[900 + i]["word_distance"] for i in range(5))


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return read_file(tokenizer_path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def tik(ranks):
    import tiktoken

    from waypost.llm.bpe_files import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(ranks), special_tokens={})


def test_byte_bpe(spark, docs, tik):
    found = encode_decode(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken")).collect()
    plain = Counter()
    for i, t, *_ in rows():
        ids = tik.encode_ordinary(t or "")
        plain[i, len(ids), ",".join(map(str, ids)), (t or "").encode()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids"], bytes(r["decoded"])) for r in found) == plain


def test_byte_bpe_random_and_long_words(ranks, tik):
    encoder, rng = Encoder(ranks), random.Random(4)
    texts = ["".join(rng.choice(alphabet) for _ in range(size)) for alphabet, size in
             (("ab", 900), ("theinon", 700), ("日本語", 300), (" \n'sreAé1!", 400), ("xy z", 60), ("'tvm ", 300))]
    texts += ["a" * 5000, "=" * 1000, "\n" * 300 + "x", "é" * 400]
    _, ids, decoded = encode_block(texts, encoder)
    for text, got, back in zip(texts, ids, decoded):
        assert got == ",".join(map(str, tik.encode_ordinary(text))) and back.decode() == text


# ---------------------------------------------------------------- token counts


@pytest.fixture(scope="module")
def clip():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_token_counts(spark, docs, clip):
    found = count_tokens(docs, tokenizer_path("word_bpe_49k.json")).collect()
    plain = Counter((i, len(clip.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in found) == plain


def test_token_counts_random(clip):
    table, rng = MergeTable(read_file(tokenizer_path("word_bpe_49k.json"))), random.Random(6)
    alphabet = "abcdetrsn'  \n.!?12ÉßΣσİ日<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    texts += ["<|endoftext|>" * 3, "a<|startoftext|>B", "aaaa" * 300, "ΑΣ ΑΣ."]
    assert count_block(texts, table).tolist() == [len(clip.encode(t, add_special_tokens=False).ids) for t in texts]


def test_single_merges_give_the_same_counts(clip):
    table = MergeTable(read_file(tokenizer_path("word_bpe_49k.json")))
    table.rising = False
    texts = ["banana bandana", "aaaaaaaaaaaa", "mississippi's"]
    assert count_block(texts, table).tolist() == [len(clip.encode(t, add_special_tokens=False).ids) for t in texts]


# ---------------------------------------------------------------- all of them


def results(docs):
    return {
        "packing": packing.packed_digest(docs, tokenizer_path("byte_bpe_50k.json")),
        "sharding": sharding.shard_documents(docs, [1.0] * 24),
        "exact": exact_dedup.exact_dedup(docs),
        "quality": quality.judge(docs),
        "bpe": encode_decode(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken")),
        "near": near_dedup.near_duplicates(docs),
        "counts": count_tokens(docs, tokenizer_path("word_bpe_49k.json")),
        "one": exact_dedup.keep_one(docs),
        "near_one": near_dedup.keep_one(docs),
    }


def test_empty_tables(empty):
    assert {k: v.count() for k, v in results(empty).items()} == dict.fromkeys(results(empty), 0)


def test_clashing_columns(clashing):
    for name, df in results(clashing).items():
        if name == "packing":
            assert df.count() >= len(rows())
        elif name == "one":
            assert df.columns == clashing.columns and df.count() == len(plain_groups())
        elif name != "near_one":
            assert df.count() == len(rows()), name
    assert DOCS.startswith("doc_id")
