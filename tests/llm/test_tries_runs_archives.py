"""Prefix trie, periodic runs and archives against plain versions."""

import base64
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypost.llm import periods, warc
from waypost.llm.prefix_trie import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id bigint, turn bigint, role string, text string"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
PAGES = "page_id bigint, url string, html string"


def in_order(df, columns=None):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, text[:200], digest, text))
    convs = {c: [(k[2], k[5]) for k in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = convs.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + convs[c][h:]
    nodes, children = {}, {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        below = children.get(key, [])
        leaves[key] = sum(leaves[x] for x in below) or 1
        words = len(WORD.findall(key[-1][1])) if key else 0
        saved[key] = (len(nodes[key]) - 1) * words + sum(saved[x] for x in below)
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(rebuilt[c]) == len(key)))
        parent = min(nodes[key[:-1]]) if key else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(key), parent, len(members), len(children.get(key, [])), leaves[key], saved[key], digest))
    return sorted(out, key=str)


def turn_rows(seed=5):
    rng, rows = random.Random(seed), []
    for c in [*range(-25, 110), *range(10**9, 10**9 + 30)]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 13])):
            text = rng.choice(["a b", "a  b c", "", None, "z"]) if rng.random() < 0.15 else "hello there"
            role = rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else "user"
            rows.append((c, None if rng.random() < 0.05 else t, role, text))
    rows = [r for r in rows if r[0] not in (40, 60)]  # families without their first conversation
    return [*rows, *rows[:20], (None, 1, "user", "x"), (77, None, None, None)]


@pytest.mark.parametrize(("segment", "shard_turns"), [(1024, 50), (4, 30)])
def test_trie_equals_plain_version(spark, segment, shard_turns):
    rows = turn_rows()
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    extra = df.select("*", *[F.lit("x").alias(n) for n in ("path", "words", "depth", "seg", "link", "n", "row")])
    assert in_order(prefix_trie(extra, segment=segment, shard_turns=shard_turns), TRIE) == plain_trie(rows)


def test_trie_of_one_hot_conversation(spark):
    """One conversation holds nearly all turns, and most of the others are equal."""
    rows = [(7, t, "user", f"turn {t % 50}") for t in range(3000)] + [(100 + c, 0, "user", "same words here") for c in range(300)]
    rows += [(7, 5, "user", "a tie"), (7, 5, "user", "a tie")]
    df = spark.createDataFrame(rows, TURNS).repartition(6)
    assert in_order(prefix_trie(df, segment=256, shard_turns=500), TRIE) == plain_trie(rows)


def test_trie_of_turnless_and_no_conversations(spark):
    assert prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    lone = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 1][:2]
    rows = [(c, 0, "user", "only turn") for c in lone]  # shorter than what they would take over from a missing one
    assert in_order(prefix_trie(spark.createDataFrame(rows, TURNS)), TRIE) == plain_trie(rows)


def plain_runs(words):
    n, runs = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                if j - i + q >= max(6, 4 * q):
                    runs.setdefault((i, j - i + q), q)
                i = j
            i += 1
    return sorted((s, n, q) for (s, n), q in runs.items())


def repetitive_texts(seed, count):
    rng = random.Random(seed)

    def letters(n, kinds):
        return [chr(97 + rng.randrange(kinds)) for _ in range(n)]

    out = []
    for i in range(count):
        if i % 4 == 0:
            words = letters(rng.randrange(90), rng.choice([1, 2, 3, 26]))
        elif i % 4 == 1:
            words = letters(rng.randrange(9), 3) + (letters(rng.randrange(1, 30), 2) * rng.randrange(2, 9))[: rng.randrange(200) + 1] + letters(rng.randrange(9), 3)
        elif i % 4 == 2:
            words = (letters(3, 2) * 3 + letters(2, 3)) * 5 + letters(5, 2)
        else:
            words = (["a"] * rng.randrange(40) + ["b"] + ["a"] * rng.randrange(40)) * rng.randrange(1, 6)
        out.append(words)
    a, b = ["a"], ["b"]
    while len(b) < 300:
        a, b = b, b + a
    return [*out, b, b * 3]


def test_runs_equal_plain_version():
    texts = repetitive_texts(3, 300)
    found = [runs for runs, _ in periods.collapse([[w.encode() for w in t] for t in texts])]
    assert found == [plain_runs(t) for t in texts]
    assert sum(map(len, found)) > 100


def test_wavelet_successor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 64, 100):
        values = rng.permutation(n)
        matrix = periods.WaveletMatrix(values)
        left = rng.integers(0, n, 200)
        right = left + rng.integers(1, n + 1, 200)
        right = np.minimum(right, n)
        bound = rng.integers(-1, n + 1, 200)
        expected = [min((v for v in values[a:b] if v > x), default=-1) for a, b, x in zip(left, right, bound)]
        assert matrix.successor(left, right, bound).tolist() == expected


def plain_run_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_digests_of_odd_and_planted_texts(spark, clashing, empty):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = [(r["doc_id"], r["text"]) for r in clashing.select("doc_id", "text").collect()]
    assert in_order(periods.run_digest(clashing), columns) == sorted((plain_run_digest(*r) for r in rows), key=str)
    texts = [" ".join(t) for t in repetitive_texts(9, 120)] + [" ".join(f"w{i}" for i in range(m)) for m in range(60)]
    many = list(enumerate(texts))
    df = spark.createDataFrame(many, "doc_id bigint, text string").repartition(3)
    assert in_order(periods.run_digest(df), columns) == sorted((plain_run_digest(*r) for r in many), key=str)
    assert periods.run_digest(empty).collect() == []


def test_runs_and_collapsed_text(spark):
    df = spark.createDataFrame([(1, "x " + "a b " * 5 + "y"), (2, None), (3, "é " * 6)], "doc_id bigint, text string")
    found = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.periodic_runs(df).collect()}
    assert found == {1: ([(1, 10, 2)], "x a b y"), 2: ([], ""), 3: ([(0, 6, 1)], "é")}


def test_runs_of_a_very_long_text(spark):
    words = [f"w{i}" for i in range(40_000)]
    text = " ".join(words * 5) + " " + " ".join(["z"] * 50_000)
    got = periods.periodic_runs(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [tuple(r) for r in got["runs"]] == [(0, 200_000, 40_000), (200_000, 50_000, 1)]


def plain_archive(rows, least):
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(best.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        target = best.get(html or "")
        own = target is None or i == target or len(body) < least
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "response" if own else "revisit", None if own else target))
    return sorted(out, key=str)


def page_rows():
    mark = warc.MARK
    texts = [
        None, "", "a", "é" * 7000, mark, mark * 5, f"x{mark}WARC-Type: response\r\n\r\ny", "\r\n\r\n", "tail\r\n", ("z" * 990 + mark) * 3,
        "日本" * 3000 + mark, "W", "WARC/1.0\r", "a" * 1000, "a" * 1001, "a" * 999 + mark, "HTTP/1.1 200 OK\r\n\r\n",
    ]
    rows = [(i, "http://h/x\r\nX-Row: 1" if i == 3 else f"http://h/{i}", t) for i, t in enumerate(texts)]
    rows += [(100 + i, "u", t) for i, t in enumerate(texts[::2])]
    return [*rows, rows[3], rows[3], rows[10], (None, None, "a"), (None, "u", "only null"), (None, "u", None)]


@pytest.mark.parametrize(("least", "compression"), [(0, None), (5, "gzip")])
def test_archives_equal_plain_version(spark, least, compression):
    rows = page_rows()
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    df = df.select("*", *[F.lit("x").alias(n) for n in ("size", "hash", "record", "row", "digest", "value")])
    found = warc.round_trip(df, least=least, chunk=1000, compression=compression)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert in_order(found, columns) == plain_archive(rows, least)


def test_archives_are_read_in_splits(spark):
    """Files that are cut anywhere give the same records."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    df = spark.createDataFrame(page_rows(), PAGES).coalesce(1)
    try:
        spark.conf.set(key, "5000")
        found = in_order(warc.round_trip(df, chunk=700))
    finally:
        spark.conf.set(key, before)
    assert found == plain_archive(page_rows(), 0)


def test_archive_bytes_and_damage(spark, tmp_path):
    rows = warc.with_payload(spark.createDataFrame([(1, "http://a", "<p>é</p>")], PAGES))
    none = spark.createDataFrame([], "record string, payload_digest string, target bigint, target_record string")
    warc.write_archives(rows, none, str(tmp_path / "a"))
    body = b"".join(p.read_bytes() for p in sorted((tmp_path / "a").glob("part-*")))
    head, block = body.split(b"\r\n\r\n", 1)
    block = block.removesuffix(b"\r\n\r\n")
    lines = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.0\r\n") and lines["WARC-Target-URI"] == "http://a" and int(lines["Content-Length"]) == len(block)
    assert block.split(b"\r\n\r\n", 1)[1].decode() == "<p>é</p>"
    for name, broken in (("short", body.replace(b"</p>", b"/p>")), ("other", body.replace(b"<p>", b"<b>"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(broken)
        with pytest.raises(Exception, match="differs from its stated"):
            warc.archived_pages(spark, str(tmp_path / name)).collect()


def test_empty_archive(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
