import json

import pytest
from pyspark.sql import functions as F

from waypost import read_conversations, read_heldout, read_model_cards, read_outcomes, route_payloads
from waypost.functions.digest import table_digest, text_hash
from waypost.functions.merkle import changed_leaves, digest_diff, digest_entries, digest_tree
from waypost.sources.payloads import payload_arguments, payload_text
from waypost.sources.readers import read_json_lines
from waypost.schema import OUTCOME_RAW


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def test_outcomes_from_json_lines(spark, tmp_path):
    base = {"request_id": 1, "model": "m", "split": "train"}
    path = write(
        tmp_path / "o.jsonl",
        [
            dict(base, text="t", acceptable=True, cost_usd=0.5, group="g", other=1),
            "",
            dict(base, prompt="p", score=0.6),
            dict(base, text="t", score=0.6, acceptable_threshold=0.7),
            dict(base, text="t", acceptable=0),
        ],
    )
    rows = read_outcomes(spark, path).collect()
    assert [r.acceptable for r in rows] == [True, True, False, False]
    assert [r.text for r in rows] == ["t", "p", "t", "t"] and rows[0].request_id == "1"
    assert rows[0].cost_usd == 0.5 and rows[1].cost_usd is None and rows[1].group == ""


def test_bad_lines(spark, tmp_path):
    path = write(tmp_path / "o.jsonl", [{"request_id": "a"}, "{broken", "[1]"])
    with pytest.raises(ValueError, match="invalid JSON line"):
        read_json_lines(spark, path, OUTCOME_RAW)
    rows, bad = read_json_lines(spark, path, OUTCOME_RAW, strict=False)
    assert rows.count() == 1 and {r.line for r in bad.collect()} == {"{broken", "[1]"}


def test_bad_lines_have_numbers_over_splits_and_files(spark, tmp_path):
    """Lines are numbered from 1 in each file, blank ones too, also where tasks read a file in parts."""
    expected = set()
    for name in ("a", "b"):
        lines = []
        for i in range(1, 1500):
            line = json.dumps({"request_id": f"{name}{i}", "text": "word " * (i % 7)})
            if i % 97 == 0:
                line = line[:-1]
                expected.add((name, i, line))
            lines.append("  " if i % 50 == 0 else line)
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    expected = {x for x in expected if x[1] % 50}
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "9000")
        rows, bad = read_json_lines(spark, str(tmp_path), OUTCOME_RAW, strict=False)
        assert rows.rdd.getNumPartitions() > 6
        found = {(r["_file"].rsplit("/", 1)[-1][0], r.number, r.line) for r in bad.collect()}
        with pytest.raises(ValueError, match="invalid JSON line 97 in .*a.jsonl"):
            read_json_lines(spark, str(tmp_path), OUTCOME_RAW)
    finally:
        spark.conf.set(key, before)
    assert found == expected


def test_missing_label_is_an_error(spark, tmp_path):
    path = write(tmp_path / "o.jsonl", [{"request_id": "a", "text": "t", "model": "m", "split": "train"}])
    with pytest.raises(ValueError, match="neither a label nor a score"):
        read_outcomes(spark, path)


def test_heldout_has_tokens_and_no_split(spark, tmp_path):
    path = write(tmp_path / "h.jsonl", [{"request_id": "a", "text": "t", "model": "m", "acceptable": True, "input_tokens": 3, "output_tokens": 4}])
    row = read_heldout(spark, path).first()
    assert (row.input_tokens, row.output_tokens) == (3, 4) and "split" not in row.asDict()


def test_cards_as_list_or_object(spark, tmp_path):
    card = {"name": "a", "context_tokens": 5, "capabilities": ["x", "x"], "metadata": {"tier": "t"}}
    for value in ([card], {"models": [card]}):
        path = tmp_path / f"{len(json.dumps(value))}.json"
        path.write_text(json.dumps(value))
        row = read_model_cards(spark, str(path)).first()
        assert row.name == "a" and row.provider == "" and row.capabilities == ["x"] and row.metadata == {"tier": "t"}


def test_conversations_from_json(spark, tmp_path):
    messages = [
        {"role": "user", "content": "hi", "tool_calls": [{"function": {"name": "f", "arguments": "{}"}}, 7]},
        {"role": "tool", "content": [{"type": "text"}]},
        {"role": "user", "content": None},
        {"role": "user"},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"conv_id": "c1", "messages": messages}))
    rows = sorted(read_conversations(spark, str(tmp_path / "a.json")).collect(), key=lambda r: r.turn)
    assert rows[0].conv_id == "c1" and rows[0].content == "hi"
    assert rows[0].tool_calls[0].name == "f" and rows[0].tool_calls[1] is None
    assert json.loads(rows[1].content) == [{"type": "text"}] and rows[2].content == "null" and rows[3].content == ""
    (tmp_path / "b.json").write_text("[]")
    with pytest.raises(ValueError):
        read_conversations(spark, str(tmp_path / "b.json"))


PAYLOADS = {
    "plain": {"messages": [{"role": "user", "content": "12345678"}]},
    "parts": {"messages": [5, {"content": [{"type": "input_text", "text": "a"}, {"type": "image"}, {"type": "text", "text": " "}]}, {"content": "b"}]},
    "pinned": {"model": "strong", "messages": [{"content": "x"}], "max_tokens": 7, "max_completion_tokens": 9},
    "auto": {"model": "auto", "messages": [{"content": "x"}], "router": None},
    "no_text": {"messages": [{"content": "  "}]},
    "no_list": {"messages": "x"},
    "bad_options": {"messages": [{"content": "x"}], "router": [1]},
    "null_number": {"messages": [{"content": "x"}], "max_completion_tokens": None},
    "null_list": {"messages": [{"content": "x"}], "router": {"required_capabilities": None}},
    "options": {"messages": [{"content": "x"}], "router": {"mode": "cost", "input_tokens": 3, "output_tokens": 4, "max_quality_drop": 0.3, "denied_providers": ["remote"]}},
    "bad_mode": {"messages": [{"content": "x"}], "router": {"mode": None}},
}


@pytest.fixture(scope="module")
def payloads(spark):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in PAYLOADS.items()] + [("junk", "{")], "id string, payload string").persist()


def test_payload_text_and_arguments(payloads):
    rows = {r.id: r for r in payload_arguments(payload_text(payloads)).collect()}
    assert rows["plain"].text == "12345678" and rows["plain"].input_tokens == 2 and rows["plain"].output_tokens == 1024
    assert rows["parts"].text == "a\nb" and rows["parts"].text_error is None
    assert rows["pinned"].allowed_models == ["strong"] and rows["pinned"].output_tokens == 9 and rows["pinned"].input_tokens == 1
    assert rows["auto"].allowed_models is None and rows["auto"].option_error is None
    assert rows["no_text"].text_error == "messages contain no routable text"
    assert rows["no_list"].text_error == rows["junk"].text_error == "messages must be a list"
    assert rows["bad_options"].option_error == "router options must be an object"
    assert rows["null_number"].option_error == "router options need numbers"
    assert rows["null_list"].option_error == "router options need lists"
    options = rows["options"]
    assert (options.mode, options.input_tokens, options.output_tokens, options.max_quality_drop) == ("cost", 3, 4, 0.3)


def test_route_payloads(spark, model, payloads):
    rows = {r.id: r.decision for r in route_payloads(payloads, model, allow_ungated_policy=True).collect()}
    assert rows["plain"].error is None and rows["plain"].selected_model in {"cheap", "strong"}
    assert rows["pinned"].selected_model == "strong" and rows["pinned"].rejected == {"cheap": ["not_allowed"]}
    assert rows["options"].selected_model == "cheap"
    assert rows["no_text"].selected_model is None and rows["no_text"].error
    assert rows["bad_mode"].error.startswith("mode must be")


def test_digests_ignore_order_and_see_changes(spark):
    df = spark.createDataFrame([(i, f"t{i}", i / 3) for i in range(50)], "id int, text string, x double")
    first = table_digest(df).first().digest
    assert table_digest(df.repartition(7).orderBy(F.desc("id"))).first().digest == first
    assert table_digest(df.withColumn("x", F.when(F.col("id") == 3, 0.0).otherwise(F.col("x")))).first().digest != first
    assert table_digest(df.unionByName(df.limit(1))).first().digest != first
    import hashlib

    assert df.filter("id = 1").select(text_hash(F.col("text"))).first()[0] == hashlib.sha256(b'{"text":"t1"}').hexdigest()


def test_digest_trees_find_what_changed(spark):
    df = spark.createDataFrame([(i, f"t{i % 40}", i / 3) for i in range(400)], "id int, text string, x double")
    names = ("id", "text", "x")

    def tree(table, levels=2):
        return {r.prefix: (r.n_rows, r.digest) for r in digest_tree(digest_entries(table, *names), levels=levels).collect()}

    first = tree(df)
    assert tree(df.repartition(7).orderBy(F.desc("id"))) == first and first[""][0] == 400
    assert sum(n for p, (n, _) in first.items() if len(p) == 4) == 400 == sum(n for p, (n, _) in first.items() if len(p) == 2)
    changed = df.filter("id <> 7").withColumn("x", F.when(F.col("id") == 3, -1.0).otherwise(F.col("x"))).unionByName(df.filter("id = 9"))
    found = {(r.id, r.x, r.n_left, r.n_right) for r in digest_diff(df, changed, *names).collect()}
    assert found == {(7, 7 / 3, 1, 0), (3, 1.0, 1, 0), (3, -1.0, 0, 1), (9, 3.0, 1, 2)}
    other = tree(changed)
    leaves = {r.prefix for r in changed_leaves(digest_tree(digest_entries(df, *names)), digest_tree(digest_entries(changed, *names))).collect()}
    assert leaves == {p for p in first.keys() | other.keys() if len(p) == 4 and first.get(p) != other.get(p)}
    assert digest_diff(df, df.repartition(3)).count() == 0
    assert len(tree(df, levels=1)) == len({p[:2] for p in first if len(p) == 4}) + 1


def test_digest_tree_of_an_empty_table_and_of_equal_rows(spark):
    empty = spark.createDataFrame([], "id int")
    assert [(r.prefix, r.n_rows) for r in digest_tree(digest_entries(empty)).collect()] == [("", 0)]
    same = spark.range(5000).select(F.lit(1).alias("id"), F.lit(None).cast("string").alias("t"))
    assert [r.n for r in digest_entries(same).collect()] == [5000]
    found = digest_diff(same, same.limit(4999)).collect()
    assert [(r.id, r.t, r.n_left, r.n_right) for r in found] == [(1, None, 5000, 4999)]
    assert {(r.n_left, r.n_right) for r in digest_diff(empty, same.select("id")).collect()} == {(0, 5000)}


def test_lines_of_a_folder_are_numbered_over_its_files(spark, tmp_path, monkeypatch):
    """No task writes a whole folder of lines, and the numbers go on from file to file."""
    from registry import stored

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id bigint, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(stored, "_folder", lambda spark, name: str(tmp_path / name))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = sorted((r.head, r.file, r.number) for r in stored.src01_numbers(spark, str(tmp_path)).collect())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert found == sorted((f'{{"request_id":"{d}"', str(d % 4), d // 4 + 1) for d in range(400) if d % 17 == 3)
    lines = [len(f.read_text().splitlines()) for f in (tmp_path / "lines").glob("bucket=*/*.txt")]
    assert sum(lines) == 400 and len(lines) > 4
