"""Nothing is dropped or changed in silence: bad rows and options raise, are reported, or stay with a null."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypost import normalize_outcomes, read_conversations, render_prefixes, route_payloads, scan_for_secrets, train_router
from waypost.operators import calibrate as C
from waypost.operators import heads as H
from waypost.operators.bootstrap import paired_bootstrap
from waypost.operators.normalize import quarantine
from waypost.operators.validate import missing_cells
from waypost.sources.payloads import payload_arguments, payload_text


def test_rows_of_another_split_stop_training(outcomes, cards):
    for split in ("dev", None):
        extra = outcomes.limit(2).withColumn("split", F.lit(split).cast("string")).withColumn("request_id", F.lit("x"))
        with pytest.raises(ValueError, match="bad_split"):
            train_router(outcomes.unionByName(extra), cards, dimension=128, backend="gradient", gradient_epochs=1)


def test_unlabelled_rows_raise_or_are_set_apart(spark):
    df = spark.createDataFrame([("a", "t", "m", "true", "train"), ("b", "t", "m", None, "train")], "request_id string, text string, model string, acceptable string, split string")
    with pytest.raises(ValueError):
        normalize_outcomes(df)
    rows, rejected = quarantine(normalize_outcomes(df, strict=False))
    assert [r.request_id for r in rows.collect()] == ["a"] and [r.request_id for r in rejected.collect()] == ["b"]


def test_blank_texts_stop_training_unless_allowed(spark, outcomes, cards):
    """A job may take blank requests as examples like all others; it counts them, and still refuses other bad rows."""
    blank = outcomes.filter("request_id in ('train-0', 'train-1', 'calibration-0')").withColumns(
        {"text": F.when(F.col("request_id") == "train-0", "").when(F.col("request_id") != "train-1", " \n"), "request_id": F.concat("request_id", F.lit("b"))}
    )
    rows = outcomes.unionByName(blank)
    for backend in ("gradient", "logistic"):
        options = {"dimension": 128, "backend": backend, "gradient_epochs": 5}
        with pytest.raises(ValueError, match="missing_field"):
            train_router(rows, cards, **options)
        found = train_router(rows, cards, allow_blank=True, **options)
        assert (found.training["train_requests"], found.training["calibration_requests"]) == (14, 9)
        with pytest.raises(ValueError, match="missing_field"):
            train_router(rows.withColumn("request_id", F.lit("")), cards, allow_blank=True, **options)


WRONG = {
    "max_cost_usd": "abc", "cost_weight": "abc", "quality_threshold": [1], "allowed_models": 5,
    "required_capabilities": 5, "denied_providers": "cloud", "input_tokens": "many", "max_quality_drop": {},
}


def test_unusable_constraints_are_errors(spark, model):
    payloads = [(name, json.dumps({"messages": [{"content": "x"}], "router": {name: value}})) for name, value in WRONG.items()]
    payloads += [("null", json.dumps({"messages": [{"content": "x"}], "router": {"max_cost_usd": None, "allowed_models": None}}))]
    df = spark.createDataFrame(payloads, "id string, payload string")
    found = {r.id: r.option_error for r in payload_arguments(payload_text(df)).collect()}
    assert found.pop("null") is None and all(found.values()), found
    routed = {r.id: r.decision for r in route_payloads(df, model, allow_ungated_policy=True).collect()}
    assert all(routed[name].error and routed[name].selected_model is None for name in WRONG)


def test_conversations_on_many_lines_and_one_per_line(spark, tmp_path):
    one = {"messages": [{"role": "user", "content": "mend the fence"}, {"content": "done", "tool_calls": [{"id": 1}]}]}
    (tmp_path / "pretty.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "list.json").write_text(json.dumps(one["messages"], indent=2))
    for name in ("pretty.json", "list.json"):
        rows = sorted(read_conversations(spark, str(tmp_path / name)).collect(), key=lambda r: r.turn)
        assert [r.content for r in rows] == ["mend the fence", "done"] and rows[0].conv_id == name and rows[1].role is None
    lines = "\n".join(json.dumps({"conv_id": f"c{i}", **one}) for i in range(3))
    (tmp_path / "lines.jsonl").write_text(lines + "\n\n")
    rows = read_conversations(spark, str(tmp_path / "lines.jsonl"), format="jsonl").collect()
    assert sorted({r.conv_id for r in rows}) == ["c0", "c1", "c2"] and len(rows) == 6
    with pytest.raises(ValueError):
        (tmp_path / "bare.jsonl").write_text(json.dumps(one))
        read_conversations(spark, str(tmp_path / "bare.jsonl"), format="jsonl")


def test_missing_role_and_call_without_function(spark, tmp_path):
    messages = [{"content": "hello"}, {"role": "assistant", "content": "x", "tool_calls": [{"id": 1}, 7]}]
    (tmp_path / "a.json").write_text(json.dumps(messages, indent=1))
    turns = read_conversations(spark, str(tmp_path / "a.json"))
    calls = {r.turn: r.tool_calls for r in turns.collect()}
    assert [c and (c.name, c.arguments) for c in calls[1]] == [("", ""), None]
    text = " ".join(str(r) for r in render_prefixes(turns).collect())
    assert "RECENT_ROLE_UNKNOWN" in text


def heads():
    rng = np.random.default_rng(1)
    for kind in (H.SIGNED, H.WORDS):
        yield H.Head(H.INDEPENDENT, kind, 64, "seed", ["a", "b"], np.array([0.1, -0.2]), rng.normal(size=(64, 2)))


def test_join_form_keeps_keys_repeats_and_word_features(spark):
    df = spark.createDataFrame([(1, 0, "mend the old fence"), (1, 0, "paint the wall red"), (2, 1, ""), (2, 1, "")], "conv_id int, turn int, text string")
    for head in heads():
        plain = sorted((r.conv_id, r.turn, r.text, *np.round(r.raw, 9)) for r in H.score(df, head).collect())
        joined = sorted((r.conv_id, r.turn, r.text, *np.round(r.raw, 9)) for r in H.score_by_join(df, head).collect())
        assert plain == joined and len(joined) == 4


def test_head_size_is_checked_when_it_is_made(monkeypatch):
    monkeypatch.setattr(H, "MAX_HEAD_CELLS", 100)
    with pytest.raises(ValueError, match="at most 100"):
        list(heads())


def test_rows_without_a_fit_stay(spark):
    points = spark.createDataFrame([("a", 0.1, 0.2), ("a", 0.9, 0.8)], "k string, threshold double, value double")
    df = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "k string, score double")
    assert {r.k: r.calibrated for r in C.calibrate_long(df, points, by=["k"]).collect()} == {"a": 0.2, "b": None}


def test_platt_takes_each_key_by_its_own_size(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = [(k, float(p), bool(rng.random() < p)) for k, n in (("small", 12), ("large", 60)) for p in rng.random(n)]
    df = spark.createDataFrame(data, "k string, probability double, outcome boolean")
    want = {r.k: (r.slope, r.intercept) for r in C.fit_platt(df, by="k", iterations=5).collect()}
    monkeypatch.setattr(C, "PLATT_TASK_POINTS", 20)
    monkeypatch.setattr(C, "MAX_KEYS", 1)
    got = {r.k: (r.slope, r.intercept) for r in C.fit_platt(df, by="k", iterations=5).collect()}
    assert want.keys() == got.keys() and all(np.allclose(want[k], got[k]) for k in want)


def test_key_column_is_scanned(spark):
    df = spark.createDataFrame([("sk-" + "a1B2c3D4" * 5, "plain"), ("k2", "plain")], "id string, text string")
    assert scan_for_secrets(df, "id").select("path").distinct().count() == 1


def test_bootstrap_of_nothing(spark):
    empty = spark.createDataFrame([], "request_id string, policy string, policy_index int, quality_diff double, routed_cost double, fixed_cost double")
    for method in ("exact", "poisson"):
        with pytest.raises(ValueError):
            paired_bootstrap(empty, samples=3, method=method)


def test_missing_cells_count_unknown_models_for_nothing(spark, cards):
    cells = spark.createDataFrame([("r1", "cheap"), ("r1", "strong"), ("r2", "cheap"), ("r3", "ghost")], "request_id string, model string")
    found = sorted((r.request_id, r.model) for r in missing_cells(cells, cards).collect())
    assert found == [("r2", "strong"), ("r3", "cheap"), ("r3", "strong")]
