import pytest

from tests.conftest import HELDOUT, OUTCOME
from waypost.operators import validate as V
from waypost.schema import CARD

GOOD = [("r1", "t", m, True, "train", 0.1, "g") for m in ("cheap", "strong")]


def rules(df):
    return {(r["rule"], r["request_id"], r["model"]) for r in df.collect()}


def test_clean_matrix_has_no_violation(spark, cards, outcomes):
    assert rules(V.validate_matrix(outcomes, cards)) == set()


@pytest.mark.parametrize(
    "rows, expected",
    [
        (GOOD + GOOD[:1], ("duplicate_cell", "r1", "cheap")),
        (GOOD[:1], ("missing_cell", "r1", "strong")),
        ([GOOD[0], ("r1", "other", "strong", True, "train", 0.1, "g")], ("text_disagrees", "r1", None)),
        ([GOOD[0], ("r1", "t", "strong", True, "train", 0.1, "h")], ("group_disagrees", "r1", None)),
        (GOOD + [("r1", "t", "ghost", True, "train", 0.1, "g")], ("unknown_model", "r1", "ghost")),
        ([GOOD[0], ("r1", "t", "strong", True, "train", -0.1, "g")], ("bad_cost", "r1", "strong")),
        ([GOOD[0], ("r1", "t", "strong", True, "train", float("inf"), "g")], ("bad_cost", "r1", "strong")),
        ([GOOD[0], ("r1", "t", "strong", True, "dev", 0.1, "g")], ("bad_split", "r1", "strong")),
        ([("", " ", "cheap", True, "train", 0.1, "g")], ("missing_field", "", "cheap")),
        (GOOD[:1], ("unused_card", None, "strong")),
    ],
)
def test_each_rule_fires(spark, cards, rows, expected):
    assert expected in rules(V.validate_matrix(spark.createDataFrame(rows, OUTCOME), cards))


def test_training_reads_the_texts_for_row_rules_once(outcomes, cards, monkeypatch):
    """Row rules are checked over all rows before the split, and not again for each split; all other rules are."""
    from waypost.plans import train

    calls, own = [], V.row_violations
    for module in (V, train):
        monkeypatch.setattr(module, "row_violations", lambda df, **options: calls.append(df) or own(df, **options))
    train.train_router(outcomes, cards, dimension=16, backend="gradient", gradient_epochs=1)
    assert len(calls) == 1
    assert rules(V.validate_matrix(outcomes.limit(1), cards, rows_checked=True)) != set()


def test_request_with_unknown_models_only_lacks_the_whole_pool(spark, cards):
    rows = spark.createDataFrame([("r9", "t", "ghost", True, "train", 0.1, "")], OUTCOME)
    found = rules(V.validate_matrix(rows, cards))
    assert {("missing_cell", "r9", "cheap"), ("missing_cell", "r9", "strong")} <= found


def test_heldout_token_rules(spark, cards):
    rows = [
        ("a", "t", "cheap", True, 0.1, "g", 10, None),
        ("a", "t", "strong", True, 0.1, "g", 10, 5),
        ("b", "t", "cheap", True, 0.1, "g", -1, 5),
        ("b", "t", "strong", True, 0.1, "g", -1, 5),
        ("c", "t", "cheap", True, 0.1, "g", None, None),
        ("c", "t", "strong", True, 0.1, "g", None, None),
    ]
    found = rules(V.validate_matrix(spark.createDataFrame(rows, HELDOUT), cards, heldout=True))
    assert found == {
        ("token_pair", "a", "cheap"),
        ("tokens_disagree", "a", None),
        ("negative_tokens", "b", "cheap"),
        ("negative_tokens", "b", "strong"),
    }


def test_card_rules(spark):
    bad = spark.createDataFrame(
        [
            (" ", "", None, None, None, None, [], {}),
            ("a", "", None, None, None, 0, [], {}),
            ("b", "", -1.0, None, None, None, [], {}),
            ("c", "", None, float("nan"), None, None, [], {}),
            ("d", "", None, None, None, None, [], {}),
            ("d", "", None, None, None, None, [], {}),
        ],
        CARD,
    )
    found = {(r["rule"], r["model"]) for r in V.card_violations(bad).collect()}
    assert found == {("card_name", " "), ("card_context", "a"), ("card_cost", "b"), ("card_cost", "c"), ("card_duplicate", "d")}


def test_require_raises_with_an_example(spark, cards):
    with pytest.raises(ValueError, match="missing_cell"):
        V.require(V.validate_matrix(spark.createDataFrame(GOOD[:1], OUTCOME), cards), "bad")


def test_scalar_arguments():
    with pytest.raises(ValueError):
        V.check_route_arguments(mode="fast")
    with pytest.raises(ValueError):
        V.check_route_arguments(input_tokens=-1)
    with pytest.raises(ValueError):
        V.check_route_arguments(max_quality_drop=2)
    with pytest.raises(ValueError):
        V.check_evaluation_arguments([], input_tokens=None, output_tokens=None, bootstrap_samples=1)
    with pytest.raises(ValueError):
        V.check_evaluation_arguments(["cost"], input_tokens=1, output_tokens=None, bootstrap_samples=1)
    with pytest.raises(ValueError):
        V.check_evaluation_arguments(["cost"], input_tokens=None, output_tokens=None, bootstrap_samples=0)
    assert V.check_evaluation_arguments(["cost", "cost"], input_tokens=1, output_tokens=1, bootstrap_samples=1) == ["cost"]
