import pytest
from pyspark.sql import functions as F

from waypost import context_tokens, render_prefixes, route_conversations, route_counts, switch_counts
from waypost.schema import TURN


@pytest.fixture(scope="module")
def parser_fix(spark):
    rows = [
        ("c", 0, "system", "policy", []),
        ("c", 1, "user", "Fix parser.py. Why does it fail?", []),
        ("c", 2, "assistant", "<think>private reasoning</think>Visible note", [("bash", '{"command":"pytest -q"}')]),
        ("c", 3, "tool", "<returncode>1</returncode><output>failed</output>", []),
        ("c", 4, "assistant", "next", []),
    ]
    return spark.createDataFrame(rows, TURN)


def test_prefix_hides_private_blocks_and_counts(parser_fix):
    row = render_prefixes(parser_fix).filter("turn = 4").first()
    summary = row.prefix_summary
    assert "private reasoning" not in row.text and "Visible note" in row.text and "pytest -q" in row.text
    assert (summary.step_index, summary.message_count, summary.tool_call_count, summary.tool_result_count) == (1, 4, 1, 1)
    assert summary.recent_nonzero_returncodes == 1 and summary.has_code_hint and summary.has_question_hint
    assert row.text.startswith("ROUTER_METADATA __step_bucket_0 __message_bucket_0 __context_bucket_0 __tool_calls_1 ")


def test_long_message_is_bounded(spark):
    df = spark.createDataFrame([("c", 0, "user", "x" * 50000, []), ("c", 1, "assistant", "", [])], TURN)
    row = render_prefixes(df).first()
    assert "[ROUTER INPUT ELIDED]" in row.text and len(row.text) < 17000
    assert row.prefix_summary.original_request_chars == 50000
    assert row.prefix_summary.approximate_context_tokens == (50000 + 4 + 3) // 4


def test_null_content_unclosed_block_and_unusable_calls(spark):
    rows = [
        ("c", 0, "user", None, [None, ("f", None)]),
        ("c", 1, "user", "shown <ANALYSIS>hidden to the end", []),
        ("c", 2, "assistant", "", []),
    ]
    row = render_prefixes(spark.createDataFrame(rows, TURN)).first()
    assert "RECENT_ROLE_USER\nnull" in row.text and "RECENT_TOOL_CALL\nf()" in row.text
    assert "hidden" not in row.text and row.prefix_summary.tool_call_count == 2


def test_first_turn_is_no_step(spark):
    df = spark.createDataFrame([("c", 0, "assistant", "hello", []), ("c", 1, "assistant", "again", [])], TURN)
    assert [r.turn for r in render_prefixes(df).collect()] == [1]


@pytest.fixture(scope="module")
def long_turns(spark):
    """One conversation holds most turns; some turns carry several return codes."""
    rows = []
    for conv, count in (("hot", 61), ("b", 7), ("c", 2)):
        for t in range(count):
            role = ("user", "assistant", "tool")[t % 3] if t else "system"
            codes = "".join(f"<returncode>{(t + i) % 3}</returncode>" for i in range(t % 4)) if role == "tool" and t > 10 else ""
            rows.append((conv, t * 5, role, f"turn {t} of {conv} {codes}", [("go", str(t))] if t % 5 == 2 else []))
    return spark.createDataFrame(rows, TURN).persist()


def test_slices_do_not_change_prefixes(long_turns):
    def run(width):
        return {(r.conv_id, r.turn): (r.text, r.prefix_summary) for r in render_prefixes(long_turns, slice_turns=width).collect()}

    whole = run(100_000)
    assert len(whole) > 20
    for width in (1, 7, 40):
        assert run(width) == whole


def test_context_tokens(spark):
    df = spark.createDataFrame([("c", 0, "user", "12345", []), ("d", 0, "", "", [])], TURN)
    assert {r.conv_id: r.context_tokens for r in context_tokens(df).collect()} == {"c": 3, "d": 1}


def test_switches_follow_the_models(spark, model, long_turns):
    allowed = F.when(F.col("turn") % 2 == 0, F.array(F.lit("cheap"))).otherwise(F.array(F.lit("strong")))

    def run(width):
        routed = route_conversations(
            long_turns, model, slice_turns=width, mode="cost", allowed_models=allowed, allow_ungated_policy=True, output_tokens=200
        )
        return routed.persist()

    routed = run(100_000)
    rows = routed.orderBy("conv_id", "turn").collect()
    last = {}
    for r in rows:
        assert r.previous_model == last.get(r.conv_id)
        assert r.switched == (r.previous_model is not None and r.previous_model != r.decision.selected_model)
        assert r.selected_provider == {"cheap": "local", "strong": "remote"}[r.decision.selected_model]
        assert r.input_tokens_for_cost == r.prefix_summary.approximate_context_tokens and r.output_tokens_for_cost == 200
        last[r.conv_id] = r.decision.selected_model
    sliced = run(9)
    key = lambda df: {(r.conv_id, r.turn, r.previous_model, r.switched) for r in df.collect()}
    assert key(sliced) == key(routed)
    counts = {(r.conv_id, r.model): r.routes for r in route_counts(routed, model.models).collect()}
    assert counts[("b", "cheap")] + counts[("b", "strong")] == sum(r.conv_id == "b" for r in rows)
    switches = {r.conv_id: (r.steps, r.switch_count) for r in switch_counts(routed).collect()}
    assert switches["hot"] == (sum(r.conv_id == "hot" for r in rows), sum(r.switched for r in rows if r.conv_id == "hot"))


def test_agent_step_with_required_tool_and_token_override(spark, model):
    rows = [
        ("c", 0, "system", "You are a tool-using agent.", []),
        ("c", 1, "user", "Prove a hard theorem with a tool.", []),
        ("c", 2, "assistant", "", []),
    ]
    turns = spark.createDataFrame(rows, TURN)
    step = route_conversations(turns, model, required_capabilities=["tools"], output_tokens=200).first()
    assert step.decision.selected_model == "strong" and step.selected_provider == "remote"
    assert step.decision.rejected == {"cheap": ["missing_capability"]} and step.step_index == 0 and step.input_tokens_for_cost > 0
    fixed = route_conversations(turns, model, input_tokens=123).first()
    assert fixed.input_tokens_for_cost == 123 and fixed.previous_model is None and not fixed.switched
