import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from waypost import late_rows, ordered_switch_stream, session_monitor, window_monitor, route, route_payload_stream, route_stream, switch_stream
from waypost.streaming.ordered import ROCKSDB, set_provider


def run(query_frame, path):
    (
        query_frame.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp")
        .trigger(availableNow=True).start().awaitTermination()
    )


def test_stream_routes_like_a_batch(spark, model, tmp_path):
    rows = spark.createDataFrame([(str(i), f"prove theorem {i}") for i in range(20)], "id string, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run(route_stream(source, model, mode="quality").select("id", "decision.selected_model"), tmp_path)
    streamed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == {tuple(r) for r in route(rows, model, mode="quality").select("id", "decision.selected_model").collect()}


def test_payload_stream(spark, model, tmp_path):
    rows = spark.createDataFrame([("a", '{"messages":[{"content":"hi"}]}'), ("b", "{")], "id string, payload string")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run(route_payload_stream(source, model).select("id", F.col("decision.error").alias("error")), tmp_path)
    got = {r.id: r.error for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a"] is None and got["b"]


def test_switch_state_carries_over_and_flags_late_turns(spark, tmp_path):
    batches = [
        [("c", 2, "x"), ("c", 0, "x"), ("c", 1, "y"), ("d", 0, "y")],
        [("c", 1, "x"), ("c", 3, "y"), ("c", 3, "x")],
        [("c", 4, "y"), ("d", 5, "x")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "conv_id string, turn bigint, model string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("conv_id string, turn bigint, model string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(switch_stream(source), tmp_path)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    on_time = {(r.conv_id, r.turn): (r.model, r.previous_model, r.switched, r.steps, r.switch_count) for r in rows if not r.late}
    assert on_time == {
        ("c", 0): ("x", None, False, 1, 0),
        ("c", 1): ("y", "x", True, 2, 1),
        ("c", 2): ("x", "y", True, 3, 2),
        ("c", 3): ("y", "x", True, 4, 3),
        ("c", 4): ("y", "y", False, 5, 3),
        ("d", 0): ("y", None, False, 1, 0),
        ("d", 5): ("x", "y", True, 2, 1),
    }
    assert sorted(r.turn for r in rows if r.late) == [1, 3]
    last = [r for r in rows if r.conv_id == "c" and r.turn == 4][0]
    assert last.route_counts == {"x": 2, "y": 3}


TIMED = "conv_id string, turn bigint, model string, s bigint"


def run_ordered(spark, path, batches, **options):
    """Each batch is one file; the rows of the stream, its query and its state tables."""
    for rows in batches:
        timed = spark.createDataFrame(rows, TIMED).select("conv_id", "turn", "model", F.timestamp_seconds("s").alias("ts"))
        timed.coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    before = set_provider(spark, ROCKSDB)
    try:
        run(ordered_switch_stream(source, **options), path)
        state = {
            name: spark.read.format("statestore").option("path", f"{path}/cp").option("stateVarName", name).load().count()
            for name in ("waiting", "last", "routes")
        }
    finally:
        set_provider(spark, before)
    return spark.read.parquet(f"{path}/out").collect(), state


def test_ordered_switches_of_a_shuffled_stream(spark, tmp_path):
    """Turns come several batches late, in any order; the result is that of the ordered table, and the state is gone."""
    rng = random.Random(2)
    rows = [(f"c{c}", t, rng.choice("xyz"), 10**6 + t * 60 + c) for c in range(15) for t in range(rng.randrange(1, 12))]
    expected = {}
    for c in {r[0] for r in rows}:
        previous, switches, counts = None, 0, {}
        for step, (_, t, m, _) in enumerate(sorted(r for r in rows if r[0] == c), 1):
            switched = previous is not None and previous != m
            switches += switched
            counts[m] = counts.get(m, 0) + 1
            expected[c, t] = (m, previous, switched, step, switches)
            previous = m
        expected[c] = counts
    rng.shuffle(rows)
    batches = [*(rows[i::4] for i in range(4)), [("end", 0, "x", 2 * 10**6)]]
    found, state = run_ordered(spark, tmp_path, batches, delay="1 hour", idle=timedelta(hours=1))
    assert not any(r.late for r in found)
    got = {(r.conv_id, r.turn): (r.model, r.previous_model, r.switched, r.steps, r.switch_count) for r in found}
    got |= {r.conv_id: r.route_counts for r in found if r.route_counts}
    assert got == expected
    assert state == {"waiting": 1, "last": 0, "routes": 0}  # the last event still waits


def test_ordered_switches_late_turns_and_idle_conversations(spark, tmp_path):
    batches = [
        [("c", 0, "x", 0), ("c", 2, "y", 100), ("c", 2, "z", 100)],  # a repeated turn
        [("d", 0, "x", 400)],  # the watermark passes turns 0 and 2
        [("c", 1, "x", 390)],  # below a released turn
        [("d", 1, "x", 10_000)],  # conversation c is idle for long
        [("c", 7, "z", 10_500), ("d", 2, "x", 20_000)],
        [("d", 3, "x", 90_000)],
    ]
    found, state = run_ordered(spark, tmp_path, batches, delay="1 minute", idle=timedelta(minutes=30))
    rows = {(r.conv_id, r.turn, r.late): (r.model, r.previous_model, r.steps, r.switch_count, r.route_counts) for r in found}
    assert rows["c", 2, False] == ("y", "x", 2, 1, {"x": 1, "y": 1})
    assert rows["c", 2, True][0] == "z" and rows["c", 1, True][0] == "x"
    assert rows["c", 7, False] == ("z", None, 1, 0, {"z": 1})  # begins anew
    assert state["waiting"] == 1 and state["last"] <= 1


def test_ordered_switches_need_a_time(spark, tmp_path):
    with pytest.raises(Exception, match="lacks"):
        run_ordered(spark, tmp_path, [[("c", 0, "x", None)]])


DECIDED = "conv_id string, s bigint, model string, switched boolean, cost_usd double"


def test_window_monitor_counts_late_rows_apart(spark, tmp_path):
    batches = [
        [("a", 10, "x", False, 1.0), ("a", 50, "y", True, None), ("b", 130, "x", False, 0.5), ("b", 140, None, False, 0.5)],
        [("a", 5000, "z", False, 1.0)],
        [("a", 5005, "x", False, 1.0)],
        [("a", 20, "x", True, 9.0), ("a", 5010, "x", True, 1.0)],  # the first is behind the watermark of the batch before
        [("a", 90_000, "x", False, 1.0)],
    ]
    for rows in batches:
        df = spark.createDataFrame(rows, DECIDED).select("conv_id", F.timestamp_seconds("s").alias("ts"), "model", "switched", "cost_usd")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    windows = window_monitor(source, ["x", "y"], size="2 minutes", delay="1 minute")
    query = windows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert late_rows(query) == 1
    found = {r.start.timestamp(): r for r in spark.read.parquet(str(tmp_path / "out")).select("*").collect()}
    rows = sorted((int(k), r.decisions, r.cost_usd, r.unpriced, r.switches, r.other, [x.routes for x in r.routes]) for k, r in found.items())
    rows = [(k - rows[0][0], *rest) for k, *rest in rows]
    assert rows == [(0, 2, 1.0, 1, 1, 0, [1, 1]), (120, 2, 1.0, 0, 0, 0, [1, 0]), (4920, 3, 3.0, 0, 1, 1, [2, 0])]
    batch = window_monitor(table.filter("cost_usd IS NULL OR cost_usd < 9"), ["x", "y"], size="2 minutes")
    assert {(r.start, r.decisions) for r in batch.collect()} >= {(r.start, r.decisions) for r in found.values()}
    assert [x.share for x in batch.orderBy("start").first().routes] == [0.5, 0.5]
    sessions = session_monitor(table, gap="1 minute").filter("conv_id = 'a'").orderBy("start").collect()
    assert [(r.decisions, r.switches) for r in sessions] == [(3, 2), (3, 1), (1, 0)]
    for bad in ([], ["x", "x"]):
        with pytest.raises(ValueError):
            window_monitor(table, bad, size="1 minute")


DOCUMENT = "doc_id bigint, text string, lang string, n_chars bigint"


def test_routed_stream_reads_a_table_of_several_files(spark, tmp_path):
    from registry.streams import str01

    rows = spark.createDataFrame([(i, f"prove theorem {i}", "en", 16) for i in range(20)], DOCUMENT)
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "single"))
    file = next((tmp_path / "single").glob("part-*.parquet"))
    file.rename(tmp_path / "single" / "documents.parquet")
    found = {name: sorted(map(tuple, str01(spark, str(tmp_path / name)).collect())) for name in ("folder", "single")}
    assert len(found["folder"]) == 20 and found["folder"] == found["single"]


def test_sliding_windows_count_by_the_nearest_second(spark, tmp_path):
    import duckdb

    from registry.queries import ORACLES
    from registry.streams import mon01

    clocks = ["05:59:59.499999", "05:59:59.5", "05:59:59.7", "07:59:58.5", "08:00:00.2", "19:59:59.999999"]
    columns = "event_id bigint, user_id bigint, event_type string, value double, ts timestamp_ntz"
    rows = spark.createDataFrame([(i, i % 2, "view", 1.0 + i, f"2024-01-03 {c}") for i, c in enumerate(clocks)], columns.replace("timestamp_ntz", "string"))
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = mon01(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = con.execute(ORACLES["mon01_sliding_windows"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected) and len(expected) > 0
