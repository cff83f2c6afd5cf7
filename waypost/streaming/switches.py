"""Running model switches per conversation across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = (
    "conv_id string, turn bigint, model string, previous_model string, switched boolean, "
    "steps bigint, switch_count bigint, late boolean, route_counts map<string,bigint>"
)
STATE = "turn bigint, model string, steps bigint, switches bigint, models array<string>, counts array<bigint>"
ROWS_PER_FRAME = 10_000


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.exists:
        last_turn, last_model, steps, switches, names, counts = state.get
        names, counts = list(names), list(counts)
    else:
        last_turn, last_model, steps, switches, names, counts = -1, None, 0, 0, [], []
    # A batch is held as two small arrays: turn numbers and positions in the model list.
    positions = {name: i for i, name in enumerate(names)}
    turns, models = [], []
    for frame in frames:
        for name in frame["model"].unique():
            positions.setdefault(name, len(positions))
        turns.append(frame["turn"].to_numpy(np.int64))
        models.append(frame["model"].map(positions).to_numpy(np.int32))
    turn, model = np.concatenate(turns), np.concatenate(models)
    order = np.argsort(turn, kind="stable")
    turn, model = turn[order], model[order]
    # A turn at or below the last one seen, or repeated in the batch, is late.
    late = turn <= np.maximum(np.concatenate([[-1], turn[:-1]]), last_turn)
    on_time = ~late
    kept = model[on_time]
    start = positions[last_model] if last_model is not None else -1
    before = np.concatenate([[start], kept[:-1]])[: len(kept)]
    changed = (before >= 0) & (before != kept)
    previous = np.full(len(turn), -1)
    previous[on_time] = before
    switched = np.zeros(len(turn), dtype=bool)
    switched[on_time] = changed
    running_steps = steps + np.cumsum(on_time)
    running_switches = switches + np.cumsum(switched)
    names = list(positions)
    totals = np.bincount(kept, minlength=len(names)) + np.array(counts + [0] * (len(names) - len(counts)))
    if len(kept):
        last_turn, last_model = int(turn[on_time][-1]), names[kept[-1]]
        steps, switches = int(running_steps[-1]), int(running_switches[-1])
    state.update((int(last_turn), last_model, steps, switches, names, [int(n) for n in totals]))
    tally = {name: int(n) for name, n in zip(names, totals) if n}
    for begin in range(0, len(turn), ROWS_PER_FRAME):
        part = slice(begin, min(begin + ROWS_PER_FRAME, len(turn)))
        size = part.stop - part.start
        ends = [None] * size
        if part.stop == len(turn):
            ends[-1] = tally
        yield pd.DataFrame(
            {
                "conv_id": [key[0]] * size,
                "turn": turn[part],
                "model": [names[i] for i in model[part]],
                "previous_model": [names[i] if i >= 0 else None for i in previous[part]],
                "switched": switched[part],
                "steps": running_steps[part],
                "switch_count": running_switches[part],
                "late": late[part],
                "route_counts": ends,
            }
        )


def switch_stream(decisions: DataFrame) -> DataFrame:
    """Stream of (conv_id, turn, model) with the running state of each conversation.

    State is the last turn and model, the step and switch counts, and the routes per
    model. Inside a batch, turns are put in order; a turn not above the last one seen is
    flagged late and changes nothing. The last row of a conversation in a batch carries
    its route counts. What one conversation brings at once is bounded by the batch, so
    give the source a limit such as `maxFilesPerTrigger`.
    """
    return (
        decisions.select("conv_id", "turn", "model")
        .groupBy("conv_id")
        .applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    )
