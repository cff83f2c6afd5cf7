"""Model switches of conversations whose turns arrive out of order, with state that ends.

A turn waits in the state until the watermark has passed its event time; then all that are due are released in the
order of turns. What a conversation keeps is its waiting turns, its last released turn, its counts, and one timer.
When nothing waits, the timer ends the conversation's state once the watermark is `idle` past its last released event.
A turn later than that begins anew also where the state still stands, so results do not hang on how rows are batched.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waypost.streaming.switches import OUTPUT

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = [field.split(" ")[0] for field in OUTPUT.split(", ")]


def set_provider(spark: SparkSession, provider: str | None) -> str | None:
    """Set what keeps streaming state (these streams need ROCKSDB) and return the setting before; none unsets it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if provider is None:
        spark.conf.unset(key)
    else:
        spark.conf.set(key, provider)
    return before


class OrderedSwitches(StatefulProcessor):
    """Holds back each conversation's turns until they are due."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "turn bigint", "model string, event_ms bigint")
        self.last = handle.getValueState("last", "turn bigint, model string, steps bigint, switches bigint, event_ms bigint")
        self.routes = handle.getMapState("routes", "model string", "routes bigint")
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        released = last[0] if last else None
        late, first = [], None
        for frame in rows:
            for turn, model, event_ms in zip(frame["turn"].tolist(), frame["model"].tolist(), frame["event_ms"].tolist()):
                ended = last is not None and event_ms > last[4] + self.idle_ms
                if (released is not None and turn <= released and not ended) or self.waiting.containsKey((turn,)):
                    late.append((turn, model))
                else:
                    self.waiting.updateValue((turn,), (model, event_ms))
                    first = event_ms if first is None else min(first, event_ms)
        if first is not None:
            self._wake(first, sooner=True)
        if late:
            previous, steps, switches = (None, last[2], last[3]) if last else (None, 0, 0)
            yield self._frame([(key[0], t, m, previous, False, steps, switches, True, None) for t, m in sorted(late)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        held = [(k[0], v[0], v[1]) for k, v in self.waiting.iterator()]
        due = sorted(x for x in held if x[2] <= now)
        ahead = [x[2] for x in held if x[2] > now]
        last = self.last.get()
        turn, model, steps, switches, newest = last if last else (None, None, 0, 0, due[0][2] if due else now)
        out, counts = [], {}
        for number, name, event_ms in due:
            self.waiting.removeKey((number,))
            if event_ms > newest + self.idle_ms:
                turn, model, steps, switches, counts = None, None, 0, 0, {}
                self.routes.clear()
            newest = max(newest, event_ms)
            if turn is not None and number <= turn:
                # A lower turn with a later time than one already released.
                out.append((key[0], number, name, None, False, steps, switches, True, None))
                continue
            switched = model is not None and model != name
            steps, switches = steps + 1, switches + switched
            out.append((key[0], number, name, model, switched, steps, switches, False, None))
            counts[name] = counts.get(name, 0) + 1
            turn, model = number, name
        if due:
            self.last.update((turn, model, steps, switches, newest))
            for name, n in counts.items():
                before = self.routes.getValue((name,)) if self.routes.containsKey((name,)) else (0,)
                self.routes.updateValue((name,), (before[0] + n,))
        tally = {k[0]: int(v[0]) for k, v in self.routes.iterator()} if counts else None
        if ahead:
            self._wake(min(ahead), sooner=False)
        elif newest + self.idle_ms > now:
            self._wake(newest + self.idle_ms, sooner=False)
        else:
            for state in (self.waiting, self.last, self.routes):
                state.clear()
        if out:
            if tally:
                place = max(i for i, row in enumerate(out) if not row[7])
                out[place] = (*out[place][:8], tally)
            yield self._frame(out)

    def _wake(self, at_ms: int, *, sooner: bool) -> None:
        """One timer per conversation: at the given time, or earlier if one is set and `sooner` says to keep the earlier."""
        now = self.timer.get()
        if now is not None:
            if sooner and now[0] <= at_ms and self.last.get() is None:
                return
            self.handle.deleteTimer(now[0])
            at_ms = min(now[0], at_ms) if sooner else at_ms
        self.handle.registerTimer(at_ms)
        self.timer.update((at_ms,))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({name: list(values) for name, values in zip(COLUMNS, zip(*rows))}, columns=COLUMNS)

    def close(self) -> None:
        pass


def ordered_switch_stream(decisions: DataFrame, *, time: str = "ts", delay: str = "10 minutes", idle: timedelta = timedelta(days=1)) -> DataFrame:
    """Stream of (conv_id, turn, model, event time) with previous model, switch flag and counts, turns in order.

    A turn is given out when the watermark, `delay` behind the newest event time of the stream, has passed its time. A
    turn at or below the last released one, or already waiting, is flagged late and changes nothing; one that comes
    behind the watermark is dropped by Spark and counted as `numRowsDroppedByWatermark` in the query's progress. The
    last row that a conversation releases at once carries its route counts. A conversation that goes on after `idle`
    begins anew, with its counts. Rows without conv_id, turn or time are errors.
    """
    needed = {c: F.col(c) for c in ("conv_id", "turn")} | {"event_ms": F.unix_millis(F.col(time))}
    checked = [
        F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"a decision lacks {name}"))).alias(name) for name, value in needed.items()
    ]
    timed = decisions.withWatermark(time, delay).select(*checked, "model")
    return timed.groupBy("conv_id").transformWithStateInPandas(
        OrderedSwitches(int(idle.total_seconds() * 1000)), OUTPUT, "Append", "EventTime"
    )
