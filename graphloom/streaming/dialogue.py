"""The dialogue of ``graphloom.operators.dialogue`` on a stream of messages, with state and timers by session."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphloom.operators.dialogue import START, STEPS, as_frame, step


class Dialogue(StatefulProcessor):
    """Takes each session from message to message. A session that hears nothing for ``idle_ms`` gives a row with the
    action "closed" and begins anew."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.session.get()[0]) if self.session.exists() else START
        out = []
        # the messages of a session that arrived together, in order
        for m in pd.concat(list(rows)).sort_values(["turn", "text"], kind="stable").itertuples(index=False):
            state, row = step(state, m)
            out.append(row)
        self.session.update((json.dumps(state),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield as_frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = json.loads(self.session.get()[0]) if self.session.exists() else START
        self.session.clear()
        yield as_frame([(key[0], None, None, False, "closed", state["phase"], None, sum(map(len, state["known"].values())), state["n"])])

    def close(self) -> None:
        pass


def steps(messages: DataFrame, idle_ms: int = 30 * 60 * 1000) -> DataFrame:
    """The rows of ``STEPS`` of a stream of messages with signs. The session needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``)."""
    return messages.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=Dialogue(idle_ms), outputStructType=STEPS, outputMode="Append", timeMode="ProcessingTime")
