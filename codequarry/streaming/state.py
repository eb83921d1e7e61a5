"""Keyed state of event streams in named variables: a client's list that latches at the end, and threads that are taken up where they stopped (STM6, STM9, SNK10).

Both keep one small row for each key, whatever passes: they need the RocksDB state store (ROCKSDB), and their query's checkpoint folder is what a
lost run goes on from.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from codequarry.shipping import ship

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Events that end a scan's list (fixed values).
LAST_EVENTS = ["SCAN_COMPLETED", "SCAN_FAILED"]


class _Client(StatefulProcessor):
    """Lets through what is new: ids above the highest so far, up to the event that ends the list."""

    def __init__(self, names: list[str], keep_ms: int | None):
        self.names, self.keep_ms = names, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "last long, ended boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, ended = tuple(self.mark.get()) if self.mark.exists() else (-1, False)
        every = pd.concat(list(rows)).sort_values("id", kind="stable").drop_duplicates("id")
        fresh = every[every["id"] > last]
        if ended or not len(fresh):
            return
        ends = fresh["event_type"].isin(LAST_EVENTS).to_numpy().nonzero()[0]
        if len(ends):
            fresh, ended = fresh.iloc[: ends[0] + 1], True
            if self.keep_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        self.mark.update((int(fresh["id"].iloc[-1]), bool(ended)))
        yield fresh[self.names]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.mark.clear()
        return iter(())


def client(stream: DataFrame, key: str = "scan_id", keep_ms: int | None = None) -> DataFrame:
    """STM6: the rows of stream (key, id, event_type and others) that change a client's list.

    Of each key's events those with an id above all before, in order, up to the first that ends the scan; repeated and late ids and whatever follows
    the end change nothing. The state is an id and a mark for each key; with keep_ms a timer drops it that long after the key's end (such a query runs until
    it is stopped, as timers may be due at any time), without it stays.
    """
    ship(stream.sparkSession)
    return stream.groupBy(key).transformWithStateInPandas(_Client(stream.columns, keep_ms), stream.schema, "append", "none" if keep_ms is None else "processingtime")


class _Threads(StatefulProcessor):
    """Takes each thread's steps one after the other."""

    def __init__(self, steps: list[str], key: str):
        self.steps, self.key = steps, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "n long, result string")
        self.ahead = handle.getMapState("ahead", StructType([StructField("step", LongType())]), StructType([StructField("result", StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, so_far = tuple(self.done.get()) if self.done.exists() else (0, "{}")
        for b in rows:
            for step, result in zip(b["step"], b["result"], strict=True):
                at = self.steps.index(step) if step in self.steps else -1
                if at >= n and not self.ahead.containsKey((at,)):  # the first result of a step stays
                    self.ahead.updateValue((at,), (result,))
        before, values = n, json.loads(so_far)
        while n < len(self.steps) and self.ahead.containsKey((n,)):
            values[self.steps[n]] = self.ahead.getValue((n,))[0]
            self.ahead.removeKey((n,))
            n += 1
        if n == before:
            return
        self.done.update((n, json.dumps(values)))
        yield pd.DataFrame({self.key: [key[0]], "done": [n], "next": [self.steps[n] if n < len(self.steps) else None], "finished": [n == len(self.steps)], "result": [json.dumps(values)]})


def threads(stream: DataFrame, steps: list[str], key: str = "thread_id") -> DataFrame:
    """STM9, SNK10: key, done, next, finished, result (JSON of the steps' results) whenever a thread gets on.

    stream: key, step, result. A step counts once those before it are there, results that come early wait, repeated and unknown ones change nothing. A query
    that is started again with the same checkpoint goes on behind the last step of each thread, and says nothing of finished ones.
    """
    ship(stream.sparkSession)
    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).transformWithStateInPandas(_Threads(steps, key), f"{key} {kind}, done long, next string, finished boolean, result string", "update", "none")
