"""Traces from a stream of messages: the batch fold over keyed state that lives between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from braidline.operators.trace_fold import LISTS, MAPS, TraceFold
from braidline.sources.trajectories import COLUMNS, TRACE, fold_rows, judged

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Stored:
    """A session's state in a state store: the keys that a micro-batch touches are read once and written once, at its end."""

    def __init__(self, maps: dict[str, Any], lists: dict[str, Any]) -> None:
        self.maps, self.lists = maps, lists
        self.read: dict[tuple[str, str], Any] = {}
        self.written: set[tuple[str, str]] = set()
        self.absent: set[tuple[str, str]] = set()
        self.added: dict[str, list] = {}
        self.cleared: set[str] = set()
        self.held: dict[str, list] = {}

    def get(self, name: str, key: str) -> Any:
        if (name, key) not in self.read:
            found = self.maps[name].getValue((key,))
            self.read[name, key] = None if found is None else json.loads(found[0])
        return self.read[name, key]

    def put(self, name: str, key: str, value: Any, fresh: bool = False) -> None:
        """fresh: the caller knows that the store has no such key."""
        if fresh or self.read.get((name, key), "") is None and (name, key) not in self.written:
            self.absent.add((name, key))
        self.read[name, key] = value
        self.written.add((name, key))

    def drop(self, name: str, key: str) -> None:
        self.put(name, key, None)

    def items(self, name: str) -> list:
        if name not in self.held:
            self.held[name] = [] if name in self.cleared else [json.loads(v[0]) for v in self.lists[name].get()]
        return [*self.held[name], *self.added.get(name, [])]

    def append(self, name: str, value: Any) -> None:
        self.added.setdefault(name, []).append(value)

    def clear(self, name: str) -> None:
        self.cleared.add(name)
        self.held[name] = []
        self.added.pop(name, None)

    def flush(self) -> None:
        for name, key in sorted(self.written):
            value = self.read[name, key]
            if value is not None:
                self.maps[name].updateValue((key,), (json.dumps(value, ensure_ascii=False),))
            elif (name, key) not in self.absent:  # what came and went within a micro-batch was never stored
                self.maps[name].removeKey((key,))
        for name in sorted(self.cleared):
            self.lists[name].clear()
        for name, values in self.added.items():
            self.lists[name].appendList([(json.dumps(v, ensure_ascii=False),) for v in values])

    def end(self) -> None:
        for state in (*self.maps.values(), *self.lists.values()):
            state.clear()


class Traced(StatefulProcessor):
    """Folds the messages of a session in order of ordinal, whatever order they come in.

    Messages wait in a map until all before them are there. Timers: `wait` ms after the last message, messages that still wait for a gap are taken
    without it; `idle` ms after the last message the session has ended and its state goes. `ttl` ms after an operation last succeeded, that
    success is forgotten. A message that comes after its place was passed gives a row of kind `late` and changes nothing; one that repeats
    a taken message does so too.
    """

    def __init__(self, horizon: int | None, wait: int | None, idle: int | None, ttl: int | None) -> None:
        self.horizon, self.wait, self.idle, self.ttl = horizon, wait, idle, ttl
        self.timed = wait is not None or idle is not None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.maps = {name: handle.getMapState(name, "key string", "value string", self.ttl if name == "ok" else None) for name in MAPS}
        self.lists = {name: handle.getListState(name, "value string") for name in LISTS}
        self.waiting = handle.getMapState("waiting", "ordinal bigint", "message string, failed boolean, meaning string")
        self.next = handle.getValueState("next", "ordinal bigint, waiting bigint, last bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, waiting, _ = (self.next.get() if self.next.exists() else None) or (1, 0, 0)
        late, new = [], {}
        for part in rows:
            for ordinal, message, failed, meaning in part[["ordinal", "message", "failed", "meaning"]].itertuples(index=False):
                if int(ordinal) < due:
                    late.append(int(ordinal))
                else:
                    new[int(ordinal)] = (message, bool(failed), meaning)
        yield self._take(key[0], int(due), int(waiting), new, late, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, waiting, last = self.next.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        out = pd.DataFrame(columns=COLUMNS)
        if waiting and self.wait is not None and now >= last + self.wait:
            out = self._take(key[0], int(due), int(waiting), {}, [], int(last), skip=True)
        if self.idle is not None and now >= last + self.idle:
            Stored(self.maps, self.lists).end()
            self.waiting.clear()
            self.next.clear()
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        yield out

    def _take(self, session: str, due: int, waiting: int, new: dict[int, tuple], late: list[int], last: int, skip: bool = False) -> pd.DataFrame:
        """Fold what is due: up to the next gap, or over all gaps. Of the new messages only those that have to wait are stored."""
        store = Stored(self.maps, self.lists)
        fold, rows = TraceFold(session, store, self.horizon), []
        order = iter(sorted(k[0] for k in self.waiting.keys())) if skip else None
        while new or waiting:
            due = next(order) if skip else due
            found = self.waiting.getValue((due,)) if waiting else None
            if found is not None:
                self.waiting.removeKey((due,))
                waiting -= 1
                new.pop(due, None)
            elif due in new:
                found = new.pop(due)
            else:
                break
            rows.append((due, *found))
            due += 1
        for ordinal, message in new.items():
            waiting += not self.waiting.containsKey((ordinal,))
            self.waiting.updateValue((ordinal,), message)
        made = fold_rows(fold, rows)
        made += [(session, "late", *[ordinal if c == "ordinal" else None for c in COLUMNS[2:]]) for ordinal in late]
        store.flush()
        self.next.update((due, waiting, last))
        if not self.timed:
            return pd.DataFrame(made, columns=COLUMNS)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        for after in {self.wait if waiting else None, self.idle} - {None}:
            self.handle.registerTimer(last + after)
        return pd.DataFrame(made, columns=COLUMNS)

    def close(self) -> None:
        pass


def stream_traces(messages: DataFrame, horizon: int | None = None, wait: int | None = None, idle: int | None = None, ttl: int | None = None) -> DataFrame:
    """TRACE rows of a stream (session_id, ordinal, message) in append mode, each once; a session's ordinals run from 1.

    State is keyed, so a message reads and writes a few keys however long its session is; it needs the RocksDB state store, which is set here for
    the session. See Traced for timers and TTL (milliseconds of processing time; none unless given), TraceFold for the horizon. Without
    a horizon, what is kept of answered calls grows with the session, on disk.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = judged(messages).select("session_id", "ordinal", "message", "failed", "meaning").groupBy("session_id")
    # With processing time Spark goes on with empty micro-batches for timers to fire in, so an availableNow trigger would not end.
    mode = "none" if wait is idle is ttl is None else "processingtime"
    return rows.transformWithStateInPandas(Traced(horizon, wait, idle, ttl), TRACE, "append", mode)


def windowed_failures(events: DataFrame, every: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events and failures by type and event-time window; rows later than the watermark are left out, as their windows are closed."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", every), "event_type")
        .agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("bigint")).alias("failures"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "failures")
    )
