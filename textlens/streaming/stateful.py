"""Keyed stream operators with state that ends: transformWithState with value and list state and timers (group J).

Each is a small state machine fed with a key's rows in time order. The batch twin feeds the same machine from a table that Spark
has dealt and sorted by key and time, row by row, so that a key with very many rows takes no more memory than one with few. The
stream keeps the machine's state in the store; a timer ends it when a key has been silent for its time, so that state follows the
keys that are active and not all that ever were. Needs the RocksDB state store, see use_rocksdb().
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Requests of fewer characters (without white space around) are ignored; a change in length by more passes at once.
LEAST_CHARS, CHANGE = 3, 0.15


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class Machine:
    """What a key goes through: `start` is its first state, a tuple; step() takes a row and gives the next state and output rows;
    wake() is called when the time of due() has come, and gives None as the state to forget the key. Times are microseconds."""

    start: tuple
    schema: str  # of the state
    output: str  # columns of the output, without the key

    def step(self, state: tuple, row: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        raise NotImplementedError

    def wake(self, state: tuple) -> tuple[tuple | None, list[tuple]]:
        return None, []


def run_batch(rows: DataFrame, machine: Machine, key: str, time: str, order: str, columns: list[str], until: int | None = None) -> DataFrame:
    """The machine over a table: (key, output). A key's rows come by time, then `order`. A wake-up that is due before the next row's
    time, or not after `until` (microseconds; None: for ever) behind the last row, takes place."""
    kind = rows.schema[key].dataType.simpleString()
    names = [key, *[c.strip().split()[0] for c in machine.output.split(",")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def end(limit: int | None) -> list[tuple]:
            nonlocal state
            out = []
            while state is not None and (due := machine.due(state)) is not None and (limit is None or due <= limit):
                state, rows_ = machine.wake(state)
                out += [(now, *r) for r in rows_]
            return out

        for batch in batches:
            out = []
            for k, t, row in zip(batch[key].tolist(), _micros(batch[time]), batch[[order, *columns]].itertuples(index=False, name=None), strict=True):
                if k != now:
                    out += end(until)
                    now, state = k, None
                else:
                    out += end(t)
                state, found = machine.step(machine.start if state is None else state, (t, *row))
                out += [(k, *r) for r in found]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(end(until), columns=names)

    dealt = rows.where(rows[key].isNotNull()).select(key, time, order, *columns).repartition(key).sortWithinPartitions(key, time, order)
    return dealt.mapInPandas(run, f"{key} {kind}, {machine.output}")


class _Processor(StatefulProcessor):
    """A machine behind the store: a value of state and a timer for each key; with `held`, its columns, also a list of the rows that
    the watermark hasn't passed, which wait there to be taken in time order."""

    def __init__(self, machine: Machine, names: list[str], time: str, columns: list[str], held: str | None, event_time: bool):
        self.machine, self.names, self.time, self.columns, self.columns_held, self.event_time = machine, names, time, columns, held, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.machine.schema)
        self.held = handle.getListState("held", self.columns_held) if self.columns_held else None

    def _clock(self, timers) -> int:
        """The end of the millisecond up to which time has passed."""
        return 1000 * (timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()) + 999

    def _wake(self, state: tuple | None, until: int, out: list[tuple]) -> tuple | None:
        while state is not None and (due := self.machine.due(state)) is not None and due <= until:
            state, found = self.machine.wake(state)
            out += found
        return state

    def _take(self, rows: list[tuple], timers) -> list[tuple]:
        """Steps through rows in time order, then wakes what is due; rows beyond the clock wait if there is a list for them."""
        now, out = self._clock(timers), []
        state = tuple(self.state.get()) if self.state.exists() else None
        waiting = []
        if self.held is not None:
            rows = [tuple(r) for r in self.held.get()] + rows if self.held.exists() else rows
            waiting = [r for r in rows if r[0] > now]
            rows = [r for r in rows if r[0] <= now]
            self.held.put(waiting) if waiting else self.held.clear()
        for row in sorted(rows, key=lambda r: r[:2]):
            state = self._wake(state, row[0], out)
            state, found = self.machine.step(self.machine.start if state is None else state, row)
            out += found
        state = self._wake(state, now, out)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        ends = [r[0] for r in waiting] + ([due] if state is not None and (due := self.machine.due(state)) is not None else [])
        if ends:  # the millisecond in which the first is over, one that is still to come
            self.handle.registerTimer(max(-(-min(ends) // 1000), now // 1000 + 1))
        return out

    def _out(self, key: Any, found: list[tuple]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(*key, *r) for r in found], columns=self.names)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        times = _micros(batch[self.time]) if self.event_time else [self._clock(timerValues)] * len(batch)
        yield from self._out(key, self._take(list(zip(times, *[batch[c].tolist() for c in self.columns], strict=True)), timerValues))

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._out(key, self._take([], timerValues))

    def close(self) -> None:
        pass


def run_stream(rows: DataFrame, machine: Machine, key: str, time: str, order: str, columns: list[str], watermark: str = WATERMARK, event_time: bool = True, ordered: bool = False, mode: str = "append") -> DataFrame:
    """The machine over a stream: (key, output). Rows of a micro-batch are taken in time order, later batches as they come; with
    `ordered` a row waits until the watermark has passed it, so that the output is the batch twin's whatever the order of arrival.
    Times are those of the rows, and timers wait for the watermark, or (event_time=False) both are the processor's clock."""
    use_rocksdb(rows.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [key, *[c.strip().split()[0] for c in machine.output.split(",")]]
    known = rows.where(rows[key].isNotNull()).withWatermark(time, watermark)
    held = ", ".join(["at bigint", *[f"{c} {types[c]}" for c in [order, *columns]]]) if ordered and event_time else None
    processor = _Processor(machine, names, time, [order, *columns], held, event_time)
    return known.groupBy(key).transformWithStateInPandas(processor, f"{key} {types[key]}, {machine.output}", mode, "EventTime" if event_time else "ProcessingTime")


class Debounce(Machine):
    """Of a burst of requests only the last passes, when `gap` has gone by without another; one whose length differs from that of the
    text passed last by more than CHANGE passes at once; one equal to the text passed last, or of fewer than LEAST_CHARS characters,
    never passes. Each request ends what was waiting. After `forget` without a request the key's last text is forgotten."""

    start = (None, None, None, 0)
    schema = "last string, waiting string, number bigint, at bigint"
    output = "number bigint, reason string"

    def __init__(self, gap: int, forget: int):
        self.gap, self.forget = gap, forget

    def step(self, state, row):
        last = state[0]
        at, number, text = row
        text = (text or "").strip()
        if len(text) < LEAST_CHARS or text == last:
            return (last, None, None, at), []
        size = len(last or "")
        if abs(len(text) - size) > CHANGE * max(1, size):
            return (text, None, None, at), [(number, "length")]
        return (last, text, number, at), []

    def due(self, state):
        return state[3] + (self.forget if state[2] is None else self.gap)

    def wake(self, state):
        if state[2] is None:
            return None, []
        return (state[1], None, None, state[3]), [(state[2], "burst_end")]


class RateLimit(Machine):
    """At most `most` requests of a key in a window that begins with the first request after the last window; those beyond are excess,
    aren't counted, and learn after how many seconds the window is over. The key is forgotten with its window."""

    start = (None, 0)
    schema = "reset bigint, n bigint"
    output = "number bigint, excess boolean, retry_after bigint"

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most

    def step(self, state, row):
        at, number = row
        reset, n = state
        if reset is None or at > reset:
            reset, n = at + self.window, 0
        if n >= self.most:
            return (reset, n), [(number, True, -(-(reset - at) // 1_000_000))]
        return (reset, n + 1), [(number, False, 0)]

    def due(self, state):
        return None if state[0] is None else state[0] + 1


class UserState(Machine):
    """The last event of a user; a removal, or `ttl` without an event, takes the user away. Output: an update for each row, and a
    removal (null event) at the end of its time."""

    start = (None, None)
    schema = "event string, at bigint"
    output = "at bigint, event string"

    def __init__(self, ttl: int, removals: tuple[str, ...] = ("error",)):
        self.ttl, self.removals = ttl, removals

    def step(self, state, row):
        at, _, event = row
        if event in self.removals:
            return None, [(at, None)]
        return (event, at), [(at, event)]

    def due(self, state):
        return None if state[1] is None else state[1] + self.ttl + 1

    def wake(self, state):
        return None, [(state[1] + self.ttl, None)]


class StatusChanges(Machine):
    """Whether a check differs from the one before it, and whether the domain became available; forgotten after `ttl` without a check."""

    start = (None, None, None)
    schema = "is_up boolean, registered boolean, at bigint"
    output = "event_id bigint, changed boolean, became_available boolean"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def step(self, state, row):
        at, number, is_up, registered = row
        known = state[2] is not None
        changed = known and (state[0] != is_up or state[1] != registered)
        return (bool(is_up), bool(registered), at), [(number, bool(changed), bool(known and state[1] and not registered))]

    def due(self, state):
        return None if state[2] is None else state[2] + self.ttl


class Reuse(Machine):
    """Of requests with one key (a text's digest) the first is answered anew, those within its time for reuse again; the time depends
    on the text's length, as in dedupe_texts_batch()."""

    start = (None, None)
    schema = "until bigint, first bigint"
    output = "number bigint, answered_by bigint"

    def step(self, state, row):
        at, number, chars = row
        if state[0] is not None and at < state[0]:
            return state, [(number, state[1])]
        seconds = 7200 if chars < 1000 else 3600 if chars <= 10000 else 1800
        return (at + seconds * 1_000_000, number), [(number, number)]

    def due(self, state):
        return state[0]

