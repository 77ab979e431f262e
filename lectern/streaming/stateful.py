"""Operators with state of their own that keep what comes too late.

Spark's windowed operators drop a row that is older than the watermark. These give such rows
out as data, marked ``late``, next to what they close, so that a batch step can merge them
(``lectern.streaming.feeds``). State is held per key in the state store and is bounded by the
delay of the watermark: whatever the watermark has passed is given out and forgotten.

Times are microseconds; the watermark and timers are milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.replay import INITIAL, TRANSITIONS

MILLI = 1000


def _timer_at(micros: int) -> int:
    """The first millisecond that is not before a time."""
    return -(-int(micros) // MILLI)


class _Processor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass

    def wake_at(self, micros: int, watermark: int) -> None:
        """A timer at a time, or as soon as the watermark moves on."""
        self.handle.registerTimer(max(_timer_at(micros), watermark + 1))


class WindowCounts(_Processor):
    """Sums per window; a window is given out once, as the watermark passes its end.

    Keys are (window_start, window_end), rows are partial sums; sums for a window that was
    given out are ``late``. Open windows are in the state ``counts``.
    """

    SUMS = ("attempts", "failures", "retries")
    SCHEMA = ("window_start bigint, window_end bigint, attempts bigint, failures bigint, "
              "retries bigint, kind string")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getValueState("counts", ", ".join(f"{x} bigint" for x in self.SUMS))

    def _row(self, key: tuple, sums: list[int], kind: str) -> pd.DataFrame:
        return pd.DataFrame([(*key, *sums, kind)],
                            columns=["window_start", "window_end", *self.SUMS, "kind"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sums = [0] * len(self.SUMS)
        for part in rows:
            sums = [have + int(part[name].sum()) for have, name in zip(sums, self.SUMS)]
        watermark = timerValues.getCurrentWatermarkInMs()
        if key[1] <= watermark * MILLI:
            yield self._row(key, sums, "late")
            return
        if self.counts.exists():
            sums = [have + more for have, more in zip(self.counts.get(), sums)]
        else:
            self.wake_at(key[1], watermark)
        self.counts.update(tuple(sums))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counts.exists():
            yield self._row(key, list(self.counts.get()), "closed")
            self.counts.clear()


class Sessions(_Processor):
    """Stretches of signs of life that end ``lease`` after their last one.

    A session is given out once, as the watermark passes its end; a sign of life whose own
    lease has passed by then is ``late``, a session by itself. Open ones are in the state
    ``open``.
    """

    SCHEMA = "fragment_id bigint, started bigint, last bigint, beats bigint, kind string"

    def __init__(self, lease: int) -> None:
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "started bigint, last bigint, beats bigint")

    def _rows(self, key: tuple, sessions: list[tuple], kind: str) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *session, kind) for session in sessions],
                            columns=["fragment_id", "started", "last", "beats", "kind"])

    def _keep(self, sessions: list[tuple], watermark: int) -> None:
        if sessions:
            self.open.put(sessions)
            self.wake_at(min(last for _, last, _ in sessions) + self.lease, watermark)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        times = [int(x) for part in rows for x in part["at"]]
        late = [(x, x, 1) for x in times if x + self.lease <= watermark * MILLI]
        if late:
            yield self._rows(key, late, "late")
        held = [tuple(map(int, x)) for x in self.open.get()] if self.open.exists() else []
        new = [(x, x, 1) for x in times if x + self.lease > watermark * MILLI]
        merged: list[tuple] = []
        for started, last, beats in sorted(held + new):
            if merged and started < merged[-1][1] + self.lease:
                before = merged.pop()
                merged.append((before[0], max(before[1], last), before[2] + beats))
            else:
                merged.append((started, last, beats))
        self._keep(merged, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(map(int, x)) for x in self.open.get()] if self.open.exists() else []
        closed = [x for x in held if x[1] + self.lease <= watermark * MILLI]
        if closed:
            yield self._rows(key, closed, "closed")
        self._keep([x for x in held if x[1] + self.lease > watermark * MILLI], watermark)


class Deliveries(_Processor):
    """The first delivery of every key; keys are dealt into buckets, which hold many each.

    A key is remembered until the watermark passes its time and the delay once more. Rows
    older than the watermark are ``late``: whether their key came before is not known here.
    """

    def __init__(self, keys: list[str], kinds: list[str], delay: int) -> None:
        self.keys, self.kinds, self.delay = keys, kinds, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        fields = ", ".join(f"{name} {kind}" for name, kind in zip(self.keys, self.kinds))
        self.seen = handle.getListState("seen", f"{fields}, at bigint")

    def _held(self, watermark: int) -> list[tuple]:
        held = map(tuple, self.seen.get()) if self.seen.exists() else ()
        return [x for x in held if x[-1] + self.delay > watermark * MILLI]

    def _keep(self, held: list[tuple], watermark: int) -> None:
        if held:
            self.seen.put(held)
            self.wake_at(min(x[-1] for x in held) + self.delay, watermark)
        else:
            self.seen.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = self._held(watermark)
        known = {x[:-1] for x in held}
        for part in rows:
            part = part.drop(columns=["bucket"])
            late = part["at"] <= watermark * MILLI
            if late.any():
                yield part[late].assign(kind="late")
            on_time = part[~late].drop_duplicates(self.keys)
            ids = list(on_time[self.keys].itertuples(index=False, name=None))
            new = [x not in known for x in ids]
            if any(new):
                first = on_time[new]
                yield first.assign(kind="first")
                fresh = [(*x, int(at)) for x, at, is_new in zip(ids, on_time["at"], new) if is_new]
                known.update(x[:-1] for x in fresh)
                held.extend(fresh)
        self._keep(held, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self._keep(self._held(watermark), watermark)
        yield from ()


class Replay(_Processor):
    """The state machine of fragments, fed in whatever order events come.

    Events wait in ``pending``, those of a batch in one entry of arrays, as every entry is
    converted by itself, until the watermark passes them and are then judged in order against
    the state in ``folded``. An event that belongs before one already judged is
    ``late`` and left out: the fragment is past it. A fragment without events for ``ttl`` is
    forgotten; should it come back, its first event is marked ``begins`` once more.

    It takes and gives rows, as a frame for every fragment costs more than its few rows, and
    asks the state store, whose every answer is a message, no more than it has to.
    """

    COLUMNS = ["fragment_id", "event_id", "at", "action", "from_state", "to_state", "legal",
               "begins", "kind"]
    OUT = Row(*COLUMNS)
    SCHEMA = ("fragment_id bigint, event_id bigint, at bigint, action string, from_state string, "
              "to_state string, legal boolean, begins boolean, kind string")

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.folded = handle.getValueState("folded", "state string, at bigint, event_id bigint")
        self.pending = handle.getListState(
            "pending", "at array<bigint>, event_id array<bigint>, action array<string>")

    def _waiting(self) -> list[tuple]:
        return [event for entry in self.pending.get() for event in zip(*entry)]

    def _settle(
        self, key: tuple, known: tuple | None, events: list[tuple], watermark: int
    ) -> list[Row]:
        """Judge what the watermark has passed and keep the rest; the rows given out."""
        state, last = (known[0], (int(known[1]), int(known[2]))) if known else (INITIAL, None)
        out, begins = [], known is None
        events = sorted(events, key=lambda x: x[:2])
        ready = [x for x in events if x[0] <= watermark * MILLI]
        for at, event_id, action in ready:
            moved = TRANSITIONS.get(action, {}).get(state)
            out.append(self.OUT(key[0], event_id, at, action, state, moved or state,
                                moved is not None, begins, "judged"))
            state, last, begins = moved or state, (at, event_id), False
        if ready:
            self.folded.update((state, *last))
        rest = events[len(ready):]
        if rest:
            self.pending.put([tuple(map(list, zip(*rest)))])
            self.wake_at(rest[0][0], watermark)
        else:
            self.pending.clear()
            if last:
                self.wake_at(last[0] + self.ttl, watermark)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        events = [(row["at"], row["event_id"], row["action"]) for row in rows]
        out = []
        known = self.folded.get()
        if known:
            _, at, number = known
            late = [x for x in events if x[:2] <= (at, number)]
            events = [x for x in events if x[:2] > (at, number)]
            out = [self.OUT(key[0], n, at, action, None, None, None, None, "late")
                   for at, n, action in late]
        yield from out
        if not events:
            return
        first = min(event[0] for event in events)
        if first > watermark * MILLI:  # what waits already has its timer
            self.pending.appendValue(tuple(map(list, zip(*events))))
            self.wake_at(first, watermark)
        else:
            yield from self._settle(key, known, events + self._waiting(), watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        events = self._waiting()
        known = self.folded.get()
        if events:
            yield from self._settle(key, known, events, watermark)
        elif known:
            if known[1] + self.ttl <= watermark * MILLI:
                self.folded.clear()
            else:
                self.wake_at(known[1] + self.ttl, watermark)
