"""Readiness, errors and performance as state of a stream, a row of state for each key: page sessions, sources, operations.

The rules themselves are small functions over one key's events (settled, ErrorMap, Ring); the stateful processors hand them
what arrives and keep their state in the state store, so a stream picks up where it stopped. The session needs the RocksDB state
store (see options).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a stream with these processors needs to be set in its session.
OPTIONS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
# Quiet window and hard timeout of a page, errors that are held, samples that are held.
STABLE_MS, TIMEOUT_MS, MAX_ERRORS, MAX_SAMPLES = 500, 1000, 100, 100

Event = tuple[int, str]  # milliseconds, kind


def settled(events: list[Event], now: int, stable_ms: int = STABLE_MS, timeout_ms: int = TIMEOUT_MS) -> tuple[int, str, int] | None:
    """When and how a page session settled by `now`: (milliseconds, quality, noise before), or None.

    events begin with the start; visual ones begin the quiet window anew, noise is counted, blocked and unblocked tell whether images
    or placeholders are still awaited. A window that ends while the page is blocked is not tried again before the next visual event.
    At the hard timeout the session settles as DEGRADED, whatever is going on.
    """
    events = sorted(events)
    begin = events[0][0]
    due: int | None = begin + stable_ms
    noise, blocked, last = 0, False, begin + timeout_ms
    for at, kind in [*events, (now + 1, "")]:
        if due is not None and due < min(at, last) and due <= now:
            if not blocked:
                return due, "STABLE" if noise else "OPTIMAL", noise
            due = None
        if last < at or at > now:
            break
        if kind == "visual":
            due = at + stable_ms
        elif kind == "noise":
            noise += 1
        elif kind in ("blocked", "unblocked"):
            blocked = kind == "blocked"
    return (last, "DEGRADED", noise) if last <= now else None


@dataclass
class ErrorMap:
    """Errors by code and message, the one seen longest ago first; a new one beyond the bound drops the first."""

    most: int = MAX_ERRORS
    held: dict[str, list] = field(default_factory=dict)  # key -> count, first and last time

    def track(self, key: str, at: int) -> None:
        n, first, _ = self.held.pop(key, (0, at, at))
        self.held[key] = [n + 1, first, at]
        if len(self.held) > self.most:
            del self.held[next(iter(self.held))]


@dataclass
class Ring:
    """All-time count, sum and extremes, and the last samples."""

    most: int = MAX_SAMPLES
    n: int = 0
    total: float = 0.0
    least: float = float("inf")
    greatest: float = float("-inf")
    last: list[float] = field(default_factory=list)

    def add(self, x: float) -> None:
        self.n, self.total = self.n + 1, self.total + x
        self.least, self.greatest = min(self.least, x), max(self.greatest, x)
        self.last = [*self.last, x][-self.most :]

    def stats(self) -> tuple:
        """n, total, least, most, the spread around the all-time mean and nearest-rank p50, p95 and p99 of the last samples."""
        mean, ordered = self.total / self.n, sorted(self.last)
        rank = lambda p: ordered[max(1, -(-len(ordered) * p // 100)) - 1]
        return self.n, self.total, self.least, self.greatest, (sum((x - mean) ** 2 for x in self.last) / len(self.last)) ** 0.5, rank(50), rank(95), rank(99)


def _ms(at: dt.datetime) -> int:
    return round(at.timestamp() * 1000)


class Readiness(StatefulProcessor):
    """Settles each key's session once. Events wait in state until the watermark has passed them, so late ones count in their place;
    there are no more of them than come within the hard timeout. Timers: when a quiet window may end, and the hard timeout.
    """

    def __init__(self, stable_ms: int = STABLE_MS, timeout_ms: int = TIMEOUT_MS) -> None:
        self.stable_ms, self.timeout_ms = stable_ms, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at long, kind string")
        self.done = handle.getValueState("done", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.done.exists():
            new = [(_ms(r.ts), r.kind) for r in rows]
            begin = min([at for at, _ in new] + [e[0] for e in self.events.get()])
            for at, kind in new:
                if at <= begin + self.timeout_ms:
                    self.events.appendValue((at, kind))
                    self.handle.registerTimer(at + self.stable_ms)
            self.handle.registerTimer(begin + self.timeout_ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.done.exists():
            return
        found = settled([(e[0], e[1]) for e in self.events.get()], expiredTimerInfo.getExpiryTimeInMs(), self.stable_ms, self.timeout_ms)
        if found:
            self.done.update((found[0],))
            self.events.clear()
            yield Row(key=key[0], settled_ms=found[0], quality=found[1], noise=found[2])


class Errors(StatefulProcessor):
    """Each source's errors as they stand after a micro-batch: those that it touched and that are still held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "keys array<string>, counts array<long>, firsts array<long>, lasts array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        errors = ErrorMap()
        if self.held.exists():
            keys, *columns = self.held.get()
            errors.held = {k: list(v) for k, *v in zip(keys, *columns, strict=True)}
        touched = set()
        for at, _, name in sorted((_ms(r.ts), r.seq, r.error) for r in rows):
            errors.track(name, at)
            touched.add(name)
        n, first, last = ([v[i] for v in errors.held.values()] for i in range(3))
        self.held.update(([*errors.held], n, first, last))
        for name in touched & errors.held.keys():
            yield Row(key=key[0], error=name, n=errors.held[name][0], first_ms=errors.held[name][1], last_ms=errors.held[name][2])


class Samples(StatefulProcessor):
    """Each operation's statistics after a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "n long, total double, least double, most double, last array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ring = Ring()
        if self.ring.exists():
            n, total, least, most, last = self.ring.get()
            ring = Ring(n=n, total=total, least=least, greatest=most, last=list(last))
        for _, x in sorted((r.seq, r.value) for r in rows):
            ring.add(x)
        self.ring.update((ring.n, ring.total, ring.least, ring.greatest, ring.last))
        n, total, least, most, spread, p50, p95, p99 = ring.stats()
        yield Row(key=key[0], n=n, total=total, least=least, most=most, spread=spread, p50=p50, p95=p95, p99=p99)


def readiness(events: DataFrame, late: str = "0 seconds", stable_ms: int = STABLE_MS, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """A stream of key, ts and kind (start, visual, noise, blocked, unblocked) as key, settled_ms, quality and noise, once a key, as the watermark passes it."""
    return events.withWatermark("ts", late).groupBy("key").transformWithState(Readiness(stable_ms, timeout_ms), "key string, settled_ms long, quality string, noise long", "append", "eventTime")


def errors(events: DataFrame) -> DataFrame:
    """A stream of key, ts, seq and error as key, error, n, first_ms and last_ms; at most MAX_ERRORS errors of a key are held."""
    return events.groupBy("key").transformWithState(Errors(), "key string, error string, n long, first_ms long, last_ms long", "update", "none")


def samples(events: DataFrame) -> DataFrame:
    """A stream of key, seq and value as key and the statistics of Ring.stats."""
    return events.groupBy("key").transformWithState(Samples(), "key string, n long, total double, least double, most double, spread double, p50 double, p95 double, p99 double", "update", "none")
