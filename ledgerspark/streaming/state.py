"""Keyed state in streams: updates in event-time order, heights scanned, node health, periods, notifications.

Rows arrive in any order inside the watermark's delay. ``InOrder`` lets them wait in the key's state and deals them to ``step`` in
event time once the watermark has passed them, so that the result is that of the batch operators; rows behind the watermark
are dropped by Spark. Timers are in event time, but for notifications, whose wait is a matter of the clock. All need the
RocksDB state store (:func:`with_rocksdb`).
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerspark.operators import status

STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own choice comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


class InOrder(StatefulProcessor):
    """Deals the rows of a key in the order of (``at``, then the other fields), once the watermark is past them.

    ``fields`` are the columns that wait, ``at`` (microseconds) first; ``kept`` is the schema of the key's own state and
    ``begin`` its value. After ``idle`` seconds of event time without a row, ``quiet`` says what becomes of a key.

    A call to the state store costs as much as many rows, and so does a row of a list there: the rows that a batch brings to
    a key wait as one pickle.
    """

    fields: tuple[str, ...] = ("at",)
    kept = ""
    begin: tuple = ()
    idle: int | None = None

    def step(self, key: tuple, now: tuple, row: tuple) -> tuple[tuple, list[Row]]:
        raise NotImplementedError

    def quiet(self, key: tuple, now: tuple) -> tuple[tuple | None, list[Row]]:
        """State and rows after ``idle`` seconds without an update; None forgets the key."""
        return None, []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.state = handle.getValueState("state", f"{self.kept}, last long, due long, silent long")

    def _timer(self, old: int, new: int) -> int:
        """Moves a timer, given in milliseconds; -1 is none."""
        if old != new:
            if old >= 0:
                self.handle.deleteTimer(old)
            if new >= 0:
                self.handle.registerTimer(new)
        return new

    def _get(self) -> tuple[tuple, int, int, int]:
        held = self.state.get()
        if held is None:
            return self.begin, -1, -1, -1
        *now, last, due, silent = held
        return tuple(now), last, due, silent

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new, pick = [], None
        for r in rows:
            # Places are looked up once, as a row searches its names for each.
            pick = pick or [r.__fields__.index(f) for f in self.fields]
            new.append(tuple([r[k] for k in pick]))
        if new:
            self.waiting.appendValue((pickle.dumps(new),))
            now, last, due, silent = self._get()
            first = -(-min(r[0] for r in new) // 1000)
            due = self._timer(due, first if due < 0 else min(due, first))
            self.state.update((*now, last, due, silent))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        fired, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() * 1000
        now, last, due, silent = self._get()
        out: list[Row] = []
        if fired == due:
            rows = [r for (held,) in self.waiting.get() for r in pickle.loads(held)]
            try:
                rows.sort()
            except TypeError:  # nulls come first
                rows.sort(key=lambda r: [(x is not None, x) for x in r])
            past = bisect_right(rows, mark, key=lambda r: r[0])
            for r in rows[:past]:
                # A pause that ended before this row comes first, as it would have with a watermark in smaller steps.
                if self.idle is not None and last >= 0 and r[0] - last > self.idle * 1_000_000:
                    state, told = self.quiet(key, now)
                    now = self.begin if state is None else state
                    out += told
                now, told = self.step(key, now, r)
                out += told
                last = r[0]
            left, due = rows[past:], -1
            self.waiting.put([(pickle.dumps(left),)]) if left else self.waiting.clear()
            if left:
                due = -(-left[0][0] // 1000)
                self.handle.registerTimer(due)
            if self.idle is not None and last >= 0:
                # Timers at or before the watermark have fired already; this one must still come.
                end = -(-(last + 1) // 1000) + self.idle * 1000
                silent = self._timer(silent, max(end, timerValues.getCurrentWatermarkInMs() + 1))
        elif fired == silent:
            silent = -1
            if due < 0 or due * 1000 > mark:
                state, out = self.quiet(key, now)
                if state is None and due < 0:
                    self.state.clear()
                    return iter(out)
                now, last = self.begin if state is None else state, -1
        self.state.update((*now, last, due, silent))
        return iter(out)

    def close(self) -> None:
        pass


class StatusInOrder(InOrder):
    """Status of a key under rules, whose conditions were evaluated on each row (``does``: a letter for each status, that of
    an action of ``names``, or ``NONE``)."""

    fields = ("at", "event_id", "to", "does")
    kept = "status int, moves long, rejected long, action string"

    def __init__(self, states: list[str], names: dict[str, str], idle: int | None):
        self.states, self.names, self.idle, self.begin = states, names, idle, (0, 0, 0, None)

    def step(self, key: tuple, now: tuple, row: tuple) -> tuple[tuple, list[Row]]:
        place, moves, rejected, action = now
        act = self.names.get(row[3][place])
        now = (place, moves, rejected + 1, action) if act is None else (row[2], moves + 1, rejected, act)
        return now, [_STATUS(key[0], row[0], row[1], self.states[now[0]], now[1], now[2], now[3])]


_STATUS = Row("tx_key", "at", "event_id", "status", "moves", "rejected", "last_action")
#: The letter of no action; those of actions follow it.
NONE = "-"


def status_stream(updates: DataFrame, delay: str, rules: tuple = status.RULES, start: str = "pending", idle: int | None = None) -> DataFrame:
    """(tx_key, at, event_id, status, moves, rejected, last_action) after each update (tx_key, ts, event_id, new_status) in
    event time, for updates at most ``delay`` late. ``at`` is in microseconds.

    ``idle`` seconds of event time after its last update a key is forgotten, and would start again (None: never).
    """
    states = status.states_of(rules, start)
    place = F.coalesce(F.array_position(F.array(*map(F.lit, states)), F.col("new_status")).cast("int"), F.lit(0)) - 1
    # One text of letters is cheaper to hand over than a list of names.
    letters = {name: chr(ord(NONE) + 1 + k) for k, name in enumerate(dict.fromkeys(r[2] for r in rules))}
    does = status.actions(F.col("new_status"), tuple((a, b, letters[n], *c) for a, b, n, *c in rules), start)
    does = F.array_join(does, "", NONE)
    rows = updates.withWatermark("ts", delay).select("tx_key", "ts", F.unix_micros("ts").alias("at"), "event_id", place.alias("to"), does.alias("does"))
    kind = updates.schema["tx_key"].dataType.simpleString()
    return rows.groupBy("tx_key").transformWithState(StatusInOrder(states, {c: n for n, c in letters.items()}, idle), f"tx_key {kind}, at long, event_id long, status string, moves long, rejected long, last_action string", "Append", "EventTime")


class HealthInOrder(InOrder):
    """Health of a node after each probe, as in ``metrics.node_health``; a silent node is unhealthy until its next success."""

    fields = ("at", "event_id", "ok")
    kept, begin = "successes long, streak long, healthy boolean", (0, 0, True)

    def __init__(self, fail: int, succeed: int, idle: int | None):
        self.fail, self.succeed, self.idle = fail, succeed, idle

    def _row(self, key: tuple, now: tuple, at: int | None, event: int | None, silent: bool) -> Row:
        return _HEALTH(key[0], key[1], at, event, now[0], now[1], now[2], silent)

    def step(self, key: tuple, now: tuple, row: tuple) -> tuple[tuple, list[Row]]:
        good, streak, healthy = now
        good, streak = (good + 1, 0) if row[2] else (good, streak + 1)
        healthy = False if streak >= self.fail else True if row[2] and good >= self.succeed else healthy
        now = (good, streak, healthy)
        return now, [self._row(key, now, row[0], row[1], False)]

    def quiet(self, key: tuple, now: tuple) -> tuple[tuple | None, list[Row]]:
        now = (now[0], now[1], False)
        return now, [self._row(key, now, None, None, True)]


_HEALTH = Row("chain_id", "node", "at", "event_id", "successes", "streak", "healthy", "silent")


def health_stream(probes: DataFrame, delay: str, fail: int = 3, succeed: int = 2, idle: int | None = None) -> DataFrame:
    """(chain_id, node, at, event_id, successes, streak, healthy, silent) after each probe (chain_id, node, ts, event_id, ok),
    and one row, ``silent``, for a node that had no probe for ``idle`` seconds of event time."""
    rows = probes.withWatermark("ts", delay).select("chain_id", "node", "ts", F.unix_micros("ts").alias("at"), "event_id", "ok")
    return rows.groupBy("chain_id", "node").transformWithState(HealthInOrder(fail, succeed, idle), "chain_id string, node string, at long, event_id long, successes long, streak long, healthy boolean, silent boolean", "Append", "EventTime")


class FirstInOrder(InOrder):
    """The first row of a key in each period; the key is forgotten when its period is over."""

    fields = ("at", "event_id")
    kept, begin = "opened long", (-1,)

    def __init__(self, seconds: int):
        # A key without rows for a whole period is at its begin again, whatever came before.
        self.period, self.idle = seconds * 1_000_000, seconds

    def step(self, key: tuple, now: tuple, row: tuple) -> tuple[tuple, list[Row]]:
        if now[0] >= 0 and row[0] - now[0] <= self.period:
            return now, []
        return (row[0],), [Row(key=key[0], at=row[0], event_id=row[1])]


def first_stream(df: DataFrame, key: str, ts: str, tie: str, seconds: int, delay: str) -> DataFrame:
    """(key, at, event_id): rows whose key was not kept in the ``seconds`` before, as ``status.first_within_ttl`` finds them.
    State lasts as long as a period."""
    rows = df.withWatermark(ts, delay).select(F.col(key).alias("key"), F.col(ts), F.unix_micros(ts).alias("at"), F.col(tie).cast("long").alias("event_id"))
    kind = df.schema[key].dataType.simpleString()
    return rows.groupBy("key").transformWithState(FirstInOrder(seconds), f"key {kind}, at long, event_id long", "Append", "EventTime")


class HeightsScanned(StatefulProcessor):
    """The scanned heights of a chain as disjoint ranges, merged as they arrive; the first one's end is the watermark."""

    def __init__(self, first: int, depth: int):
        self.first, self.depth = first, depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranges = handle.getListState("ranges", "low long, high long")
        self.marks = handle.getValueState("marks", "scanned long, confirmed long, finalized long, tip long, final long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        scanned, confirmed, finalized, tip, final = self.marks.get() if self.marks.exists() else (0, 0, 0, 0, 0)
        ranges = [tuple(r) for r in self.ranges.get()]
        for r in rows:
            tip, final = max(tip, r["tip"] or 0), max(final, r["finalized"] or 0)
            scanned = max(scanned, r["hw_scanned"] or 0)
            if r["success"] and r["start_block"] is not None and r["end_block"] >= r["start_block"]:
                ranges.append((r["start_block"], r["end_block"]))
        ranges.sort()
        merged: list[tuple[int, int]] = []
        for low, high in ranges:
            if merged and low <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        self.ranges.put(merged) if merged else self.ranges.clear()
        reached = merged[0][1] if merged and merged[0][0] <= self.first else self.first - 1
        # No watermark goes back.
        scanned = max(scanned, reached)
        confirmed, finalized = max(confirmed, min(scanned, tip)), max(finalized, min(scanned, final))
        self.marks.update((scanned, confirmed, finalized, tip, final))
        yield Row(chain_id=key[0], hw_scanned=scanned, hw_confirmed=confirmed, hw_finalized=finalized, hw_boundary=max(scanned - self.depth, 0), ranges=len(merged))

    def close(self) -> None:
        pass


def watermark_stream(results: DataFrame, first: int = 1, depth: int = 128) -> DataFrame:
    """(chain_id, hw_scanned, hw_confirmed, hw_finalized, hw_boundary, ranges) after each batch of scan results.

    ``results`` (chain_id, start_block, end_block, success, tip, finalized, hw_scanned): a range that was scanned, and what
    the chain's head was then; a row with null heights only tells the head, or sets a watermark to go on from. Ranges come
    in any order and may overlap; state is one pair for each gap, so its size follows the gaps and not the heights.
    """
    out = "chain_id string, hw_scanned long, hw_confirmed long, hw_finalized long, hw_boundary long, ranges int"
    return results.groupBy("chain_id").transformWithState(HeightsScanned(first, depth), out, "Update", "None")


class Notifier(StatefulProcessor):
    """Packs the events of a stream; what waits is sent when it is full, after some seconds, or before a reorganisation."""

    def __init__(self, size: int, seconds: float):
        self.size, self.wait = size, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "body string")
        self.count = handle.getValueState("count", "waiting long, sent long, due long")

    def _message(self, key: tuple, number: int, bodies: list[str], why: str) -> Row:
        text = '{"batch_size":%d,"events":[%s]}' % (len(bodies), ",".join(bodies))
        return Row(stream=key[0], number=number, batch_size=len(bodies), flushed_by=why, message=text)

    def _events(self, rows: Iterator[Row]) -> Iterator[tuple]:
        """(place, is a reorganisation, body) of the rows, as plain tuples, which take less than rows."""
        return ((r["place"], r["event_type"] == "reorg", r["body"]) for r in rows)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        waiting, sent, before = self.count.get() if self.count.exists() else (0, 0, -1)
        bodies = [r[0] for r in self.buffer.get()] if waiting else []
        out, due, end = [], before, timerValues.getCurrentProcessingTimeInMs() + self.wait

        def flush(why: str) -> None:
            nonlocal sent, due
            if bodies:
                out.append(self._message(key, sent, bodies, why))
                sent += 1
                bodies.clear()
            due = -1

        for _, reorg, body in sorted(self._events(rows), key=lambda e: e[0]):
            if reorg:
                flush("reorg")
                bodies.append(body)
                flush("itself")
                continue
            bodies.append(body)
            due = end if due < 0 else due
            if len(bodies) >= self.size:
                flush("size")
        # The clock stands still inside a batch, so only what waits at its end needs a timer: each is a call to the state store.
        if due != before:
            if before >= 0:
                self.handle.deleteTimer(before)
            if due >= 0:
                self.handle.registerTimer(due)
        self.buffer.put([(b,) for b in bodies]) if bodies else self.buffer.clear()
        self.count.update((len(bodies), sent, due))
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        waiting, sent, due = self.count.get()
        if expiredTimerInfo.getExpiryTimeInMs() != due or not waiting:
            return iter(())
        out = self._message(key, sent, [r[0] for r in self.buffer.get()], "time")
        self.buffer.clear()
        self.count.update((0, sent + 1, -1))
        return iter([out])

    def close(self) -> None:
        pass


class PackedNotifier(Notifier):
    """The same for rows of :func:`_events_packed`."""

    def _events(self, rows: Iterator[Row]) -> Iterator[tuple]:
        return (e for r in rows for e in pickle.loads(r["events"]))


def _events_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stream, events): the events (place, is a reorganisation, body) that an Arrow batch has of a stream, as one pickle. A row
    of its own for each event costs the state's task far more than the event."""
    for b in batches:
        by: dict[Any, list[tuple]] = {}
        for stream, place, kind, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
            by.setdefault(stream, []).append((place, kind == "reorg", body))
        yield pa.RecordBatch.from_arrays([pa.array(list(by), b.schema.field(0).type), pa.array([pickle.dumps(e) for e in by.values()], pa.binary())], names=["stream", "events"])


def notification_stream(events: DataFrame, size: int = 100, seconds: float = 5.0) -> DataFrame:
    """(stream, number, batch_size, flushed_by, message): ``events`` (stream, place, event_type, body) packed in messages.

    A message goes out when ``size`` events wait, when the oldest has waited ``seconds`` on the clock, or at once on a
    reorganisation, which follows what waited as a message of its own. Inside a batch events go by ``place``. ``stream`` may
    be finer than a chain: each packs on its own.
    """
    kind = events.schema["stream"].dataType.simpleString()
    packed = events.select("stream", "place", "event_type", "body").mapInArrow(_events_packed, f"stream {kind}, events binary")
    return packed.groupBy("stream").transformWithState(PackedNotifier(size, seconds), "stream string, number long, batch_size int, flushed_by string, message string", "Append", "ProcessingTime")
