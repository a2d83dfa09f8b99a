"""Keyed state in Spark runs: order of event time, expiry, silent nodes, heights, notifications by size, clock and order."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerspark.operators import status
from ledgerspark.streaming import state, streams

T0 = datetime(2024, 1, 1)


def stream_of(spark, path, batches, schema):
    """A stream that gives one of ``batches`` (lists of rows) at a time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def run(spark, df, path, mode="append"):
    """All rows that come out, with their batch."""
    out = []
    w = df.writeStream.outputMode(mode).foreachBatch(lambda rows, n: out.extend((n, r) for r in rows.collect())).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    with state.with_rocksdb(spark):
        w.start().awaitTermination()
    return out


def kept_state(spark, path, name):
    with state.with_rocksdb(spark):
        return spark.read.format("statestore").option("path", f"{path}/checkpoint").option("stateVarName", name).load().collect()


UPDATES = "tx_key long, ts timestamp, event_id long, new_status string"
at = lambda s: T0 + timedelta(seconds=s)


def test_late_updates_change_what_they_should(spark, tmp_path):
    """``finalized`` arrives before ``confirmed``: in event time it is legal. A row behind the watermark is dropped."""
    first = [(1, at(20), 2, "finalized"), (2, at(30), 3, "reverted")]
    second = [(1, at(10), 1, "confirmed"), (2, at(5), 0, "confirmed")]
    far, next_ = [(9, at(500), 8, "pending")], [(9, at(510), 7, "pending")]
    late = [(1, at(15), 9, "reverted"), (9, at(1000), 9, "pending")]
    end = [(9, at(5000), 10, "pending")]
    out = run(spark, state.status_stream(stream_of(spark, tmp_path, [first, second, far, next_, late, end], UPDATES), "60 seconds"), tmp_path)
    got = [(r.tx_key, r.event_id, r.status, r.rejected) for _, r in out if r.tx_key < 9]
    assert [g for g in got if g[0] == 1] == [(1, 1, "confirmed", 0), (1, 2, "finalized", 0)]
    assert [g for g in got if g[0] == 2] == [(2, 0, "confirmed", 0), (2, 3, "reverted", 0)]
    waiting = kept_state(spark, tmp_path, "waiting")
    assert len(waiting) == 1


@pytest.mark.parametrize("seed", [0, 1])
def test_status_equals_fold(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 2, None]), at(rng.randrange(900)), k, rng.choice(["confirmed", "pending", "finalized", "reverted", "unheard", None])) for k in range(300)]
    rng.shuffle(rows)
    rules = (("pending", "confirmed", "c", F.col("event_id") % 2 == 0), *status.RULES[1:], ("finalized", "pending", "reopen"))
    end = [(9, at(9000), -1, "pending")]
    out = run(spark, state.status_stream(stream_of(spark, tmp_path, [rows[:100], rows[100:200], rows[200:], end], UPDATES), "1 hour", rules), tmp_path)
    last = {}
    for _, r in out:
        if r.event_id >= 0 and (r.tx_key not in last or (r["at"], r.event_id) > (last[r.tx_key]["at"], last[r.tx_key].event_id)):
            last[r.tx_key] = r
    got = {k: (r.status, r.moves, r.rejected, r.last_action) for k, r in last.items()}
    want = {r.tx_key: tuple(r)[1:] for r in status.fold(spark.createDataFrame(rows, UPDATES), rules=rules).collect()}
    assert got == want


def test_idle_keys_are_forgotten(spark, tmp_path):
    """After an hour of event time without updates a key's state is gone from the store, and it starts anew."""
    batches = [[(1, at(0), 0, "confirmed")], [(2, at(1000), 1, "confirmed")], [(2, at(6000), 2, "pending")], [(2, at(6100), 3, "finalized")], [(1, at(7000), 4, "finalized"), (3, at(7000), 5, "pending")], [(3, at(7200), 6, "pending")]]
    out = run(spark, state.status_stream(stream_of(spark, tmp_path, batches, UPDATES), "10 seconds", idle=3600), tmp_path)
    by = {r.event_id: (r.tx_key, r.status, r.moves) for _, r in out}
    assert by[0] == (1, "confirmed", 1)
    assert by[4] == (1, "pending", 0)  # forgotten, so not finalized
    assert by[1] == (2, "confirmed", 1) and by[2] == (2, "pending", 0)
    assert {r["key"]["tx_key"] for r in kept_state(spark, tmp_path, "state")} <= {1, 2, 3}
    fresh = tmp_path / "again"
    run(spark, state.status_stream(stream_of(spark, fresh, [batches[0], [(2, at(9000), 1, "confirmed")], [(2, at(9100), 2, "confirmed")]], UPDATES), "10 seconds", idle=3600), fresh)
    assert {r["key"]["tx_key"] for r in kept_state(spark, fresh, "state")} == {2}


def test_periods_expire(spark, tmp_path):
    """A repeat after its period is kept, unlike with a plain distinct, and only live periods stay in the store."""
    rows = [[("a", at(0), 0), ("a", at(30), 1), ("b", at(10), 2)], [("a", at(61), 3), ("a", at(100), 4)], [("a", at(121), 5), ("z", at(5000), -1)], [("z", at(5020), -2)]]
    out = run(spark, state.first_stream(stream_of(spark, tmp_path, rows, "k string, ts timestamp, e long"), "k", "ts", "e", 60, "20 seconds"), tmp_path)
    assert sorted(r.event_id for _, r in out if r.event_id >= 0) == [0, 2, 3]
    assert {r["key"]["key"] for r in kept_state(spark, tmp_path, "state")} == {"z"}


def test_silent_nodes(spark, tmp_path):
    probes = [[("1", "n", at(k), k, True) for k in range(3)], [("1", "m", at(1000), 10, True)], [("1", "n", at(1050), 11, True), ("1", "m", at(1100), 12, False)], [("1", "m", at(9000), 13, True)]]
    df = stream_of(spark, tmp_path, probes, "chain_id string, node string, ts timestamp, event_id long, ok boolean")
    rows = [(r.event_id, r.healthy, r.silent) for _, r in run(spark, state.health_stream(df, "5 seconds", idle=300), tmp_path) if r.node == "n"]
    assert rows == [(0, True, False), (1, True, False), (2, True, False), (None, False, True), (11, True, False), (None, False, True)]


def test_heights_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    ranges = [(lo, lo + 9, lo != 701) for lo in range(1, 1000, 10)] + [(5, 25, True), (990, 2000, True)]
    rng.shuffle(ranges)
    rows = [("1", lo, hi, ok, 650, 600, None) for lo, hi, ok in ranges] + [("2", 11, 20, True, 50, 50, None), ("3", None, None, None, 70, 60, 40)]
    schema = "chain_id string, start_block long, end_block long, success boolean, tip long, finalized long, hw_scanned long"
    out = run(spark, state.watermark_stream(stream_of(spark, tmp_path, [rows[k::5] for k in range(5)], schema), depth=100), tmp_path, "update")
    last = {r.chain_id: tuple(r)[1:] for _, r in out}
    assert last == {"1": (700, 650, 600, 600, 2), "2": (0, 0, 0, 0, 1), "3": (40, 40, 40, 0, 0)}
    marks = [r.hw_scanned for _, r in out if r.chain_id == "1"]
    assert marks == sorted(marks)


class Fake:
    """A handle over plain lists, with timers that a test fires."""

    def __init__(self):
        self.timers, self.values = set(), {}

    def getListState(self, name, schema):
        class State:
            rows: list = []
            get = lambda s: iter(s.rows)
            put = lambda s, rows: setattr(s, "rows", list(rows))
            clear = lambda s: setattr(s, "rows", [])

        return State()

    def getValueState(self, name, schema):
        class State:
            value = None
            exists = lambda s: s.value is not None
            get = lambda s: s.value
            update = lambda s, v: setattr(s, "value", v)

        return State()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Now:
    def __init__(self, ms):
        self.getCurrentProcessingTimeInMs = self.getExpiryTimeInMs = lambda: ms


def test_notifications_by_hand_clock():
    p, h = state.Notifier(3, 5), Fake()
    p.init(h)
    event = lambda k, kind="log": Row(place=k, event_type=kind, body=str(k))
    give = lambda ms, *rows: [(r.number, r.flushed_by, json.loads(r.message)["events"]) for r in p.handleInputRows(("s",), iter(rows), Now(ms))]
    fire = lambda ms: [(r.number, r.flushed_by, json.loads(r.message)["events"]) for r in p.handleExpiredTimer(("s",), Now(ms), Now(ms))]
    assert give(1000, event(2), event(1)) == [] and h.timers == {6000}
    assert give(2000, event(3), event(4)) == [(0, "size", [1, 2, 3])] and h.timers == {7000}
    h.timers.clear()
    assert fire(7000) == [(1, "time", [4])] and fire(7000) == []
    assert give(8000, event(5), event(6, "reorg"), event(7)) == [(2, "reorg", [5]), (3, "itself", [6])] and h.timers == {13000}
    assert fire(9999) == []  # a timer that no longer counts
    h.timers.clear()
    assert fire(13000) == [(4, "time", [7])]
    assert give(20000, event(8, "reorg")) == [(5, "itself", [8])] and not h.timers


def test_notifications_by_the_clock(spark, tmp_path):
    """What waits goes out by itself."""
    df = stream_of(spark, tmp_path, [[("s", k, "log", str(k)) for k in range(5)]], "stream string, place long, event_type string, body string")
    out = []
    w = state.notification_stream(df, 3, 1.0).writeStream.outputMode("append").foreachBatch(lambda rows, n: out.extend(rows.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint")
    with state.with_rocksdb(spark):
        q = w.trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 90
        while len(out) < 2 and time.time() < end:
            time.sleep(0.3)
    finally:
        q.stop()
    assert [(r.number, r.batch_size, r.flushed_by) for r in out] == [(0, 3, "size"), (1, 2, "time")]


def test_rules_with_conditions_are_not_lists():
    with pytest.raises(ValueError, match="condition"):
        streams.legal_moves((("a", "b", "go", F.lit(False)),))


def test_store_choice_comes_back(spark):
    spark.conf.set(state.STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(RuntimeError), state.with_rocksdb(spark):
        raise RuntimeError
    assert "HDFS" in spark.conf.get(state.STORE)
    spark.conf.unset(state.STORE)


def test_timers_of_notifications_are_set_once_a_batch(monkeypatch):
    """However many messages a batch fills, it has one timer, and packed events give what single ones do."""
    import pickle

    calls, rows = [], [Row(place=k, event_type="reorg" if k == 50 else "log", body=str(k)) for k in range(100)]
    monkeypatch.setattr(Fake, "registerTimer", lambda h, ms: (calls.append(ms), h.timers.add(ms)))
    out = []
    for p, given in ((state.Notifier(3, 5), rows), (state.PackedNotifier(3, 5), [Row(events=pickle.dumps([(r.place, r.event_type == "reorg", r.body) for r in part])) for part in (rows[60:], rows[:60])])):
        h = Fake()
        p.init(h)
        out.append([tuple(r) for r in p.handleInputRows(("s",), iter(given), Now(1000))])
        assert h.timers == {6000}
    assert calls == [6000, 6000] and out[0] == out[1] and len(out[0]) == 34
