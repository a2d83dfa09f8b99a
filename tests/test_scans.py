"""Running values over blocks, composed status changes and periods, against plain loops; few keys in many blocks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import metrics, notify, progress, quality, scans, status, tables

T0 = datetime(2024, 1, 1)


def probes(rng, n):
    """Most rows are one node's."""
    return [(rng.choice(["1", "1", "1", None]), rng.choice(["a", "a", "b"]), T0 + timedelta(seconds=rng.randrange(n)), k, rng.random() < 0.6, rng.randrange(100)) for k in range(n)]


PROBES = "chain_id string, node string, ts timestamp, event_id long, ok boolean, response_ms long"


def by_key(rows, key, order):
    out = {}
    for r in sorted(rows, key=order):
        out.setdefault(key(r), []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_node_health_and_means_over_blocks(spark, parts):
    rows = probes(random.Random(parts), 900)
    df = spark.createDataFrame(rows, PROBES).repartition(3)
    health, means = {}, {}
    for keyed in by_key(rows, lambda r: r[:2], lambda r: (r[2], r[3])).values():
        good, streak, well, total = 0, 0, True, 0
        for n, (_, _, _, e, ok, ms) in enumerate(keyed):
            good, streak = good + ok, 0 if ok else streak + 1
            well = False if not ok and streak >= 3 else True if ok and good >= 2 else well
            total += ms
            health[e], means[e] = (good, streak, well), total / (n + 1)
    got = {r["event_id"]: (r["successes"], r["streak"], r["healthy"]) for r in metrics.node_health(df, parts=parts).collect()}
    assert got == health
    got = {r["event_id"]: r["running_mean"] for r in metrics.running_mean(df, "response_ms", ["chain_id", "node"], ["ts", "event_id"], parts=parts).collect()}
    assert got == pytest.approx(means)


@pytest.mark.parametrize("new", [0.3, 0.05, 0.9, 1.0])
def test_moving_rate_over_runs(spark, new):
    rng = random.Random(1)
    rows = [(c, k, rng.choice([None, *range(50)])) for c in ("1", None) for k in range(1500)]
    got = {(r["chain_id"], r["at"]): r["ema"] for r in metrics.moving_rate(spark.createDataFrame(rows, "chain_id string, at long, rate long"), new=new, parts=9).collect()}
    for c in ("1", None):
        ema = 0.0
        for _, k, x in (r for r in rows if r[0] == c):
            ema = (x or 0) * new + ema * (1 - new)
            assert got[c, k] == pytest.approx(ema, rel=1e-12, abs=1e-12)


def test_no_block_holds_a_key(spark):
    """The largest block of a hot key is a fraction of its rows."""
    df = spark.range(20_000).select(F.lit("1").alias("chain_id"), F.col("id").alias("at"))
    sizes = [r["count"] for r in scans.blocked(df, ["chain_id"], ["at"], 16).groupBy(scans.BLOCK).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16


@pytest.mark.parametrize("parts", [1, 13])
def test_batches_over_blocks(spark, parts):
    rng = random.Random(2)
    rows = [("1" if k % 3 else None, k, "reorg" if rng.random() < 0.02 else "log") for k in range(2000)]
    got = notify.batches(spark.createDataFrame(rows, "chain_id string, k long, event_type string"), ["chain_id"], ["k"], 10, parts=parts)
    got = {r["k"]: (r["epoch"], r["batch"]) for r in got.collect()}
    for c in ("1", None):
        epoch = n = 0
        for _, k, kind in (r for r in rows if r[0] == c):
            if kind == "reorg":
                epoch, n = epoch + 1, 0
            assert got[k] == (epoch, n // 10)
            n += 1


def plain_fold(updates, rules):
    out = {}
    for key, keyed in by_key(updates, lambda r: r[0], lambda r: (r[1], r[2])).items():
        now, moves, rejected, action = "pending", 0, 0, None
        for _, ts, e, to in keyed:
            act = next((a for x, y, a, *c in rules if x == now and y == to and (not c or c[0](e))), None)
            now, moves, rejected, action = (now, moves, rejected + 1, action) if act is None else (to, moves + 1, rejected, act)
        out[key] = (now, moves, rejected, action)
    return out


CYCLE = (*status.RULES, ("finalized", "pending", "reopen"), ("reverted", "pending", "retry"))


@pytest.mark.parametrize("parts", [1, 11])
def test_status_maps_compose(spark, monkeypatch, parts):
    monkeypatch.setattr(status, "LISTED", 16)
    rng = random.Random(3)
    names = ["pending", "confirmed", "finalized", "reverted", "unheard", None]
    rows = [(rng.choice([7, 7, 7, 7, None, 1, 2]), rng.randrange(5000), k, rng.choice(names)) for k in range(4000)]
    df = spark.createDataFrame(rows, "tx_key long, ts long, event_id long, new_status string").repartition(5)
    for rules in (status.RULES, CYCLE):
        got = {r["tx_key"]: tuple(r)[1:] for r in status.fold(df, rules=rules, parts=parts).collect()}
        assert got == plain_fold(rows, rules)


def test_rules_with_conditions(spark):
    """A rule whose condition is false, or null, doesn't hold; a later rule for the same move may."""
    rng = random.Random(4)
    rows = [(rng.randrange(6), k, k, rng.choice(["pending", "confirmed", "finalized", "reverted"])) for k in range(600)]
    df = spark.createDataFrame(rows, "tx_key long, ts long, event_id long, new_status string")
    even, never = (lambda e: e % 2 == 0), (lambda e: False)
    plain = (("pending", "confirmed", "even", even), ("pending", "confirmed", "odd third", lambda e: e % 3 == 0), ("confirmed", "finalized", "never", never), ("confirmed", "pending", "back"))
    e = F.col("event_id")
    rules = (("pending", "confirmed", "even", e % 2 == 0), ("pending", "confirmed", "odd third", e % 3 == 0), ("confirmed", "finalized", "never", F.lit(None).cast("boolean")), ("confirmed", "pending", "back"))
    got = {r["tx_key"]: tuple(r)[1:] for r in status.fold(df, rules=rules, parts=4).collect()}
    assert got == plain_fold(rows, plain)


def test_one_key_with_very_many_updates(spark):
    """200,000 alternating updates of one key: no list, and no task, holds them."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("tx_key"), F.col("id").alias("ts"), F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, "confirmed").otherwise("pending").alias("new_status"))
    rules = (("pending", "confirmed", "there"), ("confirmed", "pending", "back"))
    assert [tuple(r) for r in status.fold(df, rules=rules, parts=16).collect()] == [(1, "pending", n, 0, "back")]


@pytest.mark.parametrize("parts", [1, 12])
def test_periods_of_a_hot_key(spark, parts):
    rng = random.Random(5)
    rows, t = [], 0
    for k in range(3000):
        t += rng.choice([0, 1, 5, 400])
        rows.append((rng.choice([None, "hot", "hot", "hot"]), T0 + timedelta(seconds=t), k))
    want = []
    for keyed in by_key(rows, lambda r: r[0], lambda r: (r[1], r[2])).values():
        last = None
        for _, at, k in keyed:
            if last is None or at - last > timedelta(seconds=60):
                want.append(k)
                last = at
    got = status.first_within_ttl(spark.createDataFrame(rows, "k string, ts timestamp, e long").repartition(4), "k", "ts", 60, "e", parts=parts)
    assert sorted(r["e"] for r in got.collect()) == sorted(want)


def test_long_lists_of_addresses(spark, monkeypatch):
    """Rows that tie or repeat stay as often as they are, whichever columns hit."""
    monkeypatch.setattr(quality, "LISTED", 3)
    rng = random.Random(6)
    rows = [(rng.choice("abcdefgh"), rng.choice([*"abcdefgh", None, ""])) for _ in range(400)]
    df = spark.createDataFrame(rows, "from_address string, to_address string").repartition(7)
    got = sorted(map(str, map(tuple, quality.filter_transactions(df, addresses=list("abcda")).collect())))
    assert got == sorted(str(r) for r in rows if r[0] in "abcd" or r[1] in [*"abcd"])


def test_ranges_meet_rows_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET", 10)
    rng = random.Random(7)
    rows = [(rng.choice("12"), h, "confirmed") for h in range(300)]
    ranges = [(rng.choice("12"), lo, lo + rng.choice([0, 3, 40])) for lo in rng.sample(range(300), 12)]
    txs = spark.createDataFrame(rows, "chain_id string, block_number long, status string")
    r = spark.createDataFrame(ranges, "chain_id string, fork_height long, old_tip long")
    inside = lambda c, h: any(x == c and lo < h <= hi for x, lo, hi in ranges)
    assert sorted(map(tuple, tables.delete_ranges(txs, r).collect())) == sorted(x for x in rows if not inside(*x[:2]))
    got = {(x["chain_id"], x["block_number"]): (x["status"], x["revert_reason"]) for x in tables.mark_reverted(txs, r).collect()}
    assert got == {(c, h): ("reverted", "reorg") if inside(c, h) else ("confirmed", None) for c, h, _ in rows}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = tables.delete_ranges(txs, r)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "_b#" in plan.split("SortMergeJoin")[1].split("\n")[0]


@pytest.mark.parametrize("parts", [1, 9])
def test_contiguous_heights(spark, parts):
    """Ranges that overlap, touch, tie or lie below the first height, and one of 10^9 heights."""
    rng = random.Random(8)
    rows = [(c, lo, lo + rng.randrange(-1, 12), rng.random() < 0.9) for c in "abcdefgh" for lo in [rng.randrange(-5, 60) for _ in range(30)]]
    rows += [("long", 1, 10**9, True), ("long", 10**9 + 1, 10**9 + 5, True), ("long", 10**9 + 7, 10**9 + 9, True), ("none", 1, 5, False), ("late", 2, 5, True), (None, 1, 3, True)]
    got = {r.chain_id: r.contiguous_height for r in progress.contiguous(spark.createDataFrame(rows, "chain_id string, start_block long, end_block long, success boolean"), parts=parts).collect()}
    for c in "abcdefgh":
        done = {h for x, lo, hi, ok in rows if x == c and ok for h in range(lo, hi + 1)}
        assert got[c] == next(h for h in range(1, 200) if h not in done) - 1
    assert (got["long"], got["none"], got["late"], got[None]) == (10**9 + 5, 0, 0, 3)


def test_stored_tables_are_noted(spark, tmp_path):
    from pathlib import Path
    from urllib.parse import urlparse

    from ledgerspark.shared import discard, noted

    df = spark.createDataFrame(probes(random.Random(9), 50), PROBES)
    with noted() as paths:
        metrics.node_health(df).write.parquet(f"{tmp_path}/health")
    assert len(paths) == 1 and Path(urlparse(paths[0]).path).exists()
    discard(spark, paths)
    assert not Path(urlparse(paths[0]).path).exists() and spark.read.parquet(f"{tmp_path}/health").count() == 50
