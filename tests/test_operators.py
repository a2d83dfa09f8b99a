"""Operators on hand-written payloads and random input, against plain Python."""

import hashlib
import json
import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import exprs as X
from ledgerspark.operators import joins, ledger, metrics, normalize, notify, progress, quality, reorg, status, tables
from ledgerspark.sources import blocks, messages, rpc
from ledgerspark.streaming import streams

A, B = "0x" + "a" * 40, "0x" + "b" * 40


def value_of(spark, column):
    return spark.range(1).select(column).first()[0]


def test_numbers(spark):
    random.seed(0)
    values = [random.getrandbits(random.choice([1, 8, 60, 64, 119, 120, 121, 255, 256])) for _ in range(200)] + [0, 2**256 - 1, 2**120 - 1, 2**120]
    df = spark.createDataFrame([(str(v), random.choice(["0x%x", "%x", "0x%070x"]) % v) for v in values] + [(None, x) for x in ("0x", "zz", "", "0x" + "f" * 65, None)], "v string, h string")
    for r in df.select("v", X.hex_to_text(F.col("h")).alias("t"), X.hex_to_decimal(F.col("h")).alias("d"), X.block_number(F.col("h")).alias("n"), "h").collect():
        assert r.t == r.v
        assert r.d == (int(r.v) if r.v is not None and int(r.v) < 2**120 else None)
        if r.v is not None and r.h.startswith("0x"):
            assert r.n == (int(r.v) if int(r.v) < 2**63 else None)
    total = df.where("v IS NOT NULL").agg(X.sum_words(X.hex_word(F.col("h")))).first()[0]
    assert int(total) == sum(values)


@pytest.mark.parametrize("text,number", [("123", 123), ("0x7b", 123), ("0", 0), ("0x0", 0), ("-1", None), ("1e3", None), ("", None), ("9223372036854775808", None), ("0x8000000000000000", None), ("0x7fffffffffffffff", 2**63 - 1)])
def test_block_number(spark, text, number):
    assert value_of(spark, X.block_number(F.lit(text))) == number


@pytest.mark.parametrize("amount,decimals,shown", [("0", 18, "0"), ("1", 18, "0.000000000000000001"), ("1500", 3, "1.5"), ("1000", 3, "1"), ("7", 0, "7"), (None, 6, "0"), ("-2500", 3, "-2.5"), (str(2**256), 6, str(2**256 // 10**6) + "." + str(2**256 % 10**6).zfill(6).rstrip("0"))])
def test_display(spark, amount, decimals, shown):
    assert value_of(spark, X.display(F.lit(amount).cast("string"), F.lit(decimals))) == shown


def test_texts(spark):
    one = lambda c: value_of(spark, c)
    assert [one(X.is_address(F.lit(a))) for a in (A, A[:-1], "0x" + "g" * 40, "Tx", "T", None)] == [True, False, False, True, False, False]
    assert one(X.byte_text(F.lit(1536))) == "1.5 KiB" and one(X.byte_text(F.lit(5))) == "5 B"
    assert one(X.thousands(F.lit(-1234567))) == "-1,234,567" and one(X.truncate(F.lit("abcdef"), 3)) == "abc..."
    assert one(X.clean_text(F.lit(" a\x01b\x7f "))) == "ab"
    assert one(X.record_id(F.lit("1"), F.lit("0xh"), F.lit(3))) == hashlib.sha256(b"1-0xh-3").hexdigest()
    assert one(X.address_shard(F.lit(A), 16)) == hashlib.sha256(b"aa").digest()[0] % 16 and one(X.address_shard(F.lit("x"), 16)) == 0
    encoded = "0x" + "20".zfill(64) + "5".zfill(64) + "hello".encode().hex().ljust(64, "0")
    assert [one(X.abi_string(F.lit(c))) for c in (encoded, "plain", "0x12", encoded[:-60])] == ["hello", "plain", "", ""]
    assert str(one(X.wei_to_ether(F.lit("1500000000000000000")))).rstrip("0") == "1.5" and one(X.ether_to_wei(F.lit("1.5"))) == 15 * 10**17
    assert one(X.fee(F.lit(10**10), F.lit(21000))) == 21 * 10**13 and one(X.fee(F.lit(str(10**30)), F.lit(10**12))) is None


def test_envelopes(spark):
    rows = ['{"id":1,"result":{"a":1}}', '[{"id":2,"result":"0x5"},{"id":3,"error":{"code":-32000,"message":"no"}}]', "{broken", '{"id":4}']
    good, bad = rpc.decode_envelopes(spark.createDataFrame([(r,) for r in rows], "envelope string"))
    assert sorted((r.id, r.result) for r in good.collect()) == [("1", '{"a":1}'), ("2", "0x5")]
    assert sorted(r.reason for r in bad.collect()) == ["rpc error: -32000: no", "unreadable", "unreadable"]


def raw(spark, *items, chain="1"):
    return spark.createDataFrame([(chain, json.dumps(i) if not isinstance(i, str) else i) for i in items], "chain_id string, result string")


TX = {"hash": "0x1", "from": A, "to": None, "value": "0x10", "gasPrice": "0x2", "input": "0x"}
BLOCK = {"number": "0x5", "hash": "0xb", "parentHash": "0xa", "timestamp": "0x64", "transactions": [TX, "0xjusthash", {**TX, "hash": "0x2", "value": "0xzz"}, {**TX, "hash": "0x3", "to": B}]}


def test_evm_blocks_and_transactions(spark):
    good, bad = normalize.evm_blocks(raw(spark, BLOCK, {**BLOCK, "number": "zz"}, {"hash": "0xb"}, "nonsense"))
    b = good.collect()
    assert len(b) == 1 and b[0].block_number == 5 and b[0].block_ts.timestamp() % 86400 == 100
    assert sorted(len(r.reasons) for r in bad.collect()) == [1, 3, 4]
    txs, q = normalize.evm_transactions(normalize.block_transactions(good))
    assert sorted((r.tx_hash, r.tx_index, r.value_wei, r.to_address, r.status) for r in txs.collect()) == [("0x1", 0, 16, None, "pending"), ("0x3", 3, 16, B, "pending")]
    assert sorted(r.reasons for r in q.collect()) == [["hash", "from", "value", "gasPrice"], ["value"]]
    lenient, none = normalize.evm_transactions(normalize.block_transactions(good), lenient=True)
    assert lenient.count() == 4 and none.count() == 0


def test_receipts_and_logs(spark):
    log = {"transactionHash": "0x1", "blockNumber": "0x5", "address": A, "topics": [X.TRANSFER, None, "0x" + "0" * 24 + "b" * 40], "data": "0x" + "f".zfill(64), "logIndex": "0x0", "transactionIndex": "0x1"}
    r = {"transactionHash": "0x1", "blockNumber": "0x5", "blockHash": "0xb", "status": "0x1", "gasUsed": "0x5208", "transactionIndex": "0x1", "logs": [log, {**log, "transactionIndex": None}]}
    good, bad = normalize.evm_receipts(raw(spark, r, {**r, "blockHash": None}))
    assert [(x.status, x.gas_used) for x in good.collect()] == [("confirmed", 21000)] and [x.reasons for x in bad.collect()] == [["block_hash"]]
    logs, lost = normalize.evm_logs(normalize.receipt_logs(good))
    assert [x.topics for x in logs.collect()] == [[X.TRANSFER, "0x" + "0" * 24 + "b" * 40]] and lost.count() == 1


def test_other_chains_and_registry(spark):
    tron_tx = {"txID": "t1", "blockNumber": 9, "fromAddress": "Tf", "toAddress": "Tt", "value": 7, "gasPrice": 1, "gasUsed": 3, "status": True, "logs": [{"address": "Tc", "topics": ["x"], "data": "d"}]}
    tron = {"blockID": "tb", "blockNumber": 9, "parentHash": "ta", "timestamp": 1700000000999, "transactions": [tron_tx, {"value": 1}]}
    sol_tx = {"signature": "s1", "slot": 4, "meta": {"err": None, "fee": 5000, "logMessages": ["m1", "m2"]}}
    sol = {"slot": 4, "blockhash": "sb", "blockTime": 1700000000, "transactions": [sol_tx, {**sol_tx, "signature": "s2", "meta": {"err": "bad", "fee": 1}}]}
    b, q = normalize.tron_blocks(raw(spark, tron, chain="tron"))
    t, bad = normalize.tron_transactions(normalize.block_transactions(b))
    assert b.first().block_ts.timestamp() == 1700000000 and (t.first().status, t.first().value_wei) == ("confirmed", 7) and bad.count() == 1
    assert normalize.nested_logs(t).first().topics == ["x"]
    b, _ = normalize.solana_blocks(raw(spark, sol, chain="sol"))
    t, _ = normalize.solana_transactions(normalize.block_transactions(b))
    assert sorted((r.tx_hash, r.status, r.gas_used) for r in t.collect()) == [("s1", "confirmed", 5000), ("s2", "reverted", 1)]
    assert [r.topics for r in normalize.nested_logs(t).orderBy("log_index").collect()] == [["m1"], ["m2"]]
    rows = [("evm", "1", json.dumps(BLOCK)), ("tron", "tron", json.dumps(tron)), ("solana", "sol", json.dumps(sol)), ("what", "x", "{}")]
    blocks_, txs, lost = normalize.normalize_all(spark.createDataFrame(rows, "chain_type string, chain_id string, result string"))
    assert blocks_.count() == 3 and txs.count() == 5 and lost.count() == 4
    normalize.register_chain("copy", *normalize.CHAINS["evm"])
    with pytest.raises(ValueError):
        normalize.register_chain("copy", *normalize.CHAINS["evm"])
    del normalize.CHAINS["copy"]


def test_filters_with_long_lists(spark):
    df = spark.createDataFrame([("1", "0x1", A, B, Decimal(5)), ("1", "0x2", B, None, Decimal(5)), ("1", "0x3", "0xc", "0xd", Decimal(5))], "chain_id string, tx_hash string, from_address string, to_address string, value_wei decimal(38,0)")
    long = [A] + [f"0x{i:040x}" for i in range(quality.LISTED)]
    keys = lambda d: sorted(r.tx_hash for r in d.collect())
    for listed in ([A], long):
        assert keys(quality.filter_transactions(df, addresses=listed)) == ["0x1"]
    for listed in ([B], [B, *long[1:]]):
        assert keys(quality.filter_transactions(df, addresses=listed)) == ["0x1", "0x2"]
        assert keys(quality.filter_transactions(df, contracts=listed)) == ["0x1", "0x2"]


def test_messages(spark):
    df = spark.createDataFrame([("k1", '{"a": 1}'), ("k2", "{nope"), ("k3", None)], "key string, value string").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    good, dead = messages.decode_messages(df, "a int")
    assert [(r.key, r.a) for r in good.collect()] == [("k1", 1)]
    assert sorted(str(r.message) for r in dead.collect()) == ["None", "{nope"] and dead.columns == ["message", "reason", "time"]


def test_block_source_batch_and_stream(spark, tmp_path):
    src = tmp_path / "chain"
    src.mkdir()
    for h in range(400):
        (src / f"{h}.json").write_text(json.dumps({"id": h, "result": {**BLOCK, "number": hex(h)}}))
    (src / "head").write_text("249")
    spark.dataSource.register(blocks.BlockRangeSource)
    df = spark.read.format("block_range").option("path", str(src)).option("start", 10).load()
    assert df.count() == 240 and df.rdd.getNumPartitions() == 3
    (src / "0xabc.json").write_text("{}")
    named = spark.read.format("block_range").option("path", str(src)).option("hashes", "0xabc, 0xmissing").load()
    assert [tuple(r) for r in named.collect()] == [("1", None, "{}")]
    out, check = tmp_path / "out", tmp_path / "check"

    def write(name, rows, n):
        rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={n}")

    for head in ("249", "399"):
        (src / "head").write_text(head)
        stream = spark.readStream.format("block_range").option("path", str(src)).option("finality_blocks", 9).option("chain_id", "1").load()
        streams.ingest(stream.select("chain_id", "envelope"), write, str(check)).start().awaitTermination()
    got = spark.read.parquet(f"{out}/blocks").select("block_number")
    assert sorted(r.block_number for r in got.collect()) == list(range(391))
    assert spark.read.parquet(f"{out}/transactions").count() == 2 * 391


def test_reorg_replay_changes_nothing(spark, sf_dir):
    from ledgerspark.plans.queries import state_of

    state, events = state_of(spark, sf_dir)
    once = reorg.apply(state, events)
    twice = reorg.apply(once, events)
    for name in once:
        a, b = (sorted(map(str, x[name].collect())) for x in (once, twice))
        assert a == b, name
    net = once["ledger"].groupBy("token").agg(F.sum(F.when(F.col("kind") != "fee", F.col("amount"))).alias("n")).where("token <> ''")
    assert {r.n for r in net.collect()} <= {0}


def test_detection_limits(spark):
    local = [("1", n, f"l{n}" if n > 5 else f"c{n}") for n in range(1, 11)] + [("2", n, f"l{n}") for n in range(1, 300)] + [("3", n, f"c{n}") for n in (1, 2, 4)] + [("4", n, f"x{n}") for n in range(1, 9)]
    canon = [("1", n, f"c{n}") for n in range(1, 13)] + [("2", n, f"c{n}") for n in range(1, 301)] + [("3", n, "c1" if n == 1 else f"d{n}") for n in range(1, 6)] + [("4", n, f"c{n}") for n in range(1, 8)]
    schema = "chain_id string, block_number long, block_hash string"
    got = reorg.detect(spark.createDataFrame(local, schema), spark.createDataFrame(canon, schema))
    assert sorted(map(tuple, got.collect())) == [("1", 10, 5, 5, None), ("2", 299, None, None, "search_limit"), ("3", 4, 1, 3, "local_gap")]


def test_folds(spark):
    rng = random.Random(1)
    names = ["pending", "confirmed", "finalized", "reverted"]
    rows = [(rng.randrange(20), rng.randrange(50), k, rng.choice(names)) for k in range(600)]
    df = spark.createDataFrame(rows, "tx_key long, ts long, event_id long, new_status string")
    want, legal = {}, streams.legal_moves()
    for key, _, _, to in sorted(rows):
        now, moves, rejected = want.get(key, ("pending", 0, 0))
        want[key] = (to, moves + 1, rejected) if to in legal.get(now, ()) else (now, moves, rejected + 1)
    assert {r.tx_key: (r.status, r.moves, r.rejected) for r in status.fold(df).collect()} == want
    seen = spark.createDataFrame([("a", s, k) for k, s in enumerate([0, 5, 11, 12, 30])] + [("b", 3, 9)], "k string, s long, e long").withColumn("ts", F.timestamp_seconds("s"))
    kept = status.first_within_ttl(seen, "k", "ts", 10, "e")
    assert sorted((r.k, r.e) for r in kept.collect()) == [("a", 0), ("a", 2), ("a", 4), ("b", 9)]


def test_health_and_rates(spark):
    rng = random.Random(2)
    rows = [("1", f"n{rng.randrange(3)}", t, t, rng.random() < 0.5) for t in range(300)]
    df = spark.createDataFrame(rows, "chain_id string, node string, ts long, event_id long, ok boolean")
    got = {r.event_id: r.healthy for r in metrics.node_health(df, 2, 5).collect()}
    state = {}
    for _, node, t, _, ok in rows:
        streak, good, healthy = state.get(node, (0, 0, True))
        streak, good = (0, good + 1) if ok else (streak + 1, good)
        healthy = (good >= 5 or healthy) if ok else healthy and streak < 2
        state[node] = (streak, good, healthy)
        assert got[t] == healthy
    samples = spark.createDataFrame([("1", k, float(k * k)) for k in range(5)], "chain_id string, s long, rate double").withColumn("at", F.timestamp_seconds("s"))
    ema, want = 0.0, []
    for k in range(5):
        ema = 0.3 * k * k + 0.7 * ema
        want.append(ema)
    assert [r.ema for r in metrics.moving_rate(samples).orderBy("at").collect()] == pytest.approx(want)


def test_contiguous_heights(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for c in range(30):
        spans = [(s, s + rng.randrange(1, 25), rng.random() < 0.85) for s in rng.sample(range(1, 80), 12)] + [(1, rng.randrange(1, 9), c % 5 > 0)]
        rows += [(str(c), a, b, ok) for a, b, ok in spans]
        done = {h for a, b, ok in spans if ok for h in range(a, b + 1)}
        want[str(c)] = next(h for h in range(1, 999) if h not in done) - 1
    got = progress.contiguous(spark.createDataFrame(rows, "chain_id string, start_block long, end_block long, success boolean"))
    assert {r.chain_id: r.contiguous_height for r in got.collect()} == want


def test_ranges(spark):
    heads = spark.createDataFrame([("1", 10, 25, 40, 0.0), ("2", 50, 40, 40, 0.9), ("3", 0, 7, 3, 0.9)], "chain_id string, hw_scanned long, finalized long, tip long, pressure double")
    got = sorted((r.chain_id, r.start_block, r.end_block) for r in progress.scan_ranges(heads, 8).collect())
    assert got == [("1", 11, 18), ("1", 19, 25), ("3", 1, 2), ("3", 3, 3)]
    s = progress.shard_ranges(spark.createDataFrame([("1", 5, 14), ("2", 1, 2)], "chain_id string, start_block long, end_block long"), 4)
    assert sorted(map(tuple, s.collect())) == [("1", 0, 5, 7), ("1", 1, 8, 10), ("1", 2, 11, 12), ("1", 3, 13, 14), ("2", 0, 1, 1), ("2", 1, 2, 2)]


def test_tables(spark, tmp_path):
    schema = "chain_id string, block_number long, block_hash string, version long"
    old = spark.createDataFrame([("1", 1, "a", 1), ("1", 2, "b", 5)], schema)
    new = spark.createDataFrame([("1", 1, "c", 1), ("1", 2, "d", 4), ("2", 1, "e", 1)], schema)
    merged = tables.upsert(old, new, tables.KEYS["blocks"])
    want = [("1", 1, "c"), ("1", 2, "b"), ("2", 1, "e")]
    tables.write_version(merged, str(tmp_path / "t"), 1)
    again = tables.upsert(tables.read_version(spark, str(tmp_path / "t"), 1).drop("height_bucket"), new, tables.KEYS["blocks"])
    assert sorted((r.chain_id, r.block_number, r.block_hash) for r in again.collect()) == want
    marks = spark.createDataFrame([("1", 5, 4)], "chain_id string, hw_scanned long, hw_confirmed long")
    up = spark.createDataFrame([("1", 9), ("2", 1)], "chain_id string, hw_scanned long")
    assert [tuple(r) for r in tables.update_watermark(marks, up).collect()] == [("1", 9, 4)]
    ranges = spark.createDataFrame([("1", 3, 6), ("1", 5, 8), ("1", 20, 21)], "chain_id string, fork_height long, old_tip long")
    assert sorted((r.low, r.high) for r in tables.merged_ranges(ranges).collect()) == [(3, 8), (20, 21)]


def test_notifications(spark):
    rows = [("1", k, "reorg" if k in (250, 251) else "log", f'{{"n":{k}}}') for k in range(500)]
    df = spark.createDataFrame(rows, "chain_id string, k long, event_type string, body string")
    out = notify.packed(notify.batches(df, ["chain_id"], ["k"]), ["chain_id"], ["k"]).orderBy("epoch", "batch").collect()
    assert [r.batch_size for r in out] == [100, 100, 50, 1, 100, 100, 49]
    first = json.loads(out[4].message)
    assert first["batch_size"] == 100 and first["events"][0] == {"n": 251}


def test_ledger_rules(spark):
    txs = spark.createDataFrame([("1", "t1", 1, A, B, Decimal(100), 2, 10, "confirmed", None), ("1", "t2", 1, A, B, Decimal(50), 2, 10, "reverted", "execution"), ("1", "t3", 1, A, B, Decimal(50), 2, 10, "reverted", "reorg")], "chain_id string, tx_hash string, block_number long, from_address string, to_address string, value_wei decimal(38,0), gas_price long, gas_used long, status string, revert_reason string")
    pad = lambda a: "0x" + "0" * 24 + a[2:]
    logs = spark.createDataFrame([("1", t, 1, 0, "0xk", [X.TRANSFER, pad(A), pad(B)], hex(7)) for t in ("t1", "t2", "t3")] + [("1", "t1", 1, 1, "0xk", [X.TRANSFER], hex(9))], "chain_id string, tx_hash string, block_number long, log_index long, address string, topics array<string>, data string")
    bal = {(r.address, r.token): int(r.balance) for r in ledger.balances(ledger.entries(txs, logs)).collect()}
    assert bal == {(A, ""): -140, (B, ""): 100, (A, "0xk"): -7, (B, "0xk"): 7}


def test_streams_agree_with_batch(spark, sf_dir):
    from ledgerspark.plans.queries import QUERIES

    a = sorted(map(tuple, QUERIES["tx_status_stream"](spark, sf_dir).collect()))
    b = sorted(map(tuple, QUERIES["tx_status_fold"](spark, sf_dir).collect()))
    assert a == b


def test_retries_and_dead_letters(spark):
    df = spark.createDataFrame([(k, 1 + k % 4) for k in range(8)], "k long, attempt int")
    failed = []
    good = streams.with_retries(df, lambda d: d.withColumn("ok", F.col("k") % 2 == 0), lambda d: failed.extend(d.collect()))
    assert good.count() == 4 and {(r.k, r.dead) for r in failed} == {(1, False), (3, True), (5, False), (7, True)}


def test_expired_keys(spark):
    t = datetime(2024, 1, 2)
    done = spark.createDataFrame([("a", datetime(2024, 1, 1, 12)), ("b", datetime(2023, 1, 1))], "key string, created_at timestamp")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert sorted(r.key for r in joins.not_processed(rows, done, F.lit(t), 86400).collect()) == ["b", "c"]
    assert [r.key for r in status.unexpired(done, F.lit(t), 86400).collect()] == ["a"]
    assert [r.key for r in status.cleared(done, rows.where("key = 'a'")).collect()] == ["b"]


def test_wide_numbers(spark):
    """All magnitudes, with digits at the edges of the bases that carries pass."""
    rng = random.Random(9)
    nums = [0, 1, 2**64 - 1, 2**64, 2**256 - 1, 10**77, *(10 ** (9 * k) - 1 for k in range(1, 9)), *(10 ** (18 * k) + 10**9 - 1 for k in range(1, 5)), *(rng.getrandbits(rng.randrange(1, 257)) for _ in range(300))]
    df = spark.createDataFrame([(str(n), hex(n)) for n in nums], "want string, h string")
    assert df.select("want", X.hex_to_text(F.col("h")).alias("got")).where("NOT want <=> got").count() == 0
    total = df.agg(X.sum_words(X.hex_word(F.col("h"))).alias("t")).first()["t"]
    assert total == str(sum(nums))


def test_duration_text(spark):
    df = spark.createDataFrame([(0.0125, "12ms"), (1.5, "1.50s"), (135.0, "2.25m"), (5400.0, "1.50h"), (None, None)], "s double, want string")
    assert df.where(~F.col("want").eqNullSafe(X.duration_text(F.col("s")))).count() == 0


def test_missing_heights(spark, tmp_path):
    """What is not there becomes a bad row, or fails the range; a batch needs an end."""
    for h in (10, 12):
        (tmp_path / f"{h}.json").write_text('{"jsonrpc":"2.0","id":1,"result":{"number":"0x1"}}')
    spark.dataSource.register(blocks.BlockRangeSource)
    read = lambda **o: spark.read.format("block_range").options(path=str(tmp_path), start=10, **o).load()
    good, bad = rpc.decode_envelopes(read(end=12))
    assert [r.block_number for r in good.orderBy("block_number").collect()] == [10, 12] and [(r.block_number, r.reason) for r in bad.collect()] == [(11, "unreadable")]
    with pytest.raises(Exception, match="nothing at 11"):
        read(end=12, missing="fail").collect()
    with pytest.raises(Exception, match="no head"):
        read().collect()
    _, bad = rpc.decode_envelopes(read(hashes="12, 0xmissing", missing="row"))
    assert [r.name for r in bad.collect()] == ["0xmissing"]
    assert blocks.BlockStreamReader({"path": str(tmp_path)}).latestOffset() == {"height": -1}


def test_ttl_over_many_repeats(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(4000), k) for k in range(3000)]
    want, last = [], {}
    for k, t, e in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] > 10:
            last[k] = t
            want.append(e)
    df = spark.createDataFrame(rows, "k string, s long, e long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.e for r in status.first_within_ttl(df, "k", "ts", 10, "e").collect()) == sorted(want)


def test_address_lists_are_values(spark):
    df = spark.createDataFrame([("it's", "0x1"), ("b", "it's")], "from_address string, to_address string")
    from ledgerspark.operators import quality

    assert quality._among(df, ["from_address", "to_address"], ["it's"]).count() == 2
