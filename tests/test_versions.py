"""Tables that change together: what an upsert touches, changes that stop half-way, replays, readers; topics and bulk writes."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import normalize, reorg, tables, versions
from ledgerspark.sources import messages

KEYS = ["chain_id", "block_number"]


def blocks(spark, heights, version, chain="1"):
    return spark.range(*heights).select(F.lit(chain).alias("chain_id"), F.col("id").alias("block_number"), F.lit(version).alias("version"))


@pytest.fixture
def store(spark, tmp_path):
    out = versions.Store(spark, str(tmp_path), bucket=10)
    both = blocks(spark, (0, 1000), 1).unionByName(blocks(spark, (0, 50), 1, "a/b=c d%"))
    out.publish([out.fresh("blocks", both)], out.snapshot())
    return out


def test_upsert_touches_its_partitions(spark, store):
    """New rows of one bucket in a hundred: the other directories stay as they are, and are not read."""
    before = store.snapshot()
    new = blocks(spark, (500, 505), 2).unionByName(blocks(spark, (507, 508), 0))
    read = []
    real = versions.Snapshot.read
    versions.Snapshot.read = lambda self, table, names=None: read.append(names) or real(self, table, names)
    try:
        change = store.merged("blocks", new, KEYS)
    finally:
        versions.Snapshot.read = real
    assert read == [["p_chain=1/p_bucket=50"]] and list(change.put) == ["p_chain=1/p_bucket=50"]
    after = store.publish([change], before)
    assert {n for n, p in after.parts("blocks").items() if before.parts("blocks")[n] != p} == {"p_chain=1/p_bucket=50"}
    got = {r.block_number: r.version for r in after.read("blocks").where("chain_id = '1'").collect()}
    assert got == {h: 2 if 500 <= h < 505 else 1 for h in range(1000)}
    # Who opened the tables before still sees them as they were.
    assert before.read("blocks").where("version <> 1").count() == 0 and before.read("blocks").count() == 1050


def test_upsert_of_other_chains(spark, store):
    at = store.publish([store.merged("blocks", blocks(spark, (45, 55), 2, "a/b=c d%"), KEYS)], store.snapshot())
    rows = at.read("blocks").where("chain_id = 'a/b=c d%'")
    assert rows.count() == 55 and rows.where("version = 2").count() == 10 and at.read("blocks").count() == 1055
    assert at.inside("blocks", [("a/b=c d%", 49, 52)]) == ["p_chain=a%2Fb%3Dc d%25/p_bucket=5"]
    assert sorted(at.inside("blocks", [("1", 99, 100), ("1", 989, 5000)])) == ["p_chain=1/p_bucket=10", "p_chain=1/p_bucket=99"]


def test_stopped_change_shows_nothing(spark, store):
    """A change of two tables that fails in the second leaves the first as it was."""
    old = store.snapshot()

    def work(at):
        change = store.merged("blocks", blocks(spark, (0, 5), 2), KEYS, at=at)
        broken = blocks(spark, (0, 5), 2).withColumn("x", F.raise_error(F.lit("stopped")).cast("string"))
        return [change, store.fresh("others", broken)]

    with pytest.raises(Exception, match="stopped"):
        store.once("s", 7, work)
    assert store.numbers() == [1] and store.snapshot().content == old.content
    assert store.forget(1) > 0 and store.snapshot().read("blocks").count() == 1050


def test_replay_and_conflict(spark, store):
    calls = []

    def work(at):
        calls.append(at.number)
        return [store.appended("log", blocks(spark, (0, 3), 1))]

    first = store.once("s", 0, work)
    assert store.once("s", 0, work).number == first.number and calls == [1]
    second = store.once("s", 1, work)
    assert second.read("log").count() == 6 and store.once("other", 0, work).read("log").count() == 9
    with pytest.raises(versions.Conflict):
        store.publish([], first)
    assert store.forget(1) == 3 and store.snapshot().read("blocks").count() == 1050


def test_empty_tables(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path / "e"))
    assert store.numbers() == [] and store.snapshot().parts("blocks") == {}
    none = blocks(spark, (0, 0), 1)
    at = store.publish([store.fresh("blocks", none)], store.snapshot())
    assert at.read("blocks").count() == 0
    at = store.publish([store.merged("blocks", blocks(spark, (0, 5), 1), KEYS)], at)
    assert at.read("blocks").count() == 5
    at = store.publish([store.rewritten("blocks", list(at.parts("blocks")), lambda df: df.where("false"))], at)
    assert at.read("blocks").count() == 0 and at.parts("blocks") == {}


def test_reorganisation_is_published_at_once(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path), bucket=10)
    b = blocks(spark, (1, 101), 1).withColumn("block_hash", F.col("block_number").cast("string"))
    tx = b.select("chain_id", F.concat(F.lit("t"), "block_hash").alias("tx_hash"), "block_number", F.lit("confirmed").alias("status"), F.lit(None).cast("string").alias("revert_reason"))
    logs = tx.select("chain_id", "tx_hash", "block_number", F.lit(0).alias("log_index"))
    entry = tx.select("chain_id", F.lit("x").alias("address"), F.lit("").alias("token"), "tx_hash", "block_number", F.lit("credit").alias("kind"), F.lit(5).cast("decimal(38,0)").alias("amount"))
    marks = spark.createDataFrame([("1", 100)], "chain_id string, hw_scanned long")
    kind = "chain_id string, event_id string, fork_height long, old_tip long, depth long"
    none = spark.createDataFrame([], kind + ", processed boolean")
    at = store.snapshot()
    at = store.publish([store.fresh(n, df) for n, df in (("transactions", tx), ("blocks", b), ("logs", logs), ("ledger", entry))] + [store.fresh("watermarks", marks, False), store.fresh("reorg_events", none, False)], at)
    events = spark.createDataFrame([("1", "e", 84, 100, 16)], kind)
    after = reorg.commit(store, events, batch=3)
    assert after.read("blocks").count() == after.read("logs").count() == 84
    assert after.read("transactions").where("status = 'reverted' AND revert_reason = 'reorg'").count() == 16
    assert after.read("ledger").agg(F.sum("amount")).first()[0] == 84 * 5 and after.read("watermarks").first().hw_scanned == 84
    changed = {n for n in at.parts("transactions") if after.parts("transactions")[n] != at.parts("transactions")[n]}
    assert changed == {"p_chain=1/p_bucket=8", "p_chain=1/p_bucket=9", "p_chain=1/p_bucket=10"}
    assert reorg.commit(store, events, batch=3).number == after.number
    again = reorg.commit(store, events, batch=4)
    assert again.number == after.number + 1 and again.read("ledger").count() == after.read("ledger").count()
    assert at.read("blocks").count() == 100


def test_typed_messages(spark):
    rows = [(b"k", b'{"chain_id":"1","block_number":5,"block_hash":"h"}'), (b"k", b'{"chain_id":"1","block_number":"5x","block_hash":"h"}'), (None, b"{broken"), (b"k", b'{"block_number":7}'), (b"k", None), (b"k", b"{}")]
    df = spark.createDataFrame(rows, "key binary, value binary").withColumn("timestamp", F.lit(datetime(2024, 1, 1)))
    good, dead = messages.typed(df, messages.TOPICS["raw-blocks"])
    assert [(r.block_number, r.key) for r in good.collect()] == [(5, "k")]
    why = sorted(r.reason for r in dead.collect())
    assert why.count("missing chain_id, block_hash") == 1 and len(why) == 5
    for t in messages.TOPICS.values():
        messages.typed(df, t)[0].collect()


def test_sink_replaces_what_was_left_unfinished(spark, tmp_path):
    sink = messages.OnceSink(str(tmp_path))
    rows = spark.range(3)
    assert sink.write("t", rows, 0) and not sink.write("t", rows, 0) and sink.write("t", rows, 1)
    (tmp_path / "t" / "batch=1" / "_SUCCESS").unlink()
    assert sink.write("t", rows, 1) and sink.read(spark, "t").count() == 6


def test_failing_handler_gives_the_batch_again(spark, tmp_path):
    value = json.dumps({"chain_id": "1", "tx_hash": "t", "block_number": 1})
    spark.createDataFrame([(b"k", value.encode(), datetime(2024, 1, 1))], "key binary, value binary, timestamp timestamp").write.parquet(f"{tmp_path}/in")
    sink, calls = messages.OnceSink(f"{tmp_path}/out"), []

    def handler(rows, n):
        sink.write("txs", rows, n)
        calls.append(n)
        if len(calls) == 1:
            raise RuntimeError("lost")

    read = lambda: spark.readStream.schema("key binary, value binary, timestamp timestamp").parquet(f"{tmp_path}/in")
    start = lambda: messages.subscribe(read(), "normalized-transactions", handler, lambda rows, n: None, f"{tmp_path}/c").start()
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    start().awaitTermination()
    assert calls == [0, 0] and sink.read(spark, "txs").count() == 1


def test_bulk_ids(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "a", 3)], "chain_id string, tx_hash string, v long")
    tables.write_bulk(df, str(tmp_path), ["chain_id", "tx_hash"], 0)
    tables.write_bulk(df.withColumn("v", F.col("v") * 10), str(tmp_path), ["chain_id", "tx_hash"], 1)
    tables.write_bulk(df.withColumn("v", F.col("v") * 100), str(tmp_path), ["chain_id", "tx_hash"], 1)
    got = tables.read_bulk(spark, str(tmp_path)).collect()
    assert sorted((r.chain_id, r.tx_hash, r.v) for r in got) == [("1", "a", 100), ("1", "b", 200), ("2", "a", 300)] and len({r.record_id for r in got}) == 3


def test_lenient_logs(spark):
    raw = [("1", '{"transactionHash":"t","logIndex":"0x2","topics":["a",null,3]}'), ("1", "{broken"), ("1", None)]
    good, bad = normalize.evm_logs(spark.createDataFrame(raw, "chain_id string, result string"), lenient=True)
    got = sorted((r.tx_hash, r.block_number, r.log_index, r.address, len(r.topics), r.data) for r in good.collect())
    assert got == [("", 0, 0, "", 0, ""), ("", 0, 0, "", 0, ""), ("t", 0, 2, "", 2, "")] and bad.count() == 0


def test_ingest_is_published_once(spark, tmp_path):
    """A batch that fails on the way shows nothing; after the restart each row is there once, and a block that comes again is
    replaced."""
    from ledgerspark.streaming import streams

    def envelope(height, mark, *txs):
        rows = [{"hash": f"t{height}-{k}", "from": sender, "to": None, "value": "0x5", "gasPrice": "0x1", "input": "0x"} for k, sender in enumerate(txs)]
        return json.dumps({"jsonrpc": "2.0", "id": 1, "result": {"number": hex(height), "hash": mark, "parentHash": "p", "timestamp": "0x5", "transactions": rows}})

    good, bad = "0x" + "a" * 40, "0xbad"
    for k, rows in enumerate([[("1", envelope(5, "h5", good, bad)), ("1", "{broken")], [("1", envelope(6, "h6", good)), ("1", envelope(5, "new5", good, good))]]):
        spark.createDataFrame(rows, "chain_id string, envelope string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    store = versions.Store(spark, f"{tmp_path}/store", 10)
    read = lambda: spark.readStream.schema("chain_id string, envelope string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = lambda: streams.ingest_into(read(), store, f"{tmp_path}/c").start().awaitTermination()
    real, versions.Store.appended = versions.Store.appended, lambda *a, **k: 1 / 0
    try:
        with pytest.raises(Exception, match="division"):
            run()
    finally:
        versions.Store.appended = real
    assert store.numbers() == []
    run()
    at = store.snapshot()
    assert at.content["batches"] == {"ingest": 1} and store.numbers() == [1, 2]
    assert sorted((r.block_number, r.block_hash) for r in at.read("blocks").collect()) == [(5, "new5"), (6, "h6")]
    assert sorted(r.tx_hash for r in at.read("transactions").collect()) == ["t5-0", "t5-1", "t6-0"]
    assert at.read("quarantine").count() == 2 and store.snapshot(1).read("transactions").count() == 1


def test_relational_tables(spark):
    """Rows go to an embedded database and come back in ranges of heights; a later read takes what is new."""
    url, options = "jdbc:derby:memory:ledger;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [("1", h, f"h{h}") for h in range(10, 500)] + [("1", None, "none")]
    messages.write_table(spark.createDataFrame(rows, "chain_id string, block_number long, block_hash string").repartition(3), url, "blocks", **options)
    got = messages.read_table(spark, url, "blocks", 4, **options)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 200
    new = messages.read_table(spark, url, "blocks", 2, since=490, **options)
    assert sorted(r[1] for r in new.collect()) == list(range(491, 500))
    assert messages.read_table(spark, url, "blocks", 2, since=1000, **options).count() == 0


def test_writes_leave_no_shuffle_files_and_are_compressed(spark, tmp_path):
    """What a change has shuffled goes when it is written; hex texts travel and lie in half their bytes, and come back."""
    from pathlib import Path

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*")}
    rows = spark.range(3000).select(F.lit("1").alias("chain_id"), F.col("id").alias("block_number"), F.concat(F.lit("0x"), F.sha2(F.col("id").cast("string"), 256)).alias("h"), F.array(F.lit("0xAB"), F.lit(None), F.lit("0x")).alias("topics"), F.lit(1).alias("version"))
    out, before = versions.Store(spark, str(tmp_path), bucket=1000), files()
    at = out.publish([out.merged("t", rows, ["chain_id", "h"])], out.snapshot())
    assert not files() - before
    # The table had none of these partitions, so the rows were written once.
    assert not (tmp_path / "data" / "t").exists() and {p.split("/")[1] for ps in at.parts("t").values() for p in ps} == {"t.new"}
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 3000 * 50
    assert sorted(map(tuple, at.read("t").collect())) == sorted(map(tuple, rows.collect()))
    again = out.publish([out.merged("t", rows.where("block_number < 10").withColumn("version", F.lit(2)), ["chain_id", "h"])], at)
    assert again.read("t").where("version = 2").count() == 10 and again.read("t").count() == 3000


def test_batches_of_ingest_wait_compressed(spark, tmp_path):
    """The rows of a batch are not persisted, and what holds them goes after it."""
    from ledgerspark.streaming import streams

    spark.createDataFrame([("1", "{}")], "chain_id string, envelope string").write.parquet(str(tmp_path / "in"))
    raw, seen = spark.readStream.schema("chain_id string, envelope string").parquet(str(tmp_path / "in")), []
    streams._started(raw, lambda df, n: seen.append((df.storageLevel.useDisk, df.count(), (tmp_path / "ckpt" / f"batch-{n}").exists())), str(tmp_path / "ckpt"), None).start().awaitTermination()
    assert seen == [(False, 1, True)] and not (tmp_path / "ckpt" / "batch-0").exists()
