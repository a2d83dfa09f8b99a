"""Faults that show only on larger tables, brought about on small ones."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def agrees(spark, name, sf_dir, tables="orders lineitem events"):
    """Whether the query has the rows of its DuckDB form."""
    con = duckdb.connect()
    for t in tables.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    return plain(entry.queries()[name](spark, sf_dir).select(*cols).collect()) == plain(want.fetchall())


@pytest.fixture
def late_broadcast(spark):
    """Small sides are found to be small only while the job runs, as on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["reorg_detect", "reorg_apply_blocks", "reorg_apply_logs", "reorg_apply_tx"])
def test_reorganisations_when_joins_turn_to_broadcasts_late(spark, late_broadcast, name):
    assert agrees(spark, name, SF)


#: Prices in cents whose value is so little below a multiple of 2^56 that a quotient of six places is rounded up to it.
PRICES = (1968527, 3952568, 5936609, 19824896)


@pytest.mark.parametrize("name", ["chain_union", "raw_tx_explode", "ingest_store"])
def test_values_just_below_a_multiple_of_the_hex_part(spark, tmp_path, name):
    for t in ("lineitem", "events"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    price = " ".join(f"WHEN {k} THEN {p / 100}" for k, p in enumerate(PRICES))
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE o_orderkey % 7 {price} ELSE o_totalprice END AS o_totalprice) FROM '/root/testdata/sf0.001/orders.parquet') TO '{tmp_path}/orders.parquet'")
    assert agrees(spark, name, str(tmp_path))


def test_events_of_one_range_share_its_list(spark):
    """What is grouped is one list a range, however many events have it."""
    from ledgerspark.operators import reorg

    txs = spark.createDataFrame([("1", h, f"t{h}") for h in range(1, 9)], "chain_id string, block_number long, tx_hash string")
    events = spark.createDataFrame([(k, "1", 2, 5) for k in range(3)] + [(7, "1", 6, 7), (8, "1", 50, 60)], "event_id long, chain_id string, fork_height long, old_tip long")
    got = {r.event_id: r.tx_hashes for r in reorg.affected(txs, events).collect()}
    assert got == {0: ["t3", "t4", "t5"], 1: ["t3", "t4", "t5"], 2: ["t3", "t4", "t5"], 7: ["t7"]}


def test_stream_files_stay_small_and_in_order(spark, tmp_path, monkeypatch):
    from ledgerspark.plans import queries

    monkeypatch.setattr(queries, "ROWS", 100)
    path = str(tmp_path / "rows")
    queries.ordered_files(spark, spark.range(1000), queries.F.col("id"), path)
    files = sorted((tmp_path / "rows").glob("part-*"), key=lambda f: f.stat().st_mtime)
    rows = [[r.id for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert len(rows) == 10 and max(map(len, rows)) < 300 and sorted(sum(rows, [])) == list(range(1000))
    assert all(max(a) < min(b) for a, b in zip(rows, rows[1:], strict=False))


def test_only_fees_wait_for_receipts(spark):
    """Coins are booked whether or not there is a receipt, fees only with one."""
    from ledgerspark.operators import ledger

    txs = spark.createDataFrame([("1", "t1", 1, "a", "b", 5, 2, "confirmed"), ("1", "t2", 1, "a", "b", 7, 2, "pending")], "chain_id string, tx_hash string, block_number long, from_address string, to_address string, value_wei long, gas_price long, status string")
    logs = spark.createDataFrame([], "chain_id string, tx_hash string, block_number long, log_index long, address string, topics array<string>, data string")
    receipts = spark.createDataFrame([("1", "t1", 3)], "chain_id string, tx_hash string, gas_used long")
    got = sorted((r.tx_hash, r.kind, r.address, int(r.amount)) for r in ledger.entries(txs, logs, receipts).collect())
    assert got == [("t1", "credit", "b", 5), ("t1", "debit", "a", -5), ("t1", "fee", "a", -6), ("t2", "credit", "b", 7), ("t2", "debit", "a", -7)]


def test_a_long_chain_has_no_more_partitions(spark, tmp_path):
    """Directories of a stored table don't grow in number with the heights."""
    from ledgerspark.plans import queries

    duckdb.sql(f"COPY (SELECT * REPLACE (o_orderkey * 1000 AS o_orderkey) FROM '/root/testdata/sf0.001/orders.parquet') TO '{tmp_path}/orders.parquet'")
    tx = queries.view(spark, str(tmp_path), "tx")
    at = queries.store_of(spark, str(tmp_path), {"transactions": tx}).snapshot()
    assert 64 < len(at.parts("transactions")) <= 3 * 64 and at.read("transactions").count() == tx.count() == 1500


def test_rows_of_a_key_wait_as_one_value(spark, tmp_path):
    """A batch puts one element into the state of a key, however many rows it brings."""
    from test_state import T0, UPDATES, kept_state, run, stream_of

    from ledgerspark.streaming import state

    rows = [(k % 2, T0, k, "confirmed") for k in range(40)]
    run(spark, state.status_stream(stream_of(spark, tmp_path, [rows], UPDATES), "60 seconds"), tmp_path)
    with state.with_rocksdb(spark):
        held = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load()
        assert held.count() == 2


def test_packed_texts_come_back(spark):
    from pyspark.sql import functions as F

    from ledgerspark.functions import exprs as X
    from ledgerspark.operators import joins

    texts = ["0x" + "0a" * 32, "0xAb", "0xabc", "0x", "", "1", "0xzz", "0xß", "zzab", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", "t", X.unpacked(X.packed(F.col("t"))).alias("u"), F.octet_length(X.packed(F.col("t"))).alias("n")).orderBy("k").collect()
    assert [r.u for r in got] == texts and got[0].n == 33
    out = joins.packed_join(df, df.select("t", F.col("k").alias("other")), ["t"])
    assert out.where("k = other").count() == len(texts) - 1 == out.count() and dict(out.dtypes)["t"] == "string"


def test_ledger_joins_travel_packed(spark):
    """Hashes meet as bytes, in half the room of their digits."""
    import json

    from ledgerspark.operators import ledger

    txs = spark.createDataFrame([], "chain_id string, tx_hash string, block_number long, from_address string, to_address string, value_wei long, gas_price long, status string")
    logs = spark.createDataFrame([], "chain_id string, tx_hash string, block_number long, log_index long, address string, topics array<string>, data string")
    receipts = spark.createDataFrame([], "chain_id string, tx_hash string, gas_used long")
    plan = json.loads(ledger.entries(txs, logs, receipts)._jdf.queryExecution().analyzed().toJSON())
    kinds = [e["dataType"] for n in plan if n["class"].endswith(".Join") for e in n["condition"] if e["class"].endswith("AttributeReference")]
    assert len(kinds) == 8 and set(kinds) == {"binary"}
