"""Ledger views over the driver's tables. One text serves Spark and DuckDB; later views use earlier ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import exprs as X
from ledgerspark.shared import brief_shuffles, fresh_path

#: {H:text} is the SHA-256 of a text in hex.
VIEWS: dict[str, str] = {
    "tx": """
SELECT CASE o_orderkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '56' ELSE '137' END AS chain_id,
       CAST(floor(o_orderkey / 30.0) AS BIGINT) + 1 AS block_number,
       o_orderkey % 30 AS tx_index,
       concat('0x', {H:concat('tx-', CAST(o_orderkey AS STRING))}) AS tx_hash,
       concat('0x', substr({H:concat('addr-', CAST(o_custkey AS STRING))}, 1, 40)) AS from_address,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE
         concat('0x', substr({H:concat('addr-', CAST((o_custkey * 7 + o_orderkey) % 1500 AS STRING))}, 1, 40)) END AS to_address,
       CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DECIMAL(38,0)) * CAST(10000000000000000 AS DECIMAL(18,0)) AS value_wei,
       CAST(1000000000 * (1 + o_orderkey % 50) AS BIGINT) AS gas_price,
       CASE o_orderstatus WHEN 'F' THEN 'finalized' WHEN 'O' THEN 'pending' ELSE 'confirmed' END AS status,
       o_orderkey AS src_key
FROM orders""",
    "receipts": """
SELECT t.chain_id, t.tx_hash, t.block_number, t.tx_index, CAST(21000 * count(*) AS BIGINT) AS gas_used,
       CASE WHEN t.status = 'confirmed' AND t.src_key % 2 = 0 THEN '0x0' ELSE '0x1' END AS status_hex
FROM tx t JOIN lineitem l ON l.l_orderkey = t.src_key
GROUP BY t.chain_id, t.tx_hash, t.block_number, t.tx_index, t.status, t.src_key""",
    "tokens": """
SELECT * FROM (VALUES
 ('1', 0, '0xdAC17F958D2ee523a2206206994597C13D831ec7', 'USDT', 'Tether', 6),
 ('1', 1, '0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48', 'USDC', 'USD Coin', 6),
 ('1', 2, '0x2260FAC5E5542a773Aa44fBCfeDf7C193bc2C599', 'WBTC', 'Wrapped BTC', 8),
 ('56', 0, '0x55d398326f99059fF775485246999027B3197955', 'USDT', 'Tether', 18),
 ('56', 1, '0x8AC76a51cc950d9822D68b83fE1Ad97B32Cd580d', 'USDC', 'USD Coin', 18),
 ('137', 0, '0xc2132D05D31c914a87C6611C10748AEb04B58e8F', 'USDT', 'Tether', 6),
 ('137', 1, '0x2791Bca1f2de4661ED88A30C99A7a9449Aa84174', 'USDC', 'USD Coin', 6)
) AS v(chain_id, slot, contract, symbol, name, decimals)""",
    "logs": """
SELECT t.chain_id, t.tx_hash, t.block_number, t.tx_index, g.log_index,
       coalesce(k.contract, concat('0x', repeat('9', 40))) AS address,
       CASE WHEN g.qty % 10 = 0 THEN concat('0x', {H:'other'})
            ELSE '0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef' END AS topic0,
       concat('0x', repeat('0', 24), substr(t.from_address, 3, 40)) AS topic1,
       concat('0x', repeat('0', 24), substr(coalesce(t.to_address, concat('0x', repeat('0', 40))), 3, 40)) AS topic2,
       concat('0x', lpad(lower(hex(CAST(g.qty * 1000000 + t.src_key AS BIGINT))), 64, '0')) AS data,
       CAST(g.qty * 1000000 + t.src_key AS BIGINT) AS amount
FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS log_index, min(l_suppkey) AS supp, CAST(sum(l_quantity) AS BIGINT) AS qty
      FROM lineitem GROUP BY l_orderkey, CAST(l_linenumber AS BIGINT)) g
JOIN tx t ON t.src_key = g.l_orderkey
LEFT JOIN tokens k ON k.chain_id = t.chain_id AND k.slot = g.supp % 4""",
    "heads": """
SELECT chain_id, max(block_number) AS tip,
       greatest(max(block_number) - CASE chain_id WHEN '1' THEN 12 WHEN '56' THEN 20 ELSE 128 END, 0) AS finalized,
       CASE chain_id WHEN '1' THEN 3 WHEN '56' THEN 0 ELSE 7 END AS fork_depth
FROM tx GROUP BY chain_id""",
    "blocks_local": """
SELECT t.chain_id, t.block_number,
       concat('0x', {H:concat(CASE WHEN t.block_number > h.tip - h.fork_depth THEN 'fork-' ELSE 'blk-' END, t.chain_id, '-', CAST(t.block_number AS STRING))}) AS block_hash,
       concat('0x', {H:concat(CASE WHEN t.block_number - 1 > h.tip - h.fork_depth THEN 'fork-' ELSE 'blk-' END, t.chain_id, '-', CAST(t.block_number - 1 AS STRING))}) AS parent_hash,
       1700000000 + 12 * t.block_number AS block_ts, count(*) AS tx_count
FROM tx t JOIN heads h ON h.chain_id = t.chain_id
GROUP BY t.chain_id, t.block_number, h.tip, h.fork_depth""",
    "blocks_canonical": """
SELECT b.chain_id, b.block_number, concat('0x', {H:concat('blk-', b.chain_id, '-', CAST(b.block_number AS STRING))}) AS block_hash FROM blocks_local b
UNION ALL
SELECT chain_id, tip + 1, concat('0x', {H:concat('blk-', chain_id, '-', CAST(tip + 1 AS STRING))}) FROM heads WHERE chain_id = '137'""",
    "status_updates": """
SELECT user_id AS tx_key, ts, event_id,
       CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'purchase' THEN 'finalized' WHEN 'error' THEN 'reverted' ELSE 'pending' END AS new_status
FROM events""",
    "probe_log": """
SELECT CASE user_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '56' ELSE '137' END AS chain_id,
       concat('node-', CAST(user_id % 10 AS STRING)) AS node, ts, event_id, event_type <> 'error' AS ok, value AS response_ms
FROM events""",
    "reorg_events": """
SELECT CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '56' ELSE '137' END AS chain_id,
       ts AS detected_at, event_id, 1 + event_id % 40 AS depth, 60 + event_id % 400 AS old_tip,
       60 + event_id % 400 - (1 + event_id % 40) AS fork_height, event_id % 4 = 0 AS processed
FROM events WHERE event_type = 'error'""",
    "scan_results": """
SELECT chain_id, CAST(floor((block_number - 1) / 10.0) AS BIGINT) AS range_no, min(block_number) AS start_block, max(block_number) AS end_block,
       count(DISTINCT block_number) AS blocks_scanned, count(*) AS txs_found, CAST(floor((block_number - 1) / 10.0) AS BIGINT) % 7 <> 3 AS success
FROM tx GROUP BY chain_id, CAST(floor((block_number - 1) / 10.0) AS BIGINT)""",
}
TABLES = ("orders", "lineitem", "events")
#: Views of one row a chain. Joins inside other views broadcast them; otherwise all rows would be dealt by chain.
OF_CHAIN = ("heads",)


def _needs(text: str) -> list[str]:
    return [n for n in (*TABLES, *VIEWS) if re.search(rf"(FROM|JOIN) {n}\b", text)]


def duckdb_with(sql: str) -> str:
    """``sql`` behind the fixture views it uses, as one DuckDB statement."""
    todo, used = _needs(sql), []
    while todo:
        n = todo.pop()
        if n in VIEWS and n not in used:
            used.append(n)
            todo += _needs(VIEWS[n])
    ctes = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in used]
    body = re.sub(r"^\s*WITH\s", ", " if ctes else "WITH RECURSIVE ", sql)
    text = (("WITH RECURSIVE " + ",\n".join(ctes)) if ctes else "") + ("\n" if not body.startswith(",") else "") + body
    return hashed(text, "sha256({})")


def hashed(text: str, call: str) -> str:
    """Replaces {H:...} with a call; texts inside may hold parentheses, not braces."""
    return re.sub(r"\{H:([^{}]*)\}", lambda m: call.format(m[1]), text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Fixture view ``name`` as a DataFrame."""
    if name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df
    text = hashed(VIEWS[name], "sha2({}, 256)")
    parts = {n: F.broadcast(view(spark, sf_dir, n)) if n in OF_CHAIN else view(spark, sf_dir, n) for n in _needs(text)}
    for n in parts:
        text = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **parts)


#: Where an application has written the raw blocks of a folder of tables.
_WRITTEN: dict[tuple[str, str], str] = {}


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain_id, block_number, envelope): one RPC answer for each block, every fiftieth sender damaged.

    Written once for each application, as the dumps are that a scanner would find; queries then only read and decode.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        path = fresh_path(spark, "raw-blocks")
        with brief_shuffles(spark):
            _made_blocks(spark, sf_dir).write.option("compression", "zstd").parquet(path)
        _WRITTEN[key] = path
    return spark.read.schema("chain_id string, block_number bigint, envelope string").parquet(_WRITTEN[key])


def _made_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, blocks = view(spark, sf_dir, "tx"), view(spark, sf_dir, "blocks_local")
    sender = F.when(F.col("src_key") % 50 == 7, F.substring("from_address", 1, 41)).otherwise(F.col("from_address"))
    value = F.concat(F.lit("0x"), _hex_of(F.col("value_wei")))
    one = F.to_json(F.struct(F.col("tx_hash").alias("hash"), sender.alias("from"), F.col("to_address").alias("to"), value.alias("value"), X.to_hex(F.col("gas_price")).alias("gasPrice"), F.lit("0x").alias("input")))
    per = tx.groupBy("chain_id", "block_number").agg(F.sort_array(F.collect_list(F.struct("tx_index", one.alias("j")))).alias("l"))
    joined = blocks.join(per, ["chain_id", "block_number"])
    body = F.concat(
        F.lit('{"jsonrpc":"2.0","id":1,"result":{"number":"'), X.to_hex(F.col("block_number")), F.lit('","hash":"'), F.col("block_hash"), F.lit('","parentHash":"'), F.col("parent_hash"),
        F.lit('","timestamp":"'), X.to_hex(F.col("block_ts")), F.lit('","transactions":['), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]}}"),
    )
    return joined.select("chain_id", "block_number", body.alias("envelope"))


def _hex_of(c: F.Column) -> F.Column:
    """Hex digits of a decimal of at most 2^116, in two parts."""
    half = F.lit(2**56).cast("decimal(20,0)")
    low = (c % half).cast("decimal(20,0)")
    # Nothing is left over: other quotients are rounded to six places, which may lift them to the next whole number.
    high = ((c - low) / half).cast("bigint")
    return F.when(high > 0, F.concat(F.hex(high), F.lpad(F.hex(low.cast("bigint")), 14, "0"))).otherwise(F.hex(low.cast("bigint")))
