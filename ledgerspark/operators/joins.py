"""Joins of ledger tables. Shuffles are on natural keys; only the token table, a fixed list for each chain, is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import exprs as X

TX = ["chain_id", "tx_hash"]
#: Native symbols by chain id, fixed values.
NATIVE = {"1": "ETH", "56": "BNB", "137": "MATIC"}


def packed_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on ``on`` whose texts travel packed (:func:`exprs.packed`): hashes and addresses are most of what is
    shuffled, and their hex digits hardly compress."""
    (small, wide), (small_right, wide_right) = X.packs(left.schema), X.packs(right.schema)
    out = left.withColumns(small).join(right.withColumns(small_right), on, how)
    return out.withColumns(wide if how in ("left_semi", "left_anti") else wide | wide_right)


def with_receipts(txs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Transactions that have a receipt, with gas used and the status it states."""
    r = receipts.select(*TX, "gas_used", "status_hex")
    return txs.join(r, TX).withColumn("status", X.receipt_status(F.col("status_hex"))).drop("status_hex")


def without_receipt(txs: DataFrame, receipts: DataFrame) -> DataFrame:
    return txs.join(receipts.select(*TX), TX, "left_anti")


def logs_with_transactions(logs: DataFrame, txs: DataFrame) -> DataFrame:
    t = txs.select(*TX, "from_address", "to_address", "gas_price", "status")
    return logs.join(t, TX)


def with_tokens(df: DataFrame, tokens: DataFrame, contract: str = "address") -> DataFrame:
    """Adds symbol, name and decimals; ``Unknown`` and 18 where the contract isn't listed."""
    k = tokens.select(F.col("chain_id").alias("_c"), F.col("contract").alias("_k"), "symbol", "name", "decimals")
    out = df.join(F.broadcast(k), (F.col("chain_id") == F.col("_c")) & (F.col(contract) == F.col("_k")), "left").drop("_c", "_k")
    return out.withColumns({"symbol": F.coalesce("symbol", F.lit("Unknown")), "name": F.coalesce("name", F.lit("Unknown")), "decimals": F.coalesce("decimals", F.lit(18))})


def native_symbol(chain: F.Column) -> F.Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in NATIVE.items() for x in kv))[chain], F.lit("ETH"))


def members(df: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is among the values of the one column of ``listed``."""
    return df.join(listed.select(F.col(listed.columns[0]).alias(column)), column, "left_semi")


def not_processed(df: DataFrame, processed: DataFrame, now: F.Column, ttl_seconds: int) -> DataFrame:
    """Rows whose ``key`` was not processed within the time to live."""
    live = processed.where(F.col("created_at") > now - F.make_interval(secs=F.lit(ttl_seconds))).select("key")
    return df.join(live, "key", "left_anti")


def inside_ranges(txs: DataFrame, events: DataFrame, width: int = 32) -> DataFrame:
    """(event_id, tx): transactions inside (fork_height, old_tip] of each event of their chain.

    Ranges are spread over buckets of ``width`` heights, so that a transaction meets only the events near its height.
    """
    bucket = lambda h: F.floor(h / width)
    e = events.where("fork_height < old_tip").select(F.col("chain_id").alias("_c"), "event_id", "fork_height", "old_tip", F.explode(F.sequence(bucket(F.col("fork_height") + 1), bucket(F.col("old_tip")))).alias("_b"))
    on = (F.col("chain_id") == F.col("_c")) & (bucket(F.col("block_number")) == F.col("_b")) & (F.col("block_number") > F.col("fork_height")) & (F.col("block_number") <= F.col("old_tip"))
    return txs.join(e, on).drop("_c", "_b")


def with_named_block(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Events with ``block_reason``: why the block they name (new_hash, new_number) doesn't exist as stated, or null."""
    b = blocks.select(F.col("chain_id").alias("_c"), F.col("block_hash").alias("_h"), F.col("block_number").alias("_n"))
    out = events.join(b, (F.col("chain_id") == F.col("_c")) & (F.col("new_hash") == F.col("_h")), "left")
    why = F.when(F.col("_h").isNull(), "new block not found").when(F.col("_n") != F.col("new_number"), "new block number differs")
    return out.withColumn("block_reason", why).drop("_c", "_h", "_n")


def address_tokens(addresses: DataFrame, tokens: DataFrame) -> DataFrame:
    """(chain_id, address, token, symbol, decimals): each address with the tokens of its chain, and the native one."""
    own = addresses.join(F.broadcast(tokens.select("chain_id", F.col("contract").alias("token"), "symbol", "decimals")), "chain_id")
    native = addresses.withColumns({"token": F.lit(""), "symbol": native_symbol(F.col("chain_id")), "decimals": F.lit(18)})
    return own.select("chain_id", "address", "token", "symbol", "decimals").unionByName(native.select("chain_id", "address", "token", "symbol", "decimals"))
