"""Raw chain payloads to common rows.

Every normaliser returns (good, quarantine); quarantined rows keep their raw text and the reasons. ``lenient`` replaces
missing and bad fields by zero or empty instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark import schemas
from ledgerspark.functions import exprs as X


def reasons(*tests: tuple[str, Column]) -> Column:
    """Array of the names of the tests that hold; a null test counts as not held."""
    return F.filter(F.array(*(F.when(t, name) for name, t in tests)), lambda x: x.isNotNull())


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with ``value`` as a column that is computed once for each row.

    A generated row of one, which the optimizer neither copies into later expressions nor moves filters through:
    otherwise every field of a parsed text, and every test on it, would parse the text again.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def split(df: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """Rows without and with ``reasons``."""
    df = df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")
    good = df.where(F.size("reasons") == 0).drop("reasons", raw)
    return good, df.where(F.size("reasons") > 0).select("chain_id", F.col(raw).alias("raw"), "reasons")


def _or(c: Column, default: object, lenient: bool) -> Column:
    return F.coalesce(c, F.lit(default)) if lenient else c


def evm_blocks(df: DataFrame, raw: str = "result", lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chain_id, raw) -> blocks, with their transactions still raw."""
    b = once(df, F.from_json(raw, schemas.EVM_BLOCK), "_b")
    height, seconds = X.block_number(F.col("_b.number")), X.block_number(F.col("_b.timestamp"))
    out = b.select(
        "chain_id", _or(height, 0, lenient).alias("block_number"), _or(F.col("_b.hash"), "", lenient).alias("block_hash"), _or(F.col("_b.parentHash"), "", lenient).alias("parent_hash"),
        F.timestamp_seconds(_or(seconds, 0, lenient)).alias("block_ts"), F.col("_b.transactions").alias("transactions"), raw,
    )
    bad = [] if lenient else [(n, F.col(c).isNull()) for n, c in (("number", "block_number"), ("hash", "block_hash"), ("parentHash", "parent_hash"), ("timestamp", "block_ts"))]
    return split(out.withColumn("reasons", reasons(*bad, ("unreadable", F.lit(False))) if bad else F.array().cast("array<string>")), raw)


def block_transactions(blocks: DataFrame) -> DataFrame:
    """One row (chain_id, block_number, block_hash, tx_index, result) for each element, at its original position."""
    return blocks.select("chain_id", "block_number", "block_hash", F.posexplode("transactions").alias("tx_index", "result")).withColumn("tx_index", F.col("tx_index").cast("bigint"))


def evm_transactions(df: DataFrame, raw: str = "result", lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chain_id, block_number, block_hash, tx_index, raw) -> transactions, pending."""
    t = once(df, F.from_json(raw, schemas.EVM_TX), "_t")
    word = X.hex_word(F.col("_t.value"))
    value = X.hex_to_decimal(F.col("_t.value"))
    out = t.select(
        "chain_id", _or(F.col("_t.hash"), "", lenient).alias("tx_hash"), "block_number", "block_hash", "tx_index", _or(F.col("_t.from"), "", lenient).alias("from_address"), F.col("_t.to").alias("to_address"),
        _or(word, "0" * 64, lenient).alias("value_hex"), (F.when(word.isNull(), F.lit(0).cast("decimal(38,0)")).otherwise(value) if lenient else value).alias("value_wei"), _or(X.hex_to_decimal(F.col("_t.gasPrice")), 0, lenient).cast("decimal(38,0)").alias("gas_price"), F.lit("pending").alias("status"), raw,
    )
    bad = [] if lenient else [(n, F.col(c).isNull()) for n, c in (("hash", "tx_hash"), ("from", "from_address"), ("value", "value_hex"), ("gasPrice", "gas_price"))]
    return split(out.withColumn("reasons", reasons(*bad) if bad else F.array().cast("array<string>")), raw)


def evm_receipts(df: DataFrame, raw: str = "result") -> tuple[DataFrame, DataFrame]:
    """(chain_id, raw) -> receipts, with their logs still raw."""
    r = once(df, F.from_json(raw, schemas.EVM_RECEIPT), "_r")
    out = r.select(
        "chain_id", F.col("_r.transactionHash").alias("tx_hash"), X.block_number(F.col("_r.blockNumber")).alias("block_number"), F.col("_r.blockHash").alias("block_hash"),
        X.block_number(F.col("_r.transactionIndex")).alias("tx_index"), X.block_number(F.col("_r.gasUsed")).alias("gas_used"), F.when(F.col("_r.status").isNotNull(), X.receipt_status(F.col("_r.status"))).alias("status"), F.col("_r.logs").alias("logs"), raw,
    )
    return split(out.withColumn("reasons", reasons(*((c, F.col(c).isNull()) for c in ("tx_hash", "block_number", "block_hash", "tx_index", "gas_used", "status")))), raw)


def evm_logs(df: DataFrame, raw: str = "result", lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chain_id, raw) -> logs; topics that are no texts are dropped.

    ``lenient`` keeps every log: what is missing or unreadable is zero, empty or no topics.
    """
    g = once(df, F.from_json(raw, schemas.EVM_LOG), "_l")
    height = lambda name: _or(X.block_number(F.col(f"_l.{name}")), 0, lenient)
    word = lambda name: _or(F.col(f"_l.{name}"), "", lenient)
    topics = F.filter("_l.topics", lambda x: x.isNotNull())
    topics = F.coalesce(topics, F.array().cast("array<string>")) if lenient else topics
    out = g.select(
        "chain_id", word("transactionHash").alias("tx_hash"), height("blockNumber").alias("block_number"), height("transactionIndex").alias("tx_index"),
        height("logIndex").alias("log_index"), word("address").alias("address"), topics.alias("topics"), F.coalesce("_l.data", F.lit("")).alias("data"), raw,
    )
    bad = [] if lenient else [(c, F.col(c).isNull()) for c in ("tx_hash", "block_number", "tx_index", "log_index", "address", "topics")]
    return split(out.withColumn("reasons", reasons(*bad) if bad else F.array().cast("array<string>")), raw)


def receipt_logs(receipts: DataFrame) -> DataFrame:
    return receipts.select("chain_id", F.explode("logs").alias("result"))


def tron_blocks(df: DataFrame, raw: str = "result") -> tuple[DataFrame, DataFrame]:
    b = once(df, F.from_json(raw, schemas.TRON_BLOCK), "_b")
    out = b.select("chain_id", F.col("_b.blockNumber").alias("block_number"), F.col("_b.blockID").alias("block_hash"), F.col("_b.parentHash").alias("parent_hash"), X.from_millis(F.col("_b.timestamp")).alias("block_ts"), F.col("_b.transactions").alias("transactions"), raw)
    return split(out.withColumn("reasons", reasons(("number", F.col("block_number").isNull()), ("hash", F.col("block_hash").isNull()))), raw)


def tron_transactions(df: DataFrame, raw: str = "result") -> tuple[DataFrame, DataFrame]:
    """Transactions of Tron blocks (rows of :func:`block_transactions`), with their logs."""
    t = once(df, F.from_json(raw, schemas.TRON_TX), "_t")
    value = F.col("_t.value")
    out = t.select(
        "chain_id", F.col("_t.txID").alias("tx_hash"), F.coalesce("_t.blockNumber", "block_number").alias("block_number"), F.coalesce("_t.blockHash", "block_hash").alias("block_hash"), "tx_index",
        F.col("_t.fromAddress").alias("from_address"), F.col("_t.toAddress").alias("to_address"), F.lpad(F.lower(F.hex(value.try_cast("bigint"))), 64, "0").alias("value_hex"), value.alias("value_wei"),
        F.col("_t.gasPrice").alias("gas_price"), X.flag_status(F.col("_t.status")).alias("status"), F.col("_t.gasUsed").alias("gas_used"), F.col("_t.logs").alias("logs"), raw,
    )
    return split(out.withColumn("reasons", reasons(("hash", F.col("tx_hash").isNull()), ("from", F.col("from_address").isNull()))), raw)


def nested_logs(transactions: DataFrame) -> DataFrame:
    """Logs inside Tron or Solana transactions, numbered by place."""
    t = transactions.select("chain_id", "tx_hash", "block_number", "tx_index", F.posexplode("logs").alias("log_index", "l"))
    return t.select("chain_id", "tx_hash", "block_number", "tx_index", F.col("log_index").cast("bigint").alias("log_index"), "l.address", F.coalesce("l.topics", F.array().cast("array<string>")).alias("topics"), F.coalesce("l.data", F.lit("")).alias("data"))


def solana_blocks(df: DataFrame, raw: str = "result") -> tuple[DataFrame, DataFrame]:
    """The slot is the height; the parent hash is optional."""
    b = once(df, F.from_json(raw, schemas.SOLANA_BLOCK), "_b")
    out = b.select("chain_id", F.coalesce("_b.slot", F.col("_b.parentSlot") + 1).alias("block_number"), F.col("_b.blockhash").alias("block_hash"), F.col("_b.previousBlockhash").alias("parent_hash"), F.timestamp_seconds("_b.blockTime").alias("block_ts"), F.col("_b.transactions").alias("transactions"), raw)
    return split(out.withColumn("reasons", reasons(("number", F.col("block_number").isNull()), ("hash", F.col("block_hash").isNull()))), raw)


def solana_transactions(df: DataFrame, raw: str = "result") -> tuple[DataFrame, DataFrame]:
    """The fee counts as gas used; each log message is a log of one topic."""
    t = once(df, F.from_json(raw, schemas.SOLANA_TX), "_t")
    log = F.transform(F.coalesce("_t.meta.logMessages", F.array().cast("array<string>")), lambda m: F.struct(F.lit("").alias("address"), F.array(m).alias("topics"), F.lit("").alias("data")))
    zero = F.lit(0).cast("decimal(38,0)")
    out = t.select(
        "chain_id", F.col("_t.signature").alias("tx_hash"), F.coalesce("_t.slot", "block_number").alias("block_number"), "block_hash", "tx_index", F.lit(None).cast("string").alias("from_address"), F.lit(None).cast("string").alias("to_address"),
        F.lit("0" * 64).alias("value_hex"), zero.alias("value_wei"), zero.alias("gas_price"), X.flag_status(F.col("_t.meta.err").isNull()).alias("status"), F.col("_t.meta.fee").alias("gas_used"), log.alias("logs"), raw,
    )
    return split(out.withColumn("reasons", reasons(("hash", F.col("tx_hash").isNull()))), raw)


Normaliser = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
#: Chain type -> (block normaliser, transaction normaliser).
CHAINS: dict[str, tuple[Normaliser, Normaliser]] = {"evm": (evm_blocks, evm_transactions), "tron": (tron_blocks, tron_transactions), "solana": (solana_blocks, solana_transactions)}


def register_chain(chain_type: str, blocks: Normaliser, transactions: Normaliser) -> None:
    """Adds a chain type; both normalisers take DataFrames with ``chain_id`` and ``result``."""
    if not chain_type or chain_type in CHAINS:
        raise ValueError(f"chain type {chain_type!r} is empty or taken")
    CHAINS[chain_type] = (blocks, transactions)


def normalize_all(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, transactions, quarantine) of rows (chain_type, chain_id, result), each by its chain type's normaliser."""
    blocks, txs, bad = [], [], []
    for kind, (f, g) in CHAINS.items():
        b, q = f(df.where(F.col("chain_type") == kind).select("chain_id", "result"))
        t, r = g(block_transactions(b))
        blocks.append(b.select("chain_id", "block_number", "block_hash", "parent_hash", "block_ts"))
        txs.append(t.select("chain_id", "tx_hash", "block_number", "block_hash", "tx_index", "from_address", "to_address", "value_hex", "value_wei", "gas_price", "status"))
        bad += [q, r]
    unknown = df.where(F.col("chain_type").isNull() | ~F.col("chain_type").isin(*CHAINS)).select("chain_id", F.col("result").alias("raw"), F.array(F.lit("chain type")).alias("reasons"))
    join = lambda dfs: reduce(DataFrame.unionByName, dfs)
    return join(blocks), join(txs), join([*bad, unknown])
