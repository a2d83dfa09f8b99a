"""Keyed tables: upserts, deletions, status changes, lookups and pages.

A table is a Parquet directory of versions; writers never overwrite what they read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Natural keys.
KEYS = {"blocks": ["chain_id", "block_number"], "transactions": ["chain_id", "tx_hash"], "logs": ["chain_id", "tx_hash", "log_index"], "watermarks": ["chain_id"]}
#: Heights in a partition of a stored table.
BUCKET = 100_000


def newest(df: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """One row for each key, the one of greatest ``version``."""
    order = Window.partitionBy(*keys).orderBy(*(v.desc_nulls_last() for v in version))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def first_of_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """``old`` with the rows of ``new``; of equal keys the greatest version stays, of equal versions the new row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return newest(both, keys, [F.col(version), F.col("_new")]).drop("_new")


def with_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("height_bucket", F.floor(F.col("block_number") / BUCKET).cast("bigint"))


def write_version(df: DataFrame, path: str, version: int) -> str:
    """Writes all rows as one job to a new version directory and returns it."""
    target = f"{path}/v{version}"
    with_bucket(df).repartition("chain_id", "height_bucket").sortWithinPartitions("block_number").write.partitionBy("chain_id", "height_bucket").parquet(target)
    return target


def write_touched(new: DataFrame, path: str) -> None:
    """Replaces only the partitions that ``new`` has, by dynamic overwrite; ``new`` must not read ``path``.

    Whatever else such a partition held is gone, so ``new`` must hold all its rows (see :func:`upsert`).
    """
    with_bucket(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chain_id", "height_bucket").parquet(path)


def write_bulk(df: DataFrame, path: str, keys: list[str], batch: int, shares: int = 16) -> str:
    """Writes ``df`` grouped by chain, each row with ``record_id``, the hash of its ``keys``; returns the directory.

    Ids are deterministic, so what is written twice is found by them (:func:`read_bulk`), and a batch that is written again
    replaces itself. A chain is dealt to ``shares`` tasks by key, so that a large one is not one task and one file; ids are
    made afterwards and don't travel.
    """
    target = f"{path}/batch={batch}"
    text = F.concat_ws("-", *(F.col(k).cast("string") for k in keys))
    cut = df.repartition("chain_id", F.pmod(F.xxhash64(text), F.lit(shares))).withColumn("record_id", F.sha2(text, 256))
    cut.sortWithinPartitions("chain_id", "record_id").write.mode("overwrite").partitionBy("chain_id").parquet(target)
    return target


def read_bulk(spark: SparkSession, path: str) -> DataFrame:
    """One row for each id, that of the last batch."""
    rows = spark.read.parquet(path).withColumn("chain_id", F.col("chain_id").cast("string"))
    return newest(rows, ["record_id"], [F.col("batch")]).drop("batch")


def recorded_reorgs(old: DataFrame, new: DataFrame) -> DataFrame:
    """One event for each chain and second of detection; of several the last recorded stays, of one batch the greatest
    height."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).withColumn("_at", F.unix_timestamp("detected_at"))
    return newest(both, ["chain_id", "_at"], [F.col("_new"), F.col("old_tip"), F.col("event_id")]).drop("_new", "_at")


def append_reorgs(df: DataFrame, path: str) -> None:
    """Adds to a log of events; :func:`recorded_reorgs` keeps their key."""
    df.write.mode("append").parquet(path)


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v{version}").withColumn("chain_id", F.col("chain_id").cast("string"))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """(chain_id, low, high]: ranges (chain_id, fork_height, old_tip) with overlaps joined, so that a row meets one."""
    order = Window.partitionBy("chain_id").orderBy("fork_height", "old_tip")
    gap = F.col("fork_height") > F.coalesce(F.max("old_tip").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("fork_height") - 1)
    island = ranges.withColumn("_gap", gap.cast("int")).withColumn("_island", F.sum("_gap").over(order))
    return island.groupBy("chain_id", "_island").agg(F.min("fork_height").alias("low"), F.max("old_tip").alias("high")).drop("_island")


def _in_buckets(ranges: DataFrame) -> DataFrame:
    """(_c, _b, _low, _high): merged ``ranges`` once for each bucket of ``BUCKET`` heights that they touch."""
    bucket = lambda h: F.floor(h / BUCKET)
    return merged_ranges(ranges).where("low < high").select(F.col("chain_id").alias("_c"), F.explode(F.sequence(bucket(F.col("low") + 1), bucket(F.col("high")))).alias("_b"), F.col("low").alias("_low"), F.col("high").alias("_high"))


def _hit(df: DataFrame) -> Column:
    """Rows meet only the ranges of their chain and bucket: as many join keys as buckets."""
    return (df["chain_id"] == F.col("_c")) & (F.floor(df["block_number"] / BUCKET) == F.col("_b")) & (df["block_number"] > F.col("_low")) & (df["block_number"] <= F.col("_high"))


def delete_ranges(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows outside (fork_height, old_tip] of every range of their chain."""
    return df.join(_in_buckets(ranges), _hit(df), "left_anti")


def mark_reverted(txs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Transactions with status ``reverted`` inside the ranges, and ``revert_reason`` = ``reorg`` there."""
    out = txs.join(_in_buckets(ranges), _hit(txs), "left").select(*(txs[c] for c in txs.columns), F.col("_b").isNotNull().alias("_hit"))
    why = F.col("revert_reason") if "revert_reason" in txs.columns else F.when(F.col("status") == "reverted", "execution")
    return out.withColumn("revert_reason", F.when(F.col("_hit"), "reorg").otherwise(why)).withColumn("status", F.when(F.col("_hit"), "reverted").otherwise(F.col("status"))).drop("_hit")


def update_status(txs: DataFrame, updates: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """``txs`` with statuses of ``updates`` (chain_id, tx_hash, new_status; one a key). With ``rules`` only legal moves."""
    u = updates.select(F.col("chain_id").alias("_c"), F.col("tx_hash").alias("_h"), "new_status")
    out = txs.join(u, (F.col("chain_id") == F.col("_c")) & (F.col("tx_hash") == F.col("_h")), "left")
    to = F.col("new_status")
    if rules is not None:
        legal = F.lit(False)
        for a, bs in rules.items():
            legal = legal | ((F.col("status") == a) & to.isin(*bs))
        to = F.when(legal, to)
    return out.withColumn("status", F.coalesce(to, "status")).select(*txs.columns)


def update_watermark(marks: DataFrame, updates: DataFrame) -> DataFrame:
    """Only chains that are there change; columns of ``updates`` that are null keep the old value."""
    u = updates.select("chain_id", *(F.col(c).alias("_" + c) for c in updates.columns if c != "chain_id"))
    out = marks.join(u, "chain_id", "left")
    return out.select("chain_id", *(F.coalesce("_" + c, c).alias(c) if c in updates.columns else F.col(c) for c in marks.columns if c != "chain_id"))


def block_by_number(blocks: DataFrame, chain_id: str, number: int) -> DataFrame:
    return blocks.where((F.col("chain_id") == chain_id) & (F.col("block_number") == number))


def block_by_hash(blocks: DataFrame, chain_id: str, block_hash: str) -> DataFrame:
    return blocks.where((F.col("chain_id") == chain_id) & (F.col("block_hash") == block_hash))


def transaction_by_hash(txs: DataFrame, chain_id: str, tx_hash: str) -> DataFrame:
    return txs.where((F.col("chain_id") == chain_id) & (F.col("tx_hash") == tx_hash))


def transactions_of_block(txs: DataFrame, chain_id: str, number: int, limit: int = 10_000) -> DataFrame:
    return block_by_number(txs, chain_id, number).orderBy("tx_index").limit(limit)


def get_logs(
    logs: DataFrame, chain_id: str, block: int | None = None, from_block: int | None = None, to_block: int | None = None, address: str | None = None, tx_hash: str | None = None,
    topics: list[str] = (), limit: int = 100, offset: int = 0,
) -> DataFrame:
    """Logs that pass all given tests, each listed topic anywhere, by block and log index."""
    out = logs.where(F.col("chain_id") == chain_id)
    for name, op, v in (("block_number", "=", block), ("block_number", ">=", from_block), ("block_number", "<=", to_block), ("address", "=", address), ("tx_hash", "=", tx_hash)):
        if v is not None:
            out = out.where({"=": F.col(name) == v, ">=": F.col(name) >= v, "<=": F.col(name) <= v}[op])
    for t in topics:
        out = out.where(F.array_contains("topics", t))
    return out.orderBy("block_number", "log_index", "tx_hash").offset(offset).limit(limit)


def transactions_of_address(txs: DataFrame, chain_id: str, address: str, limit: int = 20, offset: int = 0) -> DataFrame:
    own = txs.where((F.col("chain_id") == chain_id) & ((F.col("from_address") == address) | (F.col("to_address") == address)))
    return own.orderBy(F.desc("block_number"), "tx_hash").offset(offset).limit(limit)


def reorgs_of_chain(events: DataFrame, chain_id: str, limit: int = 20, offset: int = 0) -> DataFrame:
    return events.where(F.col("chain_id") == chain_id).orderBy(F.desc("detected_at"), F.desc("event_id")).offset(offset).limit(limit)


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page of ``df`` with ``total`` and ``has_more``. The total is one count; rows come by a top-k sort."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumn("total", total.scalar()).withColumn("has_more", F.col("total") > number * size)
