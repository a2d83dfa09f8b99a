"""Structured Streaming jobs: ingest, de-duplication, windowed counters, reorganisations, dead letters. Keyed state is in
:mod:`.state`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ledgerspark.operators import normalize, quality, status, tables, versions
from ledgerspark.shared import discard
from ledgerspark.sources import rpc

#: What a table job is called with: name, rows, batch id.
Writer = Callable[[str, DataFrame, int], None]


def decoded(raw: DataFrame) -> dict[str, DataFrame]:
    """Blocks, transactions and quarantine of raw envelopes (chain_id, envelope)."""
    good, bad = rpc.decode_envelopes(raw)
    blocks, q = normalize.evm_blocks(good)
    txs, r = normalize.evm_transactions(normalize.block_transactions(blocks))
    txs, s = quality.validated(txs, quality.transaction_reasons())
    letters = bad.select("chain_id", "raw", F.array("reason").alias("reasons")).unionByName(q).unionByName(r)
    return {"blocks": blocks.drop("transactions"), "transactions": txs, "quarantine": letters.unionByName(s.select("chain_id", F.col("tx_hash").alias("raw"), "reasons"))}


def _started(raw: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> DataStreamWriter:
    def kept(df: DataFrame, n: int) -> None:
        # The source is read once. Rows wait in a compressed table, a fraction of what they take when persisted.
        path, spark = f"{checkpoint}/batch-{n}", df.sparkSession
        df.write.mode("overwrite").option("compression", versions.CODEC).parquet(path)
        try:
            batch(spark.read.schema(df.schema).parquet(path), n)
        finally:
            discard(spark, [path])

    w = raw.writeStream.foreachBatch(kept).option("checkpointLocation", checkpoint)
    return w.trigger(processingTime=every) if every else w.trigger(availableNow=True)


def ingest(raw: DataFrame, write: Writer, checkpoint: str, every: str | None = None) -> DataStreamWriter:
    """Raw envelopes (chain_id, envelope) to blocks, transactions and quarantine, each written by ``write``, in this order.

    ``every`` is a processing interval; without it the job takes what is there and ends (backfill).
    """

    def batch(df: DataFrame, n: int) -> None:
        for name, rows in decoded(df).items():
            write(name, rows, n)

    return _started(raw, batch, checkpoint, every)


def ingest_into(raw: DataFrame, store: versions.Store, checkpoint: str, every: str | None = None, stream: str = "ingest") -> DataStreamWriter:
    """:func:`ingest` into the tables of ``store``: a batch's blocks, transactions and quarantine are published at once.

    Rows are merged by their keys, those of a later batch win, and only partitions that a batch touches are read and
    written. A batch that was published before changes nothing, so a restart neither loses nor repeats rows.
    """

    def batch(df: DataFrame, n: int) -> None:
        def work(at: versions.Snapshot) -> list[versions.Change]:
            out = decoded(df)
            keyed = [store.merged(t, tables.newest(out[t].withColumn("version", F.lit(n).cast("long")), tables.KEYS[t], [F.col("block_hash")]), tables.KEYS[t], at=at) for t in ("blocks", "transactions")]
            return [*keyed, store.appended("quarantine", out["quarantine"], keyed=False)]

        store.once(stream, n, work)

    return _started(raw, batch, checkpoint, every)


def legal_moves(rules: tuple = status.RULES) -> dict[str, list[str]]:
    """(from: to) moves of rules without conditions; with one, see :func:`status.actions`, which evaluates it on rows."""
    out: dict[str, list[str]] = {}
    for a, b, _, *condition in rules:
        if condition:
            raise ValueError(f"the move from {a} to {b} has a condition")
        out.setdefault(a, []).append(b)
    return out


def deduplicated(df: DataFrame, keys: list[str], ts: str, ttl: str) -> DataFrame:
    """First row of each key within ``ttl`` of event time."""
    return df.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def windowed_counters(df: DataFrame, labels: list[str], width: str, late: str, ts: str = "ts") -> DataFrame:
    """Counters for each window; rows later than ``late`` are dropped by Spark's rule."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, width), *labels).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *labels, "n")


def reorg_job(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Own query for reorganisation events: ``handle`` gets one row for each event id of a batch."""

    def batch(df: DataFrame, n: int) -> None:
        handle(tables.first_of_key(df, ["event_id"], [F.col("detected_at")]), n)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def with_retries(df: DataFrame, work: Callable[[DataFrame], DataFrame], failed: Callable[[DataFrame], None], most: int = 3) -> DataFrame:
    """Runs ``work`` on rows with an ``attempt``; it returns them with ``ok``. Good rows are returned, failed ones go to
    ``failed`` with the next attempt, or as dead letters beyond ``most``."""
    done = work(df)
    bad = done.where(~F.col("ok")).withColumn("attempt", F.col("attempt") + 1).withColumn("dead", F.col("attempt") > most)
    failed(bad)
    return done.where("ok")
