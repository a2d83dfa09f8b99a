"""Notifications: envelopes, packing into batches, message rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions import exprs as X

from . import scans


def envelopes(df: DataFrame, event_type: str, at: Column, order: list[str]) -> DataFrame:
    """(event_type, timestamp, body, order columns): JSON of ``event_type``, ``timestamp`` (unix seconds) and ``data``."""
    seconds = F.unix_timestamp(at)
    body = F.to_json(F.struct(F.lit(event_type).alias("event_type"), seconds.alias("timestamp"), F.struct("*").alias("data")))
    return df.select(F.lit(event_type).alias("event_type"), seconds.alias("timestamp"), body.alias("body"), *order)


def batches(df: DataFrame, by: list[str], order: list[str], size: int = 100, at: str | None = None, seconds: int = 5, parts: int | None = None) -> DataFrame:
    """Adds ``epoch`` and ``batch``: batches of ``size`` in order; a reorganisation starts a new epoch, so that what came
    before it is flushed and it goes first. ``by`` are the streams that pack on their own.

    With a time column ``at``, what waits is also flushed every ``seconds``: ``tick`` numbers these periods, and batches
    count within one. Places are counted over blocks of rows (see :mod:`.scans`), so a stream may have any number of rows.
    """
    reorg = (F.col("event_type") == "reorg").cast("bigint")
    out = scans.running(scans.blocked(df, by, order, parts), by, order, _n=("sum", F.lit(1).cast("bigint")), epoch=("sum", reorg)).drop(scans.BLOCK)
    out = out.withColumn("epoch", F.coalesce("epoch", F.lit(0).cast("bigint")))
    if at:
        # A period bounds its rows, so its order is a window's.
        out = out.withColumn("tick", F.floor(F.unix_timestamp(at) / seconds))
        place = F.row_number().over(Window.partitionBy(*by, "epoch", "tick").orderBy(*order))
        return out.withColumn("batch", F.floor((place - 1) / size).cast("bigint")).drop("_n")
    first = out.groupBy(*by, "epoch").agg(F.min("_n").alias("_first")).select(*(F.col(c).alias("_k_" + c) for c in [*by, "epoch"]), "_first")
    met = out.join(first, reduce(and_, (out[c].eqNullSafe(first["_k_" + c]) for c in [*by, "epoch"])))
    return met.select(*(out[c] for c in out.columns if c != "_n"), F.floor((F.col("_n") - F.col("_first")) / size).cast("bigint").alias("batch"))


def packed(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One message for each batch: ``batch_size`` and ``events``; the batch size bounds each list."""
    events = F.transform(F.sort_array(F.collect_list(F.struct(*order, "body"))), lambda x: x["body"])
    own = [*by, "epoch", *(["tick"] if "tick" in df.columns else []), "batch"]
    g = df.groupBy(*own).agg(F.count(F.lit(1)).alias("batch_size"), events.alias("e"))
    text = F.concat(F.lit('{"batch_size":'), F.col("batch_size").cast("string"), F.lit(',"events":['), F.array_join("e", ","), F.lit("]}"))
    return g.select(*own, "batch_size", text.alias("message"))


def message_rows(df: DataFrame, topic: str, key: Column) -> DataFrame:
    """(topic, key, value) for ``write.format("kafka")``."""
    return df.select(F.lit(topic).alias("topic"), key.alias("key"), F.to_json(F.struct("*")).alias("value"))


def transaction_key() -> Column:
    return X.message_key(F.col("chain_id"), F.col("tx_hash"), F.col("tx_index"))


def block_key() -> Column:
    return X.message_key(F.col("chain_id"), F.col("block_number"))


def reorg_key() -> Column:
    return X.message_key(F.col("chain_id"), F.unix_timestamp("detected_at"))


def post(df: DataFrame, send: Callable[[str], None]) -> None:
    """Sends the column ``message`` of each row from the executors, in order within a partition."""

    def each(rows) -> None:
        for r in rows:
            send(r["message"])

    df.foreachPartition(each)
