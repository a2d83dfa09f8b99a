"""Message topics and relational tables. Connector jars are the user's; decoding works on any (key, value, timestamp)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ledgerspark import schemas


def read_topic(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """Stream of a Kafka topic."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()


def decode_messages(df: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead): decoded fields with ``key`` and ``timestamp``; undecodable messages as dead letters."""
    text = F.col("value").cast("string")
    # The permissive reader gives a row of nulls for broken text; the corrupt field tells it from an empty object.
    parsed = F.from_json(text, schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = df.select(F.col("key").cast("string").alias("key"), "timestamp", text.alias("message"), parsed.alias("m"))
    bad = F.col("m").isNull() | F.col("m._corrupt").isNotNull()
    good = rows.where(~bad).select("key", "timestamp", "m.*").drop("_corrupt")
    return good, dead_letters(rows.where(bad), F.lit("undecodable"))


def dead_letters(df: DataFrame, reason: F.Column, message: str = "message") -> DataFrame:
    """(message, reason, time) of failed rows."""
    return df.select(F.col(message).alias("message"), reason.alias("reason"), F.coalesce(F.col("timestamp") if "timestamp" in df.columns else F.lit(None), F.current_timestamp()).alias("time"))


def decode_dead_letters(df: DataFrame) -> DataFrame:
    return decode_messages(df, schemas.DEAD_LETTER)[0].drop("key", "timestamp")


@dataclass(frozen=True)
class Topic:
    """A topic's message type: ``schema`` of its JSON, and the fields without which a message is a dead letter."""

    name: str
    schema: str
    required: tuple[str, ...]


#: The four topics, by the names that configurations use.
TOPICS = {
    t.name: t
    for t in (
        Topic("raw-blocks", "chain_id string, block_number bigint, block_hash string, parent_hash string, block_ts bigint, raw string", ("chain_id", "block_number", "block_hash")),
        Topic("normalized-transactions", "chain_id string, tx_hash string, block_number bigint, tx_index bigint, from_address string, to_address string, value_wei string, gas_price bigint, status string", ("chain_id", "tx_hash", "block_number")),
        Topic("reorg-events", "chain_id string, event_id bigint, depth bigint, old_tip bigint, fork_height bigint, detected_at timestamp", ("chain_id", "event_id", "fork_height", "old_tip")),
        Topic("dead-letters", schemas.DEAD_LETTER, ("reason",)),
    )
}
#: What is called with the good rows of a batch and the batch id.
Handler = Callable[[DataFrame, int], None]


def typed(messages: DataFrame, topic: Topic) -> tuple[DataFrame, DataFrame]:
    """(good, dead) of ``messages`` (key, value, timestamp): a message that can't be decoded, or lacks a required field, is a
    dead letter that names why. Fields of another type count as missing."""
    good, dead = decode_messages(messages, topic.schema)
    lacks = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in topic.required)), lambda x: x.isNotNull())
    marked = good.withColumn("_lacks", lacks)
    short = marked.where(F.size("_lacks") > 0)
    body = F.to_json(F.struct(*(c for c in good.columns if c not in ("key", "timestamp"))))
    why = F.concat(F.lit("missing "), F.array_join("_lacks", ", "))
    return marked.where(F.size("_lacks") == 0).drop("_lacks"), dead.unionByName(dead_letters(short.withColumn("message", body), why))


class OnceSink:
    """Tables of batches under ``root``: a batch that was written before is not written again.

    Each batch has a directory of its own, and Spark's commit marks it as whole; one that a job left unfinished is replaced.
    """

    def __init__(self, root: str):
        self.root = root

    def write(self, table: str, rows: DataFrame, batch: int) -> bool:
        """Whether ``rows`` were written now."""
        spark, path = rows.sparkSession, f"{self.root}/{table}/batch={batch}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return False
        rows.write.mode("overwrite").parquet(path)
        return True

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{table}")


def subscribe(messages: DataFrame, topic: str, handler: Handler, letters: Handler, checkpoint: str, every: str | None = None) -> DataStreamWriter:
    """Stream of a topic's ``messages`` (key, value, timestamp) to ``handler``, and what can't be decoded to ``letters``.

    Both get each batch with its id; after a failure Spark gives the same rows with the same id again, so a handler that
    writes through :class:`OnceSink`, or publishes by batch, has each row once. ``every`` is a processing interval; without it
    the stream takes what is there and ends.
    """

    def batch(rows: DataFrame, n: int) -> None:
        rows.persist()
        try:
            good, dead = typed(rows, TOPICS[topic])
            handler(good, n)
            letters(dead.withColumn("topic", F.lit(topic)), n)
        finally:
            rows.unpersist()

    w = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return w.trigger(processingTime=every) if every else w.trigger(availableNow=True)


def read_table(spark: SparkSession, url: str, table: str, partitions: int, height: str = "block_number", since: int | None = None, **options: str) -> DataFrame:
    """Relational table, read in ``partitions`` ranges of its heights at once.

    The ranges follow the least and greatest height, which the database is asked for first; with ``since`` only rows above
    that height are read, by a condition that the database evaluates, so a later read takes what is new. Rows without a
    height are in the first range. An empty table gives no rows.
    """
    # Names are quoted as the database wants it; the filter below is one that Spark hands to the database.
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(height)
    newer = f" WHERE {name} > {int(since)}" if since is not None else ""
    low, high = spark.read.jdbc(url, f"(SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}{newer}) b", properties=options).first()
    if low is None:
        rows = spark.read.jdbc(url, table, properties=options)
    else:
        rows = spark.read.jdbc(url, table, column=height, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=partitions, properties=options)
    return rows if since is None else rows.where(F.col(height) > since)


def write_table(df: DataFrame, url: str, table: str, batch: int = 1000, **options: str) -> None:
    """Appends ``df`` to a relational table, each task in transactions of its own; a new table gets the types of ``df``."""
    df.write.option("batchsize", batch).jdbc(url, table, mode="append", properties=options)
