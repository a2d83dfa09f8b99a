"""JSON-RPC answers: decoding of envelopes, single or in batches, from dumps or any text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark import schemas
from ledgerspark.operators.normalize import once


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines file of answers as (envelope)."""
    return spark.read.text(path).withColumnRenamed("value", "envelope")


def decode_envelopes(df: DataFrame, column: str = "envelope") -> tuple[DataFrame, DataFrame]:
    """(good, bad): good has ``id`` and ``result`` (raw JSON), bad has ``id`` and ``reason``; other columns stay.

    An array is a batch: a failed element fails alone. Unreadable text is bad as a whole.
    """
    items = F.when(F.ltrim(column).startswith("["), F.from_json(column, "array<string>")).otherwise(F.array(F.col(column)))
    rows = once(df.withColumn("_raw", F.explode_outer(items)), F.from_json("_raw", schemas.ENVELOPE), "_e")
    reason = F.when(F.col("_raw").isNull() | F.col("_e").isNull() | (F.col("_e.result").isNull() & F.col("_e.error").isNull()), "unreadable").when(
        F.col("_e.error").isNotNull(), F.concat_ws(": ", F.lit("rpc error"), F.col("_e.error.code").cast("string"), F.col("_e.error.message"))
    )
    rows = rows.withColumn("reason", reason).withColumn("id", F.col("_e.id"))
    keep = [c for c in df.columns if c not in (column, "id", "reason")]
    good = rows.where("reason IS NULL").select(*keep, "id", F.col("_e.result").alias("result"))
    return good, rows.where("reason IS NOT NULL").select(*keep, "id", "reason", F.coalesce("_raw", column).alias("raw"))
