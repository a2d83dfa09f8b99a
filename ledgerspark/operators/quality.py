"""Validation and filters."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import exprs as X

from .normalize import reasons

#: Longer lists are joined instead of listed.
LISTED = 1000


def _missing(c: str) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def block_reasons(kind: str = "evm") -> Column:
    tests = [("number", F.coalesce(F.col("block_number") == 0, F.lit(True))), ("hash", _missing("block_hash")), ("time", F.col("block_ts").isNull())]
    return reasons(*tests, *([("parent", _missing("parent_hash"))] if kind == "evm" else []))


def transaction_reasons(kind: str = "evm") -> Column:
    tests = [("hash", _missing("tx_hash")), ("from", _missing("from_address"))]
    if kind == "evm":
        tests += [("address", ~_missing("from_address") & ~X.is_address(F.col("from_address"))), ("value", F.col("value_wei").isNull())]
    return reasons(*tests)


def log_reasons(kind: str = "evm") -> Column:
    tests = [("tx_hash", _missing("tx_hash")), ("number", F.coalesce(F.col("block_number") == 0, F.lit(True))), ("address", _missing("address"))]
    if kind == "evm":
        tests += [("address form", ~_missing("address") & ~X.is_address(F.col("address"))), ("topics", F.coalesce(F.size("topics") < 1, F.lit(True)))]
    return reasons(*tests)


def validated(df: DataFrame, why: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad with ``reasons``)."""
    marked = df.withColumn("reasons", why)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def _among(df: DataFrame, columns: list[str], values: list[str]) -> DataFrame:
    """Rows with one of ``columns`` in ``values``."""
    if len(values) <= LISTED:
        return df.where(reduce(or_, (F.col(c).isin(*values) for c in columns)))
    # The list is distinct, so no join multiplies rows, and each row is tested once, by flags.
    listed = df.sparkSession.createDataFrame([(v,) for v in set(values)], "v string")
    out, flags = df, []
    for k, c in enumerate(columns):
        hit = listed.select(F.col("v").alias(f"_v{k}"), F.lit(True).alias(f"_hit{k}"))
        out, flags = out.join(hit, F.col(c) == F.col(f"_v{k}"), "left"), [*flags, F.coalesce(F.col(f"_hit{k}"), F.lit(False))]
    return out.where(reduce(or_, flags)).select(*df.columns)


def filter_transactions(df: DataFrame, addresses: list[str] = (), contracts: list[str] = (), min_value: int | None = None, exclude_empty: bool = False) -> DataFrame:
    """All given tests must hold. Contracts are tested only where a receiver is present."""
    if addresses:
        df = _among(df, ["from_address", "to_address"], list(addresses))
    if contracts:
        to = F.col("to_address")
        df = df.where(to.isNull() | (to == "") | to.isin(*contracts)) if len(contracts) <= LISTED else df.where("to_address IS NULL OR to_address = ''").unionByName(_among(df, ["to_address"], list(contracts)))
    if min_value is not None:
        df = df.where(F.col("value_wei") >= F.lit(str(min_value)).cast("decimal(38,0)"))
    if exclude_empty:
        df = df.where("to_address IS NOT NULL AND to_address <> '' AND value_wei <> 0")
    return df


def filter_logs(df: DataFrame, addresses: list[str] = (), contracts: list[str] = (), signatures: list[str] = ()) -> DataFrame:
    """Logs by address, contract and event signature; logs without topics pass the signature test."""
    for values in (addresses, contracts):
        if values:
            df = _among(df, ["address"], list(values))
    if signatures:
        first = F.get("topics", F.lit(0))
        df = df.where(first.isNull() | first.isin(*signatures))
    return df
