"""Ordered running values of few large keys, without one task for each key.

Rows are cut into blocks that are ranges of (key, order), so that a key with very many rows is many blocks. Each block has a
summary for each key in it; a scan over the summaries, which are few, gives what the blocks before bring along; windows
inside the blocks do the rest. Sums, maxima and last values combine this way, and what can be written with them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.shared import fresh_path, note

BLOCK = "_block"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder, read back: what is numbered once keeps its numbers. The table stays until its
    run discards it (``shared.noted``)."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    note(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocked(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_block``, a number that grows with (by, order). Rows that tie in both are in one block."""
    keys = [*by, *order]
    cut = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return written(cut.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    return reduce(and_, (left[c].eqNullSafe(right["_b_" + c]) for c in by), left[BLOCK] == right["_b_" + BLOCK])


def running(df: DataFrame, by: list[str], order: list[str], **totals: tuple[str, Column]) -> DataFrame:
    """``df`` of :func:`blocked` with a column for each of ``totals``: ("sum" | "max" | "last", value) over the rows of the
    same ``by`` up to this one. Nulls don't count."""
    inside = Window.partitionBy(*by, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    values = df.withColumns({f"_v_{n}": v for n, (_, v) in totals.items()})
    # A block's summary: its sum, its maximum, or its last value that isn't null.
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v"))))["_v"]
    ends = values.groupBy(*by, BLOCK).agg(*((latest(f"_v_{n}") if kind == "last" else fold[kind](f"_v_{n}")).alias(f"_e_{n}") for n, (kind, _) in totals.items()))
    carried = ends.select(*(F.col(c).alias("_b_" + c) for c in [*by, BLOCK]), *(fold[kind](f"_e_{n}").over(before).alias(f"_c_{n}") for n, (kind, _) in totals.items()))
    local = values.withColumns({f"_v_{n}": fold[kind](f"_v_{n}").over(inside) for n, (kind, _) in totals.items()})
    met = local.join(carried, _same(local, carried, by), "left")

    def both(name: str, kind: str) -> Column:
        here, there = F.col(f"_v_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            return F.when(here.isNull(), there).when(there.isNull(), here).otherwise(here + there)
        return F.greatest(here, there) if kind == "max" else F.coalesce(here, there)

    return met.select(*(local[c] for c in df.columns if c not in totals), *(both(n, kind).alias(n) for n, (kind, _) in totals.items()))


def before(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` of :func:`blocked` with ``name``: ``value`` of the row before, null for the first of its ``by``."""
    last = df.groupBy(*by, BLOCK).agg(F.max(F.struct(*order, F.col(value).alias("_v")))["_v"].alias("_e"))
    carried = last.select(*(F.col(c).alias("_b_" + c) for c in [*by, BLOCK]), F.lag("_e").over(Window.partitionBy(*by).orderBy(BLOCK)).alias("_c"))
    # The first row of a block has no row before it in the window; a null value must not look like that.
    order_in = Window.partitionBy(*by, BLOCK).orderBy(*order)
    local = df.withColumns({"_l": F.lag(F.struct(F.col(value).alias("_v"))).over(order_in)})
    met = local.join(carried, _same(local, carried, by), "left")
    return met.select(*(local[c] for c in df.columns), F.when(F.col("_l").isNull(), F.col("_c")).otherwise(F.col("_l._v")).alias(name))
