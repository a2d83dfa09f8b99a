"""Helpers shared by the training-data operators: shared-folder tables, word rules, components."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.shared import fresh_path, note, shared_dir

#: Words are runs of anything but ASCII space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def apart(columns: Iterable[str], taken: Iterable[str], prefix: str = "input_") -> list[str]:
    """Names for ``columns`` beside those ``taken``: their own, or with ``prefix`` as often as it takes. Case doesn't count."""
    out, used = [], {c.lower() for c in taken}
    for c in columns:
        while c.lower() in used:
            c = prefix + c
        used.add(c.lower())
        out.append(c)
    return out


def bounded_batches(spark: SparkSession, mb: int = 8) -> None:
    """Arrow batches of at most ``mb`` MB from here on: texts are long, and both sides of a Python task hold batches.

    The option is read when a result is evaluated, after the operator has returned, so it stays set.
    """
    option = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(option)
    size = int(re.match(r"-?\d+", now)[0]) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.lower().rstrip("b")[-1:], 1)
    if not 0 < size <= mb << 20:
        spark.conf.set(option, f"{mb << 20}b")


def trim() -> None:
    """Returns freed memory to the system, where the C library can. Python workers live on for other
    tasks, so a task that used much gives it back at its end."""
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back, which cuts its lineage.

    The shuffle files of the write are removed as soon as it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path, option = fresh_path(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option)
    spark.conf.set(option, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(option, before)
    note(path)
    return spark.read.parquet(path)


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts give an empty array."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +"))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Rows ``(node, root)`` for every node of an undirected edge list; ``root`` is the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a partial aggregate and an equi-join,
    until the edge set no longer changes. Lineage is cut by ``checkpoint()`` in every round. No edges: no rows.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct().checkpoint()
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        now = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct().checkpoint()
        before, seen = seen, mark(now)
        if before == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
