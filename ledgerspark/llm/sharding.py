"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into virtual parts by a seeded hash of their id. For each part a multivariate hypergeometric draw says
how many of its rows go to each shard, so that shard sizes are exact (counts differ by one at most). Each part is
permuted by a seeded key and dealt by those counts; each shard is permuted again. Whole rows move, with their texts.

The matrix is drawn in two steps, which has the same law as one: the driver draws the counts of groups of parts, and
tasks draw those of the parts in a group, given the group's. The driver sees one row for each ``PARTS`` parts.

Null ids form part of the row order like any value (they hash alike and tie); repeated rows are dealt as rows of
their own; an empty table gives an empty result; other columns are carried along, whatever their names, except those
named ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named

#: Parts in a group of the matrix.
PARTS = 1024


def draws(totals: np.ndarray, part_rows: list[int], rng: np.random.Generator) -> np.ndarray:
    """Rows of each part (first axis) that go to each shard; columns sum to ``totals``."""
    left, out = np.array(totals, dtype=np.int64), np.zeros((len(part_rows), len(totals)), dtype=np.int64)
    for k, n in enumerate(part_rows):
        out[k] = rng.multivariate_hypergeometric(left, n, method="marginals") if n else 0
        left -= out[k]
    return out


def communication_matrix(part_rows: list[int], n_shards: int, seed: int) -> np.ndarray:
    """:func:`draws` for shard sizes at most one apart."""
    total = sum(part_rows)
    sizes = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)])
    return draws(sizes, part_rows, np.random.default_rng(seed))


def _keyed(seed: int, salt: str, cols: list[Column]) -> Column:
    return F.xxhash64(F.lit(f"{salt}:{seed}"), *cols)


def _dealt(counts: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(part, ends): for each part of ``counts`` (part, n) the rank after its last row for each shard."""
    groups = counts.groupBy(F.floor(F.col("part") / PARTS).alias("grp")).agg(F.sum("n").alias("n"))
    sizes = sorted((r["grp"], r["n"]) for r in groups.collect())
    matrix = communication_matrix([n for _, n in sizes], n_shards, seed)
    totals = {g: matrix[k] for k, (g, _) in enumerate(sizes)}
    listed = counts.groupBy(F.floor(F.col("part") / PARTS).alias("grp")).agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ends = draws(totals[g], [r["n"] for r in m], np.random.default_rng([seed, g + 1])).cumsum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"] for r in m], pa.int64()), pa.array(ends.tolist(), pa.list_(pa.int64()))], names=["part", "ends"])

    return listed.mapInArrow(run, "part long, ends array<long>")


def shuffle_into_shards(df: DataFrame, key: str, n_shards: int = 16, seed: int = 17, rows_per_part: int = 2_000, tie: list[Column] | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards-1, sizes at most one apart) and ``slot`` (gapless from 0 in each shard).

    ``tie`` orders rows of equal key, so that reruns agree even when keys repeat.
    """
    own = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    # The input's columns travel in one struct, so that no name can clash with those used here.
    base = df.select(F.struct(*map(named, own)).alias("row"), named(key).alias("key"), F.array(*(c.cast("string") for c in tie or [F.lit("")])).alias("tie"))
    fields = [F.col("row").getField(c).alias(c) for c in own]
    cols = [F.col("key"), F.col("tie")]
    n = df.count()
    if not n:
        return base.select(*fields, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    n_parts = max(1, -(-n // rows_per_part))
    # Equal ids would all fall into one part, so the tie columns take part in the choice.
    parted = base.withColumn("part", F.pmod(_keyed(seed, "part", cols), F.lit(n_parts)))
    deal = _dealt(parted.groupBy("part").agg(F.count(F.lit(1)).alias("n")), n_shards, seed)
    inner = Window.partitionBy("part").orderBy(_keyed(seed, "inner", cols), *cols)
    ranked = parted.withColumn("rank", F.row_number().over(inner).cast("long") - 1).join(deal, "part")
    sent = ranked.select("row", *cols, F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    # Second permutation, inside each shard: by cell, then by key inside the cell.
    n_cells = max(1, -(-n // (n_shards * rows_per_part)))
    celled = sent.withColumn("outer", _keyed(seed, "outer", cols)).withColumn("cell", F.pmod(F.shiftright("outer", 3), F.lit(n_cells)).cast("int"))
    sizes = celled.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("start"))
    at = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("outer", *cols)).cast("long") - 1
    placed = celled.withColumn("at", at).join(starts, ["shard", "cell"])
    return placed.select(*fields, "shard", (F.col("start") + F.col("at")).alias("slot"))
