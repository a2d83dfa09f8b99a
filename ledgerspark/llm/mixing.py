"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets ``min(cap, level * weight)`` words, where ``cap`` is ``max_epochs`` times its size and the level is
such that targets sum to the size of all sources: clamping sources at the cap and sharing the excess by weight until
none is above it has this fixed point. A source's words are then taken as whole repetitions of all its documents plus
a fractional one: documents in a seeded order until the rest of the target is used up, the last of them in part.

A null source is a source of its own (last in order); null and blank texts have size 0 and are taken 0 times; rows with
equal ids are ordered by size; a very long text counts whole, and can be the one that is taken in part; an empty table gives
no rows. ``mix`` leaves other columns out; ``mixed`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, named, words_of


def source_targets(sizes: DataFrame, weights: Column, max_epochs: int = 3) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``; one row per source, so its windows are over a small table.

    ``weights`` is an expression over ``place``, the 0-based position of the source by code point, null last.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("place", place).withColumn("w", weights.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    # In order of cap / weight, sources fill up one after the other as the level rises.
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("place").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumns({"full": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open_w": F.sum("w").over(after), "total": F.sum("source_size").over(Window.partitionBy())})
    s = s.withColumn("fits", (F.col("total") - F.col("full")).cast("double") / F.col("open_w") <= F.col("cap").cast("double") / F.col("w"))
    first = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("w")).alias("r"), "place", (F.col("total") - F.col("full")).alias("rest"), "open_w"))).over(Window.partitionBy())
    s = s.withColumn("level", first)
    open_ = (F.col("cap") / F.col("w") > F.col("level.r")) | ((F.col("cap") / F.col("w") == F.col("level.r")) & (F.col("place") >= F.col("level.place")))
    shared = (F.col("w") * F.col("level.rest")).cast("double") / F.col("level.open_w")
    return s.select("source", "source_size", F.when(open_, F.least(shared, F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double")).alias("target"))


def _taken(rows: DataFrame, pattern: tuple[int, ...], max_epochs: int, seed: int) -> DataFrame:
    """``rows`` (doc_id, source, size and others) with ``source_size``, ``target`` and ``taken``."""
    more = [c for c in rows.columns if c not in ("doc_id", "source", "size")]
    # The seeded order: by md5, whose first digits also cut each source into cells that can be summed apart.
    rows = rows.withColumn("ord", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))).withColumn("cell", F.substring("ord", 1, 3))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    weight = F.element_at(F.array(*map(F.lit, pattern)), (F.pmod(F.col("place"), F.lit(len(pattern))) + 1).cast("int"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weight, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.greatest(F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"), F.lit(0)))
    starts = cells.withColumn("start", F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell")) - F.col("cell_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    plan = starts.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "c.cell", "start", "source_size", "target", "whole", "rest")
    before = Window.partitionBy("source", "cell").orderBy("ord", "size", "doc_id", *(["copy"] if "copy" in more else [])).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(before), F.lit(0)))
    out = rows.join(plan, same(rows, plan) & (rows["cell"] == plan["cell"]))
    part = F.greatest(F.least(F.col("rest") - F.col("start") - F.col("own"), F.col("size")), F.lit(0))
    return out.select("doc_id", rows["source"], *more, "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def mix(docs: DataFrame, pattern: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words of each document the mix takes."""
    return _taken(docs.select("doc_id", "source", _size(F.col("text"))), pattern, max_epochs, seed)


def mixed(docs: DataFrame, text: str = "text", pattern: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, a last part of a document as its first words.

    Documents of which nothing is taken, such as blank ones, don't occur. Ids repeat with their documents. All columns
    are kept, whatever their names; rows that agree in id and text are taken in any order.
    """
    cols = docs.columns
    # The input's columns travel in one struct, so that no name can clash with those used here.
    rows = docs.select("doc_id", "source", F.struct(*map(named, cols)).alias("row"), F.xxhash64(named(text)).alias("copy"), _size(named(text)))
    out = _taken(rows, pattern, max_epochs, seed).where("taken > 0")
    n = F.col("size")
    copies = F.when(F.col("taken") < n, F.array(F.col("taken"))).otherwise(
        F.filter(F.concat(F.array_repeat(n, F.floor(F.col("taken") / n).cast("int")), F.array(F.col("taken") % n)), lambda x: x > 0)
    )
    out = out.withColumn("words", F.explode(copies))
    whole = F.col("row").getField(text)
    part = F.array_join(F.slice(words_of(whole), F.lit(1), F.col("words").cast("int")), " ")
    return out.select(*((F.when(F.col("words") < n, part).otherwise(whole) if c == text else F.col("row").getField(c)).alias(c) for c in cols))


def mixing_sql(table: str = "documents", pattern: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7) -> str:
    """The same result in one plain statement for DuckDB."""
    case = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(pattern))
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {table}),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, CASE place % {len(pattern)} {case} END AS w, source_size * {max_epochs} AS cap FROM s1),
s3 AS (SELECT *, CAST(cap AS DOUBLE) / w AS r,
  coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
  sum(source_size) OVER () AS total FROM s2),
lv AS (SELECT r AS lr, place AS lp, total - filled AS rest0, open_w AS ow FROM s3
  WHERE CAST(total - filled AS DOUBLE) / open_w <= r ORDER BY r, place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN r > lr OR (r = lr AND place >= lp)
  THEN least(CAST(w * rest0 AS DOUBLE) / CAST(ow AS DOUBLE), CAST(cap AS DOUBLE)) ELSE CAST(cap AS DOUBLE) END AS target FROM s3, lv),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
t3 AS (SELECT *, greatest(CAST(floor(target + 0.5) AS BIGINT) - whole * source_size, 0) AS rest FROM t2),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), size, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT o.doc_id, o.size, t3.source_size, t3.target,
  CAST(t3.whole * o.size + greatest(least(t3.rest - o.before, o.size), 0) AS BIGINT) AS taken
FROM o JOIN t3 ON o.source IS NOT DISTINCT FROM t3.source"""
