"""Bottom-k sketches of shingle hashes, in DataFrame operations only.

A sketch is the sorted array of the k least distinct 64-bit hashes (moved to 0 .. 2^64-1 by order) of a text's word
shingles. Sketches of parts merge into the sketch of their union, and estimate resemblance, containment and the number
of distinct shingles.

Null and blank texts have an empty sketch; a text of fewer words than a shingle has one hash, of the whole sequence.
Two empty sketches resemble each other fully, an empty and another one not at all. Texts are taken whole, however long.
Repeated rows are rows of their own, and the next document of one may be its copy; a lone document is its own next one; an
empty table gives no rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of

#: Hashes kept in a sketch and words in a shingle.
K, SHINGLE = 128, 5


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Sorted array of the ``k`` least distinct shingle hashes of ``text``."""
    # Words are hashed once; a lambda over the array of hashes stands for a variable.
    hashed = F.array(F.transform(words_of(text), lambda w: F.xxhash64(w)))

    def shingles(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(shingle))))
        whole = F.array(F.aggregate(w, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < shingle, whole).otherwise(each)

    return F.slice(F.sort_array(F.array_distinct(F.get(F.transform(hashed, shingles), F.lit(0)))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what ``a`` and ``b`` are sketches of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, by: str, sketches: str, k: int = K) -> DataFrame:
    """One sketch for each value of ``by``. Each task keeps its k least per group before the shuffle."""
    hashes = df.select(by, F.explode(sketches).alias("_h")).distinct()
    least = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_h"))).where(F.col("_r") <= k)
    return least.groupBy(by).agg(F.sort_array(F.collect_list("_h")).alias(sketches))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity: the share of the union's sketch that lies in both."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: exact below k, else (k - 1) over the k-th least hash in 0 .. 1."""
    kth = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that are also in b."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """Fixed text form: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _cells(ids: DataFrame, rows_per_cell: int) -> tuple[list[int], int, int]:
    """Quantiles of doc_id (256 at most), the number of equal parts of each range between them, and of cells for null ids."""
    n, known = ids.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    cells = max(1, -(-known // rows_per_cell))
    coarse = min(256, cells)
    q = ids.agg(F.percentile_approx("doc_id", [i / coarse for i in range(coarse + 1)], 10_000).alias("q")).first()["q"]
    return sorted(set(q or [0])), -(-cells // coarse), -(-(n - known) // rows_per_cell)


def with_next(docs: DataFrame, rows_per_cell: int = 2000) -> DataFrame:
    """Rows (cell, doc_id, text, tie, extra): ``docs`` dealt into cells of neighbouring ids, largest cell number last.

    Each cell also gets the first row of the one below it (``extra``), so that in descending order of doc_id every own
    row has its successor in its own cell: one shuffle of the texts and no global sort. The lowest cell gets the first
    row of all. Null ids come last, in the order of a hash of their text (``tie``), by which they have cells of their
    own; rows that tie are ordered by text.
    """
    q, fine, null_cells = _cells(docs.select("doc_id"), rows_per_cell)
    edges = F.array(*[F.lit(x).cast("long") for x in q])
    at = F.greatest(F.size(F.filter(edges, lambda e: e <= F.col("doc_id"))), F.lit(1))
    lo, hi = F.get(edges, at - 1), F.coalesce(F.get(edges, at), F.lit(q[-1]).cast("long") + 1)
    step = F.least(F.floor((F.col("doc_id") - lo).cast("double") * fine / (hi - lo).cast("double")), F.lit(fine - 1))
    cell = (at * fine + F.greatest(step, F.lit(0))).cast("long")
    tie = F.lit(0).cast("long")
    if null_cells:
        tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(tie)
        share = (F.xxhash64("text").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
        null_cell = -1 - F.least(F.floor(share * null_cells), F.lit(null_cells - 1)).cast("long")
        cell = F.when(F.col("doc_id").isNull(), null_cell).otherwise(cell)
    placed = docs.select("doc_id", "text", tie.alias("tie"), cell.alias("cell"))
    # The first place of each cell in descending order of doc_id; ~x falls as x rises.
    place = F.struct(F.bitwise_not("doc_id").alias("d"), F.col("tie").alias("t"))
    tops = placed.groupBy("cell").agg(F.min(place).alias("top")).withColumn("coarse", F.floor(F.col("cell") / max(fine, null_cells)))
    # Cells are ordered inside coarse ranges, and these among each other: 260 rows at most, whatever the input.
    lows = tops.groupBy("coarse").agg(F.min("cell").alias("low"))
    beyond = F.coalesce(F.lead("low").over(Window.orderBy("coarse")), F.min("low").over(Window.partitionBy()))
    tops = tops.join(F.broadcast(lows.select("coarse", beyond.alias("beyond"))), "coarse")
    above = F.coalesce(F.lead("cell").over(Window.partitionBy("coarse").orderBy("cell")), F.col("beyond"))
    # The first row of a cell also goes to the next higher cell; that of the highest to the lowest.
    first = placed.join(tops.select("cell", "top", above.alias("above")), "cell", "left")
    own = F.struct(F.col("cell"), F.lit(0).alias("extra"))
    both = F.array(own, F.struct(F.col("above").alias("cell"), F.lit(1).alias("extra")))
    spread = F.explode(F.when(place.eqNullSafe(F.col("top")), both).otherwise(F.array(own)))
    return first.select(spread.alias("p"), "doc_id", "text", "tie").select("p.cell", "p.extra", "doc_id", "text", "tie")


def fingerprint_pairs(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch) of each text, its edit and its successor."""
    text = F.coalesce("text", F.lit("")).alias("text")
    placed = with_next(docs.select(F.col("doc_id").cast("long"), text)).repartition("cell")
    order = Window.partitionBy("cell").orderBy("extra", F.col("doc_id").desc_nulls_last(), "tie", "text")
    own = placed.withColumn("sketch", sketch(F.col("text"), k, shingle))
    near = own.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)}).where("extra = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    near = near.withColumns({"n_chars": n.cast("long"), "edited": edited})
    return near.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "sketch", sketch(F.col("edited"), k, shingle).alias("edited_sketch"), "next_sketch")
