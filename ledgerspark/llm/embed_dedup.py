"""Embedding near-duplicates by collision counting over many one-dimensional projections.

Every distinct vector is scaled to length one and projected on seeded Gaussian directions. For unit vectors with cosine c
a projected difference is normal with variance 2 - 2c, which gives all odds below.

* Two vectors *collide* in a projection if one lies in the window centred on the other. Collisions over ``m`` projections
  are binomial, so the wanted recall at the threshold gives the count a pair needs. Counting gives up early: most pairs go
  after the first ``EARLY`` projections, by a count of the same calibration. Pairs that reach the count are verified in
  double precision.
* Counting over sorted windows touches more pairs than there are: for unit vectors in 64 dimensions a window wide enough
  for cosine 0.9 holds a quarter of all vectors, and narrow windows collide for near pairs only three times as often as for
  any others. So all pairs are counted, by windows centred on each vector, whatever their number: whether two vectors are
  linked depends on these two and the seed, never on the other rows. The work is n^2 / 2 counts.
* A caller who would rather miss links than count all pairs passes a ``Plan``: pairs are then counted only if they lie in
  one cell of ``k`` projections at once, cut at seeded offsets, in one of several tables of such cells (locality-sensitive
  hashing). ``planned`` gives the plan of least expected work for a number of vectors and a recall, about n^1.3 pairs. A
  pair that shares cells of several tables is linked in the first of them only.

A cell of many vectors is cut into tiles of bounded size, which are paired; their size changes the layout, not the links. A
tile pair reports link counts and a spanning forest of its links, never all pairs.

Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of different
length never link; equal vectors are compared once and linked with each other; rows of equal ids share their component;
an empty table gives no rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, stored
from .simhash import spanning

#: Quanta in a half window, projections before counting gives up on a pair, and half a window in standard deviations.
HALF, EARLY, WIDTH = 40, 24, 1.5
#: Cost of a row of a table, in counted pairs, from measurements.
ROW = 400
#: Bounds of a tile, and chunks of a cell that keep the cores busy where tiles in between allow it.
TILE, CHUNKS = (1024, 8192), 16


def needed(m: int, p: float, recall: float) -> int:
    """Collisions that ``m`` projections of collision odds ``p`` reach with probability ``recall`` at least."""
    missed, need = 0.0, 0
    while need < m and missed + (t := math.comb(m, need) * p**need * (1 - p) ** (m - need)) <= 1 - recall:
        missed += t
        need += 1
    return need


def calibrated(m: int, cosine: float, width: float, recall: float) -> tuple[float, int]:
    """(half window, collisions needed): pairs at ``cosine`` reach the count with probability ``recall`` at least."""
    return width * math.sqrt(2 - 2 * cosine), needed(m, math.erf(width / math.sqrt(2)), recall)


def same_cell(width: float) -> float:
    """Odds that two points whose difference is standard normal share a cell of ``width`` at a random offset."""
    return math.erf(width / math.sqrt(2)) - math.sqrt(2 / math.pi) / width * (1 - math.exp(-width * width / 2))


@dataclass(frozen=True)
class Plan:
    """``tables`` of ``k`` projections each, cut into cells of ``width``; ``k`` 0: one table of one cell."""

    width: float
    k: int
    tables: int


def planned(n: int, cosine: float, recall: float) -> Plan:
    """The plan of least expected work for ``n`` vectors in general directions that finds pairs at ``cosine`` with ``recall``."""
    near, best, least = math.sqrt(2 - 2 * cosine), Plan(1.0, 0, 1), n * ROW + n * n / 2
    for w in (2, 3, 4, 5, 6, 8, 10):
        p, q = same_cell(w), same_cell(w * near / math.sqrt(2))
        for k in range(1, 64):
            tables = math.ceil(math.log(1 - recall) / math.log1p(-(p**k))) if p**k < recall else 1
            cost = tables * (n * ROW + q**k * n * n / 2)
            if cost < least and tables <= 10_000:
                best, least = Plan(w * near, k, tables), cost
    return best


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision and without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def links(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray, need: tuple[int, int], cosine: float, same: bool, earlier: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, counted: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of the pairs that pass both counts and then the exact test, about ``counted`` pairs at a time.

    ``need``: collisions among the first ``EARLY`` and among all projections. ``earlier`` tells which links, given as rows of
    a and b, share a cell in a table before this one; they are left to that table.
    """
    window, shift, block = np.uint8(2 * HALF + 2), np.uint8(HALF + 1), max(1, counted // max(1, len(b)))
    # Bytes wrap around: a difference of a whole turn counts as a collision, which verification settles.
    cbt = np.ascontiguousarray(cb[:, :EARLY].T)
    for at in range(0, len(a), block):
        own, begin = ca[at : at + block] + shift, at + 1 if same else 0  # of a tile with itself, only i < j
        hits = np.zeros((len(own), len(b) - begin), dtype=np.uint8)
        for k in range(len(cbt)):
            hits += (own[:, k, None] - cbt[k][None, begin:]) <= window
        i, j = np.nonzero(hits >= need[0])
        early = hits[i, j]
        i, j = i + at, j + begin
        if same:
            up = i < j
            i, j, early = i[up], j[up], early[up]
        for cut in range(0, len(i), 65536):
            p, q = i[cut : cut + 65536], j[cut : cut + 65536]
            count = early[cut : cut + 65536] + ((ca[p, EARLY:] + shift - cb[q, EARLY:]) <= window).sum(axis=1)
            ok = count >= need[1]
            p, q = p[ok], q[ok]
            ok = np.einsum("ij,ij->i", a[p], b[q]) >= cosine
            p, q = p[ok], q[ok]
            if earlier is not None and len(p):
                new = ~earlier(p, q)
                p, q = p[new], q[new]
            if len(p):
                yield p, q


def cells(p: np.ndarray, plan: Plan, dim: int, seed: int) -> np.ndarray:
    """Numbers of the cells of each row in each table: ``p`` holds the projections table by table."""
    if not plan.k:
        return np.zeros((len(p), 1), dtype=np.int64)
    offset = np.random.default_rng([seed, dim, 1]).random(p.shape[1])
    at = np.floor(p / plan.width + offset).astype(np.int64).astype(np.uint64).reshape(len(p), plan.tables, plan.k)
    h = np.zeros(at.shape[:2], dtype=np.uint64)
    for k in range(plan.k):
        h = (h ^ at[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _projected(vectors: DataFrame, m: int, half: float, plan: Plan, seed: int) -> DataFrame:
    """(node, n, dim, code, cell, vec): bytes of the counted projections, cell numbers of all tables, and the vector's bytes.

    The cell numbers only say which tables' tiles a row goes to; they don't travel with it.
    """
    schema = "node long, n long, dim int, code binary, cell array<long>, vec binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            n, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            first = np.cumsum(n) - n
            for d in np.unique(n).tolist():
                rows = np.flatnonzero(n == d)
                raw = flat[first[rows][:, None] + np.arange(d)]
                u = unit(raw.astype(np.float64))
                basis = np.random.default_rng([seed, d]).standard_normal((m + plan.tables * plan.k, d)).T
                p = u @ basis
                code = np.floor(p[:, :m] * (HALF / half)).astype(np.int64).astype(np.uint8)
                cell = cells(p[:, m:], plan, d, seed)
                pack = lambda x: pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())
                cols = [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.full(len(rows), d, dtype=np.int32)), pack(code), pa.ListArray.from_arrays(np.arange(0, cell.size + 1, cell.shape[1], dtype=np.int32), cell.ravel()), pack(raw)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in schema.split(", ")])

    return vectors.select("node", "n", "vec").mapInArrow(run, schema)


def _tile_pairs(p: DataFrame, tile: int) -> DataFrame:
    """(table, same, l, m): pairs of tiles of one cell, as lists of structs; ``same``: a tile with itself."""
    rows = p.select("dim", F.posexplode("cell").alias("table", "key"), F.struct("node", "n", "code", "vec").alias("row"))
    # Only cells of more than one tile have a number of chunks; Spark broadcasts this table if it is small.
    large = rows.groupBy("dim", "table", "key").count().where(F.col("count") > tile).select("dim", "table", "key", F.ceil(F.col("count") / tile).cast("int").alias("chunks"))
    place = ["dim", "table", "key"]
    rows = rows.join(large, place, "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("row.node"), F.col("chunks")), F.lit(0)).cast("int"))
    tiles = rows.groupBy(*place, "chunk").agg(F.max("chunks").alias("chunks"), F.collect_list("row").alias("m"))
    tiles = stored(tiles.where("chunks > 1 OR size(m) > 1"), "embedding-tiles")
    alone = tiles.where("chunks IS NULL").select("table", F.lit(True).alias("same"), F.col("m").alias("l"), F.col("m").alias("m"))
    split = tiles.where("chunks > 1")
    # Chunks stand in a ring and each meets those up to half way round, so all have as many partners.
    left = split.select(*place, "chunks", F.col("chunk").alias("lchunk"), F.col("m").alias("l"), F.explode(F.sequence(F.lit(0), F.expr("chunks div 2"))).alias("step"))
    left = left.where("2 * step < chunks OR lchunk < step").withColumn("chunk", F.pmod(F.col("lchunk") + F.col("step"), F.col("chunks")))
    pairs = left.drop("chunks").join(split.select(*place, "chunk", "m"), [*place, "chunk"])
    return alone.unionAll(pairs.select("table", (F.col("lchunk") == F.col("chunk")).alias("same"), "l", "m"))


class Tile:
    """Columns of a list of rows of ``_projected``."""

    def __init__(self, rows: pa.StructArray, width: int):
        f = rows.field
        self.node, self.n = f("node").to_numpy(), f("n").to_numpy()
        grid = lambda c, t: np.frombuffer(b"".join(f(c).to_pylist()), dtype=t).reshape(len(rows), -1)
        self.code, self.unit = grid("code", np.uint8), unit(grid("vec", np.float32 if width == 4 else np.float64).astype(np.float64))
        self._cells: dict[int, np.ndarray] = {}

    def cells(self, rows: np.ndarray, tables: int, plan: Plan, m: int, seed: int) -> np.ndarray:
        """Cell numbers in the first ``tables`` tables of those rows that links ask about, each computed once."""
        asked, at = np.unique(rows, return_inverse=True)
        new = [r for r in asked.tolist() if r not in self._cells]
        if new:
            d = self.unit.shape[1]
            basis = np.random.default_rng([seed, d]).standard_normal((m + plan.tables * plan.k, d)).T
            self._cells.update(zip(new, cells(self.unit[new] @ basis[:, m:], plan, d, seed)[:, :tables], strict=True))
        return np.stack([self._cells[r] for r in asked.tolist()])[at]


def link_vectors(vectors: DataFrame, cosine: float = 0.9, m: int = 48, recall: float = 0.9999, tile: int | None = None, seed: int = 9, plan: Plan | None = None) -> DataFrame:
    """Rows (node, n, root): n other rows that links of ``node`` lead to (null in rows of the spanning forest, which have
    ``root``). ``vectors``: distinct vectors ``vec`` of ``n`` rows each, with an id ``node`` that is unique and never null.

    Pairs at the threshold pass the counts with probability ``recall``, pairs above it more often, among however many
    vectors. With a ``plan`` of several tables they must also share a cell.
    """
    half = WIDTH * math.sqrt(2 - 2 * cosine)
    odds, each = math.erf(WIDTH / math.sqrt(2)), (1 + recall) / 2
    need = (needed(min(EARLY, m), odds, each), needed(m, odds, each))
    plan = plan or Plan(1.0, 0, 1)
    tile = tile or min(max(TILE[0], -(-vectors.count() // CHUNKS)), TILE[1])
    width = 4 if "float" in vectors.schema["vec"].dataType.simpleString() else 8
    pairs = _tile_pairs(stored(_projected(vectors, m, half, plan, seed), "projections"), tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, root = [], [], []
            for k in range(batch.num_rows):
                table, same = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                x = Tile(batch.column(2)[k].values, width)
                y = x if same else Tile(batch.column(3)[k].values, width)

                def met_before(p: np.ndarray, q: np.ndarray, x: Tile = x, y: Tile = y, table: int = table) -> np.ndarray:
                    return (x.cells(p, table, plan, m, seed) == y.cells(q, table, plan, m, seed)).any(axis=1)

                # The nodes of both sides, numbered on; ``u`` and ``v`` are the edges of a forest of the links so far.
                nodes, rows = (x.node, x.n) if same else (np.concatenate([x.node, y.node]), np.concatenate([x.n, y.n]))
                sums, u, v = np.zeros(len(nodes)), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                for i, j in links(x.unit, x.code, y.unit, y.code, need, cosine, same, met_before if table else None):
                    j = j if same else j + len(x.node)
                    sums += np.bincount(i, weights=rows[j], minlength=len(nodes)) + np.bincount(j, weights=rows[i], minlength=len(nodes))
                    u, v = np.append(u, i), np.append(v, j)
                    if len(u) > 4 * len(nodes):
                        u, v = _forest(len(nodes), u, v)
                u, v = _forest(len(nodes), u, v)
                hit = np.flatnonzero(sums)
                node += nodes[hit], nodes[u]
                n += sums[hit].astype(np.int64), np.full(len(u), -1)
                root += np.full(len(hit), -1), nodes[v]
            z = [np.zeros(0, dtype=np.int64)]
            kind = np.concatenate(z + n) >= 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z + node)), pa.array(np.concatenate(z + n), mask=~kind), pa.array(np.concatenate(z + root), mask=kind)], names=["node", "n", "root"])

    return pairs.mapInArrow(run, "node long, n long, root long")


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``spanning`` for links among ``n`` nodes, by their numbers."""
    return spanning(np.arange(n), np.arange(n), i, j)


def valid(vec: str) -> F.Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_duplicates(rows: DataFrame, cosine: float = 0.9, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id, embedding); see :func:`link_vectors`."""
    bounded_batches(rows.sparkSession)
    kind = "float" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    base = rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast(kind)).alias("vec"))
    base = base.withColumn("vec", F.when(valid("vec"), F.col("vec")))
    # Rows meet their class by a digest of the vector, which is shorter than the vector itself.
    digest = F.sha2(F.col("vec").cast("string"), 256)
    grouped = base.where("vec IS NOT NULL").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = stored(grouped.withColumns({"node": F.monotonically_increasing_id(), "digest": digest}), "embedding-classes")
    found = stored(link_vectors(classes, cosine, **options), "embedding-links")
    # Vectors that share their least id (rows of equal ids) share their component.
    same = classes.where("least IS NOT NULL").groupBy("least").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v <> most")
    same = classes.join(same, "least").where("node <> v").select(F.col("node").alias("u"), "v")
    linked = connected_components(found.where("root IS NOT NULL").select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(same))
    counts = found.where("n IS NOT NULL").groupBy("node").agg(F.sum("n").alias("more"))
    named = classes.select("node", "digest", "least", "n").join(counts, "node", "left").join(linked, "node", "left")
    named = named.select("digest", "least", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("digest", "n_links", "component_id")
    out = base.select("vec_id", digest.alias("digest")).join(named, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
