"""SimHash fingerprints and near-duplicate groups by tiled exact comparison.

Fingerprints are computed map-side. Distinct fingerprints are grouped into tiles by the population counts of their four
16-bit parts: the sum of the differences of these counts is a lower bound of the Hamming distance, so only pairs of
tiles within the radius are compared, with numpy exclusive-or and bit counts. Tiles are cut to a bounded size, so a
dense group is spread over many tasks. Each tile pair reports a spanning forest of its links, not every pair.

Null and blank texts have fingerprint zero and link like any other; equal fingerprints always share a component; rows
with equal ids share their component; very long texts are hashed whole, in blocks; an empty table gives no rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, stored


def simhash(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of ``text``, repeats included; fewer words: the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(words_per_shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), 65536):  # bounds memory on very long texts
        h = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)])
        ones += np.unpackbits(np.frombuffer(h, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, words_per_shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def spanning(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of fewer pairs with the same components as the links a[i] - b[j]."""
    if len(i) <= len(a) + len(b):
        return a[i], b[j]
    label = np.arange(len(a) + len(b))
    j = j + len(a)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    ids = np.concatenate([a, b])
    own = np.flatnonzero(label != np.arange(len(label)))
    return ids[own], ids[label[own]]


def near_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of fingerprints within ``radius`` bits; of a tile with itself, only i < j."""
    left, right = [], []
    for at in range(0, len(a), block):
        i, j = np.nonzero(np.bitwise_count(a[at : at + block, None] ^ b[None, :]) <= radius)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _steps(radius: int) -> list[int]:
    """Differences of tile keys (four counts, 6 bits each) to compare, one of each opposite pair."""
    out = []
    for d in itertools.product(range(-radius, radius + 1), repeat=4):
        if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0):
            out.append(sum(x << (6 * k) for x, k in zip(d, (3, 2, 1, 0), strict=True)))
    return out


def link_fingerprints(fps: DataFrame, radius: int = 2, tile: int = 2048) -> DataFrame:
    """Links (u, v) between nodes of ``fps`` (fp unique, node never null) that connect all fingerprints within ``radius`` bits."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") + radius for k in range(4)]
    key = sum((F.shiftleft(q, 6 * k) for k, q in enumerate(quarter)), F.lit(0))
    keyed = fps.select("fp", "node", key.alias("key"))
    # Four counts of 0 to 16: at most 83,521 keys, so this table can be broadcast.
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("chunks"))
    tiles = keyed.join(F.broadcast(sizes), "key").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    tiles = tiles.groupBy("key", "chunk").agg(F.collect_list(F.struct("fp", "node")).alias("m"))
    tiles = stored(tiles.select("key", "chunk", F.col("m.fp").alias("fp"), F.col("m.node").alias("node")), "simhash-tiles")
    left = tiles.select(F.explode(F.array(*map(F.lit, _steps(radius)))).alias("step"), F.col("key").alias("lkey"), F.col("chunk").alias("lchunk"), F.col("fp").alias("lfp"), F.col("node").alias("lnode"))
    left = left.withColumn("key", F.col("lkey") + F.col("step")).join(F.broadcast(sizes), "key")
    # Each pair of chunks has a key of its own in the join, so that a dense tile key is spread.
    least = F.when(F.col("step") == 0, F.col("lchunk")).otherwise(0)
    left = left.withColumn("chunk", F.explode(F.sequence(least, F.col("chunks") - 1)))
    pairs = left.join(tiles, ["key", "chunk"]).select("lfp", "lnode", "fp", "node", ((F.col("step") == 0) & (F.col("lchunk") == F.col("chunk"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            column = lambda c, k: batch.column(c)[k].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
            for k in range(batch.num_rows):
                a, an, b, bn = (column(c, k) for c in range(4))
                i, j = near_links(a.view(np.uint64), b.view(np.uint64), radius, batch.column(4)[k].as_py())
                if len(i):
                    u, v = spanning(an, bn, i, j)
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id): component_id is the smallest doc_id reachable over links."""
    prints = stored(fingerprints(docs, words_per_shingle), "simhash")
    # Fingerprints are the nodes, as they are never null; ids follow from the least of each component. Fingerprints that
    # share their least id (rows of equal ids) are linked too.
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    same = fps.where("least IS NOT NULL").groupBy("least").agg(F.min("fp").alias("first"))
    same = fps.join(same, "least").where("fp <> first").select(F.col("fp").alias("u"), F.col("first").alias("v"))
    linked = connected_components(link_fingerprints(fps.select("fp", F.col("fp").alias("node")), radius).unionAll(same))
    rooted = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
