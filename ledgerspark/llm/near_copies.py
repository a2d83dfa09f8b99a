"""One document of each group of near copies: SimHash candidates, what they miss, and exact Jaccard similarity of all.

Near copies are texts whose sets of word shingles have a Jaccard similarity of ``similarity`` at least.

1. Each text gives its set of shingle hashes, a SimHash of this set and band keys of minimum hashes. Equal sets are one
   node from here on.
2. Nodes that share a band key and whose fingerprints are within a radius are candidates. Bands and radius follow from
   the wanted recall at ``similarity``. A bucket above ``tile`` nodes is dealt once more, by each second band that its
   nodes share, so that common boilerplate doesn't join what has nothing else in common; bands are as many as make near
   copies share two of them. Where two shared bands still leave a bucket above ``tile``, nodes within the radius of its least
   one are candidates with that, and all others are compared with the whole bucket, tile by tile: like pages cost their
   number, and what is unlike is told apart by its fingerprint there too.
3. What bands and fingerprints may miss is found without odds. All shingles have one order, rare ones first, so sets of
   ``similarity`` share one of their first ``prefix`` (Chaudhuri et al., 2006). Nodes of different components that share such
   a shingle, whose sizes and places of it allow the similarity (Xiao et al., 2008) and whose parity sketches differ in no
   more bits than their sets may in shingles, are candidates too. Rare is what a bounded sample doesn't know as common; the
   order only decides the cost. Shingles of more than ``tile`` nodes are paired tile by tile.
4. The nodes of each component of candidates are compared exactly, in chunks of bounded size, and only links that reach
   ``similarity`` count. Each chunk is compared with itself first, and one member of each group so found with those of the
   other chunks. Pairs of chunks are compared in full only for what these links leave apart: a large group of like pages
   costs its size, not its square. Groups that stay apart cost the pairs of their chunks, as each pair must be looked at.

Nodes are told apart by 128 bits of their sets, and rows by 128 bits of all their columns.

Null and blank texts have the empty set, so they are copies of each other. Very long texts have all their shingles. Fewer words than a shingle: the whole sequence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import induced
from .common import bounded_batches, connected_components, named, stored, trim
from .simhash import near_links, spanning

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Minimum hashes in a band.
ROWS = 5
#: Rows that tell common shingles, and common shingles kept, at most (12 bytes each).
SAMPLE, COMMON = 8_000, 1 << 20
_RNG = np.random.default_rng(5)


def bands(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Bands so that sets of ``similarity`` share two with probability ``recall`` at least."""
    p, n = similarity**ROWS, 2
    while (1 - p) ** n + n * p * (1 - p) ** (n - 1) > 1 - recall:
        n += 1
    return n


def radius(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Bits so that 64-bit fingerprints of sets of ``similarity`` are within them with probability ``recall`` at least.

    The cosine of such sets is 2 J / (1 + J) at least; small sets have ties of votes, which add up to a quarter to the
    share of differing bits.
    """
    p = min(0.5, 1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi)
    missed = 1.0
    for k in range(65):
        missed -= math.comb(64, k) * p**k * (1 - p) ** (64 - k)
        if missed <= 1 - recall:
            break
    return k


def shingle_set(text: str | None, words_per_shingle: int = WORDS, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(words_per_shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = (digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True))
    return np.unique(np.fromiter(h, dtype=np.uint64, count=len(starts)))


def set_simhash(s: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(s), 65536):
        part = s[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(s)).tobytes(), "big")


_XOR, _MUL = (_RNG.integers(0, 1 << 64, 4096, dtype=np.uint64)[:, None] for _ in range(2))
_MUL |= np.uint64(1)


def band_keys(s: np.ndarray, n: int) -> list[int]:
    """Signed 64-bit keys of ``n`` bands; none for the empty set."""
    if not len(s):
        return []
    m = n * ROWS
    least = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 2048):
        h = (s[None, at : at + 2048] ^ _XOR[:m]) * _MUL[:m]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        np.minimum(least, h.min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(n, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def prefix(s: np.ndarray, common: np.ndarray, times: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of ``s`` in the order of all shingles: those not in ``common`` (sorted) by hash, then these by
    ``times``. Sets of ``similarity`` have one of these in common."""
    want = len(s) - math.ceil(similarity * len(s) - 1e-6) + 1 if len(s) else 0
    if not len(common):
        return s[:want]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    known = common[at] == s
    rare = s[~known]
    if len(rare) >= want:
        return rare[:want]
    rest = s[known]
    return np.concatenate([rare, rest[np.lexsort((rest, times[at[known]]))]])[:want]


def parity(s: np.ndarray) -> bytes:
    """Bits that say of each cell of hashes whether it has an odd number of ``s``: two cells a shingle at least."""
    bits = max(6, (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """Bits that two :func:`parity` sketches differ in, which is at most the number of shingles that only one set has."""
    a, b = (np.unpackbits(np.frombuffer(z, dtype=np.uint8)) for z in sorted((x, y), key=len))
    while len(b) > len(a):
        b = b[0::2] ^ b[1::2]
    return int(np.count_nonzero(a != b))


def set_links(sets: list[np.ndarray], similarity: float, label: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Links (i, j) that connect all sets of ``similarity`` at least. Members of one component, and of one ``label`` to begin
    with, aren't compared again."""
    size = np.array([len(s) for s in sets])
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    label, left, right = np.arange(len(sets)) if label is None else label.copy(), [], []
    mark = np.zeros(len(kinds), dtype=np.int64)
    for i in range(len(sets) - 1):
        rest = np.flatnonzero((label != label[i]) & (size >= similarity * size[i] - 1e-6) & (size * similarity <= size[i] + 1e-6))
        rest = rest[rest > i]
        if not len(rest):
            continue
        own = flat[start[i] : start[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat[induced.spans(start[rest], size[rest])]], np.cumsum(size[rest]) - size[rest])
        mark[own] = 0
        for j in rest[both >= similarity * (size[i] + size[rest] - both) - 1e-6].tolist():
            if label[j] != label[i]:
                left.append(i)
                right.append(j)
                label[label == label[j]] = label[i]
    return left, right


def _common(rows: DataFrame, words_per_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of ``SAMPLE`` rows have, sorted, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words_per_shingle).view(np.int64))], names=["h"])
        trim()

    share = SAMPLE / max(1, rows.count())
    picked = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "row"), F.lit(1 << 31)) < share * (1 << 31))
    found = picked.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    h = found["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], found["n"].to_numpy(dtype=np.int32)[order]


def _prints(rows: DataFrame, words_per_shingle: int, n: int, similarity: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, words_per_shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, size, keys, first, odd = [], [], [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_set(t, words_per_shingle)
                node.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                fp.append(set_simhash(s))
                size.append(len(s))
                keys.append(band_keys(s, n))
                first.append(prefix(s, *shared.value, similarity).tobytes())
                odd.append(parity(s))
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            arrays = [b.column(0), b.column(1), pa.array(node, pa.string()), signed(fp), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(first, pa.binary()), pa.array(odd, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "row", "set", "fp", "size", "keys", "first", "odd"])
        trim()

    return rows.mapInArrow(run, "id long, row string, set string, fp long, size long, keys array<long>, first binary, odd binary")


def _edges(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    flat = lambda x: pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *x]))
    return pa.RecordBatch.from_arrays([flat(us), flat(vs)], names=["u", "v"])


def _candidates(nodes: DataFrame, bits: int, tile: int) -> DataFrame:
    """Links (u, v) that connect the nodes which share a band key and are within ``bits``."""

    def bucketed(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes of buckets (node, fp, key, n, least) up to ``tile`` nodes, and of those above."""
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "fp")).alias("least")).where("n > 1")
        met = keyed.join(sizes, "key")
        return met.where(F.col("n") <= tile), met.where(F.col("n") > tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for k in range(batch.num_rows):
                m = batch.column(0)[k].values
                fp = m.field("fp").to_numpy().view(np.uint64)
                i, j = near_links(fp, fp, bits, True)
                if len(i):
                    at, node = np.arange(len(fp)), m.field("node").to_numpy()
                    u, v = spanning(at, at, i, j)
                    us.append(node[u])
                    vs.append(node[v])
            yield _edges(us, vs)

    def run_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for k in range(batch.num_rows):
                m = batch.column(0)[k].values
                node, fp, own = m.field("node").to_numpy(), m.field("fp").to_numpy().view(np.uint64), m.field("own").to_numpy(zero_copy_only=False)
                i, j = near_links(fp[own], fp[~own], bits, False) if own.any() else (node[:0], node[:0])
                if len(i):
                    u, v = spanning(node[own], node[~own], i, j)
                    us.append(u)
                    vs.append(v)
            yield _edges(us, vs)

    def linked_apart(large: DataFrame) -> DataFrame:
        """Links of buckets of any size: with the least node, or, for nodes not near it, tile by tile with all."""
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("least.fp"))) <= bits
        star = large.where(near & (F.col("node") != F.col("least.node"))).select(F.col("node").alias("u"), F.col("least.node").alias("v"))
        far = large.where(~near)
        met = large.join(far.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("lefts")), "key").withColumn("rights", F.ceil(F.col("n") / tile).cast("int"))
        place = lambda tiles: F.pmod(F.xxhash64("node"), F.col(tiles)).cast("int")
        every = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
        left = met.where(~near).select("key", "node", "fp", F.lit(True).alias("own"), place("lefts").alias("l"), every("rights").alias("r"))
        right = met.select("key", "node", "fp", F.lit(False).alias("own"), every("lefts").alias("l"), place("rights").alias("r"))
        tiles = left.unionAll(right).groupBy("key", "l", "r").agg(F.collect_list(F.struct("node", "fp", "own")).alias("m"))
        return star.unionAll(tiles.select("m").mapInArrow(run_apart, "u long, v long"))

    def linked(small: DataFrame) -> DataFrame:
        return small.groupBy("key").agg(F.collect_list(F.struct("node", "fp")).alias("m")).select("m").mapInArrow(run, "u long, v long")

    small, large = bucketed(nodes.select("node", "fp", F.explode("keys").alias("key")))
    # A node of a large bucket goes on under each pair of its key and another one of its keys; both ends of a near copy have it.
    other = F.explode(F.filter("keys", lambda k: k != F.col("key"))).alias("other")
    again = large.select("node", "fp", "key").join(nodes.select("node", "keys"), "node").select("node", "fp", "key", other).select("node", "fp", F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key")).distinct()
    small_again, large_again = bucketed(again)
    return linked(small).unionAll(linked(small_again)).unionAll(linked_apart(large_again))


def _may_reach(similarity: float, size: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets ``i`` and ``j``, whose first common shingle is at their place ``at``, may have ``similarity``."""
    a, b = size[i], size[j]
    both = similarity / (1 + similarity) * (a + b) - 1e-6
    return (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6) & (np.minimum(a - at[i], b - at[j]) >= both)


def _shared_first(node: np.ndarray, label: np.ndarray, size: np.ndarray, at: np.ndarray, n: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of different ``label`` in runs of ``n`` rows; the rows of a run go by size."""
    end, left, step, us, vs = np.repeat(np.cumsum(n), n), np.arange(len(node)), 0, [], []
    while len(left):
        step += 1
        left = left[left + step < end[left]]
        # Sizes rise in a run, so what is too large for a set stays so.
        left = left[size[left] >= similarity * size[left + step] - 1e-6]
        right = left + step
        near = (label[left] != label[right]) & _may_reach(similarity, size, at, left, right)
        us.append(np.minimum(node[left[near]], node[right[near]]))
        vs.append(np.maximum(node[left[near]], node[right[near]]))
        if sum(map(len, us)) > 1 << 18:
            yield _edges(us, vs)
            us, vs = [], []
    yield _edges(us, vs)


class _Open:
    """A run of one key above the tile: what labels it has, and one that most of its rows seem to have."""

    def __init__(self, key: int):
        self.key, self.label, self.lead, self.low, self.high = key, 0, 0, math.inf, -math.inf

    def add(self, label: np.ndarray) -> _Open:
        kinds, n = np.unique(label, return_counts=True)
        kind, most = int(kinds[n.argmax()]), int(n.max())
        if kind == self.label:
            self.lead += most
        elif most > self.lead:
            self.label, self.lead = kind, most - self.lead
        else:
            self.lead -= most
        self.low, self.high = min(self.low, int(kinds[0])), max(self.high, int(kinds[-1]))
        return self


def _missed(nodes: DataFrame, groups: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Links (u, v) between nodes of different ``groups`` (node, root): all of ``similarity``, and few others."""
    own = nodes.where("size > 0").select("node", "size", "first").join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("label"), "size", "first")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                node, label, size, first = (b.column(k)[at : at + 256] for k in range(4))
                sets = [np.frombuffer(x, dtype=np.int64) for x in first.to_pylist()]
                n = np.array([len(x) for x in sets])
                each = lambda c: pa.array(np.repeat(c.to_numpy(), n))  # noqa: E731, B023
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), each(node), each(label), each(size), pa.array(place)], names=["key", "node", "label", "size", "at"])

    schema = "key long, node long, label long, size long, at long"
    keyed = own.mapInArrow(spread, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(edges: pa.RecordBatch, large: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*edges.columns, pa.array(np.full(edges.num_rows, large))], names=["u", "v", "large"])

        def shared(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            start = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
            n = np.diff(np.append(start, len(cols[0])))
            mixed = np.minimum.reduceat(cols[2], start) != np.maximum.reduceat(cols[2], start)
            for s in np.flatnonzero(mixed & (n > tile)).tolist():
                yield from above(_Open(int(cols[0][start[s]])).add(cols[2][start[s] : start[s] + n[s]]))
            mixed &= n <= tile
            for edges in _shared_first(*(c[np.repeat(mixed, n)] for c in cols[1:]), n[mixed], similarity):
                yield told(edges, False)

        def above(x: _Open) -> Iterator[pa.RecordBatch]:
            if x.low != x.high:
                yield told(_edges([np.array([x.key])], [np.array([x.label])]), True)

        # The last key of a batch may go on in the next one; of more rows than ``tile`` only a summary waits.
        held, opened = [np.zeros(0, dtype=np.int64)] * 5, None
        for b in batches:
            cols = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns, strict=True)]
            if opened and (own := int(np.count_nonzero(cols[0] == opened.key))):
                opened.add(cols[2][:own])
                cols = [c[own:] for c in cols]
            held = cols
            if not len(cols[0]):
                continue
            if opened:
                yield from above(opened)
                opened = None
            cut = int(np.argmax(cols[0] == cols[0][-1]))
            if cut:
                yield from shared([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
            if len(held[0]) > tile:
                opened, held = _Open(int(held[0][0])).add(held[2]), [c[:0] for c in held]
        if opened:
            yield from above(opened)
        if len(held[0]):
            yield from shared(held)
        trim()

    met = stored(keyed.repartition("key").sortWithinPartitions("key", "size").mapInArrow(run, "u long, v long, large boolean"), "near-met")
    pairs = met.where("NOT large").select("u", "v")
    large = met.where("large").select(F.col("u").alias("key"), F.col("v").alias("major"))
    if large.limit(1).count():
        pairs = pairs.unionAll(_shared_apart(keyed.join(large, "key"), similarity, tile))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = (1 - similarity) / (1 + similarity)
        for b in batches:
            u, v, size = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy() + b.column(4).to_numpy()
            near = np.array([least_apart(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)], dtype=np.int64) <= most * size + 1e-6
            yield _edges([u[near]], [v[near]])

    side = lambda c, k: nodes.select(F.col("node").alias(c), F.col("size").alias(f"size{k}"), F.col("odd").alias(f"odd{k}"))
    both = pairs.distinct().join(side("u", 0), "u").join(side("v", 1), "v")
    return stored(both.select("u", "v", "size0", "odd0", "size1", "odd1").mapInArrow(close, "u long, v long"), "near-missed")


def _shared_apart(keyed: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Pairs (u, v) of different label in runs of any size (key, node, label, size, at, major), tile by tile: those of other
    labels than ``major`` with all."""
    far = F.col("label") != F.col("major")
    tiles_of = keyed.groupBy("key").agg(F.greatest(F.ceil(F.count_if(far) / tile), F.lit(1)).cast("int").alias("lefts"), F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("rights"))
    met = keyed.join(tiles_of, "key")
    place = lambda tiles: F.pmod(F.xxhash64("node"), F.col(tiles)).cast("int")
    every = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
    one = ["node", "label", "size", "at"]
    left = met.where(far).select("key", *one, F.lit(True).alias("own"), place("lefts").alias("l"), every("rights").alias("r"))
    right = met.select("key", *one, F.lit(False).alias("own"), every("lefts").alias("l"), place("rights").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                m = batch.column(0)[k].values
                node, label, size, at = (m.field(c).to_numpy() for c in one)
                own = m.field("own").to_numpy(zero_copy_only=False)
                rest = np.flatnonzero(~own)
                for i in np.flatnonzero(own).tolist():
                    j = rest[(label[rest] != label[i]) & _may_reach(similarity, size, at, np.full(len(rest), i), rest)]
                    if len(j):
                        yield _edges([np.minimum(node[i], node[j])], [np.maximum(node[i], node[j])])

    return left.unionAll(right).groupBy("key", "l", "r").agg(F.collect_list(F.struct(*one, "own")).alias("m")).select("m").mapInArrow(run, "u long, v long")


def _compared(pairs: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) inside each list ``m`` of (node, label, body); members of equal label aren't compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for k in range(batch.num_rows):
                m = batch.column(0)[k].values
                node = m.field("node").to_numpy()
                label = np.unique(m.field("label").to_numpy(), return_inverse=True)[1]
                i, j = set_links([np.frombuffer(x, dtype=np.uint64) for x in m.field("body").to_pylist()], similarity, label)
                us.append(node[i] if i else node[:0])
                vs.append(node[j] if j else node[:0])
            yield _edges(us, vs)
        trim()

    return pairs.select("m").mapInArrow(run, "u long, v long")


def _paired(own: DataFrame) -> DataFrame:
    """(root, a, b, m): the rows (root, chunks, chunk, node, label, body) of each pair of different chunks of a component."""
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("chunk"))).alias("other")
    spread = own.where("chunks > 1").select("*", other)
    return spread.groupBy("root", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b")).agg(F.collect_list(F.struct("node", "label", "body")).alias("m"))


def _verified(rows: DataFrame, nodes: DataFrame, groups: DataFrame, words_per_shingle: int, similarity: float, chunk_bytes: int) -> DataFrame:
    """Links (u, v) between nodes of one group (node, root) whose sets reach ``similarity``: enough to connect them."""
    members = nodes.join(groups, "node").select("node", "root", "size", F.col("least.row").alias("row"))
    cut = members.groupBy("root").agg(F.ceil(F.sum("size") * 8 / chunk_bytes).cast("int").alias("chunks")).where("chunks > 1")
    members = stored(members.join(cut, "root", "left").select("node", "root", "row", F.coalesce("chunks", F.lit(1)).alias("chunks")), "near-members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([shingle_set(t, words_per_shingle).tobytes() for t in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), made], names=["node", "root", "chunks", "body"])
        trim()

    # Very many equal rows are one member.
    texts = members.join(rows.select("row", "text"), "row").groupBy("node", "root", "chunks").agg(F.first("text").alias("text"))
    own = texts.mapInArrow(sets, "node long, root long, chunks int, body binary")
    own = own.withColumns({"chunk": F.pmod(F.xxhash64("node"), "chunks").cast("int"), "label": F.col("node")})
    alone = own.groupBy("root", "chunk").agg(F.collect_list(F.struct("node", "label", "body")).alias("m"))
    links = stored(_compared(alone, similarity), "near-links")
    if not members.where("chunks > 1").limit(1).count():
        return links
    # One member of each group inside a chunk stands for it towards other chunks.
    inside = connected_components(links)
    met = own.drop("label").where("chunks > 1").join(inside.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = stored(_compared(_paired(met.where("node = label")), similarity), "near-links")
    links = stored(links.unionAll(first), "near-links")
    # What is still apart in its component is compared pair by pair.
    inside = connected_components(links)
    met = own.drop("label").where("chunks > 1").join(inside.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = met.groupBy("root").agg((F.min("label") != F.max("label")).alias("apart")).where("apart").select("root")
    return links.unionAll(_compared(_paired(met.join(apart, "root", "left_semi")), similarity))


def one_of_each(docs: DataFrame, words_per_shingle: int = WORDS, similarity: float = SIMILARITY, tile: int = 2048, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with one row of each component of near copies, that of the smallest id; a null id is the largest. Of rows
    with this id in the component, the one of the least row hash stays."""
    bounded_batches(docs.sparkSession)
    each = [x for c in map(named, docs.columns) for x in (c.isNull(), c)]
    hashed = F.concat(F.hex(F.xxhash64(*each)), F.lit("-"), F.hex(F.xxhash64(F.lit("row"), *reversed(each))))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), hashed.alias("row"), "text")
    prints = _prints(rows, words_per_shingle, bands(similarity), similarity)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    sets = prints.groupBy("set").agg(*(F.first(c).alias(c) for c in ("fp", "size", "keys", "first", "odd")), least)
    # Sets are numbered once, in the table that all that follows reads.
    nodes = stored(sets.drop("set").withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    groups = connected_components(_candidates(nodes, radius(similarity), tile))
    missed = _missed(nodes, groups, similarity, tile)
    if missed.limit(1).count():
        groups = connected_components(groups.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(missed))
    linked = connected_components(_verified(rows, nodes, groups, words_per_shingle, similarity, chunk_bytes))
    kept = nodes.select("node", "least").join(linked, "node", "left").groupBy(F.coalesce("root", "node").alias("c")).agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least.row").alias("row"))
    # The input's columns travel in one struct, so that no name can clash with those used here.
    own = docs.select(hashed.alias("row"), F.struct(*map(named, docs.columns)).alias("all")).join(kept, "row", "left_semi")
    # Equal rows are met in each task first, so very many of them are no single task's.
    once = own.groupBy("row").agg(F.first("all").alias("all"))
    return once.select(*(F.col("all").getField(c).alias(c) for c in docs.columns))
