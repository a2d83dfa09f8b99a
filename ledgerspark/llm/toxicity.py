"""Toxicity by a character n-gram linear classifier over naive Bayes log-count ratios.

Features are hashed character n-grams of the lower-cased text with white space folded, present or not. Each is scaled
by the log ratio of its smoothed document shares in toxic and in clean training texts; a logistic regression is fitted
on the scaled features (Wang and Manning, 2012). Document counts are summed by Spark; the ratios with the strongest
evidence are kept, at most ``n_features``. The fit uses a bounded, documented sample of labelled rows: the first
``max_train`` (default 16,000) by a seeded hash. All documents are scored, whole, with numpy in map-side batches.

Very long texts are scored whole, in blocks. Null and blank texts get the score of a text without features; documents without label are scored and not learned from;
a document with several labels is learned once for each, and every row of a repeated id; without labelled rows of both classes every score is the share
of toxic labels (0 if there are none); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_batches, named, stored, trim

#: Bits of the hashed feature space and lengths of n-grams.
BITS, LENGTHS = 22, (4, 5, 6, 8, 10)
#: Features whose counts travel together.
STRETCH = 1 << 14
#: Characters hashed at once, so that very long texts take bounded memory.
BLOCK = 1 << 18


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(folds)) == fold


def blocks(text: str | None) -> Iterator[np.ndarray]:
    """Code points of the normalised text between two spaces, in overlapping blocks."""
    norm = f" {' '.join((text or '').lower().split())} "
    points = np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, max(1, len(points) - 2), BLOCK):
        yield points[at : at + BLOCK + max(LENGTHS) - 1]


def hashed(points: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Feature numbers of all n-grams in ``points``; with ``keep``, a table of flags, only those flagged."""
    mult, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    h, out = points.astype(np.uint64), []
    for n in range(2, max(LENGTHS) + 1):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint64(1_000_003) + points[n - 1 :]
        if n in LENGTHS:
            f = (((h ^ np.uint64(n)) * mult) >> shift).astype(np.int32)
            out.append(f if keep is None else f[keep[f]])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


def features(text: str | None, keep: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct features of a text."""
    parts = [hashed(p, keep) for p in blocks(text)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else np.unique(parts[0])


@dataclass
class Model:
    keep: np.ndarray  # sorted feature numbers
    weight: np.ndarray
    bias: float

    def flags(self) -> np.ndarray:
        f = np.zeros(1 << BITS, dtype=bool)
        f[self.keep] = True
        return f

    def score(self, texts: list[str | None], flags: np.ndarray) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for k, t in enumerate(texts):
            f = features(t, flags)
            z[k] += self.weight[np.searchsorted(self.keep, f)].sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(doc: np.ndarray, col: np.ndarray, y: np.ndarray, scale: np.ndarray, l2: float = 0.01, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on features ``scale[col]`` of rows ``doc``.

    Accelerated descent with a step for each feature: a row's curvature is at most a quarter of its feature count times
    the sum of its squared features, which bounds the loss by a separable quadratic.
    """
    n, k, x = len(y), len(scale), scale[col]
    width = np.bincount(doc, minlength=n) + 1.0
    step = 1 / (np.bincount(col, weights=x * x * width[doc], minlength=k) / 4 + l2)
    step_b = 4 / width.sum()
    w, b = np.zeros(k), 0.0
    vw, vb = w, b
    for t in range(rounds):
        z = np.bincount(doc, weights=x * vw[col], minlength=n) + vb
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        nw = vw - step * (np.bincount(col, weights=x * e[doc], minlength=k) + l2 * vw)
        nb = vb - step_b * e.sum()
        m = t / (t + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w * scale, b


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 16_000, n_features: int = 8192, min_docs: tuple[int, int] = (4, 10), seed: int = 8) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1); see the module for the sample's bound."""
    bounded_batches(docs.sparkSession)
    own = labels.where("toxic IS NOT NULL").select("doc_id", (F.col("toxic") == 1).cast("int").alias("y"))
    # The sample is chosen on ids alone, so only its texts are shuffled.
    # About twice the wanted number passes a hash limit, and the first of these are taken.
    h = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 31))
    chosen = own.where(h < 2.0 * max_train / max(1, own.count()) * (1 << 31)).orderBy(h, "doc_id", "y").limit(max_train)
    # Chosen ids are at most max_train, so they are broadcast and the texts of all other documents stay where they are.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    train = stored(sample.repartition(F.xxhash64("doc_id", "text")).select("y", "text"), "toxicity-sample")
    n, pos = (x or 0 for x in train.agg(F.count(F.lit(1)), F.sum("y")).first())
    neg = n - pos
    if not pos or not neg:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), 30.0 * (1 if n and pos else -1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_label = np.zeros((2, 1 << BITS), dtype=np.int32)
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with_label[y, features(t)] += 1
        # Counts travel packed, one row for each stretch of features, as rows of their own would fill the tasks' memory.
        for at in range(0, 1 << BITS, STRETCH):
            part = with_label[:, at : at + STRETCH]
            f = np.flatnonzero(part[0] | part[1]).astype("<i4")
            if len(f):
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.concatenate([f, part[1][f], part[0][f]]).astype("<i4").tobytes()], pa.binary())], names=["at", "c"])
        del with_label, part
        trim()

    # A feature of few documents fits them by chance: 1 in 250 training texts at least, within the two bounds.
    least = min(min_docs[1], max(min_docs[0], n // 250))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums = np.zeros((2, STRETCH), dtype=np.int64)
                for x in parts:
                    f, *by = np.frombuffer(x, dtype="<i4").reshape(3, -1)
                    sums[0, f] += by[0]
                    sums[1, f] += by[1]
                f = np.flatnonzero(sums.sum(axis=0) >= least)
                yield pa.RecordBatch.from_arrays([pa.array(f + at), pa.array(sums[0, f]), pa.array(sums[1, f])], names=["f", "p", "q"])
        trim()

    counts = train.mapInArrow(count, "at long, c binary").groupBy("at").agg(F.collect_list("c").alias("c")).mapInArrow(total, "f long, p long, q long")
    ratio = F.log((F.col("p") + 1) / (pos + 2)) - F.log((F.col("q") + 1) / (neg + 2))
    # Evidence: the ratio in units of its standard error.
    strength = F.abs(ratio) / F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))
    best = counts.select("f", ratio.alias("r"), strength.alias("s")).orderBy(F.desc("s"), "f").limit(n_features).toPandas().sort_values("f")
    keep, scale = best["f"].to_numpy(dtype=np.int64), best["r"].to_numpy(dtype=float)
    flags = Model(keep, scale, 0.0).flags()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.searchsorted(keep, features(t, flags)).astype("<i4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["y", "c"])

    rows = train.mapInArrow(project, "y int, c binary").collect()  # max_train rows of n_features numbers at most
    # In a fixed order, so that sums of floats don't depend on the order of arrival.
    rows = sorted((r["y"], bytes(r["c"])) for r in rows)
    y, cols = np.array([r[0] for r in rows], dtype=float), [np.frombuffer(r[1], dtype="<i4") for r in rows]
    w, b = logistic(np.repeat(np.arange(len(y)), [len(c) for c in cols]), np.concatenate(cols), y, scale)
    return Model(keep, w, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (any columns, with text) with a column ``score``; a column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != "score"]
    text = [c.lower() for c in kept].index("text")
    base = docs.select(*(named(c).alias(f"c{k}") for k, c in enumerate(kept)))  # a task takes no names with dots
    schema = StructType([*(StructField(c, f.dataType, f.nullable) for c, f in zip(kept, base.schema, strict=True)), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        flags = m.flags()
        for b in batches:
            s = m.score(b.column(text).to_pylist(), flags)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=schema.names)
        trim()

    return base.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    out = score(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
