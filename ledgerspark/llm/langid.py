"""Language identification by prediction by partial matching over bytes.

For each language a variable-order context tree counts which bytes follow which contexts of up to ``order`` bytes. A
byte costs its share in the longest context that has seen it, plus an escape for each longer context that has not
(method C: distinct successors over count plus distinct successors), and 1/256 below the empty context. Statistics are
frozen after training, so the code length of a text is a sum of table values. The trees of all languages are joined
into one table per order, a row for each context and byte with a column of exact costs for each language, and texts are
scored with numpy, whole batches at once.

The trees are fitted on a bounded sample: the ``per_lang`` documents of each language that come first by a seeded hash
(parameter; default 400). Sampled texts are counted whole, however long. Of the grams so found, each language keeps the most
frequent of each depth, ``max_grams`` in all (parameter; default two million, about 50 MB for the driver and each task), so
the tables' size grows neither with the corpus nor with long texts nor with the number of languages. All documents are
scored, whole.

Null texts and texts without a letter get ``und`` and score 0; rows without language are not learned from; if nothing
can be learned from, every text is ``und``; an empty table gives no rows; repeated rows are scored each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

PAD = b"\n"


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(folds)) == fold


def grams(raw: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each position from n - 1 on, as one number."""
    out = np.zeros(max(0, len(raw) - n + 1), dtype=np.uint32)
    for k in range(n):
        out = (out << np.uint32(8)) | raw[k : len(raw) - n + 1 + k]
    return out


def flat(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each behind ``order`` line feeds, and where each begins; the last entry is the end."""
    raw = [PAD * order + t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])


class Trees:
    """Frozen context trees of all languages: for each depth the sorted keys and costs in bits. Keys hold ``order`` + 1 bytes, four at most."""

    def __init__(self, langs: list[str], order: int, keys: list[np.ndarray], costs: list[np.ndarray], context_keys: list[np.ndarray], escapes: list[np.ndarray]):
        self.langs, self.order, self.keys, self.costs, self.context_keys, self.escapes = langs, order, keys, costs, context_keys, escapes

    @staticmethod
    def fit(samples: dict[str, list[str]], order: int = 3) -> Trees:
        langs = sorted(samples)
        counts = []
        for d in range(order + 1):
            seen = []
            for lang in langs:
                raw, at = flat(samples[lang], order)
                g = grams(raw[order - d :], d + 1) if len(raw) else np.zeros(0, dtype=np.uint32)
                # Positions of the padding itself are no text.
                own = np.ones(len(g), dtype=bool)
                for s in at[1:-1]:
                    own[s - order : s] = False
                seen.append(np.unique(g[own], return_counts=True))
            counts.append(seen)
        return Trees.of_counts(langs, order, counts)

    @staticmethod
    def of_counts(langs: list[str], order: int, per_depth: list[list[tuple[np.ndarray, np.ndarray]]]) -> Trees:
        """Trees from, for each depth and language, the sorted grams of depth + 1 bytes and how often each occurs."""
        counts = []  # per depth: keys of (context, byte), counts per language
        for seen in per_depth:
            keys = np.unique(np.concatenate([k for k, _ in seen])) if seen else np.zeros(0, dtype=np.uint32)
            c = np.zeros((len(keys), len(langs)))
            for j, (k, n) in enumerate(seen):
                c[np.searchsorted(keys, k), j] = n
            counts.append((keys, c))
        t = Trees(langs, order, [], [], [], [])
        for d, (keys, c) in enumerate(counts):
            contexts, start = np.unique(keys >> np.uint32(8), return_index=True)
            total = np.add.reduceat(c, start, axis=0) if len(keys) else c
            kinds = np.add.reduceat((c > 0).astype(float), start, axis=0) if len(keys) else c
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)  # an unknown context costs nothing
                row = np.searchsorted(contexts, keys >> np.uint32(8))
                own = -np.log2(c / (total + kinds)[row])
            low = t.lookup(keys & np.uint32((1 << 8 * d) - 1) if d else keys, d - 1)
            t.keys.append(keys)
            t.costs.append(np.where(c > 0, own, escape[row] + low))
            t.context_keys.append(contexts)
            t.escapes.append(escape)
        return t

    def lookup(self, g: np.ndarray, depth: int) -> np.ndarray:
        """Cost in bits, per language, of the last byte of each gram of depth + 1 bytes."""
        if depth < 0 or not len(self.keys):
            return np.full((len(g), len(self.langs)), 8.0)
        out = np.empty((len(g), len(self.langs)), dtype=self.costs[depth].dtype)
        at = np.minimum(np.searchsorted(self.keys[depth], g), len(self.keys[depth]) - 1)
        known = self.keys[depth][at] == g
        out[known] = self.costs[depth][at[known]]
        rest = g[~known]
        if len(rest):
            low = self.lookup(rest & np.uint32((1 << 8 * depth) - 1) if depth else rest, depth - 1)
            c = rest >> np.uint32(8)
            at = np.minimum(np.searchsorted(self.context_keys[depth], c), len(self.context_keys[depth]) - 1)
            hit = self.context_keys[depth][at] == c
            low[hit] += self.escapes[depth][at[hit]]
            out[~known] = low
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each whole text under each language."""
        raw, at = flat(texts, self.order)
        out = np.zeros((len(texts), len(self.langs)))
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            # Equal grams of a text are looked up once; blocks bound memory on very long texts.
            for s in range(a, b - self.order, 1 << 20):
                g, n = np.unique(grams(raw[s : min(b, s + (1 << 20) + self.order)], self.order + 1), return_counts=True)
                out[k] += n @ self.lookup(g, self.order)
        return out


def fit(docs: DataFrame, per_lang: int = 400, order: int = 3, seed: int = 10, max_grams: int = 2_000_000) -> Trees:
    """Trees from ``docs`` (doc_id, text, lang): the first ``per_lang`` documents of each language by a seeded hash, and of
    their grams the ``max_grams`` most frequent, an equal share for each language and depth."""
    h = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 31))
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", h.alias("h"))
    # About twice the wanted number passes a hash limit set by the language's size, and the first of these are ranked.
    # The model has a column for each language, so there are as few rows here.
    sizes = rows.groupBy("lang").count().collect()
    limit = F.lit(None).cast("double")
    for r in sizes:
        limit = F.when(F.col("lang") == r["lang"], 2.0 * per_lang / r["count"] * (1 << 31)).otherwise(limit)
    near = rows.where(F.col("h") < limit)
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= per_lang)
    schema = "lang string, depth int, gram long, n long"

    def run(batches: Iterator[pa.RecordBatch], block: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        def made(lang: str, depth: int, g: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array([depth] * len(g), pa.int32()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "depth", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield made(lang, -1, np.zeros(1), np.ones(1))  # a language of empty texts is one too
                raw, _ = flat([text], order)
                for d in range(order + 1):
                    for at in range(0, len(raw) - order, block):
                        part = raw[order - d + at : min(len(raw), order + at + block)]
                        yield made(lang, d, *np.unique(grams(part, d + 1), return_counts=True))

    # Whole texts are counted on the executors; the driver gets one row for each gram that the trees hold, a bounded number.
    bounded_batches(docs.sparkSession)
    share = max(1, max_grams // max(1, len(sizes) * (order + 1)))
    counted = first.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", "depth").orderBy(F.desc("n"), "gram"))
    table = counted.withColumn("place", place).where(F.col("place") <= share).drop("place").toArrow()
    lang, depth, gram, n = (table.column(c).to_numpy() for c in ("lang", "depth", "gram", "n"))
    langs = sorted(set(lang.tolist()))
    place = np.array([langs.index(x) for x in lang.tolist()], dtype=np.int64)
    by = np.lexsort((gram, depth, place))
    group, gram, n = (place * (order + 2) + depth + 1)[by], gram[by].astype(np.uint32), n[by]
    span = lambda k, d: slice(*np.searchsorted(group, [k * (order + 2) + d + 1, k * (order + 2) + d + 2]))
    return Trees.of_counts(langs, order, [[(gram[span(k, d)], n[span(k, d)]) for k in range(len(langs))] for d in range(order + 1)])


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, lang_pred, score): score is the share of the best language when code lengths are likelihoods."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            own = [k for k, x in enumerate(texts) if x and t.langs and any(map(str.isalpha, x))]
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                bits = t.code_lengths([texts[k] for k in part])
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                for k, b, s in zip(part, best.tolist(), share.tolist(), strict=True):
                    lang[k], score[k] = t.langs[b], s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
