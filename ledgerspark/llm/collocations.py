"""Phrase collocations: counts of word windows by top-order marginalisation.

Texts are lower-cased (A-Z), cut into pieces at sentence marks and line ends, and into words at spaces and tabs. Every word
that may begin a phrase gets one window: itself and its leads, ``w1`` to ``w5``, padded with nulls where the piece ends.
Only these longest windows are counted; Spark's ROLLUP over (lang, w1, ..., w5) then sums them into the counts of all shorter
prefixes, so nothing is emitted for each phrase length. The count of a phrase of k words is the sum of the windows that begin
with it, as each of its occurrences begins one window.

A phrase can't be more frequent than its words and neighbouring pairs, so a window also ends (null) before a pair below
``min_count``, which no candidate contains. Frequent words and pairs reach the tasks as bitmaps of hashes of a fixed size
(``BITS``, 16 MB each), whatever the corpus: a collision only lets a window grow longer than it need be, and final counts
are those of whole phrases. Tasks count inside an Arrow batch first; Spark sums the batches.

Most pairs are counted once: where both words have their place of a bitmap to themselves, the count of the pair that says
where windows end is exact, so windows of such a pair and nothing more are left out. Other pairs go through ROLLUP.

Null texts are empty, null languages are ``und``. Repeated rows count again, ids are not used, other columns are left out. A
very long text is cut into words like any other. Ties of the rank go by count, then phrase. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored, trim

#: Bits of a bitmap, and words of the longest phrase.
BITS, LONGEST = 1 << 27, 5
#: Bytes that end a piece; ``MARK`` stands for any of them.
ENDS, MARK = b".,;:!?\n\x0b\x0c\r", b"."

_TABLE = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + MARK * len(ENDS))


def tokens_of(text: bytes) -> list[bytes]:
    """Words of ``text`` in order, with ``MARK`` between pieces, which no word can be."""
    return text.translate(_TABLE).replace(MARK, b" . ").split()


class _Numbers(dict):
    """Numbers words in the order of their arrival; ``MARK`` is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbered(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """For each language of ``batch`` (lang, text): its words as numbers with 0 between pieces, and the words."""
    langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        rows.setdefault(lang, []).append(i)
    for lang, at in rows.items():
        numbers = _Numbers({MARK: 0})
        parts = [np.zeros(1, np.int64)]
        for i in at:
            if text := texts[i].as_py():
                parts += np.fromiter(map(numbers.__getitem__, tokens_of(text)), np.int64), parts[0]
        yield lang, np.concatenate(parts), list(numbers)


def _rows(lang: str, words: list[bytes], columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    """Rows (lang, w1, ..., count); a number below 1 is a null word."""
    names = pa.array(words, pa.binary()).cast(pa.string())
    taken = [names.take(pa.array(np.maximum(c, 0), mask=c < 1)) for c in columns]
    langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(counts), np.int64)))
    return pa.RecordBatch.from_arrays([langs, *taken, pa.array(counts, pa.int64())], ["lang", *(f"w{k + 1}" for k in range(len(columns))), "count"])


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """Spark's ``xxhash64(lang, word)`` of each word."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first << np.uint64(7)) ^ (first >> np.uint64(57)) ^ second) & np.uint64((1 << 63) - 1)


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether ``bitmap``, whose size is a power of two, has the lowest bits of each hash."""
    places = (hashes & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def _placed(hashes: Column) -> Column:
    return hashes.bitwiseAND(F.lit(BITS - 1))


def bitmap(grams: DataFrame) -> np.ndarray:
    """Bitmap of the lowest bits of the column ``hash`` of ``grams``: ``BITS`` bits, built by Spark in pieces of 4 kB."""
    at = _placed(F.col("hash")) + 1  # the functions below count from 1
    pieces = grams.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in pieces.collect():  # BITS / 8 bytes at most
        held = np.frombuffer(r["bits"], np.uint8)[: len(out)]
        begin = (r["bucket"] - 1) * 4096
        out[begin : begin + len(held)] = held[: len(out) - begin]
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, w1, f) over ``docs`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, ids, words in _numbered(batch):
                counts = np.bincount(ids, minlength=len(words))
                at = np.flatnonzero(counts[1:]) + 1
                yield _rows(lang, words, [at], counts[at])
        trim()

    return docs.mapInArrow(count, "lang string, w1 string, count bigint").groupBy("lang", "w1").agg(F.sum("count").alias("f"))


def lonely_words(words: DataFrame, min_count: int) -> DataFrame:
    """(place, lang, w1): words of ``words`` (lang, w1, f) found ``min_count`` times or more that no other word, however rare,
    shares a place of a bitmap with. Such a word is known by its place alone, so a pair of them is two places in one number."""
    placed = words.withColumn("place", _placed(F.xxhash64("lang", "w1")))
    alone = placed.groupBy("place").agg(F.count(F.lit(1)).alias("sharing")).where("sharing = 1").select("place")
    return placed.where(F.col("f") >= min_count).join(alone, "place").select("place", "lang", "w1")


def _held(docs: DataFrame, grams: DataFrame | None, hashes: Column) -> Broadcast[np.ndarray]:
    """Bitmap of ``hashes`` of ``grams`` for the tasks; an empty one of a byte without ``grams``."""
    bits = np.zeros(1, np.uint8) if grams is None else bitmap(grams.select(hashes.alias("hash")))
    return docs.sparkSession.sparkContext.broadcast(bits)


def pair_counts(docs: DataFrame, frequent: DataFrame, lonely: DataFrame | None = None) -> DataFrame:
    """(hash, f) of neighbours inside a piece whose words may both be ``frequent`` (lang, w1). Pairs of two ``lonely`` words
    have a negative number that :func:`known_pairs` reads, and an exact count. Others are told apart by 63 bits of hash:
    they only say which windows may end, so pairs that share one cost nothing but length."""
    held, sure = _held(docs, frequent, F.xxhash64("lang", "w1")), _held(docs, lonely, F.col("place"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, ids, words in _numbered(batch):
                hashes = _hashes(lang, words)
                good, known = _has(held.value, hashes), _has(sure.value, hashes)
                good[0] = False
                a, b = ids[:-1], ids[1:]
                keys, counts = np.unique((a * len(words) + b)[good[a] & good[b]], return_counts=True)
                first, second = np.divmod(keys, len(words))
                mixed = _mixed(hashes[first], hashes[second]).astype(np.int64)
                size = 8 * len(sure.value)
                places = (hashes & np.uint64(size - 1)).astype(np.int64)
                numbers = np.where(known[first] & known[second], -1 - (places[first] * size + places[second]), mixed)
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(counts, pa.int64())], ["hash", "count"])
        trim()

    return docs.mapInArrow(count, "hash bigint, count bigint").groupBy("hash").agg(F.sum("count").alias("f"))


def known_pairs(pairs: DataFrame, lonely: DataFrame) -> DataFrame:
    """(lang, words, k, a, hash): the ``pairs`` (hash, f) of two ``lonely`` words, with the hash that other pairs have."""
    number = F.lit(-1) - F.col("hash")
    pairs = pairs.where("hash < 0").select(F.shiftrightunsigned(number, BITS.bit_length() - 1).alias("first"), number.bitwiseAND(F.lit(BITS - 1)).alias("second"), "f")
    first = lonely.select(F.col("place").alias("first"), "lang", "w1")
    both = pairs.join(first, "first").join(lonely.select(F.col("place").alias("second"), F.col("w1").alias("w2")), "second")
    a, b = F.xxhash64("lang", "w1"), F.xxhash64("lang", "w2")
    mixed = F.shiftleft(a, 7).bitwiseXOR(F.shiftrightunsigned(a, 57)).bitwiseXOR(b).bitwiseAND(F.lit((1 << 63) - 1))
    return both.select("lang", F.array("w1", "w2").alias("words"), F.lit(2).alias("k"), F.col("f").alias("a"), mixed.alias("hash"))


def padded_windows(docs: DataFrame, pairs: DataFrame, lonely: DataFrame | None = None) -> DataFrame:
    """(lang, w1, ..., w5, count): windows of two words and more, each ended by null before a pair that isn't in ``pairs``
    (hash; but for collisions), summed inside batches only. Windows of two ``lonely`` words and no more are left out, as
    :func:`known_pairs` has the counts of such pairs."""
    held, sure = _held(docs, pairs, F.col("hash")), _held(docs, lonely, F.col("place"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, ids, words in _numbered(batch):
                hashes = _hashes(lang, words)
                a, b = ids[:-1], ids[1:]
                inside = np.flatnonzero((a > 0) & (b > 0))
                linked = np.zeros(len(ids) + LONGEST, bool)
                linked[inside] = _has(held.value, _mixed(hashes[a[inside]], hashes[b[inside]]))
                starts = np.flatnonzero(linked)
                known = _has(sure.value, hashes)
                starts = starts[linked[starts + 1] | ~(known[ids[starts]] & known[ids[starts + 1]])]
                leads, alive, key = [ids[starts]], np.ones(len(starts), bool), ids[starts]
                padded = np.append(ids, np.zeros(LONGEST, np.int64))
                for k in range(1, LONGEST):
                    alive = alive & linked[starts + k - 1]
                    leads.append(np.where(alive, padded[starts + k], 0))
                    # The prefix is one number, so the next lead makes a number that fits 64 bits.
                    key = np.unique(key * len(words) + leads[-1], return_inverse=True)[1]
                _, first, counts = np.unique(key, return_index=True, return_counts=True)
                yield _rows(lang, words, [c[first] for c in leads], counts)
        trim()

    columns = ", ".join(f"w{k + 1} string" for k in range(LONGEST))
    return docs.mapInArrow(count, f"lang string, {columns}, count bigint")


def phrase_counts(windows: DataFrame, min_count: int) -> DataFrame:
    """(lang, words, k, a): phrases of two words and more found ``min_count`` times or more, by ROLLUP of the windows."""
    names = [f"w{k + 1}" for k in range(LONGEST)]
    rolled = windows.rollup("lang", *names).agg(F.sum("count").alias("a"), F.grouping_id().alias("level")).where(F.col("a") >= min_count)
    words, k = F.lit(None).cast("array<string>"), F.lit(0)
    for n in range(2, LONGEST + 1):
        # The last columns are rolled up; a null in the last that isn't is the padding of a shorter window.
        here = (F.col("level") == (1 << (LONGEST - n)) - 1) & F.col(names[n - 1]).isNotNull()
        words, k = F.when(here, F.array(*names[:n])).otherwise(words), F.when(here, n).otherwise(k)
    return rolled.select("lang", words.alias("words"), k.alias("k"), "a").where("k > 0")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exact: products have up to 38 digits."""
    big = lambda c: c.cast("decimal(17,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * big(a) * big(n), big(left) * big(right))


def collocations(docs: DataFrame, min_count: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 5 words by their weakest cut.

    ``docs`` (lang, text). A phrase inside a longer one that is as frequent is left out.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = stored(word_counts(docs), "phrase-words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= min_count)
    lonely = stored(lonely_words(words, min_count), "phrase-lonely")
    pairs = stored(pair_counts(docs, frequent, lonely).where(F.col("f") >= min_count), "phrase-pairs")
    known = stored(known_pairs(pairs, lonely), "phrase-known")
    links = pairs.where("hash >= 0").select("hash").unionByName(known.select("hash"))
    longer = phrase_counts(padded_windows(docs, links, lonely), min_count)
    # Windows hold a known pair only where it begins a longer one, so their count of it is never above its own.
    phrases = stored(longer.unionByName(known.drop("hash")).groupBy("lang", "words", "k").agg(F.max("a").alias("a")), "phrases")
    counts = frequent.select("lang", F.array("w1").alias("words"), "f").unionByName(phrases.select("lang", "words", F.col("a").alias("f")))
    at = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    side = lambda name, count: counts.select("lang", F.col("words").alias(name), F.col("f").alias(count))
    cuts = at.withColumns({"first": F.slice("words", F.lit(1), F.col("cut")), "rest": F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut"))})
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(total, "lang")
    weakest = F.min(F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r", "n")).alias("m")
    scored = cuts.groupBy("lang", "words", "a").agg(weakest).select("lang", "words", "a", "m.*")
    # What lies inside a longer phrase of the same count lies inside one that is longer by one word, at its begin or end.
    ends = F.array(F.slice("words", F.lit(1), F.col("k") - 1), F.slice("words", F.lit(2), F.col("k") - 1))
    inner = phrases.where("k > 2").select("lang", "a", F.explode(ends).alias("words"))
    kept = scored.join(inner, ["lang", "words", "a"], "left_anti").withColumn("phrase", F.concat_ws(" ", "words"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))


def collocations_sql(min_count: int = 100, top: int = 2000) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
grams AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k),
counts AS (SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE k > 1 AND f >= {min_count}),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM candidates),
scored AS (
  SELECT x.lang, x.g, x.k, x.f AS a, x.c, l.f AS l, r.f AS r, n,
         (1000::HUGEINT * x.f::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cuts x JOIN counts l ON l.lang = x.lang AND l.g = x.g[1:x.c] JOIN counts r ON r.lang = x.lang AND r.g = x.g[x.c + 1:x.k]
  JOIN total t ON t.lang = x.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inner_parts AS (
  SELECT lang, f, g[s:s + m - 1] AS part FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))),
kept AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM weakest x
  WHERE NOT EXISTS (SELECT 1 FROM inner_parts p WHERE p.lang = x.lang AND p.part = x.g AND 100 * p.f >= 100 * x.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {top}"""
