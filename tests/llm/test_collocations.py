"""Collocations: counts and scores against plain Python, hashes against Spark's, bitmaps, odd rows, the query against DuckDB."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from ledgerspark.llm import collocations as C
from ledgerspark.llm import queries

DOCS = "lang string, text string"


def plain(rows, least, top):
    """The contract in plain Python."""
    out = []
    rows = [("und" if lang is None else lang, text) for lang, text in rows]
    for lang in {r[0] for r in rows}:
        f = Counter()
        for _, text in (r for r in rows if r[0] == lang):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
                w = re.findall(r"[^\x20\x09]+", piece)
                f.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        rows_ = []
        for g, a in found.items():
            inside = any(len(h) > len(g) and 100 * c >= 100 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, c in found.items())
            cuts = [(1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            if not inside:
                rows_.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]], n))
        for i, (s, a, p, left, right, n) in enumerate(sorted(rows_)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def test_against_plain_python(spark):
    rng = random.Random(0)
    words = ["the", "The", "of", "New", "york", "a", "ÉA", "éa", "x y", "\x1c", "naïve", "9"]
    ends = [" ", " ", " ", "\t ", ", ", ".", "\n", "\r\n", " ! ", "\x0b"]
    rows = [(rng.choice([None, "und", "en", ""]), "".join(rng.choice(words[: rng.choice([3, 12])]) + rng.choice(ends) for _ in range(rng.randrange(60)))) for _ in range(120)]
    rows += [("en", "new york is big")] * 9 + [("en", None), (None, ""), ("de", " \t.,"), ("en", "new york " * 20_000)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "text AS phrase", "1 AS n", "lang AS w1")
    for least, top in ((5, 10_000), (20, 7)):
        got = sorted(tuple(r) for r in C.collocations(df.repartition(3), least, top).collect())
        assert got == plain(rows, least, top)
    assert C.collocations(df.limit(0)).count() == 0


def test_rollup_counts_phrases_of_any_length(spark):
    """Windows only: each count of a shorter phrase comes from longer windows."""
    docs = spark.createDataFrame([("en", "a b c d e f. a b c. a b")] * 3, DOCS)
    pairs = C.pair_counts(docs, C.word_counts(docs))
    windows = C.padded_windows(docs, pairs)
    summed = windows.where("w1 = 'a'").groupBy(*(f"w{k}" for k in range(1, 6))).agg(F.sum("count"))
    assert {tuple(r) for r in summed.collect()} == {("a", "b", "c", "d", "e", 3), ("a", "b", "c", None, None, 3), ("a", "b", None, None, None, 3)}
    got = {tuple(r["words"]): r["a"] for r in C.phrase_counts(windows, 3).collect()}
    assert got[("a", "b")] == 9 and got[("a", "b", "c")] == 6 and got[("a", "b", "c", "d", "e")] == 3 and ("f",) not in got and ("f", "a") not in got


def test_hashes_and_bitmap(spark):
    words = ["", "a", "été", "x" * 100]
    df = spark.createDataFrame([(w,) for w in words], "w1 string").withColumn("lang", F.lit("en"))
    want = [r[0] % (1 << 64) for r in df.select(F.xxhash64("lang", "w1")).collect()]
    ours = C._hashes("en", [w.encode() for w in words])
    assert ours.tolist() == want
    held = C.bitmap(df.select(F.xxhash64("lang", "w1").alias("hash")))
    assert C._has(held, ours).all() and np.unpackbits(held).sum() == len({int(h) % C.BITS for h in ours})


def test_saturated_bitmaps_change_nothing(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("en", " ".join(rng.choice("abcdefghij") + rng.choice(["", ",", ""]) for _ in range(400))) for _ in range(10)]
    want = plain(rows, 8, 100)
    monkeypatch.setattr(C, "BITS", 64)
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in C.collocations(df, 8, 100).collect()) == want


def test_known_pairs_make_no_windows(spark):
    """Pairs that were counted exactly are not counted again: only windows of three words and more are left."""
    docs = spark.createDataFrame([("en", "a b. c d! a b c; e"), ("de", "a b")] * 4, DOCS)
    words = C.word_counts(docs)
    lonely = C.lonely_words(words, 3)
    pairs = C.pair_counts(docs, words, lonely)
    known = C.known_pairs(pairs, lonely)
    want = {("en", "a", "b"): 8, ("en", "b", "c"): 4, ("en", "c", "d"): 4, ("de", "a", "b"): 4}
    assert {(r["lang"], *r["words"]): r["a"] for r in known.collect()} == want
    assert {r["hash"] for r in known.collect()} == {r["hash"] for r in C.pair_counts(docs, words).collect()}
    windows = C.padded_windows(docs, known, lonely).groupBy(*(f"w{k}" for k in range(1, 6))).agg(F.sum("count"))
    assert [tuple(r) for r in windows.collect()] == [("a", "b", "c", None, None, 4)]


def test_words_that_share_a_place(spark, monkeypatch):
    """Frequent words that share a place of a bitmap with any word go through ROLLUP; others are known by their place."""
    rng = random.Random(2)
    rows = [(rng.choice(["en", "de"]), " ".join(rng.choice([rng.choice("abcd"), f"rare{rng.randrange(400)}"]) for _ in range(400))) for _ in range(20)]
    monkeypatch.setattr(C, "BITS", 2048)
    df = spark.createDataFrame(rows, DOCS)
    words = C.word_counts(df)
    lonely = C.lonely_words(words, 20)
    assert 0 < lonely.count() < words.where("f >= 20").count()
    assert C.known_pairs(C.pair_counts(df, words, lonely).where("f >= 20"), lonely).count() > 0
    assert sorted(tuple(r) for r in C.collocations(df, 20, 100).collect()) == plain(rows, 20, 100)


def test_query_against_duckdb(spark, sf_dir):
    got = sorted(tuple(r) for r in queries.op13_collocations(spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op13_collocations"])
    assert got == sorted(rel.fetchall()) and rel.columns == queries.op13_collocations(spark, sf_dir).columns
