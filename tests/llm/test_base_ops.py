"""Sharding, mixing, packing, fingerprints and SimHash against plain Python."""

import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerspark.llm import fingerprints, mixing, packing, queries, sharding, simhash
from ledgerspark.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, extra string, size long, shard int"
ODD = [
    (5, None, "en", "a", "x", 9, 9),
    (4, "", None, None, None, None, None),
    (3, "one two", "en", "b", "x", 9, 9),
    (2, "Ünï " * 3000, "de", "a", "x", 9, 9),
    (1, "same text of a few more words here", "en", "a", "x", 9, 9),
    (0, "same text of a few more words here", "en", "a", "x", 9, 9),
    (0, "same text of a few more words here", "en", "a", "x", 9, 9),
    (7, "\t \n", "en", "c", "x", 9, 9),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"select * from '{sf_dir}/documents.parquet'").df()


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_matrix_is_exact():
    parts = [0, 5, 100, 1, 33]
    m = sharding.communication_matrix(parts, 16, 3)
    assert m.sum(1).tolist() == parts
    assert m.sum(0).max() - m.sum(0).min() <= 1
    assert (m >= 0).all()


def test_sharding_query(spark, sf_dir, docs):
    p = queries.op3_sharding(spark, sf_dir).toPandas()
    assert sorted(p.doc_id) == sorted(docs.doc_id)
    by = p.groupby("shard").size()
    assert len(by) == 16 and by.max() - by.min() <= 1
    for _, g in p.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    t = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in p.itertuples():
        raw = (t[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    again = queries.op3_sharding(spark, sf_dir).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert p[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_shuffle_is_uniform(spark):
    """Neighbouring rows end in unrelated shards, and a shard's order isn't the input's."""
    df = spark.range(4000).withColumnRenamed("id", "k")
    p = sharding.shuffle_into_shards(df, "k", 16, rows_per_part=100).toPandas().sort_values("k")
    same = (p["shard"].values[1:] == p["shard"].values[:-1]).mean()
    assert 0.03 < same < 0.1
    assert abs(np.corrcoef(p["k"], p["slot"])[0, 1]) < 0.08


def test_sharding_odd_rows(odd, none):
    p = sharding.shuffle_into_shards(odd, "doc_id", 3, tie=[F.col("text")]).toPandas()
    assert len(p) == len(ODD) and sorted(p.groupby("shard").size()) == [2, 3, 3]
    assert "extra" in p and sharding.shuffle_into_shards(none, "doc_id", 3).count() == 0


def brute_mix(rows, pattern=(5, 2, 1), cap=3):
    src = sorted({s for s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for x, n in rows if x == s) for s in src}
    w = {s: pattern[i % 3] for i, s in enumerate(src)}
    left, target, open_ = float(sum(size.values())), {}, set(src)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * size[s]}
        if not over:
            return {**target, **{s: left * w[s] / total for s in open_}}
        for s in over:
            target[s] = float(cap * size[s])
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing_query(spark, sf_dir, docs):
    p = queries.op7_mixing(spark, sf_dir).toPandas().merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert len(p) == len(docs) and (p["size"] == p.text.map(n_words)).all()
    want = brute_mix(list(zip(p.source, p["size"], strict=True)))
    for s, g in p.groupby("source", dropna=False):
        assert g.target.iloc[0] == pytest.approx(want[s])
        assert abs(g.taken.sum() - want[s]) <= 1
    assert (p.taken <= 3 * p["size"]).all()


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000, "c": 1000}, {"a": 100, "b": 1, "c": 1, "d": 5, None: 2}, {"a": 0, "b": 0}, {"a": 3}])
def test_targets(spark, sizes):
    rows = list(sizes.items())
    w = F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (F.col("place") % 3 + 1).cast("int"))
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long"), w).collect()}
    assert got == pytest.approx(brute_mix(rows))


def test_mixing_odd_rows(odd, none):
    p = mixing.mix(odd).toPandas()
    assert len(p) == len(ODD) and (p.taken <= 3 * p["size"]).all() and mixing.mix(none).count() == 0


def check_pieces(p, docs, window=4096):
    tok = Tokenizer.from_file(queries.tokenizer_path())
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in p[p.doc_id == doc_id].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, g in p.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()][:-1] and g.length.sum() <= window


def test_packing_query(spark, sf_dir, docs):
    p = queries.op6_packing(spark, sf_dir).toPandas()
    check_pieces(p, list(zip(docs.doc_id, docs.text, strict=True)))
    fill = p.groupby("sequence_id").length.sum()
    assert (fill < 4096).sum() <= 1


def test_packing_odd_rows(spark, none):
    rows = [(i, t) for i, t in enumerate([None, "", "it's 42 Straße\x1cx y <|endoftext|> é ̈a", "x" * 9000, "word " * 9000, "ΣΑΣ."])]
    p = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), queries.tokenizer_path()).toPandas()
    check_pieces(p, rows)
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


def test_every_letter_as_the_plain_tokenizer():
    """All code points inside words, alone and before marks, random mixtures, and special tokens as text."""
    rng = np.random.default_rng(0)
    points = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}, x{chr(c)}." for c in points]
    texts += ["".join(chr(int(c)) for c in rng.choice(points[:0x3000], 12)) for _ in range(5000)]
    texts += ["x <|endoftext|> y", "a<|endoftext|>, <|ENDOFTEXT|> <|startoftext|>.", "İstanbul is a city", "it's O'Neil's, I'LL", None, "", "a\x1cb\x85c\xa0d", "ΟΔΟΣ."]
    got = packing.WordCachedTokenizer(queries.tokenizer_path(), most=10_000)(pa.array(texts))
    want = Tokenizer.from_file(queries.tokenizer_path()).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g.tolist() != w.ids] == []


def test_other_rules_are_encoded_whole():
    path = queries.tokenizer_path("byte_bpe_50k.json")
    texts = ["Some words, and  more.", None, "<|endoftext|> É"]
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in packing.WordCachedTokenizer(path)(pa.array(texts))] == want


def test_sum_of_squares_choice():
    """Each placement has the least sum of squares that any level would give."""
    rng, w = np.random.default_rng(0), 64
    s = packing.SumOfSquares(w)
    for k, n in enumerate(rng.integers(1, w, 500).tolist()):
        c = s.count.copy()
        best = min(
            sum((int(c[x]) - (x == h and h > 0) + (x == h + n)) ** 2 for x in range(1, w))
            for h in range(w - n + 1)
            if h == 0 or c[h]
        )
        s.add(k, n)
        assert int((s.count[1:w].astype(int) ** 2).sum()) == best
    s.drain()
    total = sum(p[2] for b in s.full for p in b)
    rng = np.random.default_rng(0)
    assert total == rng.integers(1, w, 500).sum()
    assert sum(sum(p[2] for p in b) < w for b in s.full) <= 1


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, links):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_query(spark, sf_dir, docs):
    p = queries.op5_simhash(spark, sf_dir).toPandas()
    want = {d: brute_simhash(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert {r.doc_id: r.fingerprint for r in p.itertuples()} == {d: f"{f:016x}" for d, f in want.items()}
    links = [(a, b) for a, b in itertools.combinations(want, 2) if (want[a] ^ want[b]).bit_count() <= 2]
    assert dict(zip(p.doc_id, p.component_id, strict=True)) == components(list(want), links)


@pytest.mark.parametrize("tile", [3, 16, 2048])
def test_links_with_small_tiles(spark, tile):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = [int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 64, (8, 2))]
    fps = sorted({0, 2**64 - 1, 1, *map(int, base), *near})
    rows = [(int(np.array(f, dtype=np.uint64).view(np.int64)), i) for i, f in enumerate(fps)]
    got = simhash.link_fingerprints(spark.createDataFrame(rows, "fp long, node long"), 2, tile).toPandas()
    want = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert all((fps[r.u] ^ fps[r.v]).bit_count() <= 2 for r in got.itertuples()) or tile > 3
    assert components(range(len(fps)), got.values.tolist()) == components(range(len(fps)), want)


def test_simhash_odd_rows(odd, none):
    p = simhash.near_duplicates(odd).toPandas().drop_duplicates()
    assert p[p.doc_id.isin([5, 4, 7])].component_id.tolist() == [4, 4, 4]
    assert set(p[p.doc_id <= 1].component_id) == {0}
    assert simhash.near_duplicates(none).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2050)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).toPandas().itertuples()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == components(nodes, [p for p in pairs if p[0] != p[1]])


def brute_shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprint_query(spark, sf_dir, docs):
    p = queries.op4_fingerprints(spark, sf_dir).toPandas().set_index("doc_id")
    order = docs.sort_values("doc_id", ascending=False)
    ids, texts = order.doc_id.tolist(), [t or "" for t in order.text]
    off = []
    for i, (d, t) in enumerate(zip(ids, texts, strict=True)):
        nxt = texts[(i + 1) % len(ids)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = p.loc[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = brute_shingles(t), brute_shingles(edited), brute_shingles(nxt)
        off += [r.near_edited - jaccard(a, b), r.near_next - jaccard(a, c)]
        if len(a | b) <= 128:
            assert r.near_edited == pytest.approx(jaccard(a, b))
    assert len(p) == len(docs) and math.sqrt(np.mean(np.square(off))) < 0.04
    same = pd.DataFrame({"t": texts, "f": [p.loc[d].fingerprint for d in ids]})
    assert (same.groupby("t").f.nunique() == 1).all()


@pytest.mark.parametrize("rows_per_cell", [1, 2, 5, 100])
def test_next_document(spark, rows_per_cell):
    rng = np.random.default_rng(4)
    ids = sorted({*rng.integers(-50, 60, 40).tolist(), 10**15, -(10**12)}, reverse=True)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    placed = fingerprints.with_next(df, rows_per_cell).toPandas()
    got = {}
    for _, g in placed.groupby("cell"):
        g = g.sort_values(["extra", "doc_id"], ascending=[True, False])
        for a, b in itertools.pairwise(g.itertuples()):
            if not a.extra:
                got[a.doc_id] = b.text
    assert got == {d: f"t{ids[(i + 1) % len(ids)]}" for i, d in enumerate(ids)}


def test_sketch_merges_and_estimates(spark):
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    df = spark.createDataFrame([("g", a, b)], "g string, a string, b string").select("g", fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprints.resemblance(F.col("a"), F.col("b")), fingerprints.containment(F.col("a"), F.col("b")), fingerprints.distinct_shingles(F.col("a"))).first()
    assert r[0] == pytest.approx(1 / 3, abs=0.12) and r[1] == pytest.approx(0.5, abs=0.2) and r[2] == pytest.approx(1996, rel=0.3)
    both = df.select("g", F.explode(F.array("a", "b")).alias("s"))
    assert fingerprints.merge_groups(both, "g", "s").first()["s"] == df.select(fingerprints.merge(F.col("a"), F.col("b"))).first()[0]


def test_fingerprint_odd_rows(odd, none):
    p = fingerprints.fingerprint_pairs(odd).toPandas()
    assert len(p) == len(ODD) and fingerprints.fingerprint_pairs(none).count() == 0
    assert len(p[p.doc_id == 5].sketch.iloc[0]) == 0 and len(p[p.doc_id == 3].sketch.iloc[0]) == 1


@pytest.mark.parametrize("rows_per_cell", [1, 4, 1000])
def test_next_document_of_null_ids(spark, rows_per_cell):
    """Null ids come last, by a hash of their text, over cells of their own."""
    rows = [(i, f"t{i}") for i in range(9)] + [(None, f"n{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nulls = [r.text for r in df.where("doc_id IS NULL").orderBy(F.xxhash64("text")).collect()]
    order = [f"t{i}" for i in range(8, -1, -1)] + nulls
    placed = fingerprints.with_next(df, rows_per_cell).toPandas()
    got = {}
    for _, g in placed.groupby("cell"):
        g = g.sort_values(["extra", "doc_id", "tie"], ascending=[True, False, True], na_position="last")
        for a, b in itertools.pairwise(g.itertuples()):
            if not a.extra:
                got[a.text] = b.text
    assert got == {t: order[(i + 1) % len(order)] for i, t in enumerate(order)}
    assert placed[placed.doc_id.isna()].cell.nunique() > 1 or rows_per_cell == 1000
