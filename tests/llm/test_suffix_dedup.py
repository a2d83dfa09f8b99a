"""Induced sorting, and the removal of repeated strings, against plain Python."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import induced, queries, suffix_dedup
from test_base_ops import DOCS, ODD


def brute_suffixes(t):
    t, n = t.tolist(), len(t)
    sa, lcp = sorted(range(n), key=lambda i: t[i:]), [0]
    for a, b in zip(sa, sa[1:], strict=False):
        k = 0
        while max(a, b) + k < n and t[a + k] == t[b + k]:
            k += 1
        lcp.append(min(k, 50))
    return sa, lcp


@pytest.mark.parametrize("fine", [0, 3, 4096])
@pytest.mark.parametrize("memory", [4, 1 << 25])
def test_suffix_array(monkeypatch, fine, memory):
    """Induction in batches (fine 0), entry by entry, or both in one recursion; arrays in memory or in files."""
    monkeypatch.setattr(induced, "FINE", fine)
    monkeypatch.setattr(induced, "MEMORY", memory)
    rng = np.random.default_rng(fine)
    for trial in range(250):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 60))
        t = np.repeat(t, rng.integers(1, 5, len(t)))[:90] if trial % 3 == 0 else np.tile(t[:7], 8) if trial % 5 == 0 else t
        t = np.unique(np.append(t, 0), return_inverse=True)[1].astype(np.int32)
        sa, lcp = induced.suffix_array(t, 50)
        assert (sa.tolist(), lcp.tolist()) == brute_suffixes(t)


def test_recursion_by_induction_in_files(monkeypatch):
    """A shard of prose recurses by induction until all names differ, and its queues and strings lie in files."""
    levels, files = [], []

    class Text(induced.Text):
        def __init__(self, t):
            super().__init__(t)
            levels.append(self.n)

    real = induced.scratch
    monkeypatch.setattr(induced, "Text", Text)
    monkeypatch.setattr(induced, "MEMORY", 1000)
    monkeypatch.setattr(induced, "scratch", lambda n, t: files.append(isinstance(out := real(n, t), np.memmap)) or out)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(300)]
    segs = [" ".join(rng.choice(words, 40)).encode() for _ in range(200)]
    segs += [segs[k][20:150] + segs[k + 1][:90] for k in range(60)]
    got = {}
    for c, s, o in zip(*induced.classes(segs, 50), strict=True):
        got.setdefault(int(c), set()).add((int(s), int(o)))
    want = {}
    for s, b in enumerate(segs):
        for o in range(len(b) - 49):
            want.setdefault(b[o : o + 50], set()).add((s, o))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert len(levels) >= 4 and levels == sorted(levels, reverse=True) and sum(files) > 10


def test_classes():
    segs = [b"abcdefgh", b"xabcdefy", b"", b"zzzz", b"zzzzz", b"abcd"]
    got = {}
    for c, s, o in zip(*induced.classes(segs, 4), strict=True):
        got.setdefault(int(c), set()).add((int(s), int(o)))
    want = {}
    for s, b in enumerate(segs):
        for o in range(len(b) - 3):
            want.setdefault(b[o : o + 4], set()).add((s, o))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def brute_removed(rows, length=50):
    """Per row (id, text): n_bytes, n_removed, n_spans, sha256 of the rest. Ids must come in ascending order."""
    seen, out = {}, []
    for i, text in rows:
        b = (text or "").encode()
        gone, own = bytearray(len(b)), []
        for q in range(len(b) - length + 1):
            w = b[q : q + length]
            own.append(w)
            if seen.get(w, i) < i:
                gone[q : q + length] = b"\1" * length
        for w in own:
            seen.setdefault(w, i)
        spans = sum(1 for q, g in enumerate(gone) if g and (q == 0 or not gone[q - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def sorted_rows(df):
    return sorted(df.toPandas().itertuples(index=False, name=None))


@pytest.mark.parametrize("length", [8, 50])
def test_runs_that_share_no_window_are_not_sorted(length):
    """Runs with one anchor: those with an equal window are always sorted, those with equal bytes round the anchor only never."""
    rng = np.random.default_rng(4)
    runs, anchors = [], []
    draw = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    for _ in range(60):
        core, gram = draw(length), min(suffix_dedup.GRAM, length // 2)
        for cut in rng.integers(0, length - gram, 6).tolist():
            raw = np.frombuffer(draw(length) + core[cut : cut + int(rng.integers(gram, length + 1))] + draw(length), dtype=np.uint8)
            r = suffix_dedup.Runs(raw, np.array([len(raw)]), length)
            runs += [raw[a : b + length].tobytes() for a, b in zip(r.first.tolist(), r.last.tolist(), strict=True)]
            anchors.append(r.anchor & suffix_dedup._LOW48)
    runs, at = np.unique(np.array(runs, dtype=object), return_index=True)
    runs, anchors = runs.tolist(), np.concatenate(anchors)[at]
    windows = [{r[k : k + length] for k in range(len(r) - length + 1)} for r in runs]
    shares = np.array([any(w & v for v in windows if v is not w) for w in windows])
    alike = suffix_dedup._alike(runs, anchors, length)
    assert alike[shares].all() and not alike.all()
    # Windows dealt by their own key, whose anchor isn't among their bytes, are sorted.
    assert suffix_dedup._alike(runs, np.zeros(len(runs), dtype=np.uint64), length).all()


def test_query(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()
    assert sorted_rows(queries.op1_suffix_dedup(spark, sf_dir)) == brute_removed(rows)


@pytest.mark.parametrize("length,chunk,size", [(30, 64, 500), (50, 1 << 20, 2000), (26, 1000, 100)])
def test_small_shards_and_blocks(spark, monkeypatch, length, chunk, size):
    """Texts cut into many pieces, groups and shards, with runs of one byte, periods and shared passages."""
    rng = np.random.default_rng(length)
    passage = "".join(rng.choice(list("abcdefgh é"), 200))
    texts = [None, "", "a" * 500, "a" * 300 + "b", "ab" * 200, "cab" * 100 + "a" * 60]
    for _ in range(40):
        a, b = sorted(rng.integers(0, 200, 2))
        texts.append("".join(rng.choice(list("abcdé "), rng.integers(0, 120))) + passage[a:b] + "".join(rng.choice(list("xyz"), 40)))
    texts += [texts[10], texts[10]]
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted_rows(suffix_dedup.remove_repeats(df, length, size, size))
    assert got == brute_removed(rows, length)


def test_pieces_cover_every_window(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 200)
    texts = [bytes(range(256)) * 3, b"", b"short", bytes(range(100))]
    seen = {}
    for raw, ends, rows, offsets in suffix_dedup.pieces(texts):
        begin = 0
        for e, r, o in zip(ends.tolist(), rows.tolist(), offsets.tolist(), strict=True):
            for q in range(begin, e - 49):
                seen.setdefault((r, o + q - begin), []).append(raw[q : q + 50].tobytes())
            begin = e
    want = {(r, q): [t[q : q + 50]] for r, t in enumerate(texts) for q in range(len(t) - 49)}
    assert seen == want


def test_odd_rows(spark):
    odd = spark.createDataFrame([*ODD, (None, "same text of a few more words here" * 3, "en", "n", "x", 1, 1), (9, "same text of a few more words here" * 3, "en", "n", "x", 1, 1)], DOCS)
    p = suffix_dedup.remove_repeats(odd, 20, with_kept=True, carry=("lang", "extra")).toPandas()
    assert len(p) == len(ODD) + 2 and set(p.columns) >= {"kept_text", "lang", "extra"}
    zero = p[p.doc_id == 0]
    assert zero.n_removed.tolist() == [0, 0] and p[p.doc_id == 1].n_removed.tolist() == [34]
    assert p[p.doc_id.isna()].n_removed.tolist() == [102] and p[p.doc_id.isna()].lang.tolist() == ["en"]
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_one_phrase_in_many_surroundings(spark):
    """10^5 different surroundings of one phrase, as many runs of a few anchors: right rows from bounded shards."""
    rng = np.random.default_rng(12)
    letters = rng.integers(97, 123, (100_000, 60), dtype=np.uint8)
    phrase = "one phrase of fifty bytes and a little more than that"
    rows = [(k, a[:30].tobytes().decode() + phrase + a[30:].tobytes().decode()) for k, a in enumerate(letters)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.remove_repeats(docs, 50, 1 << 20, 1 << 20).select("doc_id", "n_removed", "n_spans").toPandas().sort_values("doc_id")
    assert got.n_removed.tolist()[0] == 0 and (got.n_removed[1:] >= len(phrase)).all() and (got.n_spans[1:] == 1).all()
    assert got.n_removed[1:].max() <= len(phrase) + 12


def test_carried_names(spark):
    """Extra columns of the names that the operator uses itself."""
    more = {"grp": 1, "kind": 2, "body": "b", "n_bytes": 3, "kept_text": "k", "DOC_ID": 4, "key": 5, "carried_0": 6, "a.b": 7}
    df = spark.createDataFrame([(1, "some text " * 9), (2, "some text " * 9)], "id long, text string")
    df = df.select(F.col("id").alias("own"), "text", *(F.lit(v).alias(c) for c, v in more.items() if c != "DOC_ID")).withColumnRenamed("own", "doc_id")
    names = tuple(c for c in more if c != "DOC_ID")
    got = suffix_dedup.remove_repeats(df, with_kept=True, carry=names)
    assert [c for c in got.columns if c.startswith("input_")] == ["input_n_bytes", "input_kept_text"]
    row = got.where("doc_id = 2").first()
    assert (row["grp"], row["input_n_bytes"], row["input_kept_text"], row["a.b"], row["n_removed"]) == (1, 3, "k", 7, 90)


@pytest.mark.parametrize("shared", ["one passage that very many documents share", "one passage of more than fifty bytes that very many documents do share"])
def test_hot_anchor_is_dealt_over_shards(spark, shared):
    """A shared string in a different context in every document: right rows, and no shard holds most of its windows."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop "), 60))
    rows = [(k, word() + shared + word()) for k in range(600)] + [(600 + k, word()) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted_rows(suffix_dedup.remove_repeats(docs, 50, 8000, 20_000)) == brute_removed(rows)
    grouped = docs.selectExpr("doc_id", "text", "cast(doc_id % 4 as int) AS grp")
    anchors = suffix_dedup._shared_anchors(suffix_dedup._ask_anchors(grouped, 3, 50), 31)
    asked = suffix_dedup._ask_runs(grouped, anchors, 16, 50).selectExpr("shard", "length(key) / 8 AS n").groupBy("shard").sum("n").toPandas()
    assert len(asked) == 16 and asked["sum(n)"].max() < 2 * asked["sum(n)"].mean()
