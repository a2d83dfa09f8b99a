"""Rows without an id beside linked rows, in one tile."""

import numpy as np

from ledgerspark.llm import embed_dedup, simhash


def test_simhash_null_ids(spark, monkeypatch):
    """Fingerprints of one tile: null ones among pairs that are linked and ones that are not."""
    rng, rows = np.random.default_rng(4), []
    for k in range(20):
        low = [int(b) for b in rng.permutation(16)[:9]]
        fp = sum(1 << b for b in low[:8]) | sum(1 << 16 * q + int(b) for q in (1, 2, 3) for b in rng.permutation(16)[:8])
        other = fp ^ (1 << low[7]) ^ (1 << low[8])  # the same counts, two bits away
        ids = (None, None) if k % 4 == 0 else (None, 100 + k) if k % 4 == 1 else (100 + k, 200 + k)
        rows += [(i, int(np.uint64(f).view(np.int64))) for i, f in zip(ids, (fp, other), strict=True)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: docs)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long").coalesce(1))
    got = {r.fp: r.component_id for r in got.collect()}
    assert [got[f] for _, f in rows] == [x for k in range(20) for x in [None if k % 4 == 0 else 100 + k] * 2]


def test_embedding_null_ids(spark):
    rng, rows = np.random.default_rng(5), []
    for k in range(20):
        v = rng.standard_normal(64)
        ids = (None, None) if k % 4 == 0 else (None, 100 + k) if k % 4 == 1 else (100 + k, 200 + k)
        rows += [(ids[0], v.tolist()), (ids[1], (v + 0.01 * rng.standard_normal(64)).tolist())]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).collect()
    want = [(i, 1, None if k % 4 == 0 else 100 + k) for k in range(20) for i in (rows[2 * k][0], rows[2 * k + 1][0])]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(want, key=key)
