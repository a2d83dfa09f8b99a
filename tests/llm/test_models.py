"""Toxicity, embedding links and language identification."""

import itertools
import math
import zlib

import duckdb
import numpy as np
import pytest

from ledgerspark.llm import embed_dedup, langid, queries, toxicity
from test_base_ops import DOCS, ODD, components


@pytest.fixture(scope="module")
def big():
    return "/root/testdata/sf0.01"


def crc(d):
    return zlib.crc32(str(d).encode())


def test_toxicity_query(spark, big):
    p = queries.op8_toxicity(spark, big).toPandas()
    n = duckdb.sql(f"select count(*) from '{big}/documents.parquet'").fetchall()[0][0]
    assert len(p) == n and p.score.between(0, 1).all() and ((p.score >= 0.7) == (p.predicted == 1)).all()
    assert (p.held_out == p.doc_id.map(lambda d: crc(d) % 3 == 1)).all()
    labels = duckdb.sql(f"select * from '{big}/labels.parquet'").df()
    m = p.merge(labels, on="doc_id")
    assert ((m.predicted == m.toxic)[m.held_out]).mean() > 0.9
    again = queries.op8_toxicity(spark, big).toPandas()
    assert p.sort_values("doc_id").score.tolist() == pytest.approx(again.sort_values("doc_id").score.tolist())


def test_toxicity_learns_and_takes_odd_rows(spark):
    rows = [(i, f"plain words number {i} " + ("awfulword " if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(3, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.predict(docs, model).toPandas().itertuples()}
    assert got == {i: int(i % 4 == 0) for i in range(200)}
    odd = spark.createDataFrame(ODD, DOCS)
    p = toxicity.predict(odd, model).toPandas()
    assert len(p) == len(ODD) and p.predicted.sum() == 0 and p.score.between(0, 1).all()
    assert "extra" in toxicity.score(odd, model).columns
    none = toxicity.fit(docs, labels.where("doc_id < 0"))
    assert toxicity.predict(odd, none).toPandas().score.max() < 1e-6
    assert toxicity.predict(odd.limit(0), model).count() == 0
    long = "x " * 400_000 + "awfulword"
    assert model.score([long], model.flags())[0] == pytest.approx(model.score(["x awfulword", "x x awfulword"], model.flags())[1], abs=0.3)


def test_blocks_cover_all_ngrams(monkeypatch):
    text = "some longer text, with a few words of its own"
    whole = toxicity.features(text).tolist()
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert toxicity.features(text).tolist() == whole


def test_toxicity_against_brute_force(spark):
    """Counts, ratios, choice of features and the optimum of the regression, from strings and plain loops."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    texts = [" ".join(rng.choice(words[10 * (k % 3 == 0) :], 12)) + (" Vile Words" if k % 3 == 0 else "") for k in range(90)]
    y = [int(k % 3 == 0) for k in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, n_features=200)

    def number(gram):
        h = ord(gram[0])
        for c in gram[1:]:
            h = (h * 1_000_003 + ord(c)) % 2**64
        return ((h ^ len(gram)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS)

    norm = [f" {' '.join(t.lower().split())} " for t in texts]
    sets = [{number(t[i : i + n]) for n in toxicity.LENGTHS for i in range(len(t) - n + 1)} for t in norm]
    count = {}
    for s, label in zip(sets, y, strict=True):
        for f in s:
            count.setdefault(f, [0, 0])[label] += 1
    pos, neg = sum(y), len(y) - sum(y)
    ratio = {f: math.log((p + 1) / (pos + 2)) - math.log((q + 1) / (neg + 2)) for f, (q, p) in count.items() if p + q >= 4}
    strength = {f: abs(r) / math.sqrt(1 / (count[f][1] + 1) + 1 / (count[f][0] + 1)) for f, r in ratio.items()}
    best = sorted(ratio, key=lambda f: (-strength[f], f))[:200]
    least = strength[best[-1]]
    assert {f for f in best if strength[f] > least + 1e-9} <= set(m.keep.tolist()) <= {f for f in ratio if strength[f] >= least - 1e-9}
    x = np.array([[ratio[f] * (f in s) for f in m.keep.tolist()] for s in sets])
    scale = np.array([ratio[f] for f in m.keep.tolist()])
    w = m.weight / scale
    z = x @ w + m.bias
    off = 1 / (1 + np.exp(-z)) - np.array(y)
    assert np.abs(x.T @ off + 0.01 * w).max() < 0.05 and abs(off.sum()) < 0.05
    assert m.score(texts, m.flags()) == pytest.approx(1 / (1 + np.exp(-z)))


def test_calibrated_count():
    half, need = embed_dedup.calibrated(48, 0.9, 1.5, 0.9999)
    p = math.erf(1.5 / math.sqrt(2))
    missed = sum(math.comb(48, k) * p**k * (1 - p) ** (48 - k) for k in range(need))
    assert missed <= 1e-4 < missed + math.comb(48, need) * p**need * (1 - p) ** (48 - need)
    assert half == pytest.approx(1.5 * math.sqrt(0.2))


def brute_vectors(rows, cosine=0.9):
    ok = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v):
            ok[i] = embed_dedup.unit(np.array([v], dtype=float))[0]
    pairs = [(i, j) for i, j in itertools.combinations(ok, 2) if len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine]
    n = {i: sum(i in p for p in pairs) for i in range(len(rows))}
    comp = components([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in pairs])
    return [(r[0], n[i], comp[r[0]], comp[r[0]] == r[0]) for i, r in enumerate(rows)]


def test_embedding_query(spark, big):
    rows = [(int(i), list(v)) for i, v in duckdb.sql(f"select vec_id, embedding from '{big}/embeddings.parquet'").fetchall()]
    got = queries.op9_embeddings(spark, big).toPandas().sort_values("vec_id")
    assert list(got.itertuples(index=False, name=None)) == sorted(brute_vectors(rows))


@pytest.mark.parametrize("tile", [4, 50, 1024])
def test_embedding_tiles_and_odd_rows(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((25, 16))
    near = np.repeat(base, 6, axis=0) + rng.standard_normal((150, 16)) * rng.choice([0.02, 0.2, 0.35], (150, 1))
    vecs = [*near.tolist(), *(near[:5] * 3).tolist(), near[0].tolist(), None, [], [0.0] * 16, [1.0, None], [math.nan] * 16, [math.inf] * 16, [1e300] * 16, [1e-300] * 16, [1.0, 2.0], [1.0, 2.01]]
    rows = [(i, v) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embed_dedup.near_duplicates(df, tile=tile).toPandas().sort_values("vec_id")
    assert list(got.itertuples(index=False, name=None)) == brute_vectors(rows)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_over_tables(spark):
    """Pairs just above the threshold, by cells of several tables: recall against brute force, and no pair below it."""
    rng, d, n = np.random.default_rng(8), 64, 3000
    base = embed_dedup.unit(rng.standard_normal((n, d)))
    side = embed_dedup.unit((s := rng.standard_normal((n, d))) - (s * base).sum(1, keepdims=True) * base)
    c = rng.uniform(0.9, 0.93, (n, 1))
    vecs = np.concatenate([base, c * base + np.sqrt(1 - c * c) * side])
    u = embed_dedup.unit(vecs)
    want = np.array([((u[k] @ u.T) >= 0.9).sum() - 1 for k in range(0, 2 * n, 20)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs.tolist())], "vec_id long, embedding array<double>")
    plan = embed_dedup.planned(100_000, 0.9, 0.98)
    assert plan.k > 4 and plan.tables > 4
    got = embed_dedup.near_duplicates(df, plan=plan, tile=100).where("vec_id % 20 = 0").toPandas().sort_values("vec_id").n_links.to_numpy()
    assert (got <= want).all() and 0.95 <= got.sum() / want.sum()


def test_embedding_query_recall(spark, tmp_path):
    """The query over several tables of cells (more vectors than one cell takes), with planted pairs of cosine 0.9 to 0.95:
    recall of the rows divisible by 20 against all rows, and no link too many."""
    rng, d, n, pairs = np.random.default_rng(20), 64, 16_000, 4_000
    base = embed_dedup.unit(rng.standard_normal((n, d)))
    side = embed_dedup.unit((s := rng.standard_normal((pairs, d))) - (s * base[:pairs]).sum(1, keepdims=True) * base[:pairs])
    c = rng.uniform(0.9, 0.95, (pairs, 1))
    vecs = np.concatenate([base, c * base[:pairs] + np.sqrt(1 - c * c) * side])[rng.permutation(n + pairs)]
    u = embed_dedup.unit(vecs)
    want = {k: int(((u[k] @ u.T) >= 0.9).sum() - 1) for k in range(0, n + pairs, 20)}
    assert embed_dedup.planned(n + pairs, 0.9, 0.98).tables > 1
    spark.createDataFrame([(i, v) for i, v in enumerate(vecs.tolist())], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in queries.op9_embeddings(spark, str(tmp_path)).where("vec_id % 20 = 0").collect()}
    assert got.keys() == want.keys() and all(got[k] <= want[k] for k in want)
    recall = sum(got.values()) / sum(want.values())
    print(f"recall {recall:.4f} of {sum(want.values())} links")
    assert recall >= 0.95


def test_links_do_not_depend_on_the_number_of_rows(spark):
    """Pairs at the threshold among 400 vectors, alone and beside 12,000 others that link with nothing: the same rows."""
    rng, d, n, more = np.random.default_rng(21), 64, 200, 12_000
    base = embed_dedup.unit(rng.standard_normal((n, d)))
    side = embed_dedup.unit((s := rng.standard_normal((n, d))) - (s * base).sum(1, keepdims=True) * base)
    c = rng.uniform(0.9001, 0.903, (n, 1))
    vecs = [*base.tolist(), *(c * base + np.sqrt(1 - c * c) * side).tolist(), *rng.standard_normal((more, d)).tolist()]
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    few, many = (sorted(embed_dedup.near_duplicates(x).where(f"vec_id < {2 * n}").collect()) for x in (df.where(f"vec_id < {2 * n}"), df))
    assert few == many and {r.n_links for r in few} == {1}


def test_each_pair_counts_once(spark):
    """A dense group shares cells of many tables; link counts are still those of brute force."""
    rng = np.random.default_rng(9)
    vecs = rng.standard_normal((1, 32)) + 0.02 * rng.standard_normal((300, 32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs.tolist())], "vec_id long, embedding array<double>")
    got = embed_dedup.near_duplicates(df, plan=embed_dedup.Plan(2.0, 6, 20), tile=64).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(299, 0)}


def test_planned_work_grows_less_than_pairs():
    q = lambda n: (p := embed_dedup.planned(n, 0.9, 0.98), p.tables * (n * embed_dedup.ROW + embed_dedup.same_cell(p.width / math.sqrt(2)) ** p.k * n * n / 2))[1]
    assert math.log(q(10**8) / q(10**6)) / math.log(100) < 1.35


def brute_cost(train, order, text):
    """Code length by dictionaries: method C escapes, no exclusions."""
    counts = {}
    for t in train:
        raw = langid.PAD * order + t.encode()
        for p in range(order, len(raw)):
            for d in range(order + 1):
                counts.setdefault(raw[p - d : p], {}).setdefault(raw[p], 0)
                counts[raw[p - d : p]][raw[p]] += 1
    raw, bits = langid.PAD * order + text.encode(), 0.0
    for p in range(order, len(raw)):
        for d in range(order, -2, -1):
            seen = counts.get(raw[p - d : p], {}) if d >= 0 else None
            if seen is None:
                bits += 8
            elif seen:
                total, kinds = sum(seen.values()), len(seen)
                if raw[p] in seen:
                    bits -= math.log2(seen[raw[p]] / (total + kinds))
                    break
                bits -= math.log2(kinds / (total + kinds))
    return bits


def test_code_lengths_are_exact():
    samples = {"x": ["the cat sat", "the hat\nthe"], "y": ["die katze", "der hüt", "das"], "z": ["q"]}
    texts = ["the katze", "üüü", "", "zz top", "das\n\n\nthe"]
    for order in (0, 1, 2, 3):
        got = langid.Trees.fit(samples, order).code_lengths(texts)
        want = [[brute_cost(samples[k], order, t) for k in sorted(samples)] for t in texts]
        assert got == pytest.approx(np.array(want), rel=1e-4, abs=1e-3)


def test_language_query(spark, big):
    p = queries.op10_language(spark, big).toPandas()
    docs = duckdb.sql(f"select doc_id, text, lang from '{big}/documents.parquet'").df()
    m = p.merge(docs, on="doc_id")
    assert len(p) == len(docs) and p.score.between(0, 1).all()
    assert (p.held_out == p.doc_id.map(lambda d: crc(d) % 5 == 0)).all()
    assert (m.lang_pred == m.lang)[m.held_out].mean() > 0.95


def test_language_odd_rows(spark):
    odd = spark.createDataFrame([*ODD, (8, "12 34 !!", "en", "a", "x", 1, 1)], DOCS)
    p = langid.predict(odd, langid.fit(odd)).toPandas()
    assert len(p) == len(ODD) + 1
    assert set(p[p.doc_id.isin([4, 5, 7, 8])].lang_pred) == {"und"}
    assert p[p.doc_id == 2].lang_pred.tolist() == ["de"]
    assert langid.predict(odd, langid.fit(odd.limit(0))).toPandas().lang_pred.unique().tolist() == ["und"]
    assert langid.predict(odd.limit(0), langid.fit(odd)).count() == 0
