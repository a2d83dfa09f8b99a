"""The near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import itertools

import numpy as np
import pytest

import corpus_pipeline as cp
from ledgerspark.llm import near_copies
from ledgerspark.llm.common import read_table
from test_base_ops import brute_shingles, components, jaccard

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(rows):
    sets = [brute_shingles((t or "").lower()) for _, t in rows]
    close = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and jaccard(a, b) >= 0.8
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if close(sets[i], sets[j])]
    return sorted(rows[k][0] for k in set(components(range(len(rows)), links).values()))


def test_stage_agrees_with_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    rows = sorted(docs.select("doc_id", "text").toPandas().itertuples(index=False, name=None))
    assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).select("doc_id").collect()) == brute_kept(rows)


@pytest.mark.parametrize("tile,chunk", [(2048, 8 << 20), (2, 3000)])
def test_planted_copies(spark, tile, chunk):
    """Copies of every similarity from 0.6 to 1; large buckets and components in many chunks."""
    rng, rows = np.random.default_rng(3), []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        rows.append((10 * k, " ".join(words)))
        for c in range(4):
            near = list(words)
            for at in rng.integers(0, 150, c + 1).tolist():
                near[at] = f"n{at}"
            rows.append((10 * k + c + 1, " ".join(near)))
    df = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], SCHEMA).repartition(4)
    got = near_copies.one_of_each(df, tile=tile, chunk_bytes=chunk)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == brute_kept(rows)


def test_null_ids_and_equal_rows(spark):
    rows = [(None, f"clean text number {k} with nothing shared at all {k} {k}", "en", "a", 0) for k in range(5)]
    rows += [(None, None, None, None, None), (2, "", "en", "a", 0), (2, "x y", "en", "a", 3), (2, "x y", "en", "a", 3)]
    got = near_copies.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, r[1]) for r in rows[:5]] + [(2, ""), (2, "x y")])
    assert near_copies.one_of_each(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


@pytest.mark.parametrize("tile,chunk", [(8, 20_000), (2048, 40_000)])
def test_large_group_of_one_page(spark, tile, chunk):
    """A page with very many headers is one group; pages that share only boilerplate of it stay. A chain of near copies whose
    ends differ is one group too."""
    rng = np.random.default_rng(4)
    page = [f"b{x}" for x in rng.integers(0, 9999, 150)]
    rows = [(k, " ".join([f"head{k}", f"{k}er", *page])) for k in range(300)]
    rows += [(1000 + k, " ".join([*(f"own{k}x{i}" for i in range(60)), *page[:60]])) for k in range(100)]
    words = [f"c{x}" for x in range(200)]
    for k in range(12):
        rows.append((2000 + k, " ".join(words)))
        words[15 * k : 15 * k + 3] = [f"{x}n{k}" for x in range(3)]
    df = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], SCHEMA).repartition(6)
    got = near_copies.one_of_each(df, tile=tile, chunk_bytes=chunk)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == brute_kept(rows)


def test_tables_of_two_runs(spark):
    """Each run discards its own tables, in whatever order threads store them."""
    from concurrent.futures import ThreadPoolExecutor

    from ledgerspark.llm.common import stored
    from ledgerspark.shared import discard, noted

    def run(k):
        with noted() as paths:
            kept = [stored(spark.range(k + 1), f"run{k}") for _ in range(3)]
        discard(spark, paths[:-1])
        return len(paths), kept[-1].count()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(run, range(4))) == [(3, k + 1) for k in range(4)]


def test_calibration():
    assert near_copies.bands() == 24 and 18 <= near_copies.radius() <= 24


def test_large_buckets_are_told_apart_by_fingerprints(spark):
    """All nodes share both bands; groups of near fingerprints stay apart, and a chain of near ones holds together."""
    chain = [(1 << k) - 1 for k in range(0, 60, 3)]  # each three bits from the next
    far = [0xAAAAAAAAAAAAAAAA >> 1 ^ (1 << k) for k in range(1, 5)]
    nodes = spark.createDataFrame([(k, f, [1, 2, 3]) for k, f in enumerate(chain + far)], "node long, fp long, keys array<long>")
    got = {r.node: r.root for r in near_copies.connected_components(near_copies._candidates(nodes, 3, 4)).collect()}
    assert got == {k: 0 if k < len(chain) else len(chain) for k in range(len(chain + far))}


def test_near_copies_without_common_band(spark):
    """Pairs of similarity 0.8 (8 of 10 shingles), chosen because their minimum hashes agree in no band."""
    rows = []
    for k in (11994, 33886, 36208, 51248, 66009, 86646):
        words = [f"k{k}x{i}" for i in range(14)]
        sets = [near_copies.shingle_set(" ".join(w)) for w in (words, words[:12])]
        assert not set(near_copies.band_keys(sets[0], near_copies.bands())) & set(near_copies.band_keys(sets[1], near_copies.bands()))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:12]))]
    df = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], SCHEMA).repartition(3)
    got = near_copies.one_of_each(df)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == brute_kept(rows) == [r[0] for r in rows[::2]]


@pytest.mark.parametrize("tile,common", [(2048, 0), (2048, 400), (3, 0), (3, 400)])
def test_missed_finds_every_near_copy(spark, tile, common):
    """Without any candidates so far, all near copies of other groups are found, and hardly anything else."""
    rng = np.random.default_rng(9)
    pool, sets = rng.integers(0, 1 << 64, 4000, dtype=np.uint64), []
    for _ in range(25):
        base = rng.choice(pool, int(rng.integers(1, 90)), replace=False)
        for lost in (0, 0.02, 0.05, 0.1, 0.2, 0.4):
            some = base[rng.random(len(base)) >= lost]
            sets.append(np.unique(np.concatenate([some, rng.choice(pool, int(rng.integers(0, 4)))])))
    sets.append(np.unique(pool[:300]))
    known = np.sort(rng.choice(pool, common, replace=False))
    times = rng.integers(3, 9, common).astype(np.int32)
    label = [k // 6 if k % 12 < 3 else 1000 + k for k in range(len(sets))]
    rows = [(k, len(s), near_copies.prefix(s, known, times, 0.8).tobytes(), near_copies.parity(s)) for k, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, size long, first binary, odd binary").repartition(5)
    groups = spark.createDataFrame(list(enumerate(label)), "node long, root long")
    got = {(r.u, r.v) for r in near_copies._missed(nodes, groups, 0.8, tile).collect()}
    alike = {(i, j): len(np.intersect1d(sets[i], sets[j])) / max(1, len(np.union1d(sets[i], sets[j]))) for i, j in itertools.combinations(range(len(sets)), 2) if label[i] != label[j]}
    want = {p for p, x in alike.items() if x >= 0.8}
    assert len(want) > 50 and want <= got <= {p for p, x in alike.items() if x >= 0.6}


def test_parity_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for n in (1, 5, 64, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 8], rng.integers(0, 1 << 64, n // 5, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert 0.8 * apart - 2 <= near_copies.least_apart(near_copies.parity(a), near_copies.parity(b)) <= apart
