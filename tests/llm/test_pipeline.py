"""Each pipeline stage against its contract on its own input, and all of them in a row."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerspark.llm import queries
from ledgerspark.llm.common import read_table
from test_base_ops import brute_mix, check_pieces, n_words
from test_near_copies import brute_kept
from test_suffix_dedup import brute_removed

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input of each stage and the result of the last, as pandas frames."""
    docs, out = read_table(spark, SF, "documents"), []
    for _, f in cp.STAGES:
        out.append(docs.toPandas())
        docs = f(spark, spark.createDataFrame(out[-1]) if len(out) > 1 else docs, SF)
    return [*out, docs.toPandas()]


def test_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "packing"]
    assert all(list(s.columns) == cp.COLUMNS for s in stages[:-1])


def test_toxic_documents_go(spark, stages):
    scores = queries.op8_toxicity(spark, SF).toPandas()
    assert set(stages[1].doc_id) == set(scores[scores.predicted == 0].doc_id)
    a, b = stages[0].set_index("doc_id"), stages[1].set_index("doc_id")
    assert b.sort_index().equals(a.loc[b.index].sort_index())


def test_one_of_each_group_stays(stages):
    """Near copies share four fifths of their five-word shingles; the document of the smallest id stays."""
    assert sorted(stages[2].doc_id) == brute_kept(sorted(zip(stages[1].doc_id, stages[1].text, strict=True)))


def test_repeated_passages_go(stages):
    a, b = stages[2].sort_values("doc_id"), stages[3].sort_values("doc_id")
    want = brute_removed(list(zip(a.doc_id, a.text, strict=True)))
    assert a.doc_id.tolist() == b.doc_id.tolist() and a.source.tolist() == b.source.tolist()
    for text, w in zip(b.text, want, strict=True):
        assert w[1] - w[2] - 8 * w[3] <= len(text.encode()) <= w[1] - w[2]
    assert (b.n_chars == b.text.str.len()).all()


def test_mix_is_near_targets(stages):
    a, b = stages[3], stages[4]
    want = brute_mix(list(zip(a.source, a.text.map(n_words), strict=True)))
    got = b.assign(n=b.text.map(n_words)).groupby("source").n.sum()
    assert all(abs(got.get(s, 0) - t) <= 1 for s, t in want.items())
    texts = a.set_index("doc_id").text
    for r in b.itertuples():
        assert re.findall(r"\S+", texts[r.doc_id])[: n_words(r.text)] == re.findall(r"\S+", r.text) or n_words(r.text) == n_words(texts[r.doc_id])
    assert b.groupby("doc_id").size().max() <= 3


def test_all_is_packed(stages):
    a, p = stages[4], stages[5]
    whole = p.groupby("doc_id").length.sum()
    rows = a.groupby("doc_id").size()
    assert sorted(whole.index) == sorted(rows.index)
    once = [d for d, n in rows.items() if n == 1][:100]
    check_pieces(p[p.doc_id.isin(once)].assign(offset=0, sequence_id=range(p.doc_id.isin(once).sum())), [(d, a[a.doc_id == d].text.iloc[0]) for d in once])
    fill = p.groupby("sequence_id").length.sum()
    assert fill.max() <= 4096 and (fill == 4096).mean() > 0.9


def test_run_agrees_with_stages(spark, stages):
    got = cp.run(spark, SF)
    assert got.columns == list(stages[5].columns)
    assert got.agg(F.sum("length")).first()[0] == stages[5].length.sum()


def test_stages_take_empty_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (2, "x y", "en", "a", 3), (None, "z w", "de", "b", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, f in cp.STAGES[1:]:
            rows = f(spark, rows, SF)
            rows.collect()
    assert cp.STAGES[0][1](spark, docs, SF).count() == 4
