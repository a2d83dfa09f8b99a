"""The language sample takes whole texts, however long."""

import pytest

from ledgerspark.llm import langid


def test_very_long_first_text(spark):
    rows = [(1, "katze und hund " * 300_000, "de"), (2, "the cat and the dog", "en"), (3, "a bird in the hand", "en"), (4, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.fit(docs)
    want = langid.Trees.fit({"de": [rows[0][1]], "en": [rows[1][1], rows[2][1]], "fr": [""]})
    assert got.langs == want.langs == ["de", "en", "fr"]
    texts = ["die katze", "the dog", "und"]
    assert got.code_lengths(texts) == pytest.approx(want.code_lengths(texts))
    assert [r.lang_pred for r in langid.predict(docs.where("doc_id < 3").orderBy("doc_id"), got).collect()] == ["de", "en"]


def test_grams_are_bounded(spark):
    """A share of the most frequent grams for each language and depth; the texts are still told apart."""
    rows = [(k, text * 20, lang) for lang, text in (("de", "die katze und der hund "), ("en", "the cat and the dog "), ("fr", "le chat et le chien ")) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small = langid.fit(docs, max_grams=120)
    assert [len(k) for k in small.keys] <= [30, 30, 30, 30] and sum(map(len, small.keys)) <= 120
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(spark.createDataFrame([(1, "der hund", "x"), (2, "the dog", "x"), (3, "le chien", "x")], "doc_id long, text string, lang string"), small).collect()}
    assert got == {(1, "de"), (2, "en"), (3, "fr")}
    whole = langid.fit(docs)
    assert all((a == b).all() for a, b in zip(whole.keys, langid.fit(docs, max_grams=10**9).keys, strict=True))
