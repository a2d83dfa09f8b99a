"""Very long texts, whole, beside short ones: each operator's result against a plain count or its short equivalent."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import chat_format, collocations, mixing, near_copies, packing, queries, simhash, toxicity

WORDS = 400_000
LONG = " ".join(f"w{k % 9973}" for k in range(WORDS))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en", "a"), (2, LONG + " end", "en", "a"), (3, "a short text of few words", "en", "b"), (4, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))


def test_fingerprints_and_near_copies(docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert int(got[1].fingerprint, 16) == simhash.simhash(LONG) and got[1].component_id == got[2].component_id == 1
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).select("doc_id").collect()) == [1, 3, 4]


def test_packing_and_mixing(docs):
    pieces = packing.pack(docs.where("doc_id <> 2"), queries.tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"), F.max("length").alias("most")).collect()
    assert all(r.n == r.t and r.most <= 4096 for r in pieces) and next(r.n for r in pieces if r.doc_id == 1) > WORDS
    taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert taken[1]["size"] == WORDS and taken[2]["size"] == WORDS + 1
    words = mixing.mixed(docs).select("doc_id", F.size(F.split("text", " ")).alias("n")).where("doc_id < 3").groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert {r.doc_id: r.n for r in words} == {k: taken[k].taken for k in (1, 2)}


def test_toxicity_sees_the_end(spark):
    """The only toxic words come last."""
    clean, toxic = "all is well and kind in this place ", "vilest grumbling hateslop "
    rows = [(k, clean * (k % 3 + 1) + f"n{k}", 0) for k in range(60)] + [(100 + k, clean + toxic * 2 + f"n{k}", 1) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    texts = spark.createDataFrame([(1, clean * 60_000), (2, clean * 60_000 + toxic)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.predict(texts, model).collect()}
    assert got[2] > got[1]


def test_transcript_and_phrases(spark, docs):
    turns = spark.createDataFrame([(c, t, ("hello there", "general answer here")[t % 2], ("user", "assistant")[t % 2]) for c in range(9) for t in range(6)], "conv_id long, part long, text string, role string")
    talk = "\n\n".join(f"User: question {k}\n\nAssistant: answer {k}" for k in range(30_000))
    got = chat_format.format_transcripts(spark.createDataFrame([(1, 0, talk)], "conv_id long, part long, text string"), chat_format.fit(turns))
    assert got.count() == 60_000 and {r.role: r["count"] for r in got.groupBy("role").count().collect()} == {"user": 30_000, "assistant": 30_000}
    phrases = collocations.collocations(docs.select("lang", "text").where("doc_id = 1"), min_count=40, top=100_000)
    assert phrases.agg(F.max("n")).first()[0] == WORDS and phrases.where("a < 40").count() == 0
