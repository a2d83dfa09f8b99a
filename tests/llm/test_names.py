"""Every operator on a table whose other columns have the names that operators use themselves, with null and repeated ids."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerspark.llm import chat_format, embed_dedup, fingerprints, langid, mixing, near_copies, packing, queries, sharding, simhash, suffix_dedup, toxicity

NAMES = """part _part first after rank key tie row grp kind body bucket anchors n_bytes kept_text size cell start rest whole target taken
source_size ord own copy words place w cap full score fp fingerprint component_id root node least n chunk step shard slot dim
code unit digest held_out predicted lang_pred y p q seq made count a.b `tick`""".split()
TEXTS = [
    (1, "one two three four five six seven eight nine ten " * 3, "en", "a"),
    (1, "one two three four five six seven eight nine ten " * 3, "en", "a"),
    (1, "another text of the same id with nothing in common at all", "en", "b"),
    (None, "no id and words of its own kind which nobody else has used", "de", None),
    (None, "no id either but quite other words that make up this text", "de", "a"),
    (None, None, None, None),
    (7, "", "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    return df.select("*", F.length("text").cast("long").alias("n_chars"), *(F.lit(f"x{k}").alias(c) for k, c in enumerate(NAMES)))


def kept_columns(df, docs, but=()):
    rows = df.collect()
    assert all(r[c] == f"x{k}" for k, c in enumerate(NAMES) if c not in but for r in rows)
    return rows


def test_sharding(docs):
    rows = kept_columns(sharding.shuffle_into_shards(docs, "doc_id", 3, tie=[F.xxhash64("text")]), docs, ("shard", "slot"))
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert sorted(str(r["text"]) for r in rows) == sorted(str(t[1]) for t in TEXTS)


def test_mixing(docs):
    rows = kept_columns(mixing.mixed(docs), docs)
    assert rows and {r["text"] for r in rows} <= {t[1] for t in TEXTS} | {r["text"] for r in rows if any(t[1] and t[1].startswith(r["text"].split()[0]) for t in TEXTS)}
    assert mixing.mix(docs).count() == len(TEXTS)


def test_suffix_dedup(docs):
    out = suffix_dedup.remove_repeats(docs, with_kept=True, carry=tuple(NAMES))
    assert len(out.collect()) == len(TEXTS) and {"input_n_bytes", "input_kept_text"} <= set(out.columns)


def test_near_copies_lose_no_other_text(docs):
    rows = kept_columns(near_copies.one_of_each(docs), docs)
    assert sorted(str(r["text"]) for r in rows) == sorted({str(t[1] or "") if t[0] == 7 else str(t[1]) for t in TEXTS if t[1] is not None})


def test_other_operators(spark, docs):
    n = len(TEXTS)
    assert simhash.near_duplicates(docs).count() == n
    assert fingerprints.fingerprint_pairs(docs).count() == n
    assert packing.pack(docs, queries.tokenizer_path()).count() >= n
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, toxic int").withColumn("text", F.lit("t")).withColumn("y", F.lit("z"))
    model = toxicity.fit(docs, labels)
    assert toxicity.predict(docs, model).count() == n
    kept_columns(toxicity.score(docs, model), docs, ("score",))
    assert langid.predict(docs, langid.fit(docs)).count() == n
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.length("text") * 1.0).alias("embedding"), *map(lambda c: F.col("`" + c.replace("`", "``") + "`"), NAMES))
    assert embed_dedup.near_duplicates(vectors).count() == n
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit("user").alias("role"), "text", F.lit(0).alias("block"), F.lit(1).alias("line"), *(F.col("`" + c.replace("`", "``") + "`") for c in NAMES if c != "part"), F.lit(1).alias("part"))
    assert chat_format.format_transcripts(turns, chat_format.fit(turns)).count() >= 2


def test_pipeline_stages(spark, docs):
    rows = docs.drop("n_chars")
    for k, (_, f) in enumerate(cp.STAGES[1:]):
        rows = f(spark, rows, "")
        assert k == 3 or rows.columns == cp.COLUMNS
        rows.collect()


@pytest.mark.parametrize("text", ["word " * 300_000, "x" * 1_500_000])
def test_very_long_text(spark, text):
    df = spark.createDataFrame([(1, text, "en", "a"), (2, "short one", "en", "a")], "doc_id long, text string, lang string, source string")
    assert sharding.shuffle_into_shards(df, "doc_id", 2).where("length(text) > 1000000").count() == 1
    assert fingerprints.fingerprint_pairs(df).count() == 2 and simhash.near_duplicates(df).count() == 2
    assert langid.predict(df, langid.fit(df)).where("lang_pred = 'en'").count() == 2
    assert suffix_dedup.remove_repeats(df).where("n_bytes > 1000000 AND n_removed = 0").count() == 1
