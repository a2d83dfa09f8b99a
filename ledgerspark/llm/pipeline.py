"""Corpus pipeline: toxic documents out, one of each near-duplicate group, repeated passages out, mix, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``
(``COLUMNS``). Further columns of the input, whatever their names, are left out, and a missing one of these is null.
Each stage works on all rows its predecessor kept. No SQL form: the toxicity model, SimHash and sum-of-squares packing
have none, so stages are tested against brute-force versions.

Null and blank texts are copies of each other for the second stage; null ids are kept apart by their texts; documents of
which the mix takes nothing go; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.shared import discard, noted

from . import mixing, near_copies, packing, suffix_dedup, toxicity
from .common import read_table, stored
from .queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    there = {c.lower() for c in docs.columns}
    kind = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*(F.col(c) if c in there else F.lit(None).cast(kind.get(c, "string")).alias(c) for c in COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7; it learns from the same labels as its query."""
    labels = read_table(spark, sf_dir, "labels").where(~toxicity.held_out())
    docs = _documents(docs)
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model).where("score < 0.7").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard similarity 0.8), the one of smallest id."""
    return near_copies.one_of_each(_documents(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings of earlier documents. Bytes of a character cut in two go with the cut.

    No document goes, even if nothing is left of its text.
    """
    out = suffix_dedup.remove_repeats(_documents(docs), with_kept=True, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken in part is cut to its first words."""
    out = mixing.mixed(_documents(docs))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4,096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back in the shared folder; what a stage has stored on its way
    goes once its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with noted() as paths:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, paths[:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
