"""The registered queries of this package and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, embed_dedup, fingerprints, langid, mixing, packing, repair, sharding, simhash, suffix_dedup, templates, toxicity
from .common import read_table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as transcripts without roles; roles are learned from four of five conversations."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("part"), "text", "role")
    out = chat_format.format_transcripts(turns, chat_format.fit(turns.where(~langid.held_out("conv_id"))))
    return out.withColumn("held_out", langid.held_out("conv_id"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with their texts, in 16 shards, counts at most one apart; sizes and checksums follow from what arrives."""
    out = sharding.shuffle_into_shards(read_table(spark, sf_dir, "documents"), "doc_id", 16, tie=[F.xxhash64("text")])
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_pairs(read_table(spark, sf_dir, "documents"))
    near = lambda c: fingerprints.resemblance(F.col("sketch"), F.col(c))
    text = lambda c: fingerprints.as_text(F.col(c))
    return out.select("doc_id", "n_chars", "edited_sha256", text("sketch").alias("fingerprint"), text("edited_sketch").alias("edited_fingerprint"), near("edited_sketch").alias("near_edited"), near("next_sketch").alias("near_next"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.predict(docs, toxicity.fit(docs, labels))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, trees).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(read_table(spark, sf_dir, "pages"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(read_table(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_sharding": op3_sharding,
    "op4_fingerprints": op4_fingerprints,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_embeddings": op9_embeddings,
    "op10_language": op10_language,
    "op11_html_text": op11_html_text,
    "op12_repair": op12_repair,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {"op7_mixing": mixing.mixing_sql(), "op13_collocations": collocations.collocations_sql()}
