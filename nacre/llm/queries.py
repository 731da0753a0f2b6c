"""The queries opN_<name> over whole tables: thin views of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lines, minhash, mixing, packing, quality, rules, shards, sql, substrings, vectors
from .common import held_out, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    out = quality.classify(docs, labels)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shards.arrive_and_compact(table(spark, sf_dir, "documents"), shards.shared_root(spark, "shards"))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100).drop("text_hash")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang").where(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_vectors": op3_vectors,
    "op4_rules": op4_rules,
    "op5_lines": op5_lines,
    "op6_sharding": op6_sharding,
    "op7_minhash": op7_minhash,
    "op8_mixing": op8_mixing,
    "op9_language": op9_language,
    "op10_substrings": op10_substrings,
}

SQL: dict[str, str] = {"op3_vectors": sql.OP3, "op4_rules": sql.OP4, "op5_lines": sql.OP5, "op6_sharding": sql.OP6, "op7_minhash": sql.OP7, "op8_mixing": sql.OP8, "op10_substrings": sql.OP10}
