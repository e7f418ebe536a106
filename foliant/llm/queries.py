"""The queries of this subpackage: one per operator, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bitplanes, decontaminate, jaccard, language, pack, pagetext, prefixtrie, secrets, sharding, substrings, toxicity, vectors, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_words")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.digest(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.digest(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.digest(table(spark, sf_dir, "embeddings"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(table(spark, sf_dir, "embeddings"))


def op12_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.digest(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.digest(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language,
        "op2_decontaminate": op2_decontaminate,
        "op3_sharding": op3_sharding,
        "op4_secrets": op4_secrets,
        "op5_toxicity": op5_toxicity,
        "op6_page_text": op6_page_text,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_neighbours": op9_neighbours,
        "op10_pack": op10_pack,
        "op11_whitening": op11_whitening,
        "op12_bit_planes": op12_bit_planes,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.SQL,
        "op3_sharding": sharding.SQL,
        "op4_secrets": secrets.SQL,
        "op7_substring_dedup": substrings.SQL,
        "op8_jaccard_join": jaccard.SQL,
        "op13_prefix_trie": prefixtrie.SQL,
    }
