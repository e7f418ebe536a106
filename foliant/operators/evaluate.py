"""Retrieval metrics and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import STOP_WORDS, first_words, tokens


def recall_at(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...], key: str = "query_id", item: str = "item_id") -> DataFrame:
    """(query_id, recall_k ..., rr) of ranked(query_id, item_id, rank) and relevant(query_id, item_id): shares of the
    relevant items among the first k, and the reciprocal rank of the first of them; 0 where none is relevant."""
    sizes = relevant.distinct().groupBy(key).agg(F.count("*").alias("_n"))
    hits = ranked.join(relevant.distinct(), [key, item], "left_semi").groupBy(key).agg(*[F.count_if(F.col("rank") <= k).alias(f"_h{k}") for k in ks], F.min("rank").alias("_first"))
    every = ranked.select(key).unionByName(relevant.select(key)).distinct()
    out = every.join(sizes, key, "left").join(hits, key, "left")
    zero = F.lit(0.0)
    return out.select(key, *[F.coalesce(F.col(f"_h{k}") / F.col("_n"), zero).alias(f"recall_{k}") for k in ks], F.coalesce(1.0 / F.col("_first"), zero).alias("rr"))


def roll_up(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means that leave nulls out, by every combination of the keys and over all."""
    return rows.cube(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows that depend on the seed and their keys only."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def top_keywords(rows: DataFrame, key: str, text: str, n: int, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(key, word, n, place): the n most frequent words of 3 letters and more; ties to the first in the text."""
    words = rows.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "word")).where((F.length("word") > 2) & ~F.col("word").isin(*stop))
    counts = words.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    return counts.withColumn("place", place).where(F.col("place") <= n).drop("first")


def self_queries(chunks: DataFrame, title: Column, words: int = 60, lead: int = 40) -> DataFrame:
    """(chunk_id, kind, query): a chunk's own words, and its title with its first words, as queries for it."""
    shown = chunks.select("chunk_id", first_words(F.col("text"), words).alias("v"), F.concat_ws(" ", title, first_words(F.col("text"), lead)).alias("t"))
    return shown.selectExpr("chunk_id", "stack(2, 'verbatim', v, 'title', t) as (kind, query)")
