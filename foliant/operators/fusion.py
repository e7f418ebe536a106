"""Fusion of ranked lists, provenance, diversity and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(hits: DataFrame, k: int = RRF_K, depth: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, rrf_score, methods, rank) of hits(query_id, chunk_id, method, rank): the sum of
    1 / (k + rank) over a chunk's lists; ties keep the better first list, then the smaller id."""
    summed = hits.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.sort_array(F.collect_set("method")).alias("methods"), F.min("rank").alias("best_rank")
    )
    if digits is not None:
        summed = summed.withColumn("rrf_score", F.round("rrf_score", digits))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "best_rank", "chunk_id"))
    out = summed.withColumn("rank", place).drop("best_rank")
    return out if depth is None else out.where(F.col("rank") <= depth)


def min_max(value: str, by: str | list[str], flat: float) -> Column:
    """value scaled to 0..1 in its group; flat where all are equal. The two conventions of the callers, 1.0 and
    0.0, are this argument."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, F.lit(flat)).otherwise((F.col(value) - low) / (high - low))


def weighted(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, chunk_id, fused): min-max scores of each method times its weight, summed."""
    weight = F.coalesce(*[F.when(F.col("method") == m, F.lit(float(w))) for m, w in weights.items()], F.lit(0.0))
    scaled = hits.withColumn("scaled", min_max("score", ["query_id", "method"], 1.0) * weight)
    return scaled.groupBy("query_id", "chunk_id").agg(F.sum("scaled").alias("fused"))


def diversify(ranked: DataFrame, key: str, most_per_key: int, k: int, by: str = "query_id", order: str = "rank") -> DataFrame:
    """At most most_per_key of each key in a query's ranking, then the first k."""
    inner = F.row_number().over(Window.partitionBy(by, key).orderBy(order))
    outer = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return ranked.withColumn("_n", inner).where(F.col("_n") <= most_per_key).withColumn("place", outer).where(F.col("place") <= k).drop("_n")


def keep_first(rows: DataFrame, key: str | list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union_with_methods(lists: dict[str, DataFrame]) -> DataFrame:
    """(chunk_id, methods): the union of several chunk lists, each chunk once with the lists that hold it."""
    every = None
    for method, chunks in lists.items():
        part = chunks.select("chunk_id", F.lit(method).alias("method"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("chunk_id").agg(F.sort_array(F.collect_set("method")).alias("methods"))
