"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of links(a, b) reaches. Links stay distributed;
    every round is written to the checkpoint folder. Self links and repeated links do no harm; nodes without
    a link to another node are not listed. Null ends are left out."""
    edges = cut(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(edges.limit(0)).where("a <> b").distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a")
        edges = cut(
            small.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == mark:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
