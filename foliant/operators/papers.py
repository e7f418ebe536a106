"""From chunk hits to documents: scores per query, and selection with a guarantee for every requirement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.fusion import min_max


# The weights and limits of the classes below.
@dataclass(frozen=True)
class QueryWeights:
    strongest: float = 0.50
    mean_top: float = 0.20
    support: float = 0.10
    sections: float = 0.10
    methods: float = 0.10


@dataclass(frozen=True)
class PaperWeights:
    strongest: float = 0.40
    coverage: float = 0.25
    mean: float = 0.20
    diversity: float = 0.10
    agreement: float = 0.05
    bridge: float = 0.05


def score_per_query(fused: DataFrame, w: QueryWeights = QueryWeights()) -> DataFrame:
    """(query_id, paper_id, score, ...) of fused(query_id, paper_id, chunk_id, rrf_score, section, node_type,
    methods). Strongest, mean of the three best (always divided by 3) and support are min-max scaled within the
    query, equal values to 1."""
    place = F.row_number().over(Window.partitionBy("query_id", "paper_id").orderBy(F.desc("rrf_score"), "chunk_id"))
    ranked = fused.withColumn("_n", place)
    raw = ranked.groupBy("query_id", "paper_id").agg(
        F.max("rrf_score").alias("strongest"),
        (F.coalesce(F.sum(F.when(F.col("_n") <= 3, F.col("rrf_score"))), F.lit(0.0)) / 3).alias("mean_top"),
        F.count("*").alias("support"),
        (F.countDistinct("section") / F.count("*")).alias("section_diversity"),
        F.collect_set(F.array_join("methods", ",")).alias("_m"),
        F.countDistinct("node_type").alias("n_types"),
        F.countDistinct("section").alias("n_sections"),
    )
    raw = raw.withColumn("method_agreement", F.size(F.array_distinct(F.flatten(F.transform("_m", lambda m: F.split(m, ","))))) / 2).drop("_m")
    scaled = raw.withColumns({f"{c}_scaled": min_max(c, "query_id", 1.0) for c in ("strongest", "mean_top", "support")})
    total = (
        w.strongest * F.col("strongest_scaled") + w.mean_top * F.col("mean_top_scaled") + w.support * F.col("support_scaled")
        + w.sections * F.col("section_diversity") + w.methods * F.col("method_agreement")
    )
    return scaled.withColumn("score", total)


def select(scores: DataFrame, bridge: DataFrame, w: PaperWeights = PaperWeights(), shortlist: int = 5, presence: float = 0.20, top: int = 12, guarantee: int = 2) -> DataFrame:
    """The papers of a question: (paper_id, score, requirements, place, guaranteed) of scores(query_id, paper_id,
    score, n_types, n_sections, method_agreement) and bridge(query_id, requirement_id). A requirement counts as
    supported by a paper that reaches presence in it or is in its shortlist."""
    n_requirements = bridge.select("requirement_id").distinct().agg(F.count("*").alias("n_req"))
    best = scores.join(F.broadcast(bridge), "query_id").groupBy("requirement_id", "paper_id").agg(
        F.max("score").alias("raw"), F.max("n_types").alias("n_types"), F.max("n_sections").alias("n_sections"), F.max("method_agreement").alias("agreement")
    )
    scaled = best.withColumn("norm", min_max("raw", "requirement_id", 0.0))
    place = F.row_number().over(Window.partitionBy("requirement_id").orderBy(F.desc("norm"), F.desc("raw"), "paper_id"))
    scaled = scaled.withColumn("place", place)
    supported = (F.col("norm") >= presence) | (F.col("place") <= shortlist)
    papers = scaled.groupBy("paper_id").agg(
        F.max("norm").alias("strongest"), F.sum(F.when(supported, 1).otherwise(0)).alias("n_supported"), F.sum("norm").alias("_sum"),
        F.max("n_types").alias("n_types"), F.max("n_sections").alias("n_sections"), F.max("agreement").alias("agreement"),
        F.sort_array(F.collect_set(F.when(supported, F.col("requirement_id")))).alias("requirements"),
        F.max(F.when(F.col("place") <= guarantee, 1).otherwise(0)).alias("guaranteed"),
    )
    diversity = 0.5 * F.least(F.lit(1.0), F.col("n_types") / 5) + 0.5 * F.least(F.lit(1.0), F.col("n_sections") / 5)
    total = (
        w.strongest * F.col("strongest") + w.coverage * F.col("n_supported") / F.col("n_req") + w.mean * F.col("_sum") / F.col("n_req") + w.diversity * diversity
        + w.agreement * F.col("agreement") + w.bridge * F.greatest(F.col("n_supported") - 1, F.lit(0))
    )
    scored = papers.join(F.broadcast(n_requirements)).withColumn("score", total)
    # only the best few and the guaranteed ones can be selected: a global rank, by ordered limit
    chosen = scored.orderBy(F.desc("score"), "paper_id").limit(top).unionByName(scored.where("guaranteed = 1")).dropDuplicates(["paper_id"])
    return chosen.select("paper_id", "score", "requirements", (F.col("guaranteed") == 1).alias("guaranteed"))
