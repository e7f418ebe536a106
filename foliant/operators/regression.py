"""Runs held against a golden run: how alike their rankings are, what was lost and gained for each requirement, and whether what has to be found
still is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How much weight goes on to the next rank, and ranks that are compared.
PERSISTENCE, DEPTH = 0.9, 100


def align(golden: DataFrame, run: DataFrame, key: str = "requirement_id", item: str = "item_id", p: float = PERSISTENCE, depth: int = DEPTH) -> DataFrame:
    """(key, n_golden, n_run, n_both, overlap, lost, gained) of two runs(key, item, rank): rank-biased overlap of the first depth ranks, 1 for equal lists
    and 0 for lists without a common item, and the items that only one of them has, by rank. An item counts from the depth on at which both lists
    have it, so one join of both lists gives the agreement at every depth. Of an item's ranks in a list the first counts."""
    side = lambda rows, name: rows.where(F.col("rank") <= depth).groupBy(key, item).agg(F.min("rank").alias(name))
    both = side(golden, "_a").join(side(run, "_b"), [key, item], "full_outer")
    # of the last rank that either list has for a key on, nothing changes: shorter lists are compared to their own length
    ends = both.groupBy(key).agg(F.greatest(F.max("_a"), F.max("_b")).alias("_end"))
    rows = both.join(ends, key).withColumn("_from", F.greatest("_a", "_b"))
    share = lambda begin: F.aggregate(F.sequence(begin, F.col("_end")), F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d - 1) / d)
    met = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), share(F.col("_from")))
    whole = F.aggregate(F.sequence(F.lit(1), F.first("_end").cast("int")), F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d - 1))
    only = lambda here, there: F.transform(F.array_sort(F.collect_list(F.when(F.col(there).isNull(), F.struct(here, item)))), lambda x: x[item])
    return rows.groupBy(key).agg(
        F.count("_a").alias("n_golden"), F.count("_b").alias("n_run"), F.count(met).alias("n_both"), (F.coalesce(F.sum(met), F.lit(0.0)) / whole).alias("overlap"), only("_a", "_b").alias("lost"), only("_b", "_a").alias("gained"),
    )


def passed(aligned: DataFrame, run: DataFrame, known: DataFrame, least: float = 0.5, key: str = "requirement_id", item: str = "item_id") -> DataFrame:
    """(key, overlap, missing, passed): a requirement passes if its overlap is at least least and the run has every item of known(key, item)."""
    gone = known.join(run.select(key, item), [key, item], "left_anti").groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("missing"))
    every = aligned.select(key, "overlap").join(known.select(key).distinct(), key, "full_outer").join(gone, key, "left")
    none = F.array().cast(gone.schema["missing"].dataType)
    return every.select(key, F.coalesce("overlap", F.lit(0.0)).alias("overlap"), F.coalesce("missing", none).alias("missing")).withColumn("passed", (F.col("overlap") >= least) & (F.size("missing") == 0))
