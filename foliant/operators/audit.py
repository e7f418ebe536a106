"""Audits of ids and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import vector


def orphans(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """(side, id): ids that only one side has."""
    one = left.join(right, key, "left_anti").select(F.lit(left_name).alias("side"), F.col(key).alias("id"))
    return one.unionByName(right.join(left, key, "left_anti").select(F.lit(right_name).alias("side"), F.col(key).alias("id")))


def id_set_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of counts, from one aggregation of both id columns."""
    sides = left.select(F.col(key).alias("id"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(key).alias("id"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    ids = sides.groupBy("id").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return ids.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("r"), F.lit(0)).alias("n_right"), F.count_if(F.col("r") == 0).alias("only_left"),
        F.count_if(F.col("l") == 0).alias("only_right"), F.count_if(F.col("r") > 1).alias("duplicated_right"),
    )


def vector_audit(vectors: DataFrame, column: str, dimension: int, by: str) -> DataFrame:
    v = F.col(column)
    return vectors.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(F.size(v) != dimension).alias("wrong_dimension"), F.count_if(~vector.finite(v)).alias("not_finite"),
        F.min(F.round(vector.norm(v), 4)).alias("least_norm"),
    )


def report(diagnostics: DataFrame) -> DataFrame:
    """Counts by severity; passed means that no row is an ERROR."""
    return diagnostics.agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("ERROR", "WARNING", "INFO")], (F.count_if(F.col("severity") == "ERROR") == 0).alias("passed")
    )
