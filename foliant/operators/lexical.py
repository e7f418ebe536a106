"""BM25 over an inverted index of DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import TOKEN, tokens

# The usual parameters.
K1, B = 1.5, 0.75


@dataclass
class LexicalIndex:
    """postings(term, chunk_id, dl, tf), words (chunk_id, dl, words; none in a loaded index), and the corpus' size and mean
    length. A posting carries its chunk's length, so that scoring joins nothing but the queries' terms."""

    postings: DataFrame
    docs: DataFrame
    stats: DataFrame
    min_df: int = 1
    words: DataFrame | None = None

    @property
    def terms(self) -> DataFrame:
        """(term, df, idf). Counted from each chunk's distinct words where they are at hand: one shuffle of partial counts
        by term, not one of all postings."""
        if self.words is None:
            return self.weigh(self.postings)
        return self._idf(self.words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))

    def weigh(self, postings: DataFrame) -> DataFrame:
        """(term, df, idf) of the terms in postings, which must hold them whole."""
        return self._idf(postings.groupBy("term").agg(F.count("*").alias("df")))

    def _idf(self, counts: DataFrame) -> DataFrame:
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) + 1
        return counts.where(F.col("df") >= self.min_df).join(F.broadcast(self.stats.select("n"))).withColumn("idf", idf).drop("n")

    @property
    def n_total(self) -> int:
        return self.stats.first()["n"]

    def save(self, path: str) -> None:
        """Writes postings sorted by term, so that a search reads only the row groups of its terms, lengths and numbers."""
        self.postings.repartition("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.stats.withColumn("min_df", F.lit(self.min_df)).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> LexicalIndex:
    """The index at path; one whose lengths are not as many as its size says is refused."""
    stats = spark.read.parquet(f"{path}/stats")
    docs = spark.read.parquet(f"{path}/docs")
    row, held = stats.first(), docs.count()
    if row["n"] != held:
        raise ValueError(f"the index at {path} has {held} lengths for {row['n']} chunks")
    return LexicalIndex(spark.read.parquet(f"{path}/postings"), docs, stats.drop("min_df"), row["min_df"])


def build(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", pattern: str = TOKEN, min_df: int = 1) -> LexicalIndex:
    """idf is ln((N - df + 0.5) / (df + 0.5)) + 1; lengths count all tokens, also those below min_df."""
    words = chunks.select(F.col(id_col).alias("chunk_id"), tokens(F.col(text_col), pattern).alias("words"))
    words = words.select("chunk_id", F.size("words").cast("long").alias("dl"), "words")
    docs = words.select("chunk_id", "dl")
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    postings = words.select("chunk_id", "dl", F.explode("words").alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    return LexicalIndex(postings, docs, stats, min_df, words)


def _wanted(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def score(index: LexicalIndex, queries: DataFrame, k1: float = K1, b: float = B, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of queries(query_id, text), the sum over a query's distinct terms; with scope
    (query_id, chunk_id) only inside it, by the statistics of the whole corpus."""
    wanted = _wanted(queries)
    # only the queries' terms are counted: the semi join sinks below the aggregation of postings
    postings = index.postings.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
    weights = index.weigh(postings).join(F.broadcast(index.stats.select("avgdl")))
    hits = postings.join(F.broadcast(wanted), "term").join(F.broadcast(weights), "term")
    if scope is not None:
        hits = hits.join(scope, ["query_id", "chunk_id"], "left_semi")
    length = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(F.lit(1.0))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, order: str = "score", key: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The k best of each key with their rank from 1; ties go to the smaller id."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), tie))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


def _unscored(index: LexicalIndex, queries: DataFrame, scores: DataFrame, k: int, scope: DataFrame | None) -> DataFrame:
    """For each query with less than k positive scores, the k chunks of the smallest ids without a score, as score 0. The
    few queries meet each chunk where it is read, and each partition passes on k ids a query at most."""
    filled = scores.where("score > 0").groupBy("query_id").count().where(F.col("count") >= k)
    short = queries.select("query_id", "text").join(F.broadcast(filled), "query_id", "left_anti")
    if scope is not None:
        free = scope.select("query_id", "chunk_id").join(F.broadcast(short.select("query_id")), "query_id", "left_semi").join(scores, ["query_id", "chunk_id"], "left_anti")
    elif index.words is not None and index.min_df <= 1:
        asked = short.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("asked"))
        free = index.words.join(F.broadcast(asked)).where(~F.arrays_overlap("words", "asked"))
    else:
        free = index.docs.join(F.broadcast(short.select("query_id"))).join(scores, ["query_id", "chunk_id"], "left_anti")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    return free.select("query_id", "chunk_id").withColumn("n", first).where(F.col("n") <= k).select("query_id", "chunk_id", F.lit(0.0).alias("score"))


def search(index: LexicalIndex, queries: DataFrame, k: int, zero_fill: bool = True, scope: DataFrame | None = None, digits: int | None = None, **options) -> DataFrame:
    """(query_id, chunk_id, score, rank). With zero_fill, chunks without a common term fill up to k with score 0,
    above negative scores; the smaller id first."""
    scores = score(index, queries, scope=scope, **options)
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    if zero_fill:
        scores = scores.unionByName(_unscored(index, queries, scores, k, scope))
    return top_k(scores, k)


def meta(index: LexicalIndex) -> str:
    """Size, mean length and vocabulary as JSON."""
    row = index.stats.first()
    return json.dumps({"n_total": row["n"], "avgdl": row["avgdl"], "n_terms": index.terms.count(), "min_df": index.min_df})
