"""Text encoders and pair scorers: anything with encode() or score() runs on Arrow batches of a column.

No model files are part of this package; HashingEncoder and OverlapScorer need none and give the same result everywhere."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts a step.
BATCH = 32


class Encoder(Protocol):
    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


class HashingEncoder:
    """Signed counts of hashed words."""

    def __init__(self, dimension: int = 768) -> None:
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[row, (h >> 1) % self.dimension] += 1 if h & 1 else -1
        return out


class OverlapScorer:
    """The share of a query's distinct words that a passage has."""

    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        out = []
        for query, passage in pairs:
            asked = set(query.lower().split())
            out.append(len(asked & set(passage.lower().split())) / len(asked) if asked else 0.0)
        return np.array(out)


def checked(vectors: np.ndarray, rows: int, dimension: int) -> np.ndarray:
    """Vectors of length 1; other shapes and values that are not finite are refused, a zero vector stays."""
    vectors = np.asarray(vectors, np.float64)
    if vectors.shape != (rows, dimension):
        raise ValueError(f"an encoder gave {vectors.shape} for {rows} texts of dimension {dimension}")
    if not np.isfinite(vectors).all():
        raise ValueError("an encoder gave values that are not finite")
    lengths = np.sqrt((vectors**2).sum(1, keepdims=True))
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def encode(rows: DataFrame, text: Column, make: Callable[[], Encoder], name: str = "vector", batch: int = BATCH) -> DataFrame:
    """rows with a vector of each text; make() is called once in each task. Null reads as an empty text."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = part.fillna("").tolist()
            steps = [checked(model.encode(texts[i : i + batch]), len(texts[i : i + batch]), model.dimension) for i in range(0, len(texts), batch)]
            yield pd.Series([v.astype(np.float32) for step in steps for v in step])

    return rows.withColumn(name, run(text))


def score_pairs(rows: DataFrame, query: Column, passage: Column, make: Callable[[], Scorer], name: str = "encoder_score", batch: int = BATCH) -> DataFrame:
    """rows with the score of each (query, passage)."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for one, two in parts:
            pairs = list(zip(one.fillna(""), two.fillna(""), strict=True))
            steps = [model.score(pairs[i : i + batch]) for i in range(0, len(pairs), batch)]
            yield pd.Series(np.concatenate(steps) if steps else np.zeros(0))

    return rows.withColumn(name, run(query, passage))


#: Words of a macro batch, its longest pair times its pairs.
BATCH_WORDS = 16_384


def score_macro_batches(rows: DataFrame, query: Column, passage: Column, make: Callable[[], Scorer], name: str = "encoder_score", budget: int = BATCH_WORDS) -> DataFrame:
    """rows with the score of each (query, passage), and with (bucket, batch_seconds): pairs of all queries go by their length in words, so that a batch
    has pairs of like length and as many as the budget holds, however many each query has; bucket is the batch's longest pair, rounded up to
    a power of two. Scores are those of pairs scored one by one."""
    texts = rows.select("*", F.coalesce(query, F.lit("")).alias("_query"), F.coalesce(passage, F.lit("")).alias("_passage"))
    sized = texts.withColumn("_words", F.size(F.split("_query", r"\s+")) + F.size(F.split("_passage", r"\s+")))
    ordered = sized.repartitionByRange("_words", F.xxhash64("_query", "_passage")).sortWithinPartitions("_words")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType()), T.StructField("bucket", T.IntegerType()), T.StructField("batch_seconds", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            words = batch.column("_words").to_numpy()
            pairs = list(zip(batch.column("_query").to_pylist(), batch.column("_passage").to_pylist(), strict=True))
            scores, buckets, seconds = np.zeros(len(pairs)), np.zeros(len(pairs), np.int32), np.zeros(len(pairs))
            at = 0
            while at < len(pairs):
                end = at + 1
                while end < len(pairs) and int(words[end]) * (end + 1 - at) <= budget:  # words rise
                    end += 1
                began = time.perf_counter()
                scores[at:end] = model.score(pairs[at:end])
                seconds[at:end] = time.perf_counter() - began
                buckets[at:end] = 1 << int(words[end - 1] - 1).bit_length()
                at = end
            kept = [batch.column(c) for c in batch.schema.names if c not in ("_query", "_passage", "_words")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array(buckets), pa.array(seconds)], names=schema.names)

    return ordered.mapInArrow(run, schema)


def batch_latency(scored: DataFrame) -> DataFrame:
    """(bucket, pairs, median, p95, worst): seconds of a batch by its pairs' length."""
    at = lambda share: F.expr(f"percentile(batch_seconds, {share})")
    return scored.groupBy("bucket").agg(F.count("*").alias("pairs"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max("batch_seconds").alias("worst"))


def article_text(breadcrumb: Column, chunk_type: Column, embedding_text: Column, text: Column) -> Column:
    """What an article encoder reads: the breadcrumb or else the kind of chunk, and the embedding text or else the text."""
    head = F.when(F.size(breadcrumb) > 0, F.array_join(breadcrumb, " > ")).otherwise(chunk_type)
    return F.concat_ws("\n", head, F.when(F.coalesce(embedding_text, F.lit("")) != "", embedding_text).otherwise(text))
