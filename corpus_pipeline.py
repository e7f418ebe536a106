"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and its result is written
as Parquet and read again. All but the last return the columns of documents.

1. toxicity: documents that the nearest labelled examples reject go.
2. near_duplicates: of each group of documents with a 5-word shingle similarity of 0.8 or more, linked in
   chains too, the one with the smallest doc_id stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. secrets: every secret is replaced by a mark; no document goes.
5. packing: documents become pieces of sequences of at most 4096 tokens.

Null and empty texts pass all filters; empty tables pass through; columns that documents has beside its own
stay until packing. The result is not SQL-expressible (learned scores, a tokenizer, a packing), so ORACLE_SQL is
None and tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, jaccard, pack, secrets, toxicity
from foliant.session import cut_table, drop_tables


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs, size=5, share=(80, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="document")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in clean.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        made: list[str] = []
        docs = cut_table(stage(spark, docs, sf_dir), made)
        drop_tables(spark, before)  # what the stage read is not read again
        before = made
    return docs
