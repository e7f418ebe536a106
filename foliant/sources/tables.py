"""Reading and writing tables: schemas, eligibility, filters, upserts, resumable loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_SCHEMA = (
    "id string, document_id string, text string, embedding_text string, chunk_type string, section string, subsection string, breadcrumb array<string>, "
    "parent_id string, table_id string, figure_id string, document_position bigint"
)


def with_schema(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """df's columns cast to the schema, missing ones null; others go."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    own = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f"`{f.name}`") if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files below path, without embeddings and temporary files, eligible rows only, in the corpus schema."""
    files = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    kept = files.where(~name.contains("embedding") & ~name.startswith(".") & ~name.endswith(".tmp.parquet"))
    return with_schema(eligible(kept) if "retrieval_eligible" in kept.columns else kept, CORPUS_SCHEMA)


def eligible(df: DataFrame, column: str = "retrieval_eligible") -> DataFrame:
    """Rows whose flag is true; null counts as false."""
    return df.where(F.coalesce(F.col(column), F.lit(False)))


def filtered(df: DataFrame, allowed: set[str], **equals) -> DataFrame:
    """Equality filters, joined by AND; None is no filter; other columns than the allowed ones are refused."""
    for name, value in equals.items():
        if value is None:
            continue
        if name not in allowed:
            raise ValueError(f"no filter on {name!r}")
        df = df.where(F.col(name) == F.lit(value))
    return df


def last_write(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key: an upsert of all rows in order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def pending(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed load still has to do."""
    return ids.join(done, key, "left_anti")


def consolidate(df: DataFrame, path: str, key: str = "id", document: str = "document_id") -> dict[str, int]:
    """Writes one corpus table and counts it."""
    df.write.mode("overwrite").parquet(path)
    row = df.sparkSession.read.parquet(path).agg(F.count("*"), F.countDistinct(key), F.countDistinct(document)).first()
    return {"rows": row[0], "ids": row[1], "documents": row[2]}
