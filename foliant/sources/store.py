"""A chunk and vector store of tables in a folder, written atomically and loaded in batches, and the files around it: embedding files
beside chunk files, trees, run outputs and traces."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import vector as vec
from foliant.operators import dense
from foliant.sources.segments import SegmentTable
from foliant.sources.tables import CORPUS_SCHEMA, filtered, last_write, with_schema

EMBEDDINGS = "chunk_id string, embedding array<float>"
TABLES = {"chunks": CORPUS_SCHEMA.replace("id string", "chunk_id string", 1) + ", metadata string", "embeddings": EMBEDDINGS}
#: Columns that a search may be filtered by.
FILTERS = {"document_id", "chunk_type", "section", "subsection"}


def _path(spark: SparkSession, text: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(text)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


class Store:
    """chunks and embeddings below a folder, each a table of segments: a write adds its rows, readers see one version."""

    def __init__(self, spark: SparkSession, folder: str, dimension: int) -> None:
        self.spark, self.folder, self.dimension = spark, folder.rstrip("/"), dimension
        self.tables = {name: SegmentTable(spark, f"{self.folder}/{name}", "chunk_id", schema) for name, schema in TABLES.items()}

    def create(self, reset: bool = False) -> None:
        """Empty tables where there are none, or everywhere."""
        for name, schema in TABLES.items():
            if reset or not self.tables[name].exists():
                self.tables[name].replace(self.spark.createDataFrame([], schema))

    def table(self, name: str) -> DataFrame:
        return self.tables[name].table()

    def upsert_chunks(self, rows: DataFrame, order: list[str] | None = None) -> None:
        """The last row of an id wins; order says which is last, else it is the one with the longest text."""
        new = rows if order else rows.withColumn("_n", F.length("text"))
        self.tables["chunks"].upsert(with_schema(last_write(new, "chunk_id", order or ["_n", "text"]), TABLES["chunks"]))

    def _checked(self, rows: DataFrame, order: list[str]) -> DataFrame:
        wrong = rows.where((F.size("embedding") != self.dimension) | ~vec.finite(F.col("embedding")) | F.col("embedding").isNull())
        if not wrong.isEmpty():
            raise ValueError(f"vectors must be finite and of dimension {self.dimension}")
        return rows.select("chunk_id", vec.normalised(F.col("embedding")).cast("array<float>").alias("embedding"), *order)

    def upsert_vectors(self, rows: DataFrame, order: list[str] | None = None) -> None:
        """Vectors of length 1; one of another dimension or with values that are not finite fails the write, a zero vector stays. The last
        row of an id wins; without an order it is the one whose vector is largest, entry by entry."""
        self.tables["embeddings"].upsert(self._checked(rows, order or []), order)

    def load_vectors(self, rows: DataFrame, batches: int, name: str = "load", tell: Callable[[int, int, int], None] | None = None) -> None:
        """upsert_vectors() in batches, each whole or not at all; one that was stopped goes on where it was."""
        self.tables["embeddings"].load(self._checked(rows, []), batches, name, tell)

    def reload(self, chunks: DataFrame, vectors: DataFrame) -> None:
        """All rows anew, each table in one version."""
        self.tables["chunks"].replace(with_schema(chunks, TABLES["chunks"]))
        self.tables["embeddings"].replace(self._checked(vectors, []).dropDuplicates(["chunk_id"]))

    def rebuild(self) -> None:
        """Each table as one segment by id, so that a lookup of ids reads few row groups."""
        for t in self.tables.values():
            t.compact()

    def truncate(self) -> None:
        self.create(reset=True)

    def vacuum(self) -> None:
        for t in self.tables.values():
            t.vacuum()

    def counts(self) -> dict[str, int]:
        row = self.table("chunks").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("d")).first()
        return {"chunks": row["n"], "documents": row["d"], "embeddings": self.table("embeddings").count()}

    def get(self, ids: list[str], name: str = "chunks") -> DataFrame:
        return self.tables[name].get(ids)

    def search(self, queries: DataFrame, k: int, method: str = "cosine", **filters) -> DataFrame:
        """(query_id, id, score, rank); filters on chunk columns come first, then the search is exact among what is left."""
        scope = None
        if any(v is not None for v in filters.values()):
            scope = filtered(self.table("chunks"), FILTERS, **filters).select("chunk_id")
        return dense.search(self.table("embeddings"), queries, k, method=method, id_col="chunk_id", scope=scope)

    def check_alignment(self) -> None:
        """Every vector has its chunk, and no id has two vectors."""
        vectors = self.table("embeddings")
        lost = vectors.join(self.table("chunks"), "chunk_id", "left_anti").count()
        twice = vectors.groupBy("chunk_id").count().where("count > 1").count()
        if lost or twice:
            raise ValueError(f"{lost} vectors without a chunk, {twice} ids with several vectors")


def embedding_path(chunk_file: str) -> str:
    """Where the vectors of a chunk file are: beside it, in embeddings/, under the same name."""
    folder, _, name = chunk_file.rpartition("/")
    stem = name.removesuffix(".parquet")
    return f"{folder + '/' if folder else ''}embeddings/{stem}.embeddings.parquet"


def files_below(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, stem, modified) of the files below folder that fit glob, without their content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return rows.select("path", F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?:\.embeddings)?\.[a-z]+$", "").alias("stem"), F.col("modificationTime").alias("modified"))


def pending_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk files that have no file of vectors yet."""
    every = files_below(spark, folder, "*.parquet")
    return every.where(~F.col("path").contains("embeddings")).join(every.where(F.col("path").contains("embeddings")).select("stem"), "stem", "left_anti")


def load_matrix(spark: SparkSession, path: str, most: int = 1_000_000) -> tuple[list[str], np.ndarray]:
    """Ids and vectors of one file as arrays on the driver; a table of more than most rows is refused."""
    rows = spark.read.parquet(path).select("chunk_id", "embedding").orderBy("chunk_id").limit(most + 1).toArrow()
    if len(rows) > most:
        raise ValueError(f"{path} has more than {most} vectors")
    return rows["chunk_id"].to_pylist(), np.array(rows["embedding"].to_pylist(), np.float32)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Query, plan or tree files, one JSON document each; what does not parse has its text in _corrupt."""
    return spark.read.option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt string").json(path)


def read_trees(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, status, tree, error) of tree files, one JSON document named after its paper; only those of status success have a tree."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder)
    name = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), r"\.json$", "")
    status = F.get_json_object("value", "$.status")
    return files.select(name.alias("paper_id"), F.coalesce(status, F.lit("broken")).alias("status"), F.when(status == "success", F.get_json_object("value", "$.tree")).alias("tree"), F.get_json_object("value", "$.error").alias("error"))


def write_trees(nodes: DataFrame, folder: str) -> None:
    """A partition for each paper with its nodes as one JSON line and its size."""
    fields = [c for c in nodes.columns if c != "paper_id"]
    made = nodes.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("preorder", *[c for c in fields if c != "preorder"]))).alias("nodes"))
    made = made.select("paper_id", F.lit("success").alias("status"), F.to_json("nodes").alias("tree"), F.size("nodes").alias("n_nodes"))
    made.write.mode("overwrite").partitionBy("paper_id").json(folder)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, whole or not at all: it takes the place of an old one in one step."""
    at, fs = _path(spark, path)
    fresh = _path(spark, f"{path}.{uuid.uuid4().hex}")[0]
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(at), over)


def write_run(spark: SparkSession, folder: str, payload: dict, report: str) -> None:
    """A run's outputs: its payload as JSON and its report."""
    write_text(spark, f"{folder}/run.json", json.dumps(payload, ensure_ascii=False, indent=2, default=str))
    write_text(spark, f"{folder}/evidence.md", report)


class Trace:
    """Events of a run, cut at most characters a value, appended to a table as they are flushed."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str, most: int = 2000) -> None:
        self.spark, self.folder, self.run_id, self.most = spark, folder, run_id, most
        self.rows: list[tuple[str, int, str, str]] = []
        self.done = 0

    def log(self, event: str, **values) -> None:
        text = json.dumps({k: v if len(str(v)) <= self.most else f"{str(v)[: self.most]}… ({len(str(v))} characters)" for k, v in values.items()}, ensure_ascii=False, default=str)
        self.rows.append((self.run_id, self.done + len(self.rows), event, text))

    def flush(self) -> None:
        if self.rows:
            self.spark.createDataFrame(self.rows, "run_id string, n long, event string, detail string").coalesce(1).write.mode("append").parquet(self.folder)
            self.done += len(self.rows)
            self.rows = []


def encode_file(rows: DataFrame, make, dimension: int, *also: str) -> DataFrame:
    """(chunk_id, embedding, and columns passed through) of chunks with text, by an encoder made once a task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from foliant.models.plugins import checked

        model = make()
        for part in parts:
            vectors = checked(model.encode(part["text"].fillna("").tolist()), len(part), dimension)
            yield pd.DataFrame({"chunk_id": part["chunk_id"], "embedding": list(vectors.astype(np.float32)), **{c: part[c] for c in also}})

    return rows.select("chunk_id", "text", *also).mapInPandas(run, ", ".join([EMBEDDINGS, *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in also)]))


def encode_files(spark: SparkSession, folder: str, make, dimension: int, at_once: int = 64, tell: Callable[[int, int], None] | None = None) -> int:
    """Vectors of each chunk file below folder that has none yet, in a file of its own beside it; returns how many were made. Groups of files
    are encoded in one job to a hidden folder, and each file of vectors is then moved to its place, which is what marks it as done: a run
    that was stopped leaves whole files only, and the next one takes those that are open."""
    open_ = [r["path"] for r in pending_embeddings(spark, folder).select("path").distinct().orderBy("path").collect()]
    for at in range(0, len(open_), at_once):
        group = open_[at : at + at_once]
        number = F.create_map(*[F.lit(x) for k, path in enumerate(group) for x in (path, k)])
        attempt = f"{folder.rstrip('/')}/.attempt-{uuid.uuid4().hex}"
        rows = spark.read.parquet(*group).select("chunk_id", "text", number[F.col("_metadata.file_path")].alias("n"))
        encode_file(rows.repartition(len(group), "n"), make, dimension, "n").sortWithinPartitions("n").write.partitionBy("n").parquet(attempt)
        spark.createDataFrame([], EMBEDDINGS).coalesce(1).write.parquet(f"{attempt}/none")
        where, fs = _path(spark, attempt)
        for k, path in enumerate(group):
            made = _path(spark, f"{attempt}/n={k}")[0]
            made = made if fs.exists(made) else _path(spark, f"{attempt}/none")[0]  # a file without chunks has a file without vectors
            parts = [f.getPath() for f in fs.listStatus(made) if f.getPath().getName().startswith("part-")]
            to = _path(spark, embedding_path(path))[0]
            fs.mkdirs(to.getParent())
            if made.getName() == "none":
                spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, parts[0], fs, to, False, spark._jsc.hadoopConfiguration())
            elif len(parts) != 1 or not fs.rename(parts[0], to):
                raise OSError(f"{to} could not be made")
        fs.delete(where, True)
        if tell is not None:
            tell(min(at + at_once, len(open_)), len(open_))
    return len(open_)
