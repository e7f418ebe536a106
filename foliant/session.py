"""Session settings and checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foliant")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage. The cluster's setting wins; only a session without one on one machine (a
    test) gets a temporary folder, elsewhere its lack is an error."""
    context = spark.sparkContext
    set_dir = context._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = named or f"file://{tempfile.gettempdir()}/foliant-checkpoints-{os.getpid()}"
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder: later steps reread files and survive lost executors."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    # shuffle files of the lineage that has just been cut go when the driver collects its garbage
    del df
    gc.collect()
    spark._jvm.System.gc()
    return kept


def cut_table(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """Like cut(), as a compressed Parquet table in the same folder: for many rows of a few random numbers, a
    third of a checkpoint's size. The table stays until the folder is emptied, or drop_tables() gets the path that
    is added to made."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    if made is not None:
        made.append(path)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: a tenth of Spark's default of 10,000 rows keeps the buffers of both sides
    small. Any other setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")
