"""Exact vector search: few queries are broadcast, more are dealt against blocks of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are broadcast; of more, none passes the driver.
BLOCK_QUERIES = 4096
#: Vectors of a block that queries are dealt to, and queries scored against it at a time.
BLOCK_ROWS = 65_536
STEP_QUERIES = 64
METHODS = ("cosine", "dot", "l2")

Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # query, id and score of each row


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of a column's vectors for each length; nulls and vectors with a null entry are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    if column.flatten().null_count:
        sizes[[k for k, v in enumerate(column.to_pylist()) if v is not None and None in v]] = -1
    out = {}
    for n in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == n)
        out[n] = at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
    return out


def scores_of(q: np.ndarray, x: np.ndarray, method: str) -> np.ndarray:
    if method == "l2":
        return -np.sqrt(np.stack([((x - a) ** 2).sum(1) for a in q]))
    scores = q @ x.T
    if method == "cosine":
        lengths = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None, :]
        scores = np.divide(scores, lengths, out=np.zeros_like(scores), where=lengths > 0)
    return scores


def nearest(names: np.ndarray, scores: np.ndarray, asked: np.ndarray, k: int) -> Found:
    """The k best columns of each row of scores, and whatever ties with the last one."""
    if scores.shape[1] > k:
        worst = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, column = np.nonzero(scores >= worst[:, None])
    else:
        row, column = (a.ravel() for a in np.indices(scores.shape))
    return asked[row], names[column], scores[row, column]


def best(found: list[Found], k: int) -> Found:
    """The k best rows of each query; ties go to the smaller id."""
    asked, names, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    _, q = np.unique(asked, return_inverse=True)
    _, n = np.unique(names, return_inverse=True)
    order = np.lexsort((n, -scores, q))
    q = q[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    order = order[place < k]
    return asked[order], names[order], scores[order]


def values_of(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), object) if not pa.types.is_integer(column.type) else column.to_numpy(zero_copy_only=False)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(block, asks, rows): runs of batches sorted by their first two columns."""
    for batch in batches:
        blocks, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
            if hi > lo:
                yield int(blocks[lo]), bool(asks[lo]), batch.slice(lo, hi - lo)


def deal(held: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
    """held(block, ...) with every row of asked in each block, behind the block's own rows; a column asks tells them apart."""
    everywhere = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = held.withColumn("asks", F.lit(False)).unionByName(everywhere.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    names = ["block", "asks", *[c for c in both.columns if c not in ("block", "asks")]]
    parts = min(blocks, 4 * int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return both.select(*names).repartition(parts, "block").sortWithinPartitions("block", "asks")


def search(vectors: DataFrame, queries: DataFrame, k: int, method: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", scope: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of each of queries(query_id, vector); L2 scores are negative
    distances. scope(id) restricts first. Each partition keeps its k best of a query, so k rows a query and
    partition are shuffled. Null vectors and those of another length than the query take no part."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    if scope is not None:
        rows = rows.join(scope.select(F.col(scope.columns[0]).alias("id")), "id", "left_semi")
    asked = queries.select("query_id", F.col("vector").alias("q")).where("q is not null")
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"

    def answer(names: np.ndarray, x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> Found:
        scores = scores_of(q, x, method)
        return nearest(names, np.round(scores, digits) + 0.0 if digits is not None else scores, ids, k)

    few = asked.limit(BLOCK_QUERIES + 1).toArrow()
    found = _broadcast(rows, few, answer, k, schema) if few.num_rows <= BLOCK_QUERIES else _dealt(rows, asked, answer, k, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _rows(found: Found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.tolist()) for x in found], names=["query_id", "id", "score"])


Answer = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Found]


def _broadcast(rows: DataFrame, few: pa.Table, answer: Answer, k: int, schema: str) -> DataFrame:
    ids = values_of(few["query_id"].combine_chunks())
    block = rows.sparkSession.sparkContext.broadcast({n: (ids[at], q) for n, (at, q) in by_length(few["q"]).items()} if few.num_rows else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Found] = []
        n_held, most = 0, 4 * k * max(1, sum(len(a) for a, _ in block.value.values()))
        for batch in batches:
            names = values_of(batch.column(0))
            for n, (at, x) in by_length(batch.column(1)).items():
                if n in block.value:
                    held.append(answer(names[at], x, *block.value[n]))
                    n_held += len(held[-1][0])
            if n_held > most:
                held = [best(held, k)]
                n_held = len(held[0][0])
                most = max(most, 4 * n_held)
        if n_held:
            yield _rows(best(held, k))

    return rows.mapInArrow(run, schema)


def _dealt(rows: DataFrame, asked: DataFrame, answer: Answer, k: int, schema: str) -> DataFrame:
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    held = rows.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, entries = None, [], None
        for block, asks, batch in meetings(batches):
            if block != now:
                now, parts, entries = block, [], None
            if not asks:
                parts.append(batch.select(["id", "v"]))
                continue
            if entries is None:
                whole = pa.Table.from_batches(parts).combine_chunks() if parts else None
                names = values_of(whole["id"].combine_chunks()) if parts else None
                entries, parts = {n: (names[at], x) for n, (at, x) in by_length(whole["v"]).items()} if parts else {}, []
            for at in range(0, batch.num_rows, STEP_QUERIES):
                some = batch.slice(at, STEP_QUERIES)
                ids = values_of(some["query_id"])
                found = [answer(*entries[n], ids[where], q) for n, (where, q) in by_length(some["q"]).items() if n in entries]
                if found:
                    yield _rows(best(found, k))

    return deal(held, asked, blocks).mapInArrow(run, schema)
