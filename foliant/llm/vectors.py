"""Approximate nearest neighbours by inner product, with an inverted multi-index.

Both halves of the vectors have their own codebook, fitted on a bounded sample; every vector is an entry of
the cell of its pair of centroids, of about CELL_ENTRIES on average. A query visits pairs by summed distance, off a
heap over tiles of both sorted lists, until the visited cells hold a share of all entries; the share is measured on the
sample so that RECALL of its true neighbours are reached. Since summed distances order the pairs, the visited ones are
those up to one distance, the query's reach. Distances are always computed in blocks of one shape, so that a row's do not depend on the
rows beside it, and a cell counts as reached a rounding error beyond: no border cell is lost between a query's walk and its scoring.

Entries are dealt into blocks of bounded size by their first centroid, once each. A query goes to the blocks where its
reach holds a cell, and is scored exactly there against the entries within reach; queries stream past a block, so that
a task holds one block and one batch of queries. A score below what the sample's entries in reach offer cannot be
among the nearest found.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows without an id; a query never finds rows of its own id; of a query id's different
vectors the least asks, repeated rows of it ask once; fewer candidates than asked for give fewer rows; ties go to the
smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import summed_counts

#: Vectors that codebooks and the share to visit are fitted on, those with the smallest hash.
FIT_ROWS = 8192
#: Entries of a cell on average, and centroids of a half at most (the sample has no more to tell apart).
CELL_ENTRIES = 4
MOST_CENTROIDS = 1024
RECALL = 0.95
#: Rows whose products with centroids are computed at a time, always as many; relative slack of a reach.
STEP_ROWS = 256
SLACK = 1e-9
#: Centroids of each half in a tile of the heap.
TILE = 16
#: Entries of a block at most, and queries that are scored at a time.
BLOCK_ROWS = 65_536
STEP_QUERIES = 64


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of the rows, from evenly spread rows on."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        for c in range(k):
            rows = x[own == c]
            if len(rows):
                centers[c] = rows.mean(0)
    return centers


def products(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """x @ centers.T by blocks of STEP_ROWS rows, the last one filled up: products of other shapes round differently."""
    if not len(x):
        return np.zeros((0, len(centers)))
    parts = []
    for at in range(0, len(x), STEP_ROWS):
        block = np.ascontiguousarray(x[at : at + STEP_ROWS])
        if len(block) < STEP_ROWS:
            block = np.concatenate([block, np.zeros((STEP_ROWS - len(block), x.shape[1]))])
        parts.append(block @ centers.T)
    return np.concatenate(parts)[: len(x)]


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return 0.5 * (centers**2).sum(1) - products(x, centers)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return _distances(x, centers).argmin(1)


def clearly_nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Whether no other centroid is as near, within rounding."""
    if len(centers) < 2:
        return np.ones(len(x), bool)
    two = np.partition(_distances(x, centers), 1, axis=1)[:, :2]
    return two[:, 1] - two[:, 0] > SLACK * (1 + np.abs(two).max(1))


@dataclass
class Codebooks:
    halves: tuple[np.ndarray, np.ndarray]
    sample: np.ndarray
    sample_ids: np.ndarray
    share: float = 1.0
    clear: np.ndarray | None = None  # which of the sample are in their cell beyond doubt

    @property
    def cut(self) -> int:
        return self.halves[0].shape[1]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x[:, : self.cut], self.halves[0]), nearest(x[:, self.cut :], self.halves[1])

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much less than the best centroid of its half each centroid gives to the inner product with each row of q."""
        one, two = products(q[:, : self.cut], self.halves[0]), products(q[:, self.cut :], self.halves[1])
        return one.max(1, keepdims=True) - one, two.max(1, keepdims=True) - two


def reach(one: np.ndarray, two: np.ndarray, counts: np.ndarray, budget: int) -> float:
    """The summed distance up to which pairs of centroids hold budget entries, or all: tiles of pairs come off a heap by
    their least distance; once they hold enough, only tiles that begin nearer can still matter."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    one, two = one[a], two[b]
    heap = [(one[0] + two[0], 0, 0)]
    sums, held, total, bound = [], [], 0, math.inf
    while heap and heap[0][0] < bound:
        _, i, j = heapq.heappop(heap)
        sums.append((one[i : i + TILE, None] + two[None, j : j + TILE]).ravel())
        held.append(counts[np.ix_(a[i : i + TILE], b[j : j + TILE])].ravel())
        total += int(held[-1].sum())
        if j == 0 and i + TILE < len(a):
            heapq.heappush(heap, (one[i + TILE] + two[0], i + TILE, 0))
        if j + TILE < len(b):
            heapq.heappush(heap, (one[i] + two[j + TILE], i, j + TILE))
        if total >= budget and bound == math.inf:
            bound = _level(sums, held, budget)
    return _level(sums, held, budget)


def _level(sums: list[np.ndarray], held: list[np.ndarray], budget: int) -> float:
    flat, n = np.concatenate(sums), np.concatenate(held)
    order = np.argsort(flat, kind="stable")
    at = int(np.searchsorted(np.cumsum(n[order]), budget))
    return float(flat[order[at]]) if at < len(order) else math.inf


def fit(vectors: DataFrame, n: int, k: int, fit_rows: int) -> Codebooks | None:
    """Codebooks of vectors(id, v) and the share of entries to visit."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(fit_rows).collect()
    if not rows:
        return None
    x = np.array([r["v"] for r in rows], np.float64)
    ids = np.array([r["id"] for r in rows])
    half = max(1, x.shape[1] // 2)
    centroids = min(MOST_CENTROIDS, max(1, round(math.sqrt(n / CELL_ENTRIES))), len(x))
    books = Codebooks((kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids) if x.shape[1] > half else np.zeros((1, 0))), x, ids)
    books.clear = clearly_nearest(x[:, :half], books.halves[0]) & clearly_nearest(x[:, half:], books.halves[1])
    if len(x) <= k + 1:
        return books
    one, two = books.cells(x)
    needed: list[np.ndarray] = []
    for q in range(0, len(x), max(1, len(x) // 512)):
        scores = x @ x[q]
        scores[q] = -np.inf
        near = np.argpartition(-scores, k)[:k]
        to_one, to_two = books.distances(x[q : q + 1])
        far = to_one[0, one] + to_two[0, two]
        needed.append(np.searchsorted(np.sort(far), far[near], "right") / len(x))
    books.share = float(np.quantile(np.concatenate(needed), RECALL))
    return books


def _usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def search(table: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that are found of each row of table that is_query picks."""
    spark = table.sparkSession
    own = table.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"), is_query.alias("asks")).where(F.col("id").isNotNull() & F.coalesce(_usable(F.col("v")), F.lit(False)))
    size = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return empty
    own = own.where(F.size("v") == size["n"])
    n = size["count"]
    books = fit(own.select("id", "v"), n, k, fit_rows)
    shared = spark.sparkContext.broadcast(books)
    element = own.schema["v"].dataType.elementType.simpleString()
    shape = len(books.halves[0]), len(books.halves[1])

    def matrix(column: pa.Array) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(shape[0] * shape[1], np.int64)
        for batch in batches:
            if batch.num_rows:
                i, j = shared.value.cells(matrix(batch.column(0)))
                np.add.at(total, i * shape[1] + j, 1)
        return total

    counts = summed_counts(own.select("v"), shape[0] * shape[1], count, 4096).reshape(shape)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_rows = min(BLOCK_ROWS, max(1024, -(-n // (2 * partitions))))
    first, parts, blocks = _blocks(counts.sum(1), block_rows)
    sizes = spark.sparkContext.broadcast((counts, first, parts))
    share_rows = math.ceil(books.share * n)
    fields = f"block int, asks boolean, id long, reach double, least double, i int, j int, v array<{element}>"

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, parts = sizes.value
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j = shared.value.cells(matrix(batch.column(1)))
            part = batch.column(2).to_numpy() % parts[i]
            none = pa.nulls(len(i), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[i] + part, pa.int32()), pa.array(np.zeros(len(i), bool)), batch.column(0), none, none, pa.array(i, pa.int32()), pa.array(j, pa.int32()), batch.column(1)],
                names=["block", "asks", "id", "reach", "least", "i", "j", "v"],
            )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first, parts = sizes.value
        one, two = shared.value.cells(shared.value.sample)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, rows_of_id = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy()
            to_one, to_two = shared.value.distances(x)
            rows, block, far, least = [], [], [], []
            for r in range(len(ids)):
                # rows of the query's own id are reached but not found
                level = reach(to_one[r], to_two[r], counts, max(k + int(rows_of_id[r]), share_rows))
                inside = (to_one[r, one] + to_two[r, two] <= level) & (shared.value.sample_ids != ids[r]) & shared.value.clear
                scores = shared.value.sample[inside] @ x[r]
                floor = float(np.partition(scores, len(scores) - k)[len(scores) - k]) - 1e-9 * (1 + abs(float(scores.max()))) if len(scores) >= k else -math.inf
                level += SLACK * (1 + abs(level)) if level < math.inf else 0.0
                visited = np.flatnonzero(((to_one[r][:, None] + to_two[r][None, :] <= level) & (counts > 0)).any(1))
                asked = np.unique(np.concatenate([np.arange(first[i], first[i] + parts[i]) for i in visited.tolist()]))
                rows.append(np.full(len(asked), r))
                block.append(asked)
                far.append(np.full(len(asked), level))
                least.append(np.full(len(asked), floor))
            at = pa.array(np.concatenate(rows))
            none = pa.nulls(len(at), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(block), pa.int32()), pa.array(np.ones(len(at), bool)), batch.column(0).take(at), pa.array(np.concatenate(far)), pa.array(np.concatenate(least)), none, none, batch.column(1).take(at)],
                names=["block", "asks", "id", "reach", "least", "i", "j", "v"],
            )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, entries = None, None
        for batch in batches:
            blocks, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if hi == lo:
                    continue
                part = batch.slice(lo, hi - lo)
                if blocks[lo] != block:
                    block, entries, held = blocks[lo], None, []
                if not asks[lo]:
                    held.append(part)
                    continue
                if entries is None and held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    entries, held = (whole["id"].to_numpy(), whole["i"].to_numpy(), whole["j"].to_numpy(), matrix(whole["v"])), []
                for at in range(0, part.num_rows, STEP_QUERIES):
                    if entries is not None:
                        yield nearest_in(entries, part.slice(at, STEP_QUERIES))

    def nearest_in(entries: tuple[np.ndarray, ...], asked: pa.RecordBatch) -> pa.RecordBatch:
        ids, i, j, x = entries
        q, own = matrix(asked.column(7)), asked.column(2).to_numpy()
        to_one, to_two = shared.value.distances(q)
        rough = q @ x.T
        rough[(to_one[:, i] + to_two[:, j] > asked.column(3).to_numpy()[:, None]) | (rough < asked.column(4).to_numpy()[:, None]) | (ids[None, :] == own[:, None])] = -np.inf
        at_least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for r in range(len(q)):
            ok = np.flatnonzero((rough[r] > -np.inf) & (rough[r] >= at_least[r] - 1e-9 * (1 + abs(at_least[r])) if at_least[r] > -np.inf else rough[r] > -np.inf))
            exact = (x[ok] * q[r]).sum(1)
            best = np.lexsort((ids[ok], -exact))[:k]
            found.append((np.full(len(best), own[r]), ids[ok][best], exact[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    entries = own.select("id", "v", hashed.alias("h")).mapInArrow(enter, fields)
    asked = own.groupBy("id").agg(F.min(F.when(F.col("asks"), F.col("v"))).alias("v"), F.count("*").alias("rows")).where("v is not null")
    queries = asked.repartition(partitions, F.xxhash64("id"))
    met = entries.unionByName(queries.mapInArrow(visit, fields)).repartition(max(1, min(blocks, 4 * partitions)), "block").sortWithinPartitions("block", "asks")
    near = met.mapInArrow(score, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(entries: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block, blocks) of each first centroid, and the number of blocks: centroids share a block while they fit;
    one with more entries than a block may hold is dealt over several."""
    first, parts = np.zeros(len(entries), np.int64), np.ones(len(entries), np.int64)
    block, room = 0, block_rows
    for i, n in enumerate(entries.tolist()):
        if n > room and room < block_rows:
            block, room = block + 1, block_rows
        first[i] = block
        if n > block_rows:
            parts[i] = -(-n // block_rows)
            block, room = block + int(parts[i]), block_rows
        else:
            room -= n
    return first, parts, block + (room < block_rows)


def digest(table: DataFrame) -> DataFrame:
    return search(table, F.col("vec_id") % 20 == 0)
