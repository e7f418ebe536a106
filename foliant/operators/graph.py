"""Approximate vector search in navigable small-world graphs, one for each bounded shard of vectors.

Rows are dealt into shards by hash. In a shard, equal vectors are one node. A node links to its nearest neighbours, of
which one is left out if it is nearer to a kept one than to the node, so that links lead into all directions; to its nearest
among ever smaller nested samples of the shard, which are the long steps of a small world; and back from all that link to it.
Neighbours inside a shard are found by blocks of matrix products: its size is bounded, so the build is linear in the rows.

A search starts from the smallest sample and keeps the best BEAM nodes seen, following the links of the best ones that are
not yet followed; many queries step together. Each shard gives its k best, and the lists are merged by score.

The index is a table with a row for each shard, written and read like any other. Null vectors, those with a null or non-finite entry and those of
another length than most take no part; queries of another length find nothing; a vector of zeros has similarity 0 with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators.dense import Found, _rows, best, by_length, deal, meetings, values_of

# The usual sizes of such graphs.
DEGREE, CANDIDATES, BEAM = 32, 200, 64
#: Rows of a shard on average.
SHARD_ROWS = 16_384
#: Each nested sample is that much smaller; the last one has about so many nodes; links into each.
NARROWING, LEAST_SAMPLE, LONG_LINKS = 8, 64, 4
#: Nodes that a search follows at a time; queries that step together; bytes of gathered vectors in a step of the build.
FOLLOWED, STEP_QUERIES, STEP_BYTES = 4, 64, 64_000_000


@dataclass
class Graph:
    """x: unit vectors of the nodes; links: (nodes, width), -1 where there are fewer; entries: where searches start."""

    x: np.ndarray
    links: np.ndarray
    entries: np.ndarray


def unit(x: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    return np.divide(x, lengths, out=np.zeros(x.shape), where=lengths > 0)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, largest first."""
    k = min(k, scores.shape[1])
    some = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(scores, some, 1), axis=1, kind="stable"), 1)


def spread(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Which of each node's neighbours, nearest first, are kept: degree at most, each nearer to the node than to those before it."""
    around = x[near]
    to_node = np.einsum("bcd,bd->bc", around, x[nodes])
    between = around @ around.transpose(0, 2, 1)
    kept = np.zeros(near.shape, bool)
    count = np.zeros(len(nodes), int)
    for c in range(near.shape[1]):
        blocked = (kept[:, :c] & (between[:, c, :c] >= to_node[:, c, None])).any(1)
        kept[:, c] = ~blocked & (count < degree) & (near[:, c] != nodes)
        count += kept[:, c]
    return kept


def build_graph(x: np.ndarray, seed: int, degree: int = DEGREE, candidates: int = CANDIDATES) -> Graph:
    """The graph of different unit vectors."""
    n = len(x)
    order = np.random.default_rng(seed).permutation(n)
    sizes = [n]
    while sizes[-1] > NARROWING * LEAST_SAMPLE:
        sizes.append(sizes[-1] // NARROWING)
    samples = [order[:s] for s in sizes]
    entries = np.sort(order[: min(n, LEAST_SAMPLE)])
    candidates = min(candidates, n)
    rows = max(1, min(256, STEP_BYTES // (8 * candidates * max(x.shape[1], candidates))))
    ends: list[np.ndarray] = []
    for at in range(0, n, rows):
        nodes = np.arange(at, min(n, at + rows))
        near = _top(x[nodes] @ x.T, candidates)
        kept = spread(x, nodes, near, degree)
        links = [np.stack([np.repeat(nodes, kept.sum(1)), near[kept]])]
        for sample in samples[1:]:
            far = sample[_top(x[nodes] @ x[sample].T, LONG_LINKS)]
            links.append(np.stack([np.repeat(nodes, far.shape[1]), far.ravel()]))
        ends.append(np.concatenate(links, 1))
    one, two = np.concatenate(ends, 1) if ends else np.zeros((2, 0), int)
    pairs = np.unique(np.concatenate([one, two]) * n + np.concatenate([two, one]))  # every link leads back
    a, b = pairs // n, pairs % n
    a, b = a[a != b], b[a != b]
    nearness = np.concatenate([np.einsum("bd,bd->b", x[a[k : k + 65_536]], x[b[k : k + 65_536]]) for k in range(0, len(a), 65_536)]) if len(a) else np.zeros(0)
    sort = np.lexsort((b, -nearness, a))
    a, b = a[sort], b[sort]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    # of very many links back, the nearest and an even choice of the others stay
    count = np.bincount(a, minlength=n)
    wide, near = 2 * degree + LONG_LINKS * len(sizes), degree
    step = np.maximum(1, -(-(count - near) // (wide - near)))
    keep = (count[a] <= wide) | (place < near) | ((place - near) % step[a] == 0)
    a, b = a[keep], b[keep]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    links = np.full((n, int(place.max()) + 1 if len(place) else 1), -1, np.int32)
    links[a, place] = b
    return Graph(x, links, entries)


def walk(g: Graph, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), nearest first, of the best that a search from each query has seen; -1 where there are fewer."""
    n, many = len(g.x), len(q)
    every = np.arange(many)[:, None]
    seen = np.zeros((many, n + 1), bool)
    seen[:, n] = True  # where links has -1
    nodes = np.full((many, beam), n)
    sims = np.full((many, beam), -np.inf)
    followed = np.ones((many, beam), bool)
    fresh, values = np.broadcast_to(g.entries, (many, len(g.entries))), q @ g.x[g.entries].T
    seen[:, g.entries] = True
    links = np.where(g.links < 0, n, g.links)
    padded = np.concatenate([g.x, np.zeros((1, g.x.shape[1]))])
    active = np.arange(many)
    while len(active):
        rows = every[: len(active)]
        all_nodes, all_sims = np.concatenate([nodes[active], fresh], 1), np.concatenate([sims[active], values], 1)
        all_followed = np.concatenate([followed[active], np.zeros(fresh.shape, bool)], 1)
        keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        nodes[active], sims[active], followed[active] = all_nodes[rows, keep], all_sims[rows, keep], all_followed[rows, keep] | (all_sims[rows, keep] == -np.inf)
        active = active[~followed[active].all(1)]
        if not len(active):
            break
        rows = every[: len(active)]
        open_ = np.argsort(followed[active], axis=1, kind="stable")[:, :FOLLOWED]  # beams are sorted: the best that are open
        usable = ~followed[active[:, None], open_]
        followed[active[:, None], open_] = True
        at = np.where(usable, nodes[active[:, None], open_], 0)
        fresh = np.where(usable[:, :, None], links[at], n).reshape(len(active), -1)
        fresh = np.sort(fresh, axis=1)
        known = seen[active[:, None], fresh]
        known[:, 1:] |= fresh[:, 1:] == fresh[:, :-1]
        fresh = np.where(known, n, fresh)
        seen[active[:, None], fresh] = True
        most = int((~known).sum(1).max())
        first = np.argsort(known, axis=1, kind="stable")[:, : max(1, most)]
        fresh = fresh[rows, first]
        values = np.where(fresh == n, -np.inf, np.einsum("awd,ad->aw", padded[fresh], q[active]))
    return np.where(sims > -np.inf, nodes, -1), sims


@dataclass
class GraphIndex:
    """rows(block, n, ids, firsts, x, links, entries), a graph each, and how many there are."""

    rows: DataFrame
    shards: int

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> GraphIndex:
    """The index at path; one that lacks shards is refused."""
    rows = spark.read.parquet(path)
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("shards"), F.lit(0)).alias("shards"), F.count_distinct("block").alias("blocks")).first()
    if found["n"] != found["blocks"] or found["n"] > found["shards"]:
        raise ValueError(f"the index at {path} has {found['n']} graphs of {found['shards']} shards")
    return GraphIndex(rows, found["shards"])


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", degree: int = DEGREE, candidates: int = CANDIDATES, shard_rows: int = SHARD_ROWS) -> GraphIndex:
    """Graphs of cosine similarity over vectors(id, vector)."""
    good = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"block int, shards int, n int, ids array<{kind}>, firsts binary, x binary, links binary, entries binary"
    if size is None:
        return GraphIndex(vectors.sparkSession.createDataFrame([], schema), 0)
    rows = rows.where(F.size("v") == size["n"])
    shards = max(1, -(-size["count"] // shard_rows))
    dealt = rows.select(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v")
    dealt = dealt.repartition(min(shards, 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block").sortWithinPartitions("block", "id")

    def made(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        ids = values_of(whole["id"].combine_chunks())
        (_, x), *_ = by_length(whole["v"]).values()
        different, node = np.unique(x, axis=0, return_inverse=True)
        sort = np.lexsort((np.unique(ids, return_inverse=True)[1], node.ravel()))
        g = build_graph(unit(different), block, degree, candidates)
        firsts = np.concatenate([[0], np.cumsum(np.bincount(node.ravel(), minlength=len(different)))])
        columns = [[block], [shards], [len(different)], [ids[sort].tolist()], [firsts.astype("<i8").tobytes()], [different.astype("<f8").tobytes()], [g.links.astype("<i4").tobytes()], [g.entries.astype("<i4").tobytes()]]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(whole.schema.field("id").type), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "shards", "n", "ids", "firsts", "x", "links", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for block, _, batch in meetings(batches):
            if block != now and parts:
                yield made(now, parts)
                parts = []
            now = block
            parts.append(batch)
        if parts:
            yield made(now, parts)

    return GraphIndex(dealt.mapInArrow(run, schema), shards)


def search(index: GraphIndex, queries: DataFrame, k: int, beam: int = BEAM, digits: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): k near vectors of each of queries(query_id, vector) by cosine; ties go to the smaller id. Every
    query visits every shard; nothing passes the driver."""
    asked = queries.select("query_id", F.col("vector").alias("q")).where("q is not null")
    kind = index.rows.schema["ids"].dataType.elementType.simpleString()
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {kind}, score double"
    if not index.shards:
        return index.rows.sparkSession.createDataFrame([], f"{schema}, rank int")
    wide = max(beam, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for block, asks, batch in meetings(batches):
            if block != now:
                now, shard = block, None
            if not asks:
                shard = _shard(batch)
                continue
            if shard is None:
                continue
            for at in range(0, batch.num_rows, STEP_QUERIES):
                some = batch.slice(at, STEP_QUERIES)
                ids = values_of(some["query_id"])
                found = [_answer(shard, ids[where], unit(q), wide, k, digits) for n, (where, q) in by_length(some["q"]).items() if n == shard[0].x.shape[1]]
                if found:
                    yield _rows(best(found, k))

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return deal(index.rows.drop("shards"), asked, index.shards).mapInArrow(run, schema).withColumn("rank", place).where(F.col("rank") <= k)


def _shard(batch: pa.RecordBatch) -> tuple[Graph, np.ndarray, np.ndarray]:
    get = lambda name: batch.column(name)[0].as_py()
    n = get("n")
    x = unit(np.frombuffer(get("x"), "<f8").reshape(n, -1))
    return Graph(x, np.frombuffer(get("links"), "<i4").reshape(n, -1), np.frombuffer(get("entries"), "<i4")), np.frombuffer(get("firsts"), "<i8"), np.array(get("ids"), object)


def _answer(shard: tuple[Graph, np.ndarray, np.ndarray], asked: np.ndarray, q: np.ndarray, beam: int, k: int, digits: int | None) -> Found:
    g, firsts, ids = shard
    nodes, sims = walk(g, q, beam)
    row, column = np.nonzero(nodes >= 0)
    node, sims = nodes[row, column], sims[row, column]
    if digits is not None:
        sims = np.round(sims, digits) + 0.0
    count = np.minimum(firsts[node + 1] - firsts[node], k)  # a node's ids are sorted: the first k are enough
    each = np.repeat(np.arange(len(node)), count)
    member = firsts[node][each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    return asked[row][each], ids[member], sims[each]
