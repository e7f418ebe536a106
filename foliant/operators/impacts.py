"""BM25 with pruned postings: blocks that cannot reach the best k are never decoded.

Chunks are dealt into bounded shards and numbered there in the order of their ids. In a shard a term's postings are blocks of
BLOCK chunks: gaps between numbers and frequencies, each in the least whole width, the last number of each block, and the block's
best pairs of frequency and length, those that no other pair beats in both. From these pairs a block's largest impact
follows for any parameters and mean length, so the index is built in one pass.

A query cuts a shard's numbers where any block of its terms ends. In each such interval the sum of the blocks' impacts bounds every
score. Intervals are taken in falling order of bounds, their blocks decoded, their chunks scored, until the next bound is below the
k-th best score. Nothing is lost: the results are those of scoring every posting.

Defined results: repeated ids are chunks of their own; a text without tokens is a chunk of length 0; an empty corpus gives no rows; a query
without known terms is filled up with the smallest ids, as any query with less than k positive scores is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import TOKEN, tokens
from foliant.operators.lexical import K1, B, top_k
from foliant.session import cut_table

#: Chunks of a shard on average, and of a block.
SHARD_CHUNKS = 16_384
BLOCK = 128
#: Intervals that are scored before the threshold is looked at again: as many as terms of the query, then twice as many each time.
FIRST_INTERVALS = 4
#: Queries whose terms are broadcast at a time.
MOST_QUERIES = 4096

_POSTINGS = "shard int, term string, df int, last binary, docs array<binary>, tfs array<binary>, best array<binary>"
_DOCS = "shard int, ids array<string>, lengths binary"


@dataclass
class ImpactIndex:
    """postings and docs(shard, ids, lengths) of each shard; how many shards, chunks and tokens there are."""

    postings: DataFrame
    docs: DataFrame
    n_total: int
    n_tokens: int
    block: int = BLOCK

    @property
    def mean_length(self) -> float:
        return self.n_tokens / self.n_total if self.n_total else 0.0

    def save(self, path: str) -> None:
        """Postings go by term, so that a search reads only the row groups of its terms."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "shard").write.mode("overwrite").parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.docs.sparkSession.createDataFrame([(self.n_total, self.n_tokens, self.block)], "n long, tokens long, block int").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> ImpactIndex:
    """The index at path; one that lacks chunks is refused."""
    docs = spark.read.parquet(f"{path}/docs")
    row, held = spark.read.parquet(f"{path}/stats").first(), docs.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    if row["n"] != held:
        raise ValueError(f"the index at {path} has {held} chunks of {row['n']}")
    return ImpactIndex(spark.read.parquet(f"{path}/postings"), docs, row["n"], row["tokens"], row["block"])


def widen(data: bytes, n: int) -> np.ndarray:
    """n numbers of the width that follows from their bytes."""
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _narrow(values: np.ndarray, starts: np.ndarray, of: np.ndarray) -> pa.Array:
    """The numbers of each block as bytes, in the least whole width that holds them; of is each number's block."""
    top = np.maximum.reduceat(values, starts)
    width = np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of) * width)])
    at = offsets[of] + (np.arange(len(values)) - starts[of]) * width[of]
    out = np.zeros(offsets[-1], np.uint8)
    for w in (1, 2, 4):
        own = width[of] == w
        out[at[own][:, None] + np.arange(w)] = values[own].astype(f"<u{w}").view(np.uint8).reshape(-1, w)
    return _binary(out, offsets)


def post(firsts: np.ndarray, docs: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, block: int) -> dict[str, pa.Array]:
    """last, docs, tfs and best of the postings of many terms, each from its place in firsts on; a row for each term."""
    n = len(docs)
    ends = np.append(firsts[1:], n)
    df = ends - firsts
    starts = np.flatnonzero((np.arange(n) - np.repeat(firsts, df)) % block == 0)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    gaps = np.diff(docs, prepend=0) - 1
    gaps[firsts] = docs[firsts]
    dl = lengths[docs]
    # falling frequency in each block: a pair counts if it is shorter than all with a higher one; a step down for each block keeps them apart
    order = np.lexsort((dl, -tfs, of))
    stepped = dl[order] - of[order] * (int(lengths.max()) + 1)
    pairs = order[np.concatenate([[True], stepped[1:] < np.minimum.accumulate(stepped)[:-1]])]
    best = np.stack([tfs[pairs], dl[pairs]], 1).astype("<u4").view(np.uint8)
    in_term = np.append(np.searchsorted(starts, firsts), len(starts)).astype(np.int32)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(in_term), values)
    return {
        "last": _binary(docs[np.append(starts[1:], n) - 1].astype("<i4").view(np.uint8), 4 * in_term.astype(np.int64)), "docs": lists(_narrow(gaps, starts, of)), "tfs": lists(_narrow(tfs, starts, of)),
        "best": lists(_binary(best, 8 * np.concatenate([[0], np.cumsum(np.bincount(of[pairs], minlength=len(starts)))]))),
    }


def build(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", pattern: str = TOKEN, shard_chunks: int = SHARD_CHUNKS, block: int = BLOCK) -> ImpactIndex:
    """The index of chunks(id, text); it is written once to the checkpoint folder."""
    spark = chunks.sparkSession
    total = chunks.count()
    shards = max(1, -(-total // shard_chunks))
    words = chunks.select(F.col(id_col).cast("string").alias("id"), tokens(F.col(text_col), pattern).alias("words"))
    dealt = words.select(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), "id", "words")
    dealt = dealt.repartition(min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", "id")
    kinds = pa.schema([("shard", pa.int32()), ("term", pa.string()), ("df", pa.int32()), ("last", pa.binary()), *[(c, pa.list_(pa.binary())) for c in ("docs", "tfs", "best")], ("ids", pa.list_(pa.string())), ("lengths", pa.binary())])

    def made(shard: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        lists = whole["words"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        names, n = coded.dictionary.to_pylist(), len(lengths)
        pairs, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
        term, doc = pairs // n, pairs % n
        none = lambda kind, n: pa.nulls(n, kind)
        own = {"shard": pa.array([shard], pa.int32()), "ids": pa.array([whole["id"].to_pylist()]), "lengths": pa.array([lengths.astype("<u4").tobytes()])}
        yield pa.RecordBatch.from_arrays([own.get(f.name, none(f.type, 1)) for f in kinds], schema=kinds)
        if len(term):
            firsts = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1])
            rows = post(firsts, doc, tf, lengths, block) | {"shard": pa.array(np.full(len(firsts), shard), pa.int32()), "term": pa.array([names[t] for t in term[firsts].tolist()]), "df": pa.array(np.diff(np.append(firsts, len(term))), pa.int32())}
            whole_batch = pa.RecordBatch.from_arrays([rows.get(f.name, none(f.type, len(firsts))) for f in kinds], schema=kinds)
            for at in range(0, len(firsts), 4096):
                yield whole_batch.slice(at, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = (np.flatnonzero(np.diff(shard)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if hi == lo:
                    continue
                if shard[lo] != now and parts:
                    yield from made(now, parts)
                    parts = []
                now = int(shard[lo])
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield from made(now, parts)

    written = cut_table(dealt.mapInArrow(run, f"{_POSTINGS}, ids array<string>, lengths binary"))
    postings = written.where("term is not null").select("shard", "term", "df", "last", "docs", "tfs", "best")
    docs = written.where("term is null").select("shard", "ids", "lengths")
    counted = chunks.agg(F.coalesce(F.sum(F.size(tokens(F.col(text_col), pattern))), F.lit(0)).alias("t")).first()["t"] if total else 0
    return ImpactIndex(postings, docs, total, counted, block)


class Blocks:
    """One term's postings in a shard; what is decoded is kept and counted."""

    def __init__(self, row: dict, idf: float, size: int) -> None:
        self.idf, self.df, self.size = idf, row["df"], size
        self.last = np.frombuffer(row["last"], "<i4").astype(np.int64)
        self.row, self.kept = row, {}

    def bounds(self, impact) -> np.ndarray:
        """The most that each block's chunks can get from this term."""
        out = np.zeros(len(self.last))
        for k, pairs in enumerate(self.row["best"]):
            out[k] = impact(*np.frombuffer(pairs, "<u4").astype(np.int64).reshape(-1, 2).T).max()
        return np.maximum(0.0, self.idf * out)

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.kept:
            n = self.size if k + 1 < len(self.last) else self.df - self.size * (len(self.last) - 1)
            docs = np.cumsum(widen(self.row["docs"][k], n) + 1) + (self.last[k - 1] if k else -1)
            self.kept[k] = docs, widen(self.row["tfs"][k], n)
        return self.kept[k]


def best_of_shard(terms: list[Blocks], lengths: np.ndarray, k: int, mean_length: float, k1: float, b: float, digits: int | None, zero_fill: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(numbers, scores, decoded blocks) of the k best chunks of a shard; ties go to the smaller number."""
    decoded = 0
    slack = 0.0 if digits is None else 10.0**-digits
    rounded = (lambda x: x) if digits is None else (lambda x: np.round(x, digits) + 0.0)

    def impact(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        length = dl / mean_length if mean_length > 0 else np.ones(len(dl))
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))

    found, found_scores = np.zeros(0, np.int64), np.zeros(0)
    if terms:
        ends = np.unique(np.concatenate([t.last for t in terms]))
        most = np.zeros(len(ends))
        block_of = []
        for t in terms:
            at = np.searchsorted(t.last, ends)
            block_of.append(at)
            most += np.concatenate([t.bounds(impact), [0.0]])[at]
        order = np.argsort(-most, kind="stable")
        at, step = 0, FIRST_INTERVALS
        scores, chosen = np.zeros(len(lengths)), np.zeros(len(ends), bool)
        while at < len(order):
            enough = np.partition(found_scores, len(found_scores) - k)[len(found_scores) - k] if len(found_scores) >= k else -np.inf
            if most[order[at]] < enough - slack - 1e-9 * abs(enough) and enough > 0:
                break
            some = order[at : at + step]
            at, step = at + step, step * 2
            chosen[:] = False
            chosen[some] = True
            touched = []
            for t, blocks in zip(terms, block_of, strict=True):
                for j in np.unique(blocks[some]).tolist():
                    if j == len(t.last):
                        continue
                    decoded += j not in t.kept
                    docs, tf = t.block(j)
                    inside = chosen[np.searchsorted(ends, docs)]
                    docs, tf = docs[inside], tf[inside]
                    scores[docs] += t.idf * impact(tf, lengths[docs])
                    touched.append(docs)
            new = np.unique(np.concatenate(touched)) if touched else found[:0]
            found, found_scores = np.concatenate([found, new]), np.concatenate([found_scores, rounded(scores[new])])
            keep = np.lexsort((found, -found_scores))[:k]
            found, found_scores = found[keep], found_scores[keep]
    if zero_fill and (found_scores > 0).sum() < k:  # every block is decoded then: no bound was below the k-th score
        mine = np.zeros(len(lengths), bool)
        for t in terms:
            for j in range(len(t.last)):
                mine[t.block(j)[0]] = True
        free = np.flatnonzero(~mine)[:k]
        found, found_scores = np.concatenate([found, free]), np.concatenate([found_scores, np.zeros(len(free))])
        keep = np.lexsort((found, -found_scores))[:k]
        found, found_scores = found[keep], found_scores[keep]
    return found, found_scores, decoded


def search(index: ImpactIndex, queries: DataFrame, k: int, zero_fill: bool = True, digits: int | None = None, k1: float = K1, b: float = B, counts: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): what lexical.search() finds. With counts, (query_id, shard, blocks, decoded) instead: how many blocks the
    query's terms have in each shard, and how many were decoded."""
    spark = queries.sparkSession
    wanted = queries.select(F.col("query_id").cast("string").alias("query_id"), F.array_distinct(tokens(F.col("text"))).alias("words")).where("query_id is not null")
    rows = wanted.limit(MOST_QUERIES + 1).collect()
    schema = "query_id string, shard int, blocks long, decoded long" if counts else "query_id string, chunk_id string, score double"
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: search them in parts")
    asked = spark.sparkContext.broadcast([(r["query_id"], list(r["words"] or [])) for r in rows])
    terms = spark.createDataFrame([(t,) for t in sorted({t for _, words in asked.value for t in words})], "term string")
    hits = index.postings.join(F.broadcast(terms), "term", "left_semi")
    idf = {r["term"]: float(np.log((index.n_total - r["df"] + 0.5) / (r["df"] + 0.5)) + 1) for r in hits.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weights, mean, size = spark.sparkContext.broadcast(idf), index.mean_length, index.block
    met = hits.unionByName(index.docs, allowMissingColumns=True)
    parts = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-index.n_total // 2048)))
    met = met.select("shard", F.col("term").isNotNull().alias("posts"), "term", "df", "last", "docs", "tfs", "best", "ids", "lengths").repartition(parts, "shard").sortWithinPartitions("shard", "posts")

    def answer(shard: int, ids: pa.Array, lengths: np.ndarray, posts: dict[str, dict]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for query, words in asked.value:
            own = [Blocks(posts[w], weights.value[w], size) for w in words if w in posts]
            docs, scores, decoded = best_of_shard(own, lengths, k, mean, k1, b, digits, zero_fill)
            if counts:
                out.append((query, shard, sum(len(t.last) for t in own), decoded))
            else:
                out += zip([query] * len(docs), ids.take(pa.array(docs)).to_pylist(), scores.tolist(), strict=True)
        if out:
            fields = schema.split(", ")
            types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(c, types[f.split()[1]]) for c, f in zip(zip(*out, strict=True), fields, strict=True)], names=[f.split()[0] for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, lengths, posts = None, None, None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                shard = batch.column(0)[r].as_py()
                if shard != now:
                    if now is not None:
                        yield from answer(now, ids, lengths, posts)
                    now, posts = shard, {}
                if batch.column(1)[r].as_py():
                    posts[batch.column(2)[r].as_py()] = {c: batch.column(c)[r].as_py() for c in ("df", "last", "docs", "tfs", "best")}
                else:
                    ids = batch.column("ids")[r].values
                    lengths = np.frombuffer(batch.column("lengths")[r].as_py(), "<u4").astype(np.int64)
        if now is not None:
            yield from answer(now, ids, lengths, posts)

    found = met.mapInArrow(run, schema)
    return found if counts else top_k(found, k)
