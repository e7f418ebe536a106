"""N-gram Jaccard join: which documents have word-shingle sets of at least a given Jaccard similarity.

1. Equal sets collapse by a 128-bit signature into their smallest document.
2. Shingle frequencies over all documents, in a sketch of fixed size, order shingles rare first. Two sets
   that link share a shingle among the first n - ceil(t * n) + 1 of each (prefix filter).
3. Star round: within a posting list and length class each document meets one hub only, the document with the
   fewest rarer shingles before this one, and only its most frequent hub is verified. Large groups of near
   copies join up in linear work.
4. Exact round: in posting lists that still hold several components, every pair of documents of different
   components that passes the length, positional and suffix filters is verified, each pair once. Pairs inside
   a component need no check: they cannot change it. Lists are met by length class, and a long one is dealt
   by document, so that no task holds the list of a shingle that very many different documents have.
5. Components of the verified links.

Defined results: null and empty texts, and texts without words, have an empty set and link with nothing;
a text with fewer words than a shingle has its whole word sequence as its one shingle; rows that share an
id are one document; a row without an id takes part in no link; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import append_column, lower_ascii_table, mix, text_slices, window_hashes, word_bounds, word_hashes
from foliant.llm.components import connected
from foliant.session import bound_batches, cut

#: Counters of the frequency sketch: 8 bytes each, whatever the size of the corpus.
SKETCH = 1 << 20
_CHUNK = 1 << 12
_BUCKETS = 64
#: Ids up to which a table of ids is broadcast (8 MB); beyond, the semi join is shuffled.
BROADCAST_IDS = 500_000
#: Sets of a posting list that one part of it pairs with the whole list; longer lists have more parts.
PART = 1000

_IS_WORD, _LOW = lower_ascii_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, row of each shingle, shingle): distinct shingles as 64-bit hashes, sorted within each row."""
    for at, end, raw, offs in text_slices(column):
        buf = _LOW[raw]
        starts, ends, firsts = word_bounds(buf, offs, _IS_WORD)
        words = word_hashes(buf, starts, ends)
        per_row = np.diff(firsts)
        hashes = window_hashes(words, size)
        row_of = np.repeat(np.arange(end - at), per_row)
        keep = row_of[: len(hashes)] == row_of[size - 1 :] if len(hashes) else np.zeros(0, bool)
        rows, values = [row_of[: len(hashes)][keep]], [hashes[keep]]
        for n in range(1, size):  # rows of fewer words than a shingle
            short = np.flatnonzero(per_row == n)
            if len(short):
                whole = np.zeros(len(short), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(n):
                        whole = mix(whole + words[firsts[short] + k] + np.uint64(n))
                rows.append(short)
                values.append(whole)
        row, value = np.concatenate(rows), np.concatenate(values)
        if len(rows) > 1:
            order = np.argsort(row, kind="stable")
            row, value = row[order], value[order]
        if len(row):
            cuts = np.searchsorted(row, np.arange(end - at + 1)).tolist()
            for s, e in zip(cuts, cuts[1:], strict=False):
                value[s:e].sort()
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
            row, value = row[new], value[new]
        yield end - at, row, value


def frequencies(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """In how many documents the shingles of each counter occur, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, value in shingle_sets(batch.column(0), size):
                total += np.bincount((value >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
        if total.any():
            parts = total.reshape(-1, _CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])

    bound_batches(docs.sparkSession)
    schema = "chunk int, counts binary"
    sums = docs.select(text).mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema)
    out = np.zeros((SKETCH // _CHUNK, _CHUNK), np.int64)
    for chunk, counts in sums.collect():
        out[chunk] += np.frombuffer(counts, np.int64)
    return out.ravel()


_SUMMARY = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("sig1", T.LongType()),
        T.StructField("sig2", T.LongType()),
        T.StructField("prefix", T.ArrayType(T.LongType())),
        T.StructField("spread", T.ArrayType(T.IntegerType())),
    ]
)


def _summaries(column: pa.Array, size: int, counts: np.ndarray, share: tuple[int, int]) -> pa.Array:
    """Per row: size of the set, signature, rare-first prefix and the set's spread over hash buckets."""
    parts = []
    usual = max(1, int(counts.sum()) // SKETCH)  # counters at the usual load say nothing; only heavier ones order
    for rows, row, value in shingle_sets(column, size):
        n = np.bincount(row, minlength=rows)
        first = np.cumsum(n) - n
        with np.errstate(over="ignore"):
            ones, twos = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(k)))]) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
            sig1, sig2 = ones[first + n] - ones[first], twos[first + n] - twos[first]
        spread = np.bincount(row * _BUCKETS + ((value >> np.uint64(8)) % np.uint64(_BUCKETS)).astype(np.int64), minlength=rows * _BUCKETS)
        length = np.where(n > 0, n - (-(-n * share[0] // share[1])) + 1, 0)
        rank = (np.minimum(counts[(value >> np.uint64(44)).astype(np.int64)] // usual, 255).astype(np.uint64) << np.uint64(56)) | (value >> np.uint64(8))
        chosen = [s + np.argsort(rank[s : s + k], kind="stable")[:p] for s, k, p in zip(first.tolist(), n.tolist(), length.tolist(), strict=True) if k]
        prefix = value[np.concatenate(chosen)] if chosen else value
        parts.append(
            pa.StructArray.from_arrays(
                [
                    pa.array(n, pa.int64()),
                    pa.array(sig1.view(np.int64)),
                    pa.array(sig2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(prefix.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * _BUCKETS, pa.int32()), pa.array(spread, pa.int32())),
                ],
                names=[f.name for f in _SUMMARY],
            )
        )
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("spread", pa.list_(pa.int32()))]))


def _sets(column: pa.Array, size: int) -> pa.Array:
    out: list[bytes] = []
    for rows, row, value in shingle_sets(column, size):
        ends = np.searchsorted(row, np.arange(rows + 1))
        out += [value[ends[r] : ends[r + 1]].tobytes() for r in range(rows)]
    return pa.array(out, pa.binary())


def _semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df's rows with their key in ids; ids are broadcast only if they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """(a, b) of the pairs whose sets link. Sets are made again for the documents of the pairs only."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = append_column(_semi(docs, ids, "id"), "text", "set", T.BinaryType(), lambda c: _sets(c, size)).select("id", "set")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both > 0 and share[1] * both >= share[0] * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("id").alias(k), F.col("set").alias(f"set_{k}")) for k in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(check, pairs.select("a", "b").schema).distinct()


def _can_link(n_a: str, n_b: str, share: tuple[int, int]) -> str:
    return f"{share[1]}L * least({n_a}, {n_b}) >= {share[0]}L * greatest({n_a}, {n_b})"


def _candidates(posting: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b), each pair once: sets of different components with a shingle of posting(token, rep, n, pos, component) in
    common whose lengths and places let them link. The smaller set of a pair stays in its length class, the other comes
    from the same or the next one."""
    ratio = share[1] / share[0]
    # classes a hair wider than the ratio: no rounding puts a class between two sets that can link
    grade = F.floor(F.log("n") / F.lit(math.log(ratio) * (1 + 1e-9))) if ratio > 1 else F.col("n").cast("long")
    own = posting.withColumn("grade", grade)
    met = own.withColumn("met", F.explode(F.array(F.col("grade"), F.col("grade") - 1) if ratio > 1 else F.array("grade")))
    lists = cut(
        met.groupBy("token", "met").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count_if(F.col("met") == F.col("grade")).alias("smaller"))
        .where("low < high and smaller > 0").select("token", F.col("met").alias("list"), F.ceil(F.col("smaller") / PART).alias("parts"))
    )
    # joined by one hash of (shingle, class, part): equal columns below would pass for its partitioning and leave long lists whole
    shape = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("rep", "n", "pos", "component", "grade")]
    left = own.withColumn("list", F.col("grade")).join(lists, ["token", "list"])
    left = left.select(F.xxhash64("token", "list", F.pmod(F.xxhash64("rep"), "parts")).alias("deal"), *shape("a"))
    right = met.withColumnRenamed("met", "list").join(lists, ["token", "list"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    right = right.select(F.xxhash64("token", "list", "part").alias("deal"), *shape("b"))
    # at the first shingle that two sets share, what is left of either must hold all that they need to share
    bound = f"{share[1] + share[0]}L * least(n_a - pos_a, n_b - pos_b) >= {share[0]}L * (n_a + n_b)"
    return (
        left.join(right, "deal").where("component_a <> component_b and (grade_a < grade_b or rep_a < rep_b)").where(_can_link("n_a", "n_b", share)).where(bound)
        .select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
    )


def _spread_filter(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs that can still link by what their sets may have in common in each hash bucket, as a suffix
    filter with fixed pivots: the common part is at most the sum of the smaller counts."""
    shape = lambda k: sets.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("spread").alias(f"spread_{k}"))
    most = F.aggregate(F.zip_with("spread_a", "spread_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return (
        pairs.join(shape("a"), "a").join(shape("b"), "b")
        .where(F.lit(share[1] + share[0]) * most >= F.lit(share[0]) * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    )


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, share: tuple[int, int] = (90, 100)) -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of docs. Two documents link when
    share[1] * |A and B| >= share[0] * |A or B| over their shingle sets."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    counts = spark.sparkContext.broadcast(frequencies(own, "text", size))
    summed = append_column(own, "text", "s", _SUMMARY, lambda c: _summaries(c, size, counts.value, share))
    rows = cut(summed.select("id", "s.*"))
    sets = (
        rows.where("n > 0 and id is not null").groupBy("sig1", "sig2")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("spread").alias("spread"))
    )
    sets = cut(sets)
    # length classes: sizes of one class are near enough to link
    ratio = share[1] / share[0]
    grade = F.floor(F.log("n") / F.log(F.lit(ratio))) if ratio > 1 else F.col("n")
    every = sets.select("rep", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    # aggregates are written before they are joined: a join that shares their exchange cannot split a hot shingle
    shared = cut(every.groupBy("token").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("token"))
    posting = cut(every.join(shared, "token"))

    # star round
    posting_grade = posting.withColumn("grade", grade)
    lists = cut(
        posting_grade.groupBy("token", "grade").agg(F.min(F.struct("pos", "rep")).alias("hub"), F.min("rep").alias("low"), F.max("rep").alias("high"))
        .where("low < high").select("token", "grade", F.col("hub.rep").alias("hub"))
    )
    stars = (
        posting_grade.select("token", "grade", "rep").join(lists, ["token", "grade"]).where("rep <> hub")
        .groupBy("rep", "hub").count()
        .groupBy("rep").agg(F.max(F.struct("count", F.negative("hub").alias("hub"))).alias("best"))
        .select(F.negative("best.hub").alias("a"), F.col("rep").alias("b"))
    )
    stars = cut(_spread_filter(stars, sets, share))
    found = cut(_verified(stars, own, size, share))
    labels = connected(found)

    # exact round, in lists of several components
    marked = sets.select("rep").join(labels, sets["rep"] == labels["node"], "left").select("rep", F.coalesce("component", "rep").alias("component"))
    labelled = cut(posting.join(marked, "rep"))
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(_spread_filter(_candidates(labelled, share).join(tested, ["a", "b"], "left_anti"), sets, share))
    if not pairs.isEmpty():
        labels = connected(found.unionByName(_verified(pairs, own, size, share)))

    reps = sets.join(labels, sets["rep"] == labels["node"], "left").select("sig1", "sig2", F.coalesce("component", "rep").alias("component"))
    out = rows.join(reps, ["sig1", "sig2"], "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id")
    )
    # rows of one id are one document: where their texts differ, the id links the texts' components
    own_set = F.struct(F.col("n") > 0, "sig1", "sig2")
    several = cut(rows.where("id is not null").groupBy("id").agg(F.min(own_set).alias("low"), F.max(own_set).alias("high")).where("low < high").select("id"))
    if several.isEmpty():
        return out
    held = out.join(several, "id", "left_semi")
    links = held.join(held.groupBy("id").agg(F.min("component_id").alias("a")), "id").select("a", F.col("component_id").alias("b"))
    merged = connected(links).select(F.col("node").alias("component_id"), F.col("component").alias("joined"))
    return out.join(merged, "component_id", "left").select("id", "n_shingles", F.coalesce("joined", "component_id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    out = cluster(docs)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with the smallest document of each group of near copies, and every document that has none.
    Rows without an id stay."""
    groups = cluster(docs, doc_id, text, size, share)
    gone = cut(groups.where("id <> component_id").select(F.col("id").alias(doc_id)).distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, doc_id, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(len(ws), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS f FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(f, 1), g) AS pos FROM s JOIN n USING (doc_id) LEFT JOIN f USING (g)),
p AS (SELECT doc_id, g FROM r JOIN f USING (g) WHERE pos <= n - (90 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id),
i AS (SELECT a, b, count(*) AS k FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT t.node, e.b FROM t JOIN e ON e.a = t.seen)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS c FROM t GROUP BY node) m ON m.node = d.doc_id
"""
