"""Matching the leaves of a tree with the chunks of its paper by text, as joins instead of all pairs of a paper.

Texts that occur several times are one: links are made between different texts. Links are, best first,
  equal texts;
  one text, of LEAST_CONTAINED characters or more, inside the other;
  texts much like each other (alike).

Equal texts meet in the group of their digest, the first with the first; that needs no order among links, since a text has one equal at most. Only texts that then
are left over take part in the rest.

Containment is joined on anchors: of every run of WINDOW grams the least hash is an anchor, so a text that stands in another has all anchors of its runs
there. A text asks by the anchor of its own that a sketch of fixed size counts least on the other side, or not at all if one is missing there.
Anchors of the other side are rows only if a bit table has them as asked for.

Links are taken best first, one leaf with one chunk, as a stream sorted within each paper that holds how many of each text are taken."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import collapse
from foliant.operators import alike as likeness
from foliant.operators.alike import LEAST_CONTAINED, text_bytes
from foliant.session import bound_batches, cut_table

# What a link of each kind counts.
EXACT, CONTAINED, CONTAINS = 3.0, 2.0, 1.8
#: Bytes of a gram, and grams of a run: a run is LEAST_CONTAINED bytes.
GRAM = 16
WINDOW = LEAST_CONTAINED - GRAM + 1
#: Bytes whose anchors are found at once, besides one text.
STEP = 1 << 20
#: Counters of the sketch, for each side, and of a part of it.
SKETCH, PART = 1 << 21, 1 << 14
#: Bits of a bit table for each value, at most and at least (as powers of two), and of a slice.
BITS_PER_VALUE, MOST_BITS, LEAST_BITS, SLICE_BITS = 16, 29, 19, 19


def anchors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, anchor) of texts, in order, steps of whole texts; none of a text shorter than a run. Anchors that follow each other differ."""
    raw, offsets = text_bytes(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, "right")) - 1)
        edges = offsets[at : to + 1] - offsets[at]
        grams = raw[offsets[at] : offsets[to]].astype(np.uint64) + np.uint64(1)
        if len(grams) >= LEAST_CONTAINED:
            with np.errstate(over="ignore"):
                for k in (1, 2, 4, 8):
                    grams = grams[:-k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) + grams[k:]
                grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                grams ^= grams >> np.uint64(32)
            for k in (1, 2, 4, 8, WINDOW - 16):
                grams = np.minimum(grams[:-k], grams[k:])
            start = np.arange(len(grams))
            row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: len(grams)]
            inside = start + LEAST_CONTAINED <= edges[row + 1]
            new = np.append(True, grams[1:] != grams[:-1])
            new[edges[:-1][edges[:-1] < len(new)]] = True
            keep = np.flatnonzero(new & inside)
            yield at + row[keep], grams[keep]
        at = to


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _salted(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, is_leaf, anchor within its paper) of a batch of salt, is_leaf, flat, ..."""
    salt, side = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    for row, anchor in anchors(batch.column(2)):
        with np.errstate(over="ignore"):
            yield row, side[row], _mixed(anchor + salt[row])


def _slots(side: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return side * SKETCH + (anchor >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def _sketch(texts: DataFrame) -> np.ndarray:
    """How many anchors of chunks, then of leaves, each counter has, up to 255 of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SKETCH, np.uint32)
        for batch in batches:
            for _, side, anchor in _salted(batch):
                slot, n = np.unique(_slots(side, anchor), return_counts=True)
                total[slot] += n.astype(np.uint32)
        parts = total.reshape(-1, PART)
        full = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([np.minimum(parts[k], 255).astype(np.uint8).tobytes() for k in full], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, np.uint32(0)) + np.frombuffer(counts, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    out = np.zeros((2 * SKETCH // PART, PART), np.uint32)
    for part, counts in texts.select("salt", "is_leaf", "flat").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).toLocalIterator():
        out[part] += np.frombuffer(counts, np.uint32)
    return out.ravel()


def _places(side: np.ndarray, value: np.ndarray, bits: int) -> np.ndarray:
    """Where values of a side stand in a table of 2 ** bits bits."""
    return (_mixed(value ^ (side.astype(np.uint64) << np.uint64(63))) >> np.uint64(64 - bits)).astype(np.int64)


def _bit_table(values: DataFrame) -> np.ndarray:
    """A table of bytes with the bits of values(is_leaf, long). Each task makes whole slices of it."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_VALUE * values.count()).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at >> SLICE_BITS), pa.array(at & (1 << SLICE_BITS) - 1)], names=["slice", "at"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slices, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(slices).tolist():
                held.setdefault(k, np.zeros(1 << SLICE_BITS, bool))[at[slices == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(v).tobytes() for v in held.values()], pa.binary())], names=["slice", "bytes"])

    table = np.zeros(1 << bits >> 3, np.uint8)
    for k, held in values.mapInArrow(place, "slice long, at long").repartition("slice").mapInArrow(fill, "slice long, bytes binary").toLocalIterator():
        table[k << SLICE_BITS >> 3 : (k + 1) << SLICE_BITS >> 3] = np.frombuffer(held, np.uint8)
    return table


def _has(table: np.ndarray, side: np.ndarray, value: np.ndarray) -> np.ndarray:
    at = _places(side, value, len(table).bit_length() + 2)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _inside(texts: DataFrame) -> DataFrame:
    """(paper_id, is_leaf, short, long): texts of one side, is_leaf if that is the leaves', that stand in another text of the other side."""
    spark = texts.sparkSession
    bound_batches(spark)
    texts = texts.where(F.length("flat") >= LEAST_CONTAINED).select(F.xxhash64("paper_id").alias("salt"), "is_leaf", "flat", "paper_id", "key")
    counts = spark.sparkContext.broadcast(_sketch(texts))
    kind = f"paper_id {texts.schema['paper_id'].dataType.simpleString()}, key {texts.schema['key'].dataType.simpleString()}, is_leaf boolean, anchor long, before long, after long"

    def chosen(batch: pa.RecordBatch, at: np.ndarray, row: np.ndarray, side: np.ndarray, anchor: np.ndarray) -> pa.RecordBatch:
        """The anchors at these places, each with those beside it in its text (0: none)."""
        same = row[1:] == row[:-1]
        beside = [np.append(np.uint64(0), np.where(same, anchor[:-1], np.uint64(0))), np.append(np.where(same, anchor[1:], np.uint64(0)), np.uint64(0))] if len(row) else [anchor, anchor]
        rows = pa.array(row[at])
        return pa.RecordBatch.from_arrays([batch.column(3).take(rows), batch.column(4).take(rows), pa.array(side[at] > 0), *(pa.array(x[at].view(np.int64)) for x in (anchor, *beside))], names=["paper_id", "key", "is_leaf", "anchor", "before", "after"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, side, anchor in _salted(batch):
                often = counts.value[_slots(1 - side, anchor)]
                order = np.lexsort((anchor, often, row))
                first = order[np.append(True, row[order][1:] != row[order][:-1])] if len(order) else order
                yield chosen(batch, first[often[first] > 0], row, side, anchor)

    asks = cut_table(texts.mapInArrow(ask, kind))
    asked = spark.sparkContext.broadcast(_bit_table(asks.select("is_leaf", "anchor")))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, side, anchor in _salted(batch):
                yield chosen(batch, np.flatnonzero(_has(asked.value, 1 - side, anchor)), row, 1 - side, anchor)

    there = texts.mapInArrow(answer, kind)
    there = there.select("paper_id", "is_leaf", "anchor", F.col("key").alias("long"), F.col("before").alias("left"), F.col("after").alias("right"))
    # what stands inside has the same anchors beside each of its own, as far as it goes
    met = asks.withColumnRenamed("key", "short").join(there, ["paper_id", "is_leaf", "anchor"]).where("before in (0, left) and after in (0, right)")
    pairs = cut_table(met.select("paper_id", "is_leaf", "short", "long").distinct())
    # of their texts, and few others, a row
    wanted = pairs.select("is_leaf", F.xxhash64("paper_id", "short").alias("value")).unionByName(pairs.select(F.expr("not is_leaf").alias("is_leaf"), F.xxhash64("paper_id", "long").alias("value")))
    held = spark.sparkContext.broadcast(_bit_table(wanted))

    @F.pandas_udf("boolean")
    def is_wanted(side: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series(_has(held.value, side.to_numpy(), value.to_numpy().view(np.uint64)))

    texts = texts.where(is_wanted("is_leaf", F.xxhash64("paper_id", "key")))
    text = lambda name, side: texts.select("paper_id", F.expr(side).alias("is_leaf"), F.col("key").alias(name), F.col("flat").alias(f"{name}_text"))
    both = pairs.join(text("short", "is_leaf"), ["paper_id", "is_leaf", "short"]).join(text("long", "not is_leaf"), ["paper_id", "is_leaf", "long"])
    return both.where((F.length("short_text") < F.length("long_text")) & F.contains("long_text", F.col("short_text"))).select("paper_id", "is_leaf", "short", "long")


def links(texts: DataFrame, alike: bool = True) -> DataFrame:
    """(paper_id, leaf, chunk, score) between different texts(paper_id, is_leaf, key, flat), the best score of each pair."""
    own, other = F.when(F.col("is_leaf"), F.col("short")).otherwise(F.col("long")), F.when(F.col("is_leaf"), F.col("long")).otherwise(F.col("short"))
    every = _inside(texts).select("paper_id", own.alias("leaf"), other.alias("chunk"), F.when(F.col("is_leaf"), CONTAINED).otherwise(CONTAINS).alias("score"))
    if alike:
        every = every.unionByName(likeness.links(texts.where("is_leaf"), texts.where("not is_leaf")).withColumnRenamed("ratio", "score"))
    return every.groupBy("paper_id", "leaf", "chunk").agg(F.max("score").alias("score"))


def take_best(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(paper_id, leaf, chunk, score, leaf_from, chunk_from, n): links best first, then by the place of the leaf and of the chunk; each matches as many of
    both texts(paper_id, is_leaf, key, id, first, n, taken) as are left."""
    side = lambda which, name: texts.where(which).select("paper_id", F.col("key").alias(name), F.struct("first", "id").alias(f"{name}_first"), F.col("n").alias(f"{name}_n"), F.col("taken").alias(f"{name}_taken"))
    ordered = found.join(side("is_leaf", "leaf"), ["paper_id", "leaf"]).join(side("not is_leaf", "chunk"), ["paper_id", "chunk"])
    ordered = ordered.repartition("paper_id").sortWithinPartitions("paper_id", F.desc("score"), "leaf_first", "chunk_first").select("paper_id", "leaf", "chunk", "score", "leaf_n", "chunk_n", "leaf_taken", "chunk_taken")
    kinds = {c: ordered.schema[c].dataType.simpleString() for c in ("paper_id", "leaf", "chunk")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken_leaf, taken_chunk = None, {}, {}
        for batch in batches:
            out = []
            for paper, leaf, chunk, score, leaf_n, chunk_n, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if paper != now:
                    now, taken_leaf, taken_chunk = paper, {}, {}
                a, b = taken_leaf.get(leaf, a), taken_chunk.get(chunk, b)
                n = min(leaf_n - a, chunk_n - b)
                if n > 0:
                    taken_leaf[leaf], taken_chunk[chunk] = a + n, b + n
                    out.append((paper, leaf, chunk, score, a, b, n))
            if out:
                names = ["paper_id", "leaf", "chunk", "score", "leaf_from", "chunk_from", "n"]
                types = [batch.schema.field(c).type for c in ("paper_id", "leaf", "chunk")] + [pa.float64(), *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return ordered.mapInArrow(run, f"paper_id {kinds['paper_id']}, leaf {kinds['leaf']}, chunk {kinds['chunk']}, score double, leaf_from long, chunk_from long, n long")


def _members(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, key, is_leaf, id, position, rank, n, taken, flat): every leaf and chunk with text. key is the digest of its text, rank its place among the n of its side
    that have this text, taken how many of them have an equal on the other side; flat is kept by the first if others are left over."""
    side = lambda rows, name, leaf: rows.where(F.col("paper_id").isNotNull() & F.col("text").rlike(r"[^\s\x{00A0}]")).select("paper_id", F.lit(leaf).alias("is_leaf"), F.col(name).alias("id"), "position", F.lower(collapse(F.col("text"))).alias("flat"))
    rows = side(nodes, "node_id", True).unionByName(side(chunks, "chunk_id", False)).withColumn("key", F.substring(F.unhex(F.sha2("flat", 256)), 1, 16))
    same = Window.partitionBy("paper_id", "key").orderBy(F.desc("is_leaf"), "position", "id")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", F.row_number().over(same).cast("long").alias("place"), F.sum(F.col("is_leaf").cast("long")).over(whole).alias("leaves"), F.count("*").over(whole).alias("every"))
    rows = rows.withColumn("rank", F.col("place") - F.when(F.col("is_leaf"), 0).otherwise(F.col("leaves")))
    n = F.when(F.col("is_leaf"), F.col("leaves")).otherwise(F.col("every") - F.col("leaves"))
    rows = rows.withColumn("n", n).withColumn("taken", F.least(F.col("leaves"), F.col("every") - F.col("leaves")))
    return cut_table(rows.select("paper_id", "key", "is_leaf", "id", "position", "rank", "n", "taken", F.when((F.col("rank") == 1) & (F.col("n") > F.col("taken")), F.col("flat")).alias("flat")))


def match(nodes: DataFrame, chunks: DataFrame, alike: bool = True) -> DataFrame:
    """(paper_id, node_id, chunk_id, score): leaves(paper_id, node_id, position, text) with chunks(paper_id, chunk_id, position, text), one to one; of
    equal texts the first with the first."""
    members = _members(nodes, chunks)
    side = lambda which, text, rank, name: members.where(which).select("paper_id", F.col("key").alias(text), F.col("rank").alias(rank), F.col("id").alias(name))
    equal = side("is_leaf and rank <= taken", "key", "rank", "node_id").join(side("not is_leaf and rank <= taken", "key", "rank", "chunk_id"), ["paper_id", "key", "rank"])
    texts = members.where("rank = 1 and n > taken").withColumnRenamed("position", "first")
    taken = take_best(links(texts, alike), texts).select("paper_id", "leaf", "chunk", "score", "leaf_from", "chunk_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    rows = taken.select("paper_id", "leaf", "chunk", "score", (F.col("leaf_from") + F.col("k")).alias("leaf_rank"), (F.col("chunk_from") + F.col("k")).alias("chunk_rank"))
    rows = rows.join(side("is_leaf and rank > taken", "leaf", "leaf_rank", "node_id"), ["paper_id", "leaf", "leaf_rank"]).join(side("not is_leaf and rank > taken", "chunk", "chunk_rank", "chunk_id"), ["paper_id", "chunk", "chunk_rank"])
    columns = ["paper_id", "node_id", "chunk_id", "score"]
    return equal.withColumn("score", F.lit(EXACT)).select(columns).unionByName(rows.select(columns))
