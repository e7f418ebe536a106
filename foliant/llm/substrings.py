"""Substring dedup: words covered by a run of words that an earlier document has too.

A window is a run of 13 words. Documents are the reference and the stream at once, so nothing of them can be
broadcast; instead both come together in bounded shards:

1. Every window has an anchor, the 4-word run inside it with the least hash. Neighbouring windows with one anchor
   form a segment; equal windows have equal anchors, wherever they stand.
2. Anchors of two documents or more are kept (partial aggregation). A bit table of them, of bounded size, drops most
   other segments where they are made; the join drops the rest. Segments of anchors with more rows than a share of a
   partition are dealt by document, so that no task holds a hot anchor.
   Equal segments of an anchor collapse into one with its smallest document.
3. An anchor with several different segments is a reference shard: a suffix automaton of its segments holds the
   smallest document of each state, and each segment is streamed through it for matching statistics, which
   give the smallest document that holds each of its windows. Anchors with more segments than a shard may
   hold are resolved window by window in a grouped aggregation.
4. A window is removed where that document is smaller than its own; removed windows unite to maximal spans.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; rows of one
doc_id are never each other's earlier document; rows of one doc_id with different texts are kept apart by
33 bits of a text hash, equal rows are one; a row without a doc_id loses nothing and removes nothing; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import append_column, free_name, lower_ascii_table, mix, text_slices, window_hashes, word_bounds, word_hashes
from foliant.session import bound_batches, cut_table, drop_tables

WINDOW = 13
ANCHOR = 4
#: Different segments of one anchor that an automaton may hold.
SHARD_SEGMENTS = 2000
#: Bits of the table of shared anchors: this many for each, up to 2 ** MOST_BITS (64 MB). Beyond, it lets more pass, which
#: the join drops.
BITS_PER_ANCHOR, LEAST_BITS, MOST_BITS = 16, 16, 29
_SLICE_BITS = 16

_IS_WORD, _ = lower_ascii_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))


class SuffixAutomaton:
    """Of several word sequences; each state knows the smallest document that holds its runs."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.low = [-1], [0], [None]

    def add(self, words: list[str], doc) -> None:
        """Extends by a sequence; sequences come with their documents in ascending order, so a state's first
        document is its smallest."""
        nexts, link, length, low = self.next, self.link, self.length, self.low
        last = 0
        for w in words:
            known = nexts[last].get(w)
            if known is None:
                new = len(link)
                nexts.append({})
                length.append(length[last] + 1)
                link.append(0)
                low.append(doc)
                at = last
                while at >= 0 and w not in nexts[at]:
                    nexts[at][w] = new
                    at = link[at]
                if at >= 0:
                    there = nexts[at][w]
                    link[new] = there if length[there] == length[at] + 1 else self._split(at, there, w)
                last = new
            elif length[known] == length[last] + 1:
                last = known
            else:
                last = self._split(last, known, w)

    def _split(self, at: int, there: int, w: str) -> int:
        clone = len(self.link)
        self.next.append(self.next[there].copy())
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[there])
        self.low.append(self.low[there])
        self.link[there] = clone
        while at >= 0 and self.next[at].get(w) == there:
            self.next[at][w] = clone
            at = self.link[at]
        return clone

    def lows(self, words: list[str], size: int) -> list:
        """The smallest document of each run of size words, by matching statistics: the longest run that ends
        at each word and is known, and the state that it leads to."""
        nexts, link, length, low = self.next, self.link, self.length, self.low
        out, state, n = [], 0, 0
        for k, w in enumerate(words):
            to = nexts[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nexts[state].get(w)
            if to is not None:
                state, n = to, n + 1
            while state and length[link[state]] >= size:
                state = link[state]
                n = length[state]
            if k >= size - 1:
                out.append(low[state] if n >= size else None)
        return out


def _steps(column: pa.Array) -> Iterator[tuple]:
    """(first row, rows, bytes, word starts, word ends, first word of each row + total) of each step."""
    for at, end, buf, offs in text_slices(column):
        starts, ends, firsts = word_bounds(buf, offs, _IS_WORD)
        yield at, end - at, buf, starts, ends, firsts


_PLACE_BITS = 30  # a text has at most 2**30 words


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark): mark tells texts of one id apart."""
    return docs.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), _PLACE_BITS + 1).alias("mark"))


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int]]:
    """All words of a step joined by one space, and where each starts, and the end + 1."""
    lengths = ends - starts + 1
    begin = np.cumsum(lengths) - lengths
    flat = np.full(int(lengths.sum()), 0x20, np.uint8)
    if len(starts):
        word = np.ones(len(flat), bool)
        word[begin + lengths - 1] = False
        flat[word] = buf[(np.repeat(starts - begin, lengths) + np.arange(len(flat)))[word]]
    return flat.tobytes(), np.append(begin, len(flat)).tolist()


def _bit_places(anchors: np.ndarray, bits: int) -> np.ndarray:
    """Where anchors stand in a table of 2 ** bits bits; they are least hashes, so their bits are mixed first."""
    return (mix(anchors.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _bit_table(anchors: DataFrame, n: int) -> np.ndarray:
    """A table of bytes with the bits of anchors(anchor). Each task makes whole slices of it; slices are disjoint."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_ANCHOR * n).bit_length()))
    places = F.pmod("place", F.lit(1 << _SLICE_BITS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bit_places(batch.column(0).to_numpy(), bits))], names=["place"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slices, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(slices).tolist():
                held.setdefault(k, np.zeros(1 << _SLICE_BITS, bool))[at[slices == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(v).tobytes() for v in held.values()], pa.binary())], names=["slice", "bytes"])

    placed = anchors.select("anchor").mapInArrow(place, "place long").select(F.shiftright("place", _SLICE_BITS).alias("slice"), places.alias("at"))
    table = np.zeros(1 << bits >> 3, np.uint8)
    for k, held in placed.repartition("slice").mapInArrow(fill, "slice long, bytes binary").collect():
        table[k << _SLICE_BITS >> 3 : (k + 1) << _SLICE_BITS >> 3] = np.frombuffer(held, np.uint8)
    return table


def _in_table(anchors: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = _bit_places(anchors, len(table).bit_length() + 2)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _segments(batch: pa.RecordBatch, size: int, anchor: int, table: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    ids, marks = batch.column(0), batch.column(2).to_numpy()
    reach = size - anchor + 1
    for at, rows, buf, starts, ends, firsts in _steps(batch.column(1)):
        words = word_hashes(buf, starts, ends)
        grams, whole = window_hashes(words, anchor), window_hashes(words, size)
        if not len(whole):
            continue
        row = np.repeat(np.arange(rows), np.diff(firsts))
        least, where = grams[: len(whole)].copy(), np.zeros(len(whole), np.int64)
        for k in range(1, reach):
            here = grams[k : k + len(whole)]
            less = here < least
            np.copyto(least, here, where=less)
            where[less] = k
        place = np.arange(len(whole)) + where
        inside = row[: len(whole)] == row[size - 1 :]
        new = np.ones(len(whole), bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1 : len(whole)] != row[: len(whole) - 1]) | ~inside[:-1]
        bounds = np.append(np.flatnonzero(new | ~inside), len(whole))
        first = np.flatnonzero(new & inside)
        if table is not None:
            first = first[_in_table(least[first], table)]
        if not len(first):
            continue
        last = bounds[np.searchsorted(bounds, first, "right")]  # windows of a segment are [first, last)
        count = last - first
        r = row[first]
        with np.errstate(over="ignore"):
            content = mix(whole[first] * np.uint64(0x9E3779B97F4A7C15) + mix(whole[last - 1] + count.astype(np.uint64)))
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at + r)), pa.array((marks[at + r] << _PLACE_BITS) | (first - firsts[r])), pa.array(count, pa.int32()), pa.array(least[first].view(np.int64)), pa.array(content.view(np.int64))],
            names=["doc_id", "at", "count", "anchor", "content"],
        )


def _segment_rows(docs: DataFrame, size: int, anchor: int, table: np.ndarray | None = None) -> DataFrame:
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _segments(batch, size, anchor, shared.value)

    return _marked(docs.where("doc_id is not null")).mapInArrow(run, f"doc_id {kind}, at long, count int, anchor long, content long")


def _words_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(anchor, content, low, words) of the wanted segments (doc_id, mark, parts: at, count, anchor, content, low)."""
    with_parts = _marked(docs).join(wanted, ["doc_id", "mark"]).select("doc_id", "text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(2).to_pylist()
            out = []
            for at, rows, buf, starts, ends, firsts in _steps(batch.column(1)):
                joined, edges = _joined(buf, starts, ends)
                for r in range(rows):
                    for p in parts[at + r]:
                        a = int(firsts[r]) + (p["at"] & (1 << _PLACE_BITS) - 1)
                        out.append((p["anchor"], p["content"], p["low"], joined[edges[a] : edges[a + p["count"] + size - 1] - 1]))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3], pa.binary()).cast(pa.string())], names=["anchor", "content", "low", "words"])

    return with_parts.mapInArrow(run, f"anchor long, content long, low {docs.schema['doc_id'].dataType.simpleString()}, words string")


def _by_automata(segments: DataFrame, size: int) -> DataFrame:
    """(anchor, content, lows): the segments of each anchor, which come sorted, through their own automaton."""
    kind = segments.schema["low"].dataType.simpleString()

    def solve(rows: list[dict]) -> Iterator[dict]:
        automaton = SuffixAutomaton()
        words = [x["words"].split(" ") for x in rows]
        for x, own in zip(rows, words, strict=True):
            automaton.add(own, x["low"])
        for x, own in zip(rows, words, strict=True):
            yield {"anchor": x["anchor"], "content": x["content"], "lows": automaton.lows(own, size)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[dict] = []
            for x in batch.to_pylist():
                if held and held[0]["anchor"] != x["anchor"]:
                    out += solve(held)
                    held = []
                if not held or held[-1]["content"] != x["content"]:  # repeated rows give a segment several times
                    held.append(x)
            if out:
                yield pa.RecordBatch.from_pylist(out)
        if held:
            yield pa.RecordBatch.from_pylist(list(solve(held)))

    # dealt by a hash of its own: a join's partitioning by anchor below would satisfy repartition("anchor"), and
    # adaptive execution may give that up again for a local shuffle read
    dealt = segments.withColumn("shard", F.xxhash64("anchor")).repartition("shard").sortWithinPartitions("anchor", "low", "content").drop("shard")
    return dealt.mapInArrow(run, f"anchor long, content long, lows array<{kind}>")


def _by_windows(segments: DataFrame, size: int, made: list[str] | None) -> DataFrame:
    """The same for anchors of more segments than a shard may hold: each window is a shard of its own, whose automaton would say
    what the least document of its group says. The groups' answers are written, so that the join back can split a common window."""
    windows = segments.select(
        "anchor", "content", "low",
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size(F.split("words", " ")) - size + 1), lambda i: F.array_join(F.slice(F.split("words", " "), i, F.lit(size)), " "))).alias("pos", "window"),
    )
    least = cut_table(windows.groupBy("anchor", "window").agg(F.min("low").alias("least")), made)
    return (
        windows.join(least, ["anchor", "window"]).groupBy("anchor", "content")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "least"))), lambda x: x["least"]).alias("lows"))
    )


def covered(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR, shard_segments: int = SHARD_SEGMENTS, made: list[str] | None = None) -> DataFrame:
    """(doc_id, mark, spans: array of (at, end)): the windows to remove of each document that has any; at and end carry
    the text's mark in their upper bits. docs has doc_id and text; made gets the paths of the tables on the way."""
    anchors = _segment_rows(docs, size, anchor).groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("anchor", "n")
    spark, passing = docs.sparkSession, []
    anchors = cut_table(anchors, passing)
    n, rows = anchors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shared = cut_table(_of_anchors(_segment_rows(docs, size, anchor, _bit_table(anchors, n)), anchors, rows), made)
    drop_tables(spark, passing)
    different = cut_table(
        shared.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "at", "count")).alias("first"))
        .select("anchor", "content", "first.*").withColumnRenamed("doc_id", "low"),
        made,
    )
    sizes = cut_table(different.groupBy("anchor").agg(F.count("*").alias("many")).where("many > 1"), made)
    sized = different.join(sizes, "anchor", "left").withColumn("many", F.coalesce("many", F.lit(1)))
    mixed = sized.where("many > 1")
    mark = F.shiftrightunsigned("at", _PLACE_BITS).alias("mark")
    wanted = mixed.groupBy(F.col("low").alias("doc_id"), mark).agg(F.collect_list(F.struct("at", "count", "anchor", "content", "low")).alias("parts"))
    words = _words_of(docs, wanted, size)
    large = sizes.where(F.col("many") > shard_segments).select("anchor")
    if large.isEmpty():
        lows = _by_automata(words, size)
    else:
        words = cut_table(words.dropDuplicates(["anchor", "content"]), made)
        lows = _by_automata(words.join(large, "anchor", "left_anti"), size).unionByName(_by_windows(words.join(large, "anchor"), size, made))
    none = F.lit(None)
    answers = sized.where("many = 1").select("anchor", "content", "low", none.cast(lows.schema["lows"].dataType).alias("lows")).unionByName(
        lows.select("anchor", "content", none.cast(docs.schema["doc_id"].dataType).alias("low"), "lows")
    )
    found = shared.join(cut_table(answers, made), ["anchor", "content"])
    whole = F.when(F.col("low") < F.col("doc_id"), F.array(F.struct(F.col("at"), (F.col("at") + F.col("count") + size - 1).alias("end"))))
    single = F.transform(
        F.filter(F.transform("lows", lambda x, i: F.struct((x < F.col("doc_id")).alias("ok"), i.alias("i"))), lambda x: x["ok"]),
        lambda x: F.struct((F.col("at") + x["i"]).alias("at"), (F.col("at") + x["i"] + size).alias("end")),
    )
    mark_of_first = F.shiftrightunsigned(F.col("spans")[0]["at"], _PLACE_BITS).alias("mark")
    spans = found.select("doc_id", F.coalesce(whole, single).alias("spans")).where(F.size("spans") > 0)
    return spans.groupBy("doc_id", mark_of_first).agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _of_anchors(segments: DataFrame, anchors: DataFrame, rows: int) -> DataFrame:
    """The segments of anchors(anchor, n), whose n sum up to rows. An anchor of more than a quarter of a partition's rows is dealt
    over several partitions by document; there are at most four such anchors a partition."""
    bound = max(1000, rows // (4 * int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    large = {r["anchor"]: r["n"] for r in anchors.where(F.col("n") > bound).collect()}
    hot = F.col("anchor").isin(list(large))
    parts = max([-(-n // bound) for n in large.values()], default=1)
    dealt = segments.withColumn("deal", F.when(hot, F.pmod(F.xxhash64("doc_id"), F.lit(parts))).otherwise(F.lit(0).cast("long")))
    keys = anchors.select("anchor", F.explode(F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("deal"))
    return dealt.join(keys, ["anchor", "deal"]).drop("deal")


_RESULT = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())]
)


def _kept(text: pa.Array, spans: pa.Array, with_text: bool) -> pa.Array:
    spans = spans.to_pylist()
    n_words, n_removed, kept_texts, digests = [], [], [], []
    for at, rows, buf, starts, ends, firsts in _steps(text):
        joined, edges = _joined(buf, starts, ends)
        for r in range(rows):
            a, b = int(firsts[r]), int(firsts[r + 1])
            keep: list[tuple[int, int]] = []
            gone, done = 0, a
            for s in sorted(spans[at + r] or (), key=lambda s: s["at"]):
                x, y = a + (s["at"] & (1 << _PLACE_BITS) - 1), a + (s["end"] & (1 << _PLACE_BITS) - 1)
                if x > done:
                    keep.append((done, x))
                gone += max(0, y - max(x, done))
                done = max(done, y)
            if b > done:
                keep.append((done, b))
            kept = b"".join(joined[edges[x] : edges[y]] for x, y in keep)[:-1]
            n_words.append(b - a)
            n_removed.append(gone)
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode() if with_text else None)
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.string()), pa.array(digests, pa.string())], names=[f.name for f in _RESULT])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, size: int = WINDOW, anchor: int = ANCHOR, shard_segments: int = SHARD_SEGMENTS) -> tuple[DataFrame, str]:
    """docs with one more struct column (n_words, n_removed, kept: the words that stay joined by one space,
    kept_sha256), and that column's name."""
    columns = docs.columns
    made: list[str] = []
    spans = cut_table(covered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), size, anchor, shard_segments, made))
    drop_tables(docs.sparkSession, made)  # the spans are a table of their own now
    found, mark = free_name(docs, "spans"), free_name(docs, "mark")
    marked = docs.withColumn(mark, F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))), _PLACE_BITS + 1))
    own = spans.select(F.col("doc_id").alias(doc_id), F.col("mark").alias(mark), F.col("spans").alias(found))
    joined = marked.join(own, [doc_id, mark], "left").select(*[F.col(f"`{c}`") for c in columns], F.col(found))
    at = joined.columns.index(text)
    name = free_name(joined, "dedup")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, _RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _kept(batch.column(at), batch.columns[-1], with_text)], names=[*columns, name])

    return joined.mapInArrow(run, schema), name


def digest(docs: DataFrame) -> DataFrame:
    out, name = dedup(docs.select("doc_id", "text"), with_text=False)
    return out.select("doc_id", F.col(f"{name}.n_words").alias("n_words"), F.col(f"{name}.n_removed").alias("n_removed"), F.col(f"{name}.kept_sha256").alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT win, min(doc_id) AS low FROM x GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN f USING (win) WHERE low < doc_id),
r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
a AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN r USING (doc_id)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT a.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM a LEFT JOIN k USING (doc_id)
"""
