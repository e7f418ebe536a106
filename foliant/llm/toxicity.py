"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the examples; none is cut. A term weighs (1 + ln of its count) times its inverse document
frequency, counted over the whole corpus, times its relevance: how strongly the examples tie it to the toxic
label (log-likelihood ratio, saturated; a term without such a tie keeps FLOOR of it). Terms that no example has
cannot be shared and are not part of a text's length. A bounded sample of labelled rows gives the examples; near
copies of one label (5-word shingles, 0.8, in chains too) are one example of their number's weight.

The index holds the examples in blocks and, for each term, its largest weight in each block. A text's best block
gives a first k-th neighbour; of a term's list only the parts in blocks that could reach it are read, so the k nearest are exact. Votes
weighted by distance are calibrated on the examples, each left out of its own vote and of what ties its terms to a label, by weighted isotonic
regression.

Defined results: null and empty texts, and texts that share no term with any example, get the toxic share of
the examples that have no term either (of all examples, if there are none); a document labelled several times is
toxic if any label says so; labels without a document, and null labels, are left out; without examples of both
kinds all scores are the toxic share (0 without examples); repeated rows score alike; neighbours at the same
cosine (9 digits) are taken in the index's order, which follows from their content; other columns pass through, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliant.llm import jaccard
from foliant.llm.common import append_column, free_name, lower_ascii_table, summed_counts, text_slices, word_bounds, word_hashes
from foliant.session import bound_batches, cut

#: Examples of each kind, those with the smallest hash, and bytes of their texts: bounds the index and what is fitted.
MOST_EXAMPLES = 2048
MOST_EXAMPLE_BYTES = 16_000_000
#: Near copies among the examples: words of a shingle and least similarity.
COPY_SIZE, COPY_SHARE = 5, (80, 100)
#: Log-likelihood ratio at which a term's relevance is full, and the relevance of a term without any.
FULL_TIE, FLOOR = 30.0, 0.02
NEIGHBOURS = 32
BLOCK = 128
#: Bytes of a word's beginning, which is a term of its own: rare words of a family share it.
BEGINNING = 5
#: Terms with the longest lists have a dense column each.
DENSE = 192
#: Texts that are scored at a time, and bytes of text that are cut into words: what bounds a worker's memory beside the index.
STEP_TEXTS = 16
STEP_BYTES = 250_000
REJECT = 0.3

_IS_WORD, _ = lower_ascii_table(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)


def word_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, row of each word, hash of each word) of lower-cased texts, step by step."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for at, end, raw, offs in text_slices(pc.utf8_lower(column), STEP_BYTES):
        starts, ends, firsts = word_bounds(raw, offs, _IS_WORD)
        row = np.repeat(np.arange(end - at), np.diff(firsts))
        long = np.flatnonzero(ends - starts > BEGINNING)
        begun = ~word_hashes(raw, starts[long], starts[long] + BEGINNING)
        order = np.argsort(np.concatenate([row, row[long]]), kind="stable")
        yield end - at, np.concatenate([row, row[long]])[order], np.concatenate([word_hashes(raw, starts, ends), begun])[order]


class Terms:
    """The examples' words as sorted hashes; a word's place is its term."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = known

    def rows(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, row, term, count) of the distinct known words of each row, ordered by row and term."""
        size = max(1, len(self.known))
        for rows, row, hashes in word_rows(column):
            at = np.searchsorted(self.known, hashes)
            ok = at < len(self.known)
            ok[ok] = self.known[at[ok]] == hashes[ok]
            pair, count = np.unique(row[ok] * size + at[ok], return_counts=True)
            yield rows, pair // size, pair % size, count


class Index:
    """Examples' normalised vectors: dense columns for the terms with the longest lists, lists for all others, and
    of both the largest weight in each block."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, terms: int) -> None:
        self.rows, self.blocks = rows, -(-rows // BLOCK)
        frequency = np.bincount(term, minlength=terms)
        often = np.sort(np.argsort(-frequency, kind="stable")[:DENSE])
        self.column = np.full(terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((self.blocks * BLOCK, len(often)))
        common = self.column[term] >= 0
        self.dense[row[common], self.column[term[common]]] = weight[common]
        self.dense_best = self.dense.reshape(self.blocks, BLOCK, -1).max(1) if rows else np.zeros((0, len(often)))
        order = np.flatnonzero(~common).astype(np.int32)
        order = order[np.argsort(term[order] * np.int64(max(1, rows)) + row[order])]  # by term, then by example
        self.example, self.weight, term = row[order].astype(np.int32), weight[order], term[order]
        self.first = np.searchsorted(term, np.arange(terms + 1)).astype(np.int32)
        block = self.example // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.best = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0, np.float32)
        self.best_block = block[at]
        self.best_first = np.searchsorted(term[at], np.arange(terms + 1)).astype(np.int32)
        self.start = np.append(at, len(term)).astype(np.int32)  # where the part of a list in a block begins
        self.parts = self.opened = 0  # parts of lists that texts asked for, and those that were read

    def _read(self, part: np.ndarray, row: np.ndarray, weight: np.ndarray, scores: np.ndarray) -> None:
        """Adds what the given parts of lists give each row to scores (rows x examples, flat)."""
        self.opened += len(part)
        begin = self.start[part].astype(np.int64)
        n = self.start[part + 1] - begin
        places = np.repeat(begin - (np.cumsum(n) - n), n)
        places += np.arange(len(places))
        cells = np.repeat(row * (self.blocks * BLOCK), n)
        cells += self.example[places]
        weights = np.repeat(weight, n)
        weights *= self.weight[places]
        scores += np.bincount(cells, weights=weights, minlength=len(scores))

    def search(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, k: int = NEIGHBOURS, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, example) of the k nearest of each of rows texts, nearest first, ties to the earlier example;
        a cosine of 0 stands for none. skip names an example per row that is not to be found. Of a list only the parts in blocks whose bound
        reaches the k-th cosine so far are read."""
        width = self.blocks * BLOCK
        if not rows or not self.blocks:
            return np.zeros((rows, 0)), np.zeros((rows, 0), np.int64)
        common = self.column[term] >= 0
        dense = np.zeros((rows, self.dense.shape[1]))
        dense[row[common], self.column[term[common]]] = weight[common]
        rare_row, rare_term, rare_weight = row[~common], term[~common], weight[~common]
        begin = self.best_first[rare_term].astype(np.int64)
        n = self.best_first[rare_term + 1] - begin
        part = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        part_row, part_weight, part_block = np.repeat(rare_row, n), np.repeat(rare_weight, n), self.best_block[part] if len(self.best_block) else part
        self.parts += len(part)
        bound = dense @ self.dense_best.T + np.bincount(part_row * self.blocks + part_block, weights=part_weight * self.best[part], minlength=rows * self.blocks).reshape(rows, self.blocks)
        flat_scores = np.zeros(rows * width)
        scores = flat_scores.reshape(rows, self.blocks, BLOCK)

        def read(wanted: np.ndarray) -> None:
            ok = wanted[part_row, part_block]
            self._read(part[ok], part_row[ok], part_weight[ok], flat_scores)

        def visit(b: int, some: np.ndarray) -> np.ndarray:
            found = scores[some, b] + dense[some] @ self.dense[b * BLOCK : (b + 1) * BLOCK].T
            if skip is not None:
                own = np.flatnonzero(skip[some] // BLOCK == b)
                found[own, skip[some[own]] % BLOCK] = 0
            scores[some, b] = found
            return found

        top, least = bound.argmax(1), np.zeros(rows)
        first = np.zeros(bound.shape, bool)
        first[np.arange(rows), top] = True
        read(first)
        for b in np.unique(top):
            some = np.flatnonzero(top == b)
            found = visit(int(b), some)
            if k <= BLOCK:
                least[some] = np.partition(found, BLOCK - k, axis=1)[:, BLOCK - k]
        wanted = (bound >= least[:, None] - 1e-9) & (bound > 0)
        wanted[np.arange(rows), top] = False
        read(wanted)
        for b in range(self.blocks):
            some = np.flatnonzero(wanted[:, b])
            if len(some):
                visit(b, some)
        wanted[np.arange(rows), top] = True
        scores[~wanted] = 0
        flat = np.round(scores.reshape(rows, width), 9)
        k = min(k, width)
        at_least = np.partition(flat, width - k, axis=1)[:, width - k]
        cosine, example = np.zeros((rows, k)), np.zeros((rows, k), np.int64)
        # every example at or above the k-th cosine, sorted by (row, cosine descending, example)
        where, which = np.nonzero((flat >= at_least[:, None]) & (flat > 0))
        order = np.lexsort((which, -flat[where, which], where))
        where, which = where[order], which[order]
        place = np.arange(len(where)) - np.searchsorted(where, where)
        ok = place < k
        cosine[where[ok], place[ok]] = flat[where[ok], which[ok]]
        example[where[ok], place[ok]] = which[ok]
        return cosine, example


class Model:
    """Terms, their weights, the examples' index and, once calibrated, the knots of the calibration."""

    def __init__(self, ids: list, labels: np.ndarray, share: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, known: np.ndarray, frequency: np.ndarray, documents: int) -> None:
        """(row, term, count): the words of the examples, ordered by row."""
        self.terms = Terms(known)
        held = [np.bincount(term[labels[row] == kind], minlength=len(known)) for kind in (1, 0)]
        tie = relevance(held[0], held[1], int((labels == 1).sum()), int((labels == 0).sum()))
        self.rarity = np.log((documents + 1) / (frequency + 1)) + 1
        self.term_weight = self.rarity * tie
        self.held, self.of_label = [h.astype(np.int32) for h in held], [int((labels == 1).sum()), int((labels == 0).sum())]
        first = np.searchsorted(row, np.arange(len(ids) + 1))
        bare = np.flatnonzero(np.diff(first) == 0)
        base = bare if len(bare) else np.arange(len(ids))
        self.bare = float((share[base] * labels[base]).sum() / max(1e-12, share[base].sum())) if len(base) else 0.0
        # examples whose strongest terms agree are neighbours, so that few blocks hold a strong term
        own = [term[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        strongest = [int(t[np.argmax(self.term_weight[t])]) if len(t) else -1 for t in own]
        # neither id nor label places an example, since places decide ties: after the strongest term comes what it holds
        content = [zlib.crc32(own[k].tobytes() + count[a:b].tobytes()) for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))]
        kept = sorted((k for k in range(len(ids)) if len(own[k])), key=lambda k: (strongest[k], content[k], own[k].tobytes(), count[first[k] : first[k + 1]].tobytes()))
        place = np.full(len(ids), -1, np.int32)
        place[kept] = np.arange(len(kept), dtype=np.int32)
        self.ids = [ids[k] for k in kept]
        self.labels, self.share = labels[kept].astype(np.float64), share[kept].astype(np.float64)
        row = place[row]
        self.index = Index(row, term, self.weights(row, term, count, len(kept)).astype(np.float32), len(kept), len(known))
        self.places = {x: k for k, x in enumerate(self.ids)}
        self.x, self.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def weights(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int, left_out: np.ndarray | None = None) -> np.ndarray:
        """The weights of rows' terms; left_out holds each row's label if it is an example whose own part in the terms' ties does not count
        (-1: none)."""
        weight = self.term_weight[term]
        if left_out is not None:
            for label in (1, 0):
                at = np.flatnonzero(left_out[row] == label)
                own = [self.held[0][term[at]] - (label == 1), self.held[1][term[at]] - (label == 0)]
                weight[at] = self.rarity[term[at]] * relevance(*own, self.of_label[0] - (label == 1), self.of_label[1] - (label == 0))
        w = (1 + np.log(count)) * weight
        length = np.sqrt(np.bincount(row, weights=w * w, minlength=rows))
        return w / np.maximum(1e-12, length[row])

    def near(self, column: pa.Array, own: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(cosine, example) of the nearest of each text, step by step; own names the example a text is, if any."""
        at = 0
        for rows, row, term, count in self.terms.rows(column):
            places = None if own is None else np.array([self.places.get(x, -1) for x in own[at : at + rows]], np.int64)
            left_out = None if own is None else np.where(places >= 0, self.labels[np.maximum(places, 0)] if len(self.labels) else -1, -1)
            w = self.weights(row, term, count, rows, left_out)
            for lo in range(0, rows, STEP_TEXTS):
                n = min(STEP_TEXTS, rows - lo)
                a, b = np.searchsorted(row, (lo, lo + n))
                skip = None if own is None else places[lo : lo + n]
                yield self.index.search(row[a:b] - lo, term[a:b], w[a:b], n, skip=skip)
            at += rows

    def votes(self, cosine: np.ndarray, example: np.ndarray) -> np.ndarray:
        """The share of toxic neighbours, weighted by distance; not a number where there is none."""
        w = np.where(cosine > 0, 1 / (1.05 - np.minimum(1.0, cosine)), 0.0)
        w = w * self.share[example] if len(self.share) else w
        total = w.sum(1)
        return np.where(total > 0, (w * self.labels[example]).sum(1) / np.where(total > 0, total, 1), np.nan) if len(self.labels) else np.full(len(cosine), np.nan)

    def score(self, column: pa.Array) -> pa.Array:
        scores, counts, ids, cosines, labels = [np.zeros(0)], [np.zeros(0, np.int64)], [], [np.zeros(0)], [np.zeros(0)]
        for cosine, example in self.near(column):
            votes = self.votes(cosine, example)
            scores.append(np.clip(np.where(np.isnan(votes), self.bare, np.interp(votes, self.x, self.y)), 0, 1))
            shown = cosine[:, :5] > 0
            counts.append(shown.sum(1))
            which = example[:, :5][shown]
            ids += [str(self.ids[k]) for k in which.tolist()]
            cosines.append(cosine[:, :5][shown])
            labels.append(self.labels[which] if len(self.labels) else np.zeros(0))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        shown = pa.StructArray.from_arrays([pa.array(ids, pa.string()), pa.array(np.concatenate(cosines)), pa.array(np.concatenate(labels).astype(np.int32))], names=["doc_id", "cosine", "toxic"])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), shown)], names=["score", "evidence"])


def relevance(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """FLOOR, and the squared log ratio of a term's share in toxic and in clean examples, in full where it makes up a
    log-likelihood of FULL_TIE."""
    ratio = np.log(((toxic + 0.5) / (n_toxic + 1)) / ((clean + 0.5) / (n_clean + 1)))
    return FLOOR + np.clip(toxic * ratio / FULL_TIE, 0, 1) * ratio**2


_RESULT = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))),
    ]
)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function nearest to y at x, by pooling adjacent violators."""
    if not len(x):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    pools: list[list[float]] = []  # sum of w*y, sum of w, first x, last x
    for k in np.argsort(x, kind="stable").tolist():
        pools.append([w[k] * y[k], w[k], x[k], x[k]])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            a, b, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2], last]
    xs, ys = [], []
    for a, b, first, last in pools:
        xs += [first, last] if last > first else [first]
        ys += [a / b] * (2 if last > first else 1)
    return np.array(xs), np.array(ys)


def learned_from(doc_id: Column) -> Column:
    """Rows that labels may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_examples: int = MOST_EXAMPLES, most_bytes: int = MOST_EXAMPLE_BYTES) -> Model:
    """A model of the labelled rows that labels may be learned from; see the module."""
    known = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
        .where(learned_from(F.col("id")) & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    )
    sample, weights = [], [0.0, 0.0]
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most_examples).collect()
        sample += part
        weights[y] = totals.get(y, 0) / len(part) if part else 0.0
    spark = docs.sparkSession
    sample.sort(key=lambda r: r["id"])
    # small tables go in as Arrow: rows would be pickled by Python workers of another kind, which then stay beside the others
    fields = T.StructType([*known.schema.fields, T.StructField("key", T.LongType())])
    chosen = spark.createDataFrame(pa.Table.from_pylist([{"id": r["id"], "y": r["y"], "key": k} for k, r in enumerate(sample)], to_arrow_schema(fields)), fields)
    examples = cut(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "y", "key"))
    # near copies of one label are one example, the one with the smallest id, that weighs as many as they are
    groups = {r["id"]: r["component_id"] for r in jaccard.cluster(examples, "key", "text", COPY_SIZE, COPY_SHARE).collect()}
    firsts: dict[tuple[int, int], int] = {}
    for k in sorted(groups):
        firsts.setdefault((groups[k], sample[k]["y"]), k)
    copies = Counter(firsts[groups[k], sample[k]["y"]] for k in groups)
    sizes = {r["key"]: r["n"] or 0 for r in examples.groupBy("key").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    kept, room = [], [most_bytes, most_bytes]
    for k in sorted(copies, key=lambda k: (sizes[k], k)):  # within the documented bound; the longest texts first go
        room[sample[k]["y"]] -= sizes[k]
        if room[sample[k]["y"]] >= 0:
            kept.append((k, copies[k]))
    for y in (0, 1):  # what is left stands for all labelled rows of its kind
        held = sum(n for k, n in kept if sample[k]["y"] == y)
        weights[y] = totals.get(y, 0) / held if held else 0.0
    examples = examples.join(F.broadcast(spark.createDataFrame(pa.table({"key": pa.array([k for k, _ in kept], pa.int64()), "copies": pa.array([n for _, n in kept], pa.int64())}))), "key")
    bound_batches(spark)

    def own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = [], []
            for rows, row, words in word_rows(batch.column(1)):
                firsts = np.searchsorted(row, np.arange(rows + 1))
                for r in range(rows):
                    own, n = np.unique(words[firsts[r] : firsts[r + 1]], return_counts=True)
                    hashes.append(own.tobytes())
                    counts.append(n.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["key", "hashes", "counts"])

    found = examples.select("key", "text").mapInArrow(own_words, "key long, hashes binary, counts binary")
    found = found.groupBy("key").agg(F.min(F.struct("hashes", "counts")).alias("x")).select("key", "x.*").orderBy("key").toArrow()  # an id of several texts has one
    keys = found["key"].to_pylist()
    hashes, count = _flat(found["hashes"], np.uint64), _flat(found["counts"], np.int32)
    row = np.repeat(np.arange(len(keys), dtype=np.int32), pc.binary_length(found["counts"]).to_numpy() // 4 if keys else 0)
    every = np.unique(hashes)
    term = np.searchsorted(every, hashes).astype(np.int32)
    del found, hashes
    terms = Terms(every)
    shared = spark.sparkContext.broadcast(terms)

    def document_counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(len(shared.value.known) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, _, term, _ in shared.value.rows(batch.column(0)):
                np.add.at(total, term, 1)
        return total

    everywhere = summed_counts(docs.select(text), len(every) + 1, document_counts, 4096)
    shared.destroy()
    of = [sample[k] for k in keys]
    labels_of = np.array([r["y"] for r in of], np.int64)
    share = np.array([weights[r["y"]] * copies[k] for k, r in zip(keys, of, strict=True)], np.float64)
    model = Model([r["id"] for r in of], labels_of, share, row, term, count, every, everywhere[:-1], int(everywhere[-1]))
    del row, term, count
    return _calibrated(model, examples)


def _flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of all values of a binary column, one after the other."""
    parts = []
    for part in column.chunks:
        _, offsets, data = part.buffers()
        offs = np.frombuffer(offsets, np.int32)[part.offset : part.offset + len(part) + 1]
        if len(part) and offs[-1] > offs[0]:
            parts.append(np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(kind))
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _calibrated(model: Model, examples: DataFrame) -> Model:
    """The model with its calibration: the vote of each example without itself, taken on the executors."""
    spark = examples.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            votes = [shared.value.votes(*found) for found in shared.value.near(batch.column(1), own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(votes) if votes else np.zeros(0))], names=["id", "vote"])

    kind = examples.schema["id"].dataType.simpleString()
    votes = {r["id"]: r["vote"] for r in examples.select("id", "text").repartition(spark.sparkContext.defaultParallelism).mapInArrow(left_out, f"id {kind}, vote double").collect()}
    shared.destroy()
    x = np.array([votes.get(k, np.nan) for k in model.ids], np.float64)
    model.x, model.y = isotonic(np.where(np.isnan(x), model.bare, x), model.labels, model.share)
    model.held = model.rarity = None  # only votes without an example ask for them
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more struct column (score, evidence: up to five neighbours), and its name. The model is
    broadcast; MOST_EXAMPLES and MOST_EXAMPLE_BYTES bound it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = free_name(docs, "toxicity")
    return append_column(docs, text, name, _RESULT, lambda c: shared.value.score(c)), name


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored, name = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        (~learned_from(F.col("doc_id"))).alias("held_out"),
        F.col(f"{name}.score").alias("score"),
        (F.col(f"{name}.score") >= REJECT).cast("int").alias("predicted"),
        F.col(f"{name}.evidence").alias("evidence"),
    )


def reject(docs: DataFrame, labels: DataFrame, text: str = "text", least: float = REJECT) -> DataFrame:
    """docs without those that score least or more; same columns."""
    scored, name = score(docs, fit(docs, labels, text=text), text)
    return scored.where(F.col(f"`{name}`.score") < least).select(*[F.col(f"`{c}`") for c in docs.columns])
