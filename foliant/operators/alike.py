"""Texts much like each other, by blocks of texts of near length: no list of pairs is ever written.

A pair passes if
  the lengths can reach LEAST_RATIO;
  LEAST_OVERLAP of the leaf's different words, of its first WORDS_OF characters, are among the chunk's;
  the Ratcliff-Obershelp ratio is LEAST_RATIO or more.

Leaves go into classes of length; chunks go to all classes whose leaves they can be like. A class of many characters has several blocks of leaves. A
task holds one block, as lists of leaves by word, and reads the block's chunks past it. Of n words that k must be shared of, a chunk has one at least
of the n - k + 1 rarest, and m at least of the n - k + m rarest; m grows while the lists that it adds are short. Where that holds, the characters that both texts
have bound the ratio, then the words are compared, and what is left is compared character by character."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import bound_batches

LEAST_CONTAINED, LEAST_OVERLAP, LEAST_RATIO, WORDS_OF = 40, 0.45, 0.92, 4000
#: Of two texts that reach LEAST_RATIO the shorter is so long, as a share of the longer.
LEAST_LENGTH = LEAST_RATIO / (2 - LEAST_RATIO)
#: The longest texts of a class of length are so many times as long as its shortest.
CLASS = 1.4
#: Characters and texts of a block of leaves, about as many at most; chunks that are looked up at once, and pairs whose characters are compared at once.
BLOCK, TEXTS, STEP, HELD = 1 << 25, 1 << 17, 1 << 10, 1 << 14
#: Lists may grow by this share of what the rarest words read, so that more words must be shared.
MORE = 3

_WORD = re.compile("[a-z0-9]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
#: Kinds of characters that are counted: letters, digits, other ASCII characters in eight kinds, all others. The last kind is no character.
_KINDS = 46
_KIND = np.full(256, 44, np.int64)
_KIND[:0x80] = 36 + np.arange(0x80) % 8
_KIND[0x61:0x7B] = np.arange(26)
_KIND[0x30:0x3A] = 26 + np.arange(10)
_KIND[0x80:0xC0] = 45
_HASH_BITS = 52


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets: one more than rows) of a column without nulls."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of an odd number and of its inverse, modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.full(n, x, np.uint64)) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))


def word_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, word): the different words of each text as hashes of _HASH_BITS bits, by row; at most 4096 texts."""
    raw, offsets = text_bytes(pc.utf8_slice_codeunits(column, 0, WORDS_OF))
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _IS_WORD[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    begins = np.flatnonzero(inside[:-1] & (first[:-1] | ~np.append(False, inside[:-2]))) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside[:-1] & (first[1:] | ~inside[1:])) + 1
    with np.errstate(over="ignore"):
        powers, shifts = _powers(1 << len(raw).bit_length())
        sums = np.append(np.uint64(0), np.cumsum(raw * powers[: len(raw)]))
        h = (sums[ends] - sums[begins]) * shifts[begins] + (ends - begins).astype(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    row = np.searchsorted(offsets, begins, "right") - 1
    both = np.sort((row.astype(np.uint64) << np.uint64(_HASH_BITS)) | (h >> np.uint64(64 - _HASH_BITS)))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return (both >> np.uint64(_HASH_BITS)).astype(np.int64), both & np.uint64((1 << _HASH_BITS) - 1)


def kinds(column: pa.Array) -> np.ndarray:
    """How many characters of each kind each text has."""
    raw, offsets = text_bytes(column)
    row = np.repeat(np.arange(len(column)) * _KINDS, np.diff(offsets))
    return np.bincount(row + _KIND[raw], minlength=len(column) * _KINDS).reshape(-1, _KINDS)[:, :-1].astype(np.int32)


def _in_steps(column: pa.Array) -> Iterator[pa.Array]:
    for at in range(0, len(column), STEP):
        yield column.slice(at, STEP)


class Block:
    """Leaves, shortest first, as lists by word."""

    def __init__(self, texts: pa.Array) -> None:
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        self.order = np.argsort(sizes, kind="stable")
        self.texts, self.sizes = texts.take(pa.array(self.order)), sizes[self.order].astype(np.int64)
        sets, counts = zip(*((word_sets(x), kinds(x)) for x in _in_steps(self.texts)), strict=True)
        self.kinds = np.concatenate(counts)
        row = np.concatenate([r + k * STEP for k, (r, _) in enumerate(sets)])
        words, word, often = np.unique(np.concatenate([w for _, w in sets]), return_inverse=True, return_counts=True)
        n = np.bincount(row, minlength=len(self.sizes))
        needs = np.maximum(np.ceil(n * LEAST_OVERLAP - 1e-9).astype(np.int64), 1)
        order = np.lexsort((word, often[word], row))
        row, word = row[order], word[order]
        start = np.cumsum(n) - n
        place = np.arange(len(row)) - start[row]
        cost = np.cumsum(often[word]) if len(row) else np.zeros(0, np.int64)
        before = np.where(start > 0, cost[np.maximum(start, 1) - 1], 0) if len(row) else np.zeros(len(n), np.int64)
        base = n - needs + 1  # words of which one is shared at least
        at_base = np.where(n > 0, cost[np.minimum(start + np.maximum(base, 1) - 1, len(row) - 1)] - before, 0) if len(row) else before
        chosen = (place < base[row]) | (cost - before[row] <= (1 + MORE) * at_base[row] + 64)
        self.least = np.bincount(row[chosen], minlength=len(n)) - base + 1
        row, word = row[chosen], word[chosen]
        used, word = np.unique(word, return_inverse=True)
        self.words = words[used]
        self.lists = np.sort((word.astype(np.int64) << 32) | row)
        self.entries = self.lists & 0xFFFFFFFF

    def near(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(chunk, leaf) that words and characters do not rule out, of STEP texts at most."""
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        low, high = np.searchsorted(self.sizes, np.floor(size * LEAST_LENGTH - 1e-6)), np.searchsorted(self.sizes, np.ceil(size / LEAST_LENGTH + 1e-6), "right")
        row, word = word_sets(texts)
        at = np.searchsorted(self.words, word)
        known = (self.words[np.minimum(at, len(self.words) - 1)] == word) & (low < high)[row] if len(self.words) else np.zeros(len(row), bool)
        row, at = row[known], at[known].astype(np.int64)
        begin, end = np.searchsorted(self.lists, (at << 32) | low[row]), np.searchsorted(self.lists, (at << 32) | high[row])
        full = begin < end
        row, begin, n = row[full], begin[full], (end - begin)[full]
        if not len(row):
            return
        counts, edges = kinds(texts), np.searchsorted(row, np.arange(len(size) + 1)).tolist()
        begin, end, low, high = begin.tolist(), (begin + n).tolist(), low.tolist(), high.tolist()
        found, held, last = [], 0, row[-1]
        for c in np.unique(row).tolist():
            read = np.concatenate([self.entries[begin[k] : end[k]] for k in range(edges[c], edges[c + 1])])
            shared = np.bincount(read - low[c], minlength=high[c] - low[c])
            f = np.flatnonzero(shared >= self.least[low[c] : high[c]])
            if len(f):
                found.append((c, f + low[c]))
                held += len(f)
            if found and (held > HELD or c == last):
                n, f = [len(x) for _, x in found], np.concatenate([x for _, x in found])
                chunk = np.repeat([x for x, _ in found], n)
                found, held = [], 0
                for k in range(0, len(f), HELD):
                    i, j = chunk[k : k + HELD], f[k : k + HELD]
                    both = np.minimum(counts[i], self.kinds[j]).sum(1)
                    fits = both * 2 >= LEAST_RATIO * (size[i] + self.sizes[j]) - 1e-6
                    yield i[fits], j[fits]


def likeness(chunk: str, leaf: str) -> float:
    """What SequenceMatcher(None, chunk, leaf).ratio() gives, or 0 if that is below LEAST_RATIO. The longest match of a part is found by searching for
    substrings, one character longer each time, in place of its table of pairs of characters."""
    usual, every = set(), len(chunk) + len(leaf)
    if len(leaf) >= 200:  # its rule for characters that are too usual to begin a match
        usual = {c for c in set(leaf) if leaf.count(c) > len(leaf) // 100 + 1}
    one, two = chunk, leaf
    if usual:
        free = (chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000 and chr(k) not in chunk and chr(k) not in leaf)
        skip, other = next(free), next(free)
        one, two = chunk.translate({ord(c): skip for c in usual}), leaf.translate({ord(c): other for c in usual})
    starts = [k for k, c in enumerate(chunk) if c not in usual]
    matched, open_, parts = 0, min(len(chunk), len(leaf)), [(0, len(chunk), 0, len(leaf))]
    while parts:
        low, high, from_, to = parts.pop()
        at, there, n = low, from_, 0
        for k in starts[bisect_left(starts, low) : bisect_left(starts, high)]:
            while k + n < high and (found := two.find(one[k : k + n + 1], from_, to)) >= 0:
                at, there, n = k, found, n + 1
        while at > low and there > from_ and chunk[at - 1] == leaf[there - 1]:
            at, there, n = at - 1, there - 1, n + 1
        while at + n < high and there + n < to and chunk[at + n] == leaf[there + n]:
            n += 1
        open_ -= min(high - low, to - from_)
        if n:
            matched += n
            for part in ((low, at, from_, there), (at + n, high, there + n, to)):
                if part[0] < part[1] and part[2] < part[3]:
                    parts.append(part)
                    open_ += min(part[1] - part[0], part[3] - part[2])
        if 2.0 * (matched + open_) / every < LEAST_RATIO:
            return 0.0
    return 2.0 * matched / every


def links(leaves: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, leaf, chunk, ratio) of texts(paper_id, key, flat) that pass; a pair of which one text of LEAST_CONTAINED characters stands in the other
    may be missing."""
    bound_batches(leaves.sparkSession)
    size = F.length("flat")
    place = lambda x: F.floor(F.log(x) / np.log(CLASS)).cast("int")
    own = leaves.where(size >= LEAST_CONTAINED).select("paper_id", "key", "flat", place(size).alias("class"))
    large = own.groupBy("paper_id", "class").agg(F.ceil(F.greatest(F.sum(size), F.count("*") * (BLOCK // TEXTS)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    own = own.join(F.broadcast(large), ["paper_id", "class"], "left").select("paper_id", "class", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"), F.lit(True).alias("is_leaf"), "key", "flat")
    theirs = chunks.where(size > LEAST_CONTAINED * LEAST_LENGTH - 1).select("paper_id", "key", "flat", F.explode(F.sequence(place(size * LEAST_LENGTH - 1e-6), place(size / LEAST_LENGTH + 1e-6))).alias("class"))
    theirs = theirs.join(F.broadcast(large), ["paper_id", "class"], "left").select("paper_id", "class", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(False).alias("is_leaf"), "key", "flat")
    cell = ["paper_id", "class", "block"]
    rows = own.unionByName(theirs).repartition(*cell).sortWithinPartitions(*cell, F.desc("is_leaf"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("paper_id", "key")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            at = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            cuts = [0, *(k for k in range(1, len(at)) if at[k] != at[k - 1]), len(at)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                if at[s][:3] != now:
                    now, held, block = at[s][:3], [], None
                if at[s][3]:
                    held.append(part)
                elif held or block:
                    if held:
                        every = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        block, ids, held = Block(every.column(5)), every.column(4), []
                    out = [(ids[int(block.order[f])].as_py(), c, r) for c, f, r in _verified(block, part)]
                    if out:
                        leaf, chunk, ratio = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([s] * len(out))), pa.array(leaf, ids.type), pa.array(chunk, ids.type), pa.array(ratio, pa.float64())], names=["paper_id", "leaf", "chunk", "ratio"])

    return rows.mapInArrow(run, f"paper_id {kind['paper_id']}, leaf {kind['key']}, chunk {kind['key']}, ratio double")


def _verified(block: Block, chunks: pa.RecordBatch) -> Iterator[tuple[object, int, float]]:
    """(chunk's key, place of the leaf, ratio)."""
    words = lambda text: set(_WORD.findall(text[:WORDS_OF]))
    for at in range(0, len(chunks), STEP):
        part = chunks.slice(at, STEP)
        for found in block.near(part.column(5)):
            for c, f in zip(*(x.tolist() for x in found), strict=True):
                chunk, leaf = part.column(5)[c].as_py(), block.texts[f].as_py()
                if chunk == leaf or leaf in chunk or len(chunk) >= LEAST_CONTAINED and chunk in leaf:
                    continue
                own = words(leaf)
                if len(own & words(chunk)) >= LEAST_OVERLAP * len(own) - 1e-9 and (ratio := likeness(chunk, leaf)) >= LEAST_RATIO:
                    yield part.column(4)[c].as_py(), f, ratio
