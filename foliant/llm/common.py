"""Helpers that several operators share: columns without name clashes, byte-level words, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.session import bound_batches

#: Bytes of text that one vectorised step works on; bounds the memory of a Python worker.
STEP_BYTES = 1_000_000
#: Larger arrays have pages of their own, which go back when they are freed; of other freed memory a process keeps so much.
MMAP_BYTES, TRIM_BYTES = 4 << 20, 16 << 20

# freed buffers go back to the system at once: an executor's Python workers live long, next to its heap
pa.set_memory_pool(pa.system_memory_pool())
_MALLOC = getattr(ctypes.CDLL(None), "mallopt", None)
if _MALLOC:  # glibc keeps up to 64 MB and arrays of up to 32 MB for later, unless both bounds are set
    _MALLOC(-3, MMAP_BYTES)  # M_MMAP_THRESHOLD
    _MALLOC(-1, TRIM_BYTES)  # M_TRIM_THRESHOLD

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or wish with underscores where the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def lower_ascii_table(word: Callable[[int], bool]) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, byte with A-Z lower-cased), both indexed by byte; word sees the lowered byte."""
    low = np.arange(256, dtype=np.uint8)
    low[0x41:0x5B] += 0x20
    return np.array([word(int(b)) for b in low]), low


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows + 1) of a string column, in steps of about STEP_BYTES;
    null is an empty text. A longer text is a step of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + step, "right")) - 1)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def word_bounds(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row + total) of the maximal runs of word bytes; rows never join."""
    inside = is_word[buf]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(buf):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        cuts = offs[(offs > 0) & (offs < len(buf))]
        before[cuts] = False
        after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes of all words at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    part = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    with np.errstate(over="ignore"):
        lengths = ends - starts
        out = mix(lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (eight[starts] & part[np.minimum(lengths, 8)]))
        at, rest = 8, np.flatnonzero(lengths > 8)
        while len(rest):
            out[rest] = mix(out[rest] * _BASE + (eight[starts[rest] + at] & part[np.minimum(lengths[rest] - at, 8)]))
            at += 8
            rest = rest[lengths[rest] > at]
        return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of size consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _BASE + words[k : k + n]
    return mix(out)


def append_column(df: DataFrame, text: str, name: str, kind: T.DataType, make: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """df with one more column that make() computes from a string column, Arrow batch by Arrow batch.
    All other columns pass through unread."""
    bound_batches(df.sparkSession)
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, make(batch.column(at))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


_MARKS = np.array([b in b",.;:!?#$%&*" for b in range(256)])
_ASCII_LETTERS = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_BLANKS = np.array([b in b"\n\r\t" for b in range(256)])


def blank_words(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, pa.StringArray, np.ndarray, np.ndarray]]:
    """(rows, distinct words, code of each word, first word of each row + total): texts split at blanks, tabs,
    line ends and between an ASCII letter and a mark such as a comma; empty words are among them."""
    for at, end, raw, offs in text_slices(column, step):
        buf = np.where(_BLANKS[raw], np.uint8(0x20), raw)
        cuts = np.flatnonzero(_MARKS[buf[1:]] & _ASCII_LETTERS[buf[:-1]]) + 1
        buf = np.insert(buf, cuts, 0x20)
        offs = offs + np.searchsorted(cuts, offs)
        texts = pa.StringArray.from_buffers(end - at, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(buf))
        words = pc.split_pattern(texts, " ")
        coded = words.values.dictionary_encode()
        yield end - at, coded.dictionary, coded.indices.to_numpy(), words.offsets.to_numpy().astype(np.int64)


def summed_counts(df: DataFrame, size: int, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], chunk: int = 256) -> np.ndarray:
    """The sum over all partitions of a vector of fixed size that count() makes of each; vectors are added on
    the executors, chunk by chunk, and only their sum reaches the driver."""
    bound_batches(df.sparkSession)
    schema = "chunk int, counts binary"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count(batches)
        where = [k for k in range(0, size, chunk) if total[k : k + chunk].any()]
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([total[k : k + chunk].astype(np.int64).tobytes() for k in where], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(size, np.int64)
    for k, counts in df.mapInArrow(part, schema).repartition("chunk").mapInArrow(add, schema).collect():
        out[k : k + chunk] += np.frombuffer(counts, np.int64)
    return out
