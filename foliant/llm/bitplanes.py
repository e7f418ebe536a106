"""Token ids in bit-plane files.

Documents are dealt into ranges of ascending id, tokenised where they are written, and each range becomes one file: ids
in chunks of a fixed number, every chunk transposed into its bit planes (or byte planes), every plane compressed by itself, then the
documents' ids and lengths as compressed byte planes, and an index of the chunks. A reader finds any run of ids by the index and
decodes only its chunks.

A file is written under a name of its own and counts only once its row stands in the manifest, a table that Spark commits: a task
that is run again writes another file, and files that no row names are deleted. Files go to a folder that all executors
reach, by default below spark.checkpoint.dir.

    file      magic, planes of all chunks, blocks of documents, chunk index, document index, footer
    chunk     first id's place, count, planes; sizes of the planes, 0 for a plane of zeros
    footer    place and sizes of the index, number of ids, checksum of the index, magic

Defined results: a null text is empty, which is its end id alone; a null document id comes before all others; rows of one document id are ordered by
a hash of their text, equal rows follow each other; empty ranges have no file; an empty table gives an empty manifest; other columns
do not matter.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import text_slices
from foliant.session import bound_batches, checkpoint_dir, cut_table

END_ID = 0
#: Ids of a chunk and documents of a block.
CHUNK_IDS = 65_536
BLOCK_DOCS = 65_536
LEVEL = 3
#: Bytes of text tokenised at a time, and pieces of text whose ids a worker remembers.
STEP_BYTES = 8_000_000
MOST_PIECES = 800_000
MAGIC = b"IDPLANE1"
_FOOTER = struct.Struct("<QIIIQI8s")
_CHUNK = np.dtype([("at", "<u8"), ("first", "<u8"), ("count", "<u4"), ("planes", "<u2"), ("kind", "<u2")])
_DOCS = np.dtype([("at", "<u8"), ("first", "<u8"), ("count", "<u4"), ("sizes", "<u4", 17)])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- tokens ---------------------------------------------------------------------------------------

# classes of ASCII characters as far as the tokenizer's pattern tells them apart; 0 is left whole
_LETTER, _DIGIT, _MARK, _QUOTE, _WHITE = 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0x27] = _QUOTE
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _WHITE
#: [class before, class after]: whether text is always cut between them. A quote may begin a short form such as 's.
_CUT = np.zeros((6, 6), bool)
_CUT[1:5, _WHITE] = True
_CUT[_LETTER, [_DIGIT, _MARK, _QUOTE]] = _CUT[_DIGIT, [_LETTER, _MARK, _QUOTE]] = _CUT[_MARK, [_LETTER, _DIGIT]] = True


def piece_cuts(buf: np.ndarray, offs: np.ndarray, whole: list[tuple[int, int]] = ()) -> np.ndarray:
    """Places at which a tokenizer of this kind never joins text, ends of rows among them: between characters of
    different classes, before white space, and after one line end or tab that stands alone. Letters are those of ASCII and of
    Latin-1; no place beside another character is cut, nor any inside the spans that are to stay whole."""
    cut = np.zeros(len(buf) + 1, bool)
    if len(buf) > 1:
        starts, ends = _CLASS[buf], _CLASS[buf]
        lead = np.flatnonzero(buf[:-1] == 0xC3)
        lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
        starts[lead] = ends[lead + 1] = _LETTER
        cut[1:-1] = _CUT[ends[:-1], starts[1:]]
        alone = np.flatnonzero((starts[1:-1] == _WHITE) & (buf[1:-1] != 0x20) & (starts[2:] > 0) & (starts[2:] < _WHITE)) + 1
        cut[alone[cut[alone]] + 1] = True
    for a, b in whole:
        cut[a + 1 : b] = False
    cut[offs] = True
    return np.flatnonzero(cut)


class Encoder:
    """The ids of pieces of text; a piece is tokenised once while it is remembered."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(file)
        if not isinstance(self.whole.pre_tokenizer, pre_tokenizers.ByteLevel) or self.whole.normalizer is not None:
            raise ValueError("only byte-level tokenizers without normalisation")
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        # places: each piece's number; by number, the place and count of its ids in flat, and the step that used it last
        self.places: dict[str, int] = {}
        self.flat, self.first, self.size, self.used = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.step = 0

    def _forget(self) -> None:
        """Keeps the half of the pieces that was used last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: MOST_PIECES // 2])
        names = np.fromiter(self.places, object, len(self.places))[keep]
        size = self.size[keep]
        first = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(self.first[keep] - first, size) + np.arange(size.sum())]
        self.first, self.size, self.used = first, size, self.used[keep]
        self.places = dict(zip(names.tolist(), range(len(names)), strict=True))

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, number of ids) of each of some different pieces in the third, all ids that are remembered."""
        if len(self.places) > MOST_PIECES:
            self._forget()
        self.step += 1
        known, base = self.places.get, len(self.places)
        at = np.array([known(w, -1) for w in pieces], np.int64)
        new = np.flatnonzero(at < 0)
        flat, sizes = [self.flat], [self.size]
        for lo in range(0, len(new), 20_000):
            some = [pieces[k] for k in new[lo : lo + 20_000].tolist()]
            found = array("I")
            size = array("q")
            for e in self.whole.encode_batch_fast(some, add_special_tokens=False):
                ids = e.ids
                found.extend(ids)
                size.append(len(ids))
            flat.append(np.frombuffer(found, "<u4"))
            sizes.append(np.frombuffer(size, np.int64))
            self.places.update(zip(some, range(base + lo, base + lo + len(some)), strict=True))
        at[new] = base + np.arange(len(new))
        self.flat, self.size = np.concatenate(flat), np.concatenate(sizes)
        self.first = np.cumsum(self.size) - self.size
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.used[at] = self.step
        return self.first[at], self.size[at], self.flat


@functools.lru_cache(maxsize=1)
def _encoder(file: str) -> Encoder:
    return Encoder(file)


def encode(column: pa.Array, file: str, end_id: int = END_ID) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids of some rows with their end ids, each row's number of ids)."""
    encoder = _encoder(file)
    for at, _, raw, offs in text_slices(column, STEP_BYTES):
        data, whole = raw.tobytes(), []
        for special in encoder.special:  # their strings are one id each, wherever they stand
            found = data.find(special)
            while found >= 0:
                whole.append((found, found + len(special)))
                found = data.find(special, found + 1)
        cuts = piece_cuts(raw, offs, whole)
        firsts = np.searchsorted(cuts, offs)
        texts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data))
        coded = texts.dictionary_encode()
        first, size, flat = encoder.ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        starts = np.concatenate([[0], np.cumsum(size)])
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat[np.repeat(first - starts[:-1], size) + np.arange(starts[-1])], pa.uint32()))
        taken = lists.take(coded.indices)
        ids, bounds = taken.flatten().to_numpy(), taken.offsets.to_numpy().astype(np.int64)[firsts]
        yield at, np.insert(ids, bounds[1:], end_id).astype("<u4", copy=False), np.diff(bounds) + 1


# ---- files ----------------------------------------------------------------------------------------


def planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The bit planes (kind 1) or byte planes (kind 8) of ids, lowest first, up to the highest that is not all zero."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == 8:
        return [raw[:, k].tobytes() for k in range(-(-top // 8))]
    return [np.packbits(raw[:, k // 8] >> (k % 8) & 1, bitorder="little").tobytes() for k in range(top)]


def from_planes(parts: list[bytes], count: int, kind: int) -> np.ndarray:
    raw = np.zeros((count, 4), np.uint8)
    for k, part in enumerate(parts):
        if kind == 8:
            raw[:, k] = np.frombuffer(part, np.uint8)
        elif part:
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(part, np.uint8), count=count, bitorder="little") << (k % 8)
    return raw.reshape(-1).view("<u4")


def folder_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there: a path, or a URI of file, hdfs, s3, s3a, gs or abfs."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class PlaneWriter:
    """One file; ids and documents are added in order, and close() writes the index."""

    def __init__(self, uri: str, name: str, kind: int = 8, chunk_ids: int = CHUNK_IDS) -> None:
        self.fs, folder = folder_of(uri)
        self.fs.create_dir(folder, recursive=True)
        self.out = self.fs.open_output_stream(f"{folder}/{name}")
        self.kind, self.chunk_ids, self.zstd = kind, chunk_ids, zstandard.ZstdCompressor(level=LEVEL)
        self.at = self.n_ids = self.n_docs = 0
        self.chunks: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.blocks: list[tuple] = []
        self.held: list[np.ndarray] = []
        self.waiting = 0
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs_waiting = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, ids: np.ndarray, doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray) -> None:
        """ids of whole documents, one after the other."""
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.chunk_ids:
            whole = np.concatenate(self.held)
            full = len(whole) - len(whole) % self.chunk_ids
            for k in range(0, full, self.chunk_ids):
                self._chunk(whole[k : k + self.chunk_ids])
            self.held, self.waiting = [whole[full:].copy()], len(whole) - full
        self.docs.append((doc_ids, null, lengths))
        self.docs_waiting += len(lengths)
        if self.docs_waiting >= BLOCK_DOCS:
            self._block()

    def _chunk(self, ids: np.ndarray) -> None:
        at, parts = self.at, planes(ids, self.kind)
        for part in parts:
            self.sizes.append(self._put(self.zstd.compress(part)) if any(part) else 0)
        self.chunks.append((at, self.n_ids, len(ids), len(parts), self.kind))
        self.n_ids += len(ids)

    def _block(self) -> None:
        doc_ids, null, lengths = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        at = self.at
        parts = [*doc_ids.astype("<i8").view(np.uint8).reshape(-1, 8).T, *lengths.astype("<u8").view(np.uint8).reshape(-1, 8).T, null.astype(np.uint8)]
        sizes = [self._put(self.zstd.compress(part.tobytes())) for part in parts]
        self.blocks.append((at, self.n_docs, len(lengths), sizes))
        self.n_docs += len(lengths)
        self.docs, self.docs_waiting = [], 0

    def close(self) -> int:
        """The file's size."""
        if self.waiting:
            self._chunk(np.concatenate(self.held))
        if self.docs_waiting:
            self._block()
        index = np.array(self.chunks, _CHUNK).tobytes() + np.array(self.sizes, "<u4").tobytes() + np.array(self.blocks, _DOCS).tobytes()
        at = self.at
        self._put(index)
        self._put(_FOOTER.pack(at, len(self.chunks), len(self.sizes), len(self.blocks), self.n_ids, zlib.crc32(index), MAGIC))
        self.out.close()
        return self.at


class PlaneFile:
    """A file that is read chunk by chunk."""

    def __init__(self, uri: str, name: str) -> None:
        fs, folder = folder_of(uri)
        self.file = fs.open_input_file(f"{folder}/{name}")
        size = self.file.size()
        at, n_chunks, n_sizes, n_blocks, self.n_ids, crc, magic = _FOOTER.unpack(self._get(size - _FOOTER.size, _FOOTER.size))
        index = self._get(at, size - _FOOTER.size - at)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{name} is no whole file of bit planes")
        self.chunks = np.frombuffer(index, _CHUNK, n_chunks)
        self.sizes = np.frombuffer(index, "<u4", n_sizes, n_chunks * _CHUNK.itemsize)
        self.blocks = np.frombuffer(index, _DOCS, n_blocks, n_chunks * _CHUNK.itemsize + 4 * n_sizes)
        self.first_size = np.cumsum(self.chunks["planes"].astype(np.int64)) - self.chunks["planes"]
        self.zstd = zstandard.ZstdDecompressor()

    def _get(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def chunk(self, k: int) -> np.ndarray:
        c = self.chunks[k]
        sizes = self.sizes[self.first_size[k] : self.first_size[k] + c["planes"]].tolist()
        raw, at, parts = self._get(int(c["at"]), sum(sizes)), 0, []
        empty = bytes(int(c["count"])) if c["kind"] == 8 else b""
        for size in sizes:
            parts.append(self.zstd.decompress(raw[at : at + size]) if size else empty)
            at += size
        return from_planes(parts, int(c["count"]), int(c["kind"]))

    def ids(self, first: int, count: int) -> np.ndarray:
        """A run of ids; only its chunks are read."""
        if count <= 0 or not len(self.chunks):
            return np.zeros(0, "<u4")
        one, last = np.searchsorted(self.chunks["first"], [first, first + count - 1], "right") - 1
        whole = np.concatenate([self.chunk(k) for k in range(one, last + 1)])
        at = first - int(self.chunks["first"][one])
        return whole[at : at + count]

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document ids, which are null, numbers of ids), block by block."""
        for b in self.blocks:
            sizes = b["sizes"].tolist()
            raw, at, parts = self._get(int(b["at"]), sum(sizes)), 0, []
            for size in sizes:
                parts.append(np.frombuffer(self.zstd.decompress(raw[at : at + size]), np.uint8))
                at += size
            whole = [np.ascontiguousarray(np.stack(parts[k : k + 8], 1)).reshape(-1).view("<i8") for k in (0, 8)]
            yield whole[0], parts[16].astype(bool), whole[1]


# ---- tables ---------------------------------------------------------------------------------------


def write_ids(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", tokenizer_file: str | None = None, kind: int = 8, files: int | None = None) -> DataFrame:
    """Writes docs' ids in ascending order of document id; the manifest (shard, folder, file, start, n_ids, n_docs, bytes) has a
    row for each file, start being the ids in all files before it."""
    spark, file = docs.sparkSession, tokenizer_file or default_tokenizer()
    folder = folder or f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    bound_batches(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    own = own.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})  # many rows of one id can be ranges of their own
    order = (F.asc_nulls_first("id"), F.col("h"), F.col("row"))
    dealt = own.repartitionByRange(files, *order).sortWithinPartitions(*order).select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, name = TaskContext.get().partitionId(), None, ""
        for batch in _larger(batches):
            ids = batch.column(0).combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            plain = ids.fill_null(0).to_numpy()
            for at, tokens, lengths in encode(batch.column(1), file):
                if out is None:
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"
                    out = PlaneWriter(folder, name, kind)
                out.add(tokens, plain[at : at + len(lengths)], null[at : at + len(lengths)], lengths)
        if out is not None:
            size = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_ids": [out.n_ids], "n_docs": [out.n_docs], "bytes": [size]})

    written = cut_table(dealt.mapInArrow(write, "shard int, file string, n_ids long, n_docs long, bytes long"))
    _drop_others(spark, folder, written)
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    return written.select("shard", F.lit(folder).alias("folder"), "file", F.coalesce(before, F.lit(0)).alias("start"), "n_ids", "n_docs", "bytes")


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to steps of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= STEP_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _drop_others(spark: SparkSession, folder: str, written: DataFrame) -> None:
    """Deletes files of failed or doubled tasks: those that no row of the manifest names."""
    fs, path = folder_of(folder)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return
    there = [x.base_name for x in fs.get_file_info(pafs.FileSelector(path)) if x.type == pafs.FileType.File]
    if len(there) > written.count():
        named = {r["file"] for r in written.select("file").collect()}
        for name in there:
            if name not in named:
                fs.delete_file(f"{path}/{name}")


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids): every document from the files; start counts the ids of all documents before it."""
    return _read(manifest, "ids array<long>", pa.list_(pa.int64()), lambda parts: np.concatenate(parts).tolist())


def checksums(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the digest of every document's ids, from the files."""
    return _read(manifest, "ids_crc32 long", pa.int64(), lambda parts: functools.reduce(lambda crc, part: zlib.crc32(part.tobytes(), crc), parts, 0)).select("doc_id", "start", "n_tokens", "ids_crc32")


def _read(manifest: DataFrame, field: str, kind: pa.DataType, make) -> DataFrame:
    spark = manifest.sparkSession
    spread = manifest.select("folder", "file", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = ["doc_id", "start", "n_tokens", field.split()[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, k, rest = PlaneFile(folder, name), 0, np.zeros(0, "<u4")
                for doc_ids, null, lengths in file.documents():
                    made, done = [], 0

                    def rows(done: int, upto: int, made: list, start: int, doc_ids=doc_ids, null=null, lengths=lengths) -> pa.RecordBatch:
                        n = lengths[done:upto]
                        return pa.RecordBatch.from_arrays([pa.array(doc_ids[done:upto], mask=null[done:upto]), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(made, kind)], names=names)

                    held = 0
                    for d, n in enumerate(lengths.tolist()):
                        parts = []
                        while n > len(rest):
                            parts.append(rest)
                            n -= len(rest)
                            rest, k = file.chunk(k), k + 1
                        parts.append(rest[:n])
                        rest = rest[n:]
                        made.append(make(parts))
                        held += int(lengths[d])
                        if held >= 1_000_000:
                            yield rows(done, d + 1, made, start)
                            start, done, made, held = start + held, d + 1, [], 0
                    if made:
                        yield rows(done, len(lengths), made, start)
                        start += held

    return spread.mapInArrow(run, f"doc_id long, start long, n_tokens long, {field}")


def digest(docs: DataFrame) -> DataFrame:
    return checksums(write_ids(docs))
