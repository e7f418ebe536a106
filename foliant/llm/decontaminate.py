"""Benchmark decontamination: word windows of held-out items are searched in every document.

The windows of the items are a sorted array of 64-bit hashes, broadcast to the executors in blocks of
bounded size. Documents are tokenised as bytes in one vectorised scan without a shuffle; a window whose
hash is known is compared word by word before it counts. Found spans are reported, or cut from the text,
or the whole document goes.

Defined results: null and empty texts have no words and no hits; an item without words has no window;
an item of fewer words than a window is one window of all its words; repeated items count once per id
(a null id reads as an empty string); repeated documents are each reported; an empty item table gives
no hits; other columns pass through, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import append_column, free_name, lower_ascii_table, text_slices, window_hashes, word_bounds, word_hashes
from foliant.session import cut_table, drop_tables

WINDOW = 10
#: Bytes of item text in one broadcast block: about 6 MB of hashes and offsets for each MB of text.
BLOCK_BYTES = 4_000_000
#: Blocks that are broadcast at once; of more, the hits are written wave by wave.
WAVE_BLOCKS = 4
#: Words of a piece of a longer item; pieces share a window less one word, so that no window is lost.
PIECE_WORDS = 100_000

_IS_WORD, _LOW = lower_ascii_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_FILTER_BITS = 20

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("words", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("bytes", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
_HITS_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("words", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("bytes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


class Windows:
    """The windows of a block of items: sorted hashes by length, with the item and its bytes for the check."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        self.ids = [i or "" for i, _ in items]
        blob, at, parts = [], 0, {}
        for k, (_, text) in enumerate(items):
            buf = _LOW[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = word_bounds(buf, np.array([0, len(buf)]), _IS_WORD)
            if not len(starts):
                continue
            words = [buf[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
            joined = b" ".join(words)
            lengths = np.array([len(w) + 1 for w in words])
            begin = at + np.cumsum(lengths) - lengths
            n = min(size, len(words))
            hashes = window_hashes(word_hashes(buf, starts, ends), n)
            stop = begin[n - 1 :] + lengths[n - 1 :] - 1
            parts.setdefault(n, []).append((hashes, np.full(len(hashes), k), begin[: len(hashes)], stop))
            blob.append(joined)
            at += len(joined) + 1
        self.blob = b" ".join(blob)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for n, found in parts.items():
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            hashes = columns[0][order]
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.by_length[n] = (seen, hashes, *(c[order] for c in columns[1:]))

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, set[int]]]:
        """(first word, words, items) of the verified windows in a step; a window stays in its row."""
        out = []
        hashes = word_hashes(buf, starts, ends) if self.by_length else None
        for n, (seen, known, item, begin, stop) in self.by_length.items():
            here = window_hashes(hashes, n)
            maybe = np.flatnonzero(seen[(here >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            left = np.searchsorted(known, here[maybe])
            ok = left < len(known)
            ok[ok] = known[left[ok]] == here[maybe[ok]]
            for i, j in zip(maybe[ok].tolist(), left[ok].tolist(), strict=True):
                if np.searchsorted(firsts, i, "right") != np.searchsorted(firsts, i + n - 1, "right"):
                    continue
                own = b" ".join(buf[starts[k] : ends[k]].tobytes() for k in range(i, i + n))
                items = set()
                while j < len(known) and known[j] == here[i]:
                    if self.blob[begin[j] : stop[j]] == own:
                        items.add(int(item[j]))
                    j += 1
                if items:
                    out.append((i, n, items))
        return out

    def report(self, column: pa.Array) -> pa.Array:
        rows: list[dict] = []
        for at, end, raw, offs in text_slices(column):
            buf = _LOW[raw]
            starts, ends, firsts = word_bounds(buf, offs, _IS_WORD)
            found = self.find(buf, starts, ends, firsts)
            by_row: dict[int, list[tuple[int, int, set[int]]]] = {}
            for hit in found:
                by_row.setdefault(int(np.searchsorted(firsts, hit[0], "right")) - 1, []).append(hit)
            for r in range(end - at):
                n = int(firsts[r + 1] - firsts[r])
                if r not in by_row:
                    rows.append({"n_words": n, "n_hit": 0, "items": [], "words": [], "bytes": []})
                    continue
                spans: list[list[int]] = []
                for i, size, _ in sorted(by_row[r], key=lambda h: h[0]):
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], i + size)
                    else:
                        spans.append([i, i + size])
                rows.append(
                    {
                        "n_words": n,
                        "n_hit": sum(e - s for s, e in spans),
                        "items": sorted({self.ids[k] for _, _, items in by_row[r] for k in items}),
                        "words": [{"start": s - int(firsts[r]), "end": e - int(firsts[r])} for s, e in spans],
                        "bytes": [{"start": int(starts[s] - offs[r]), "end": int(ends[e - 1] - offs[r])} for s, e in spans],
                    }
                )
        return pa.array(rows, _HITS_ARROW)


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """Items as they are, but for those of more than PIECE_WORDS words: these in overlapping pieces of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buf = _LOW[np.frombuffer((text or "").encode(), np.uint8)]
                starts, ends, _ = word_bounds(buf, np.array([0, len(buf)]), _IS_WORD)
                if len(starts) <= PIECE_WORDS:
                    parts = [text]
                else:
                    parts = [buf[starts[k] : ends[min(k + PIECE_WORDS + window - 1, len(ends)) - 1]].tobytes().decode() for k in range(0, len(starts) - window + 1, PIECE_WORDS)]
                ids += [name] * len(parts)
                texts += parts
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["id", "text"])

    return items.mapInArrow(run, "id string, text string")


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int, window: int, made: list[str]) -> list[DataFrame]:
    own = _pieces(items.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")), window)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    if n == 1:
        return [own]
    own = cut_table(own, made)
    return [own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b) for b in range(n)]


def scan(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str]:
    """docs with one more struct column of hits (see HITS), and that column's name.

    Items beyond block_bytes are scanned in further blocks, row by row and without a shuffle, and the
    blocks' spans are united; no item is left out. Of more than WAVE_BLOCKS blocks only so many are broadcast at a time: each such wave reads the
    texts and writes the hits of those that have any, by the digest of the text, which the rows are joined with in the end. The table of hits
    stays in the checkpoint folder as long as the result is read; those of the waves go."""
    made: list[str] = []
    columns, blocks = docs.columns, _blocks(items, item_id, item_text, block_bytes, window, made)
    if len(blocks) <= WAVE_BLOCKS:
        scanned, parts, _ = _scan_blocks(docs, text, blocks, window)
        out = (scanned, parts[0]) if len(parts) == 1 else _united(scanned, columns, parts)
        drop_tables(docs.sparkSession, made)
        return out
    waves = []
    for at in range(0, len(blocks), WAVE_BLOCKS):
        own = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null")
        scanned, parts, known = _scan_blocks(own, "text", blocks[at : at + WAVE_BLOCKS], window)
        scanned, hits = _united(scanned, ["text"], parts)
        found = scanned.where(F.col(f"{hits}.n_hit") > 0).select(F.sha2("text", 256).alias("digest"), F.col(hits).alias("hits"))
        waves.append(cut_table(found.dropDuplicates(["digest"]), made))
        for block in known:
            block.destroy()
    every = functools.reduce(DataFrame.unionByName, waves).groupBy("digest").agg(F.collect_list("hits").alias("all"))
    words, spans = (_unite(F.flatten(F.transform("all", lambda h: h[k]))) for k in ("words", "bytes"))
    whole = F.struct(F.col("all")[0]["n_words"].alias("n_words"), _length(words).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda h: h["items"])))).alias("items"), words.alias("words"), spans.alias("bytes"))
    found = cut_table(every.select("digest", whole.alias("found")))
    drop_tables(docs.sparkSession, made)
    # rows without hits have their number of words, and empty lists, from a scan for nothing
    scanned, (bare,), _ = _scan_blocks(docs, text, [None], window)
    key, name = free_name(scanned, "digest"), free_name(scanned, "united")
    found = found.withColumnsRenamed({"digest": key, "found": "_found_" + name})
    joined = scanned.withColumn(key, F.sha2(F.col(f"`{text}`"), 256)).join(found, key, "left")
    return joined.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col("_found_" + name), F.col(bare)).alias(name)), name


def _scan_blocks(docs: DataFrame, text: str, blocks: list[DataFrame | None], window: int) -> tuple[DataFrame, list[str], list]:
    """(docs with a column of hits for each block, those columns, what is broadcast); None is a block without items."""
    parts, known = [], []
    for block in blocks:
        known.append(docs.sparkSession.sparkContext.broadcast(Windows([(r["id"], r["text"]) for r in block.collect()] if block is not None else [], window)))
        parts.append(free_name(docs, "hits"))
        docs = append_column(docs, text, parts[-1], HITS, lambda column, known=known[-1]: known.value.report(column))
    return docs, parts, known


def _length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _united(docs: DataFrame, columns: list[str], parts: list[str]) -> tuple[DataFrame, str]:
    """docs' columns and one of hits that unites those of all parts, and its name."""
    words, spans = (_unite(F.concat(*[F.col(f"`{p}`.{k}") for p in parts])) for k in ("words", "bytes"))
    name = free_name(docs, "hits")
    hits = F.struct(
        F.col(f"`{parts[0]}`.n_words").alias("n_words"), _length(words).alias("n_hit"), F.array_sort(F.array_distinct(F.concat(*[F.col(f"`{p}`.items") for p in parts]))).alias("items"), words.alias("words"), spans.alias("bytes"),
    )
    return docs.select(*[F.col(f"`{c}`") for c in columns], hits.alias(name)), name


def _unite(spans):
    """Overlapping and touching spans as one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(
        F.array_sort(spans),
        empty,
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]),
            F.concat(
                F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )


def digest(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its words, hit words, the items that it holds and whether it is contaminated."""
    scanned, hits = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items)
    return scanned.select(
        "doc_id",
        F.col(f"{hits}.n_words").alias("n_words"),
        F.col(f"{hits}.n_hit").alias("n_hit"),
        F.size(f"{hits}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{hits}.items", ","), 256).alias("items_sha256"),
        (F.col(f"{hits}.n_hit") > 0).alias("contaminated"),
        F.col(f"{hits}.words").alias("hit_words"),
    )


def remove(docs: DataFrame, items: DataFrame, text: str = "text", mode: str = "document", **options) -> DataFrame:
    """docs without contamination, same columns. mode "document" drops a document with any hit; mode
    "span" cuts the hit spans, from the first byte of the first word to the last of the last."""
    columns = docs.columns
    scanned, hits = scan(docs, items, text, **options)
    if mode == "document":
        kept = scanned.where(F.col(f"`{hits}`.n_hit") == 0)
    elif mode == "span":
        binary = F.col(f"`{text}`").cast("binary")
        spans = F.col(f"`{hits}`.bytes")
        cut = F.aggregate(
            spans,
            F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept")),
            lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["kept"], F.substring(binary, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")).cast("string")).alias("kept")),
            lambda s: F.concat(s["kept"], F.substring(binary, (s["at"] + 1).cast("int"), F.lit(2**31 - 1)).cast("string")),
        )
        kept = scanned.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(F.col(f"`{text}`")))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return kept.select(*[F.col(f"`{c}`") for c in columns])


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, ns WHERE len(ws) >= n)),
h AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
