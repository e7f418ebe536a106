"""A keyed table as immutable segments and a manifest of versions: an upsert writes only its rows, a reader sees one version.

A version is a small JSON file that names its segments, oldest first, with their rows and least and largest key. It is made by creating a file
of the next number, which fails if there is one: of two writers one wins and the other has to begin again. A version that was not written whole
has no valid checksum and does not count, so after a crash at any step readers have the version before. Segments that no version names, and
versions older than those that are kept, go with vacuum().

Reading merges: of rows with one key those of the last segment count. A segment of upserts has each key once; the base is what compaction or a load
has left. Keys of later segments are anti-joined with what came before, broadcast while they are few, so that the base is neither
shuffled nor sorted for a small change."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a segment up to which its keys are broadcast; segments and share of the base's rows from which on a table is compacted.
FEW_ROWS = 1_000_000
MOST_SEGMENTS, MOST_SHARE = 8, 0.2
#: Versions that vacuum() keeps.
KEPT = 2


@dataclass(frozen=True)
class Segment:
    path: str
    rows: int
    low: str | None
    high: str | None
    tag: str = ""


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class SegmentTable:
    """A table below folder with one row for each key."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str) -> None:
        self.spark, self.folder, self.key, self.schema = spark, folder.rstrip("/"), key, schema

    # ---- versions ----

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at, fs = self._fs(f"{self.folder}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v-(\d+)\.json", n)))

    def _read(self, number: int) -> list[Segment] | None:
        at, fs = self._fs(f"{self.folder}/versions/v-{number:012d}.json")
        try:
            stream = fs.open(at)
            try:
                whole = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
        except Exception:  # noqa: BLE001 - it may go while another process cleans up
            return None
        body, _, check = whole.rpartition("\n")
        if not body or check != f"{zlib.crc32(body.encode()):08x}":
            return None
        return [Segment(**s) for s in json.loads(body)["segments"]]

    def version(self) -> tuple[int, list[Segment]]:
        """The last whole version, and its segments; (0, []) before the first."""
        for number in reversed(self._numbers()):
            found = self._read(number)
            if found is not None:
                return number, found
        return 0, []

    def exists(self) -> bool:
        return self.version()[0] > 0

    def commit(self, segments: list[Segment], after: int) -> int:
        """Makes the version after the one that the segments were made from. Numbers of versions that were not written whole are passed
        over."""
        number = max([after, *[n for n in self._numbers() if self._read(n) is None]]) + 1
        if self.version()[0] != after:
            raise Conflict(f"{self.folder} has a version after {after}")
        body = json.dumps({"segments": [s.__dict__ for s in segments]})
        at, fs = self._fs(f"{self.folder}/versions/v-{number:012d}.json")
        try:
            out = fs.create(at, False)  # fails where it exists
        except Exception as e:
            raise Conflict(f"{self.folder} has a version {number}") from e
        out.write(bytearray(f"{body}\n{zlib.crc32(body.encode()):08x}".encode()))
        out.close()
        return number

    # ---- segments ----

    def _segment(self, rows: DataFrame, tag: str = "") -> Segment:
        """Writes rows by ranges of their keys, and looks at what was written."""
        path = f"{self.folder}/segments/{uuid.uuid4().hex}"
        rows.repartitionByRange(F.col(self.key)).sortWithinPartitions(self.key).write.parquet(path)
        found = self._load(path).agg(F.count("*").alias("n"), F.min(self.key).cast("string").alias("low"), F.max(self.key).cast("string").alias("high")).first()
        return Segment(path, found["n"], found["low"], found["high"], tag)

    def _load(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path)

    def _merged(self, segments: list[Segment]) -> DataFrame:
        out = later = None
        later_rows = 0
        for s in reversed(segments):
            rows, keys = self._load(s.path), self._load(s.path).select(self.key)
            if later is not None:
                rows = rows.join(F.broadcast(later) if later_rows <= FEW_ROWS else later, self.key, "left_anti")
            later, later_rows = keys if later is None else later.unionByName(keys), later_rows + s.rows
            out = rows if out is None else rows.unionByName(out)
        return out if out is not None else self.spark.createDataFrame([], self.schema)

    def table(self) -> DataFrame:
        """The table as it is now; later writes do not change what is returned, until vacuum() has taken its segments."""
        return self._merged(self.version()[1])

    def get(self, keys: list) -> DataFrame:
        """Rows of some keys, from the segments whose range of keys can hold them. Keys are compared as their column's type."""
        texts = [str(k) for k in keys]
        plain = self._load_type() == "string"
        near = [s for s in self.version()[1] if s.rows and (not plain or any(s.low <= t <= s.high for t in texts))]
        return self._merged(near).where(F.col(self.key).isin(keys))

    def _load_type(self) -> str:
        return next(f.dataType.simpleString() for f in self.spark.createDataFrame([], self.schema).schema if f.name == self.key)

    # ---- writes ----

    def replace(self, rows: DataFrame) -> int:
        """A version of these rows alone; they may be made from the table itself."""
        after, _ = self.version()
        return self.commit([self._segment(rows)], after)

    def upsert(self, rows: DataFrame, order: list[str] | None = None, tag: str = "") -> int:
        """Adds rows, in place of those of their keys. Of several rows of a key the last by order counts, without an order the largest by all
        columns. Compacts where there are many segments or much in them."""
        after, segments = self.version()
        last = Window.partitionBy(self.key).orderBy(*[F.desc_nulls_last(c) for c in (order or [c for c in rows.columns if c != self.key])])
        once = rows.where(F.col(self.key).isNotNull()).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        fields = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        number = self.commit([*segments, self._segment(once.select(*fields), tag)], after)
        later = segments[1:]
        if len(segments) >= MOST_SEGMENTS or segments and sum(s.rows for s in later) > MOST_SHARE * max(1, segments[0].rows):
            number = self.compact()
        return number

    def compact(self) -> int:
        """The same rows as one segment; the tags of loads stay known."""
        after, segments = self.version()
        if len(segments) < 2:
            return after
        tags = ",".join(dict.fromkeys(t for s in segments for t in s.tag.split(",") if t))
        return self.commit([replace(self._segment(self._merged(segments)), tag=tags)], after)

    def load(self, rows: DataFrame, batches: int = 1, name: str = "load", tell: Callable[[int, int, int], None] | None = None, order: list[str] | None = None) -> None:
        """Upserts rows in batches by a hash of their keys, each a version of its own. A load that was stopped goes on with the batches that
        have no segment yet; tell gets (batch, batches, rows) of each."""
        for k in range(batches):
            tag = f"{name}:{k}/{batches}"
            done = {t for s in self.version()[1] for t in s.tag.split(",")}
            if tag not in done:
                self.upsert(rows.where(F.pmod(F.xxhash64(self.key), F.lit(batches)) == k), order, tag)
            if tell is not None:
                tell(k + 1, batches, sum(s.rows for s in self.version()[1] if tag in s.tag.split(",")))

    def vacuum(self, kept: int = KEPT) -> list[str]:
        """Deletes versions but the last kept whole ones, and segments that none of those names; returns what went. Readers of older
        versions, and writers that have not committed, must be done."""
        numbers = self._numbers()
        whole = [n for n in numbers if self._read(n) is not None][-kept:]
        named = {s.path for n in whole for s in self._read(n) or []}
        at, fs = self._fs(f"{self.folder}/segments")
        gone = [f"{self.folder}/segments/{f.getPath().getName()}" for f in (fs.listStatus(at) if fs.exists(at) else [])]
        gone = [p for p in gone if p not in named]
        for path in [*gone, *(f"{self.folder}/versions/v-{n:012d}.json" for n in numbers if n not in whole and n != max(numbers))]:
            where, fs = self._fs(path)
            fs.delete(where, True)
        return gone
