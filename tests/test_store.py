"""The table of segments: what a write writes, what readers see, what a crash leaves; and files of vectors, made once each."""

import os
from pathlib import Path

import numpy as np
import pytest

from foliant.sources import segments, store
from foliant.sources.segments import Conflict, SegmentTable

SCHEMA = "id string, v long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(table):
    found = [(r.id, r.v) for r in table.table().collect()]
    assert len(found) == len({k for k, _ in found})
    return dict(found)


def test_an_upsert_writes_only_its_rows(spark, tmp_path):
    t = SegmentTable(spark, str(tmp_path / "t"), "id", SCHEMA)
    assert not t.exists() and t.table().count() == 0
    t.replace(rows(spark, *[(f"k{i:04d}", i) for i in range(1000)]))
    t.upsert(rows(spark, ("k0003", -3), ("new", 1), ("new", 2), (None, 9)))
    _, found = t.version()
    assert [s.rows for s in found] == [1000, 2] and (found[1].low, found[1].high) == ("k0003", "new")
    assert len(held(t)) == 1001 and held(t)["k0003"] == -3 and held(t)["new"] == 2 and held(t)["k0004"] == 4
    t.upsert(rows(spark, ("new", 1)), ["v"])
    assert held(t)["new"] == 1  # the last write counts, not the largest value
    assert {r.id: r.v for r in t.get(["k0003", "k0500", "none"]).collect()} == {"k0003": -3, "k0500": 500}


def test_large_later_segments_are_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FEW_ROWS", 0)
    t = SegmentTable(spark, str(tmp_path / "t"), "id", SCHEMA)
    for k in range(4):
        t.upsert(rows(spark, *[(f"k{i}", k) for i in range(k, 10)]))
    assert held(t) == {f"k{i}": min(i, 3) for i in range(10)}


def test_a_reader_sees_one_version(spark, tmp_path):
    t = SegmentTable(spark, str(tmp_path / "t"), "id", SCHEMA)
    t.replace(rows(spark, ("a", 1), ("b", 2)))
    before = t.table()
    t.upsert(rows(spark, ("a", 10), ("c", 3)))
    between = t.table()
    t.compact()
    assert {r.id: r.v for r in before.collect()} == {"a": 1, "b": 2} and {r.id: r.v for r in between.collect()} == {"a": 10, "b": 2, "c": 3} == held(t)
    assert len(t.version()[1]) == 1
    gone = t.vacuum(kept=1)
    assert len(gone) == 2 and held(t) == {"a": 10, "b": 2, "c": 3} and t.vacuum(kept=1) == []


def test_crashes_between_steps(spark, tmp_path, monkeypatch):
    folder = tmp_path / "t"
    t = SegmentTable(spark, str(folder), "id", SCHEMA)
    t.replace(rows(spark, ("a", 1)))
    # after the segment, before the version
    monkeypatch.setattr(SegmentTable, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.upsert(rows(spark, ("a", 2)))
    monkeypatch.undo()
    assert held(t) == {"a": 1} and len(list((folder / "segments").iterdir())) == 2
    # while the version was written
    number, found = t.version()
    last = next((folder / "versions").glob(f"v-{number:012d}.json"))
    for text in ("", last.read_text()[:20], last.read_text()[:-1] + "x"):
        (folder / "versions" / f"v-{number + 1:012d}.json").write_text(text)
        assert t.version() == (number, found) and held(t) == {"a": 1}
    t.upsert(rows(spark, ("b", 5)))
    assert held(t) == {"a": 1, "b": 5} and t.version()[0] == number + 2
    assert len(t.vacuum()) == 1 and held(t) == {"a": 1, "b": 5}


def test_of_two_writers_one_wins(spark, tmp_path):
    one, two = (SegmentTable(spark, str(tmp_path / "t"), "id", SCHEMA) for _ in range(2))
    one.replace(rows(spark, ("a", 1)))
    after, found = two.version()
    one.upsert(rows(spark, ("a", 2)))
    with pytest.raises(Conflict):
        two.commit([*found, two._segment(rows(spark, ("a", 3)))], after)
    assert held(one) == held(two) == {"a": 2}


def test_loads_go_on_where_they_were(spark, tmp_path, monkeypatch):
    t = SegmentTable(spark, str(tmp_path / "t"), "id", SCHEMA)
    data = rows(spark, *[(f"k{i}", i) for i in range(200)])
    calls, plain = [], SegmentTable.upsert

    def upsert(self, part, order=None, tag=""):
        if len(calls) == 2:
            calls.append(tag)
            raise OSError("stopped")
        calls.append(tag)
        return plain(self, part, order, tag)

    monkeypatch.setattr(SegmentTable, "upsert", upsert)
    with pytest.raises(OSError):
        t.load(data, 4, "first")
    told = []
    t.load(data, 4, "first", lambda *x: told.append(x))
    assert calls == ["first:0/4", "first:1/4", "first:2/4", "first:2/4", "first:3/4"] and held(t) == {f"k{i}": i for i in range(200)} and [x[:2] for x in told] == [(k, 4) for k in range(1, 5)]
    t.compact()
    t.load(data, 4, "first")
    assert len(calls) == 5  # known as done after compaction too


def test_many_upserts_are_compacted(spark, tmp_path):
    t = SegmentTable(spark, str(tmp_path / "t"), "id", SCHEMA)
    t.replace(rows(spark, *[(f"k{i}", 0) for i in range(20)]))
    for k in range(6):
        t.upsert(rows(spark, (f"k{k}", k), (f"x{k}", k)))
    assert len(t.version()[1]) < 6 and held(t) == {**{f"k{i}": i if i < 6 else 0 for i in range(20)}, **{f"x{k}": k for k in range(6)}}


class Failing:
    def __init__(self, bad):
        self.bad = bad

    def encode(self, texts):
        if any(self.bad in t for t in texts):
            raise ValueError("stopped")
        return np.array([[len(t), 1.0, 0.0] for t in texts], np.float32)


def test_files_of_vectors_are_made_once(spark, tmp_path):
    for name in "abcde":
        (tmp_path / "set").mkdir(exist_ok=True)
        made = spark.createDataFrame([(f"{name}{i}", f"text {name} {i}") for i in range(4 if name != "e" else 0)], "chunk_id string, text string").coalesce(1)
        made.write.parquet(str(tmp_path / f"w{name}"))
        next(Path(tmp_path / f"w{name}").glob("part-*.parquet")).rename(tmp_path / "set" / f"{name}.parquet")
    folder = str(tmp_path / "set")
    with pytest.raises(Exception, match="stopped"):
        store.encode_files(spark, folder, lambda: Failing("text c"), 3, at_once=2)
    done = {p.name: os.stat(p).st_mtime_ns for p in (tmp_path / "set" / "embeddings").glob("*.parquet")}
    assert sorted(done) == ["a.embeddings.parquet", "b.embeddings.parquet"]
    assert store.encode_files(spark, folder, lambda: Failing("none"), 3, at_once=2) == 3
    after = {p.name: os.stat(p).st_mtime_ns for p in (tmp_path / "set" / "embeddings").glob("*.parquet")}
    assert len(after) == 5 and all(after[k] == v for k, v in done.items())
    assert {r.chunk_id for r in spark.read.parquet(f"{folder}/embeddings/c.embeddings.parquet").collect()} == {f"c{i}" for i in range(4)} and spark.read.parquet(f"{folder}/embeddings/e.embeddings.parquet").count() == 0
    assert store.encode_files(spark, folder, lambda: Failing("none"), 3) == 0
