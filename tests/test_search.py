"""Pruned BM25, graph search and exact search dealt in blocks, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import dense, graph, impacts, lexical
from foliant.queries import retrieval

VECTORS = "vec_id long, embedding array<double>"


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("shard_chunks,block", [(100_000, 128), (700, 16), (50, 4)])
def test_pruned_search_is_exact(spark, sf, shard_chunks, block):
    chunks = retrieval.chunks(spark, sf)
    index = impacts.build(chunks, shard_chunks=shard_chunks, block=block)
    queries = spark.createDataFrame([("a", "the of and"), ("b", "der die und"), ("c", "of"), ("d", ""), ("e", "nowhere1 nowhere2"), ("f", None), ("g", "the nowhere1"), ("h", "the the of in to und les der")], "query_id string, text string")
    plain = lexical.build(chunks)
    for k, fill in ((1, False), (60, True)):
        assert rows_of(impacts.search(index, queries, k, zero_fill=fill, digits=6)) == rows_of(lexical.search(plain, queries, k, zero_fill=fill, digits=6))
    assert index.n_total == plain.n_total and abs(index.mean_length - plain.stats.first()["avgdl"]) < 1e-9


def test_pruned_search_skips_blocks(spark):
    texts = [(f"c{i:05d}", " ".join(["common"] * (i % 5 < 2) * (1 + (i % 995 == 0) * 30) + [f"w{i % 50}"] * 3)) for i in range(4000)]
    index = impacts.build(spark.createDataFrame(texts, "chunk_id string, text string").repartition(3), block=16)
    queries = spark.createDataFrame([("q", "common")], "query_id string, text string")
    row = impacts.search(index, queries, 3, counts=True).first()
    assert row.blocks == 100 and row.decoded < 25
    everything = impacts.search(index, queries, 4000, counts=True).first()
    assert everything.decoded == everything.blocks


def test_impact_index_from_disk(spark, sf, tmp_path):
    index = impacts.build(retrieval.chunks(spark, sf), shard_chunks=500)
    index.save(str(tmp_path / "ix"))
    again = impacts.load(spark, str(tmp_path / "ix"))
    assert rows_of(impacts.search(again, retrieval.asked(spark), 20, digits=6)) == rows_of(impacts.search(index, retrieval.asked(spark), 20, digits=6))
    again.docs.limit(1).write.mode("overwrite").parquet(str(tmp_path / "ix2/docs"))
    spark.read.parquet(str(tmp_path / "ix/stats")).write.parquet(str(tmp_path / "ix2/stats"))
    with pytest.raises(ValueError):
        impacts.load(spark, str(tmp_path / "ix2"))


def test_impacts_of_nothing(spark):
    empty = impacts.build(spark.createDataFrame([], "chunk_id string, text string"))
    queries = spark.createDataFrame([("a", "x")], "query_id string, text string")
    assert impacts.search(empty, queries, 5).count() == 0
    odd = impacts.build(spark.createDataFrame([("b", None), ("a", ""), ("c", "x"), ("c", "x x")], "chunk_id string, text string"))
    assert [(r.chunk_id, r["rank"]) for r in impacts.search(odd, queries, 5).orderBy("rank").collect()] == [("c", 1), ("c", 2), ("a", 3), ("b", 4)]


def cosine_rows(x, ids, queries, k):
    u = graph.unit(x)
    out = {}
    for q in queries:
        s = u @ u[q]
        out[ids[q]] = [ids[i] for i in np.lexsort((ids, -np.round(s, 6)))[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [16_384, 900])
def test_graph_search_has_recall(spark, shard_rows):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(3000, 24)), rng.normal(size=(40, 24))[rng.integers(0, 40, 1500)] + 0.05 * rng.normal(size=(1500, 24))])
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], VECTORS).repartition(6)
    index = graph.build(df, shard_rows=shard_rows)
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in graph.search(index, asked, 10, digits=6).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    want = cosine_rows(x, ids, range(0, len(x), 50), 10)
    assert sorted(got) == sorted(want) and all(sorted(v) == list(range(1, 11)) for v in got.values())
    assert np.mean([len(set(want[q]) & set(got[q].values())) / 10 for q in want]) >= 0.9


def test_graph_of_copies_odd_vectors_and_disk(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x[20:200] = x[20]  # one vector many times is one node
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [1.0]), (904, [0.0] * 8)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    graph.build(df).save(str(tmp_path / "g"))
    index = graph.load(spark, str(tmp_path / "g"))
    asked = spark.createDataFrame([(1, x[20].tolist()), (2, None), (3, [1.0, 2.0]), (4, x[250].tolist())], "query_id long, vector array<double>")
    got = graph.search(index, asked, 7).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.id) for r in got if r.query_id == 1] == [(1, k + 1, 20 + k) for k in range(7)]
    assert {r.query_id for r in got} == {1, 4} and next(r.id for r in got if r.query_id == 4) == 250
    names = df.withColumn("name", F.concat(F.lit("n"), F.col("vec_id").cast("string")))
    assert graph.search(graph.build(names, id_col="name"), asked, 1).where("query_id = 4").first().id == "n250"
    none = graph.build(df.limit(0))
    assert none.shards == 0 and graph.search(none, asked, 3).count() == 0


def test_links_reach_every_node():
    rng = np.random.default_rng(5)
    g = graph.build_graph(graph.unit(rng.normal(size=(2000, 16))), 1, degree=8, candidates=40)
    seen, todo = set(g.entries.tolist()), list(g.entries.tolist())
    while todo:
        for n in g.links[todo.pop()].tolist():
            if n >= 0 and n not in seen:
                seen.add(n)
                todo.append(n)
    assert len(seen) == 2000


@pytest.mark.parametrize("method", dense.METHODS)
def test_dealt_search_is_the_broadcast_one(spark, monkeypatch, method):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3 if i % 9 else 5).tolist()) for i in range(400)] + [(500, None), (501, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    asked = spark.createDataFrame([(f"q{i}", rng.normal(size=3 if i % 2 else 5).tolist()) for i in range(30)] + [("q90", [1.0]), ("q91", None)], "query_id string, vector array<double>")
    few = sorted(map(tuple, dense.search(df, asked, 6, method=method, digits=6).collect()))
    assert len(few) == 30 * 6
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(dense, "BLOCK_ROWS", 64)
    assert sorted(map(tuple, dense.search(df, asked, 6, method=method, digits=6).collect())) == few
    exact = {i: np.array(v) for i, v in rows if v and None not in v}
    for q, v in ((r.query_id, np.array(r.vector)) for r in asked.collect() if r.vector):
        score = {"dot": lambda a: a @ v, "l2": lambda a: -np.linalg.norm(a - v), "cosine": lambda a: a @ v / np.linalg.norm(a) / np.linalg.norm(v)}[method]
        best = sorted(((-round(float(score(a)), 6), i) for i, a in exact.items() if len(a) == len(v)))[:6]
        assert [i for _, i in best] == [i for q2, i, _, _ in sorted(few, key=lambda r: (r[0], r[3])) if q2 == q]
