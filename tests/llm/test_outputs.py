"""Whitening, bit-plane files and the prefix trie, against brute force and in odd cases; neighbours over several partitionings."""

import hashlib
import random
import zlib
from array import array

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import bitplanes, prefixtrie, vectors, whitening
from tests.compare import assert_same

EMB = "vec_id long, embedding array<double>"
CONV = "conv_id long, turn long, role string, text string"


# ---- whitening ------------------------------------------------------------------------------------


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 33):
        a = rng.normal(size=(n, n))
        a = a @ a.T
        values, turned = whitening.jacobi(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-10, atol=1e-12 * values[0]) and np.allclose(turned @ np.diag(values) @ turned.T, a) and np.allclose(turned.T @ turned, np.eye(n), atol=1e-13)
    scale = 10.0 ** np.arange(0, -24, -3)  # eigenvalues over 42 decades, of a well-scaled matrix
    core = np.eye(8) + 0.1 * np.ones((8, 8))
    values, _ = whitening.jacobi(core * np.outer(scale, scale))
    from fractions import Fraction

    product = Fraction(1)
    for v in values:
        product *= Fraction(float(v))
    want = float(np.linalg.det(core))
    for s in scale:
        product /= Fraction(float(s)) ** 2
    assert abs(float(product) / want - 1) < 1e-9  # the product holds every eigenvalue, the smallest too
    assert whitening.jacobi(np.zeros((4, 4)))[0].tolist() == [0.0] * 4


def brute_whitening(rows, components=4):
    x = {k: np.floor(np.array(v) * 256).astype(np.int64) for k, v in rows.items()}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    values, turned = np.linalg.eigh(y.T @ y / n)
    values, turned = values[::-1], turned[:, ::-1]
    k = min(components, len(s))
    return {(i, c + 1): (n, int(((n * v - s) ** 2).sum()), abs(float((v - s / n) @ turned[:, c]) / values[c] ** 0.5), values[c] / values.sum()) for i, v in x.items() for c in range(k)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_whitening_against_brute_force(spark, partitions):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 12)) * np.linspace(3, 0.5, 12)
    x[50:300] = x[50]  # copies count once
    rows = {i: v.tolist() for i, v in enumerate(x)}
    odd = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [1.0] * 5), (905, [])]
    df = spark.createDataFrame([*rows.items(), *odd], EMB).withColumn("x", F.lit(1)).withColumn("id", F.lit(2)).repartition(partitions)
    got = whitening.digest(df).collect()
    want = brute_whitening(rows)
    assert len(got) == len(want) == 4 * 700
    signs = {}
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation, int(r.deviation_exact)) == (n, deviation, deviation) and abs(r.explained / explained - 1) < 1e-9 and abs(abs(r.whitened) - whitened) < 1e-9 and r.identity_error < 1e-9
        signs.setdefault(r.component, []).append(r.whitened)
    own = np.array([signs[c] for c in (1, 2, 3, 4)])
    assert np.linalg.matrix_rank(np.corrcoef(own)) == 4


def test_whitening_edges(spark):
    of = lambda rows: sorted(tuple(r) for r in whitening.digest(spark.createDataFrame(rows, EMB)).collect())
    assert of([]) == [] and of([(1, None), (2, [])]) == []
    one = whitening.digest(spark.createDataFrame([(1, [0.5, -0.001]), (1, [0.5, -0.001]), (None, [0.5, -0.001])], EMB)).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, 0.0)} and sum(r.vec_id is None for r in one) == 2
    # a vector of zeros stays; a second component without variance has no whitened value
    two = whitening.digest(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], EMB)).collect()
    assert sorted((r.vec_id, r.component, r.deviation, r.whitened and abs(round(r.whitened, 9)), r.explained) for r in two) == [(1, 1, 256**2, 1.0, 1.0), (1, 2, 256**2, None, 0.0), (2, 1, 256**2, 1.0, 1.0), (2, 2, 256**2, None, 0.0)]
    far = whitening.digest(spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [1e30])], EMB)).collect()
    x = {1: int(256e12), 2: -int(256e12), 3: 2**63 - 1}
    for r in far:
        exact = (3 * x[r.vec_id] - sum(x.values())) ** 2
        assert r.deviation is None and (int(r.deviation_exact) == exact if exact < 10**38 else r.deviation_exact is None)


# ---- bit planes -----------------------------------------------------------------------------------


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bitplanes.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_pieces_as_the_library_makes_them():
    rng = random.Random(5)
    parts = ["a", "Z", "é", "×", "÷", "ß", "1", "9", "'", "'s", "'ll", "’", "n't", " ", "  ", "\n", "\n\n", "\t", " \n", "\r\n", ".", ",", "!", "(", "<|endoftext|>", "<|", "中", "文", " ", " ", "　", "\x85", "\x1c", "\x0b", "²", "٣", "🙂", "_", "­", "\x00", "字。", "ñandú", "œ", "Σ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(4000)] + ["", None]
    got = []
    for _, ids, sizes in bitplanes.encode(pa.array(texts), bitplanes.default_tokenizer()):
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == encoded(texts)


def test_pieces_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(bitplanes, "MOST_PIECES", 50)
    encoder = bitplanes.Encoder(bitplanes.default_tokenizer())
    rng = random.Random(6)
    for _ in range(30):
        pieces = list({" " + "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 4))) for _ in range(40)})
        first, size, flat = encoder.ids(pieces)
        assert [flat[a : a + n].tolist() for a, n in zip(first, size)] == [x[:-1] for x in encoded(pieces)]
    assert len(encoder.places) <= 50 + 40


@pytest.mark.parametrize("kind", [1, 8])
def test_plane_files_round_trip(tmp_path, kind):
    rng = np.random.default_rng(7)
    for ids in (np.zeros(0), np.zeros(10), rng.integers(0, 50257, 1), rng.integers(0, 50257, 1000), rng.integers(0, 2**32, 333), np.full(256, 255), rng.integers(0, 3, 257)):
        ids = ids.astype("<u4")
        out = bitplanes.PlaneWriter(str(tmp_path), "x", kind, chunk_ids=100)
        cuts = np.sort(rng.integers(0, len(ids) + 1, 4))
        for part in np.split(ids, cuts):
            out.add(part, np.array([-5]), np.array([False]), np.array([len(part)]))
        assert out.close() == (tmp_path / "x").stat().st_size
        file = bitplanes.PlaneFile(str(tmp_path), "x")
        assert file.n_ids == len(ids) and [n for _, _, m in file.documents() for n in m] == [len(p) for p in np.split(ids, cuts)]
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2))
            assert (file.ids(int(a), int(b - a)) == ids[a:b]).all()
    data = bytearray((tmp_path / "x").read_bytes())
    data[-30] ^= 1
    (tmp_path / "x").write_bytes(data)
    with pytest.raises(ValueError):
        bitplanes.PlaneFile(str(tmp_path), "x")


@pytest.mark.parametrize("files", [1, 6])
def test_bit_planes_against_the_library(spark, tmp_path, files):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "beta,", "gamma's", "δ", "12", "\n"]) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    rows = [(i * 3 - 200, t) for i, t in enumerate(texts)] + [(9_000, "word " * 90_000), (9_001, None), (9_002, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("row", F.lit(2)).repartition(5)
    manifest = bitplanes.write_ids(df, str(tmp_path / "ids"), files=files)
    rows.sort()
    at, want = 0, []
    for (i, _), ids in zip(rows, encoded([t for _, t in rows])):
        want.append((i, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in bitplanes.checksums(manifest).collect()) == want
    whole = {r.doc_id: (r.start, list(r.ids)) for r in bitplanes.read_ids(manifest).collect()}
    assert all(whole[i] == (w[1], ids) for i, w, ids in zip([i for i, _ in rows], want, encoded([t for _, t in rows])))
    assert len(list((tmp_path / "ids").iterdir())) == manifest.count() <= files


def test_bit_planes_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bitplanes.digest(empty).count() == 0
    rows = [(5, "same"), (5, "same"), (5, "other"), (None, "no id"), (None, None)]
    got = sorted(bitplanes.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 5, 5, 5] and [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(x), zlib.crc32(array("I", x).tobytes())) for x in encoded([t for _, t in rows]))
    # a file that no committed row names is taken away
    stray = tmp_path / "ids"
    stray.mkdir()
    (stray / "shard-000000-lost.ids").write_bytes(b"half a file")
    manifest = bitplanes.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), str(stray))
    assert sorted(p.name for p in stray.iterdir()) == sorted(r.file for r in manifest.collect())


# ---- prefix trie ----------------------------------------------------------------------------------


def brute_trie(rows, families=True):
    said = {}
    for c, t, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in said.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = tuple([*own.get(base, [])[:h], *t[h:]]) if families else tuple(t)
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    below = {key: [k for k in nodes if k[: len(key)] == key] for key in nodes}
    out = set()
    for key, members in nodes.items():
        ends = sorted(c for c in members if len(built[c]) == len(key))
        out.add((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below[key]), sum(sum(len(j) == len(k) + 1 for j in below[k]) == 0 for k in below[key]),
            sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below[key] if k), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_against_brute_force_and_sql(spark, seed, tmp_path):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 120), 80):
        for t in range(rng.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, t if rng.random() < 0.95 else rng.choice([None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["é", "b", "", None]) if t < 3 else str(rng.randrange(3))))
    rows += rows[:3] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, CONV).withColumn("depth", F.lit(1)).withColumn("c", F.lit(7)).withColumn("own", F.lit(None).cast("string")).repartition(6)
    assert {tuple(r) for r in prefixtrie.digest(df).collect()} == brute_trie(rows)
    assert {tuple(r) for r in prefixtrie.trie(df, families=False).collect()} == brute_trie(rows, False)
    c = duckdb.connect()
    c.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    assert_same(prefixtrie.digest(df), c, prefixtrie.SQL)


def test_trie_edges(spark, monkeypatch):
    empty = spark.createDataFrame([], CONV)
    assert prefixtrie.digest(empty).count() == 0
    assert prefixtrie.digest(spark.createDataFrame([(None, 1, "user", "x")], CONV)).count() == 0
    lone = [(c, 0, "user", "only") for c in (1, 2, 3, 4)]  # the first of the family is absent: nothing is left of some
    assert {tuple(r) for r in prefixtrie.digest(spark.createDataFrame(lone, CONV)).collect()} == brute_trie(lone)
    deep = [(c, t, "user", "x" if t < 500 * c else f"y{c}") for c in (1, 2, 3, 4) for t in range(2000)]  # ends of many buckets, deep paths
    monkeypatch.setattr(prefixtrie, "BUCKET", 4)
    got = prefixtrie.trie(spark.createDataFrame(deep + [(c, 0, "user", "same") for c in range(100, 200)], CONV), families=False)
    assert got.count() == 1 + 2000 + 1500 + 1000 + 500 + 1
    same = got.where("depth = 1 and conv_id = 100").first()
    assert same.n_convs == 100 and same.n_leaves == 1 and same.saved_tokens == 99 * 4 and same.ends_sha256 == hashlib.sha256(",".join(map(str, range(100, 200))).encode()).hexdigest()
    top = got.where("depth = 0").first()
    assert (top.conv_id, top.n_convs, top.n_leaves, top.n_children, top.parent_conv_id) == (1, 104, 5, 2, None)


# ---- neighbours -----------------------------------------------------------------------------------


def neighbours(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.digest(df).collect())


def test_neighbours_do_not_depend_on_partitions(spark, sf):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 48))
    x[100:350] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(40, x[700].tolist())] * 30, EMB)
    first = neighbours(df.repartition(1))
    assert len(first) == 45 * 20
    for n in (7, 32):
        assert neighbours(df.repartition(n)) == first


def test_neighbours_are_whole_lists_with_recall(spark):
    for scale in ("0.01", "0.1"):
        e = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet")
        rows = e.collect()
        ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
        got = {}
        for q, rank, v, _ in neighbours(e):
            got.setdefault(q, {})[rank] = v
        hits = 0
        for k, q in enumerate(ids.tolist()):
            if q % 20 == 0:
                s = (x * x[k]).sum(1)
                s[k] = -np.inf
                want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
                assert sorted(got[q]) == list(range(1, 21))
                hits += len(want & set(got[q].values()))
        assert hits / (20 * len(got)) >= 0.9
