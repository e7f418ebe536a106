import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.models import plugins
from foliant.operators import dense, evidence, fusion, lexical, regression, repair, structure


def test_bm25_against_plain_python(spark):
    docs = {"a": "red blue blue", "b": "red red green", "c": "", "d": "blue"}
    index = lexical.build(spark.createDataFrame(list(docs.items()), "chunk_id string, text string"))
    got = {r.chunk_id: (r.score, r["rank"]) for r in lexical.search(index, spark.createDataFrame([("q", "Blue RED red none")], "query_id string, text string"), 10).collect()}
    words = {k: v.split() for k, v in docs.items()}
    avg = sum(map(len, words.values())) / len(words)
    want = {}
    for k, ws in words.items():
        want[k] = 0.0
        for t in ("blue", "red"):
            df, tf = sum(t in w for w in words.values()), ws.count(t)
            if tf:
                want[k] += (math.log((4 - df + 0.5) / (df + 0.5)) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avg))
    assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert [k for k, v in sorted(got.items(), key=lambda x: x[1][1])] == sorted(want, key=lambda k: (-want[k], k))


def test_bm25_negative_scores_rank_below_zero(spark):
    rows = [(f"c{i}", "common") for i in range(9)] + [("z", "rare")]
    found = lexical.search(lexical.build(spark.createDataFrame(rows, "chunk_id string, text string")), spark.createDataFrame([("q", "common")], "query_id string, text string"), 10).orderBy("rank").collect()
    assert found[0].chunk_id == "z" and found[0].score == 0 and all(r.score < 0 for r in found[1:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n?;", max_size=80), max_size=12), st.integers(5, 40))
def test_packing_loses_no_paragraph(paragraphs, target):
    groups = structure.pack_paragraphs(paragraphs, target, 2 * target)
    assert [i for g in groups for i in g] == list(range(len(paragraphs)))
    for g in groups:
        assert len(g) == 1 or len("\n\n".join(paragraphs[i] for i in g)) <= target


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n?;", max_size=300), st.integers(3, 40))
def test_split_keeps_all_words_and_the_limit(text, most):
    pieces = structure.split_recursively(text, most)
    assert all(0 < len(p) <= most for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())


def test_rrf_does_not_depend_on_order(spark):
    rows = [("q", f"c{i}", m, r) for m in ("x", "y") for r, i in enumerate(random.Random(m).sample(range(20), 10), 1)]
    one = fusion.rrf(spark.createDataFrame(rows, "query_id string, chunk_id string, method string, rank int"), digits=9).collect()
    two = fusion.rrf(spark.createDataFrame(rows[::-1], "query_id string, chunk_id string, method string, rank int"), digits=9).collect()
    assert sorted(one) == sorted(two) and max(r.rrf_score for r in one) <= 2 / 61


def test_min_max_conventions(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, v double")
    assert sorted(r.s for r in rows.select(fusion.min_max("v", "k", 1.0).alias("s")).collect()) == [0, 1, 1, 1]
    assert sorted(r.s for r in rows.select(fusion.min_max("v", "k", 0.0).alias("s")).collect()) == [0, 0, 0, 1]


@pytest.mark.parametrize("method", dense.METHODS)
def test_vector_search_in_blocks_with_odd_rows(spark, method, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 2)
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)] + [(98, None), (99, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, [float(i), 1.0, 0.5]) for i in range(5)], "query_id long, vector array<float>")
    got = {(r.query_id, r["rank"]): r.id for r in dense.search(v, q, 4, method, digits=9).collect()}
    for i in range(5):
        def s(x):
            d = sum(a * b for a, b in zip(x, (i, 1, 0.5)))
            n = math.sqrt(sum(a * a for a in x)) * math.sqrt(i * i + 1.25)
            return {"dot": d, "cosine": d / n, "l2": -math.dist(x, (i, 1, 0.5))}[method]

        want = sorted((-round(s(x), 9), k) for k, x in rows if x and len(x) == 3)[:4]
        assert [got[i, r] for r in range(1, 5)] == [k for _, k in want]


def test_text_functions(spark):
    row = spark.sql("SELECT 'a <b>bold</b>  text\r\n [x](y)' AS t, 'label: one: two\nno\nx:y' AS kv").select(
        tx.strip_markup(F.col("t")).alias("m"), tx.unwrap_links(F.col("t")).alias("l"), tx.key_values(F.col("kv")).alias("kv"), tx.truncate(F.lit("abcdef"), 4).alias("tr"),
        tx.token_estimate(F.lit("abc")).alias("e"), tx.iso_date(F.lit("2020"), F.lit("3"), F.lit("9")).alias("d"), tx.sentences(F.lit("One. Two? Three")).alias("s"),
    ).first()
    assert row.m == "a bold text [x](y)" and row.l.endswith(" x") and [tuple(x) for x in row.kv] == [("label", "one: two"), ("x", "y")]
    assert row.tr == "abc…" and row.e == 1 and row.d == "2020-03-09" and row.s == ["One.", "Two?", "Three"]


def test_field_detectors(spark):
    texts = {"percentage": "12.5% of", "p-value": "p < 0.001", "confidence_interval": "95% CI 1.2", "effect_estimate": "OR = 2.1", "sample_size": "(n = 40)"}
    for name, text in texts.items():
        assert name in spark.range(1).select(tx.detect_fields(F.lit(text)).alias("f")).first().f
    assert spark.range(1).select(tx.detect_fields(F.lit("nothing here")).alias("f")).first().f == []


def test_greedy_prefers_new_requirements():
    rows = [{"chunk_id": c, "final": f, "covers": k, "paper_id": p, "chunk_type": "t"} for c, f, k, p in (("a", 1.0, ["r1"], "p1"), ("b", 0.99, ["r1"], "p1"), ("c", 0.9, ["r2"], "p2"), ("d", 0.0, [], "p3"))]
    order = [x["chunk_id"] for x in evidence.pick_greedily(rows, 2)]
    assert order[:2] == ["a", "c"] and sorted(order) == ["a", "b", "c", "d"]


def test_intent_score_and_coverage(spark):
    schema = "requirement_id string, chunk_id string, paper_id string, text string, chunk_type string, encoder double, paper double, type_match double, fields array<string>, " + ", ".join(f"{c} array<string>" for c in ("concepts", "conditions", "targets", "outcomes", "populations", "requested", "generics")) + ", confusables array<struct<own:string,other:string>>, competing array<struct<own:string,other:string>>"
    rows = [
        ("r", "good", "p", "Iron therapy raised ferritin in adults, p < 0.01", "paragraph", 0.9, 1.0, 1.0, ["p-value"], ["iron therapy"], [], ["ferritin"], [], ["adults"], ["p-value"], [], [], [("adults", "children")]),
        ("r", "bad", "p", "Children slept well", "paragraph", 0.1, 0.0, 0.0, [], ["iron therapy"], [], ["ferritin"], [], ["adults"], ["p-value"], [], [], [("adults", "children")]),
    ]
    got = {r.chunk_id: r for r in evidence.score(spark.createDataFrame(rows, schema)).collect()}
    assert got["good"].covered and got["good"].match == pytest.approx(1.0) and got["good"].penalty == 0
    assert got["good"].final == pytest.approx(0.45 * 0.9 + 0.18 + 0.12 + 0.12 + 0.05 + 0.05)
    assert not got["bad"].covered and got["bad"].final == 0


def test_markdown_and_tables(spark):
    doc = "# A\n### B\ntext\n| a | b |\n| - | - |\n\n| c |\n<table></table>"
    p = structure.markdown_profile(spark.createDataFrame([(1, doc)], "doc_id long, text string")).first()
    assert (p.n_headings, p.deepest, p.n_jumps, p.n_html_tables, p.n_pipe_tables) == (2, 3, 1, 1, 2)
    doc = "Table 1. Ages[^a]\n\n<table>\n<tr># no heading | x |\n[^q]\n</table></table>\n\n# H[^b]\n**Table 2** alone\ntext\n| a |\n\n[^a]: said[^c]\n[^b]: more"
    p = structure.markdown_profile(spark.createDataFrame([(1, doc), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert tuple(p[0]) == (1, 1, 1, 0, 1, 1, 2, 1, 2, 3, 1) and tuple(p[1]) == (2, *[0] * 10)
    chunks = [("p", "t", "table_summary", 0, "Table 1. X\nColumns:\n- Name\n- Value"), ("p", "t", "table_row", 2, "r2"), ("p", "t", "table_row", 1, "r1"), ("p", "t", "table_footnotes", 3, "[a] note")]
    rows = spark.createDataFrame([(p, t, f"c{n}", k, n, x) for p, t, k, n, x in chunks], "paper_id string, table_id string, chunk_id string, chunk_type string, position int, text string")
    tables = structure.assemble_tables(rows)
    t = tables.first()
    assert (t.caption, t.headers, t.rows, t.footnotes) == ("Table 1. X", ["Name", "Value"], ["r1", "r2"], ["[a] note"])
    assert structure.table_context(rows).where("chunk_id = 'c2'").first().context == "Table 1. X\nName | Value\nr1\nr2\n[a] note"
    long = spark.createDataFrame([("p", "t", f"c{n}", "table_row", n, f"row {n}") for n in range(60)] + [("p", "t", "n", "table_footnotes", 99, "note")], rows.schema)
    got = {r.chunk_id: r.context for r in structure.table_context(long, rows_around=2).collect()}
    assert got["c50"] == "Table t\n" + "\n".join(f"row {n}" for n in range(48, 53)) + "\nnote" and got["c0"].startswith("Table t\nrow 0\nrow 1\nrow 2\nnote") and got["n"] == "Table t\n" + "\n".join(f"row {n}" for n in range(5)) + "\nnote"


def test_repair_keeps_what_is_covered():
    of = lambda **rows: {c: (f, frozenset(k)) for c, (f, *k) in rows.items()}
    picked = of(a=(0.9, "r1"), b=(0.2, "r1"), c=(0.5, "r2"))
    found = of(x=(0.3, "r3"), y=(0.4, "r3"), z=(1.0, "r1"))
    assert sorted(repair.augment(picked, found, ["r1", "r2", "r3", "r4"], 3)) == ["a", "c", "y"] and sorted(repair.augment(picked, found, ["r3"], 4)) == ["a", "b", "c", "y"]
    assert repair.augment(of(a=(1.0, "r1")), found, ["r3"], 1) == of(a=(1.0, "r1"))
    # both rows alone cover r1 together: two open requirements must not take both
    both = repair.augment(of(a=(0.9, "r1"), b=(0.8, "r1")), of(c=(0.7, "r2"), d=(0.6, "r3")), ["r1", "r2", "r3"], 2)
    assert sorted(both) == ["a", "c"]
    # a path: for r3 a row goes whose requirement another brings back, which itself stands in for a second one
    path = repair.augment(of(a=(0.9, "r1"), b=(0.8, "r2")), of(c=(0.5, "r3"), d=(0.4, "r1", "r2")), ["r1", "r2", "r3"], 2)
    assert sorted(path) == ["c", "d"]


@pytest.mark.parametrize("seed", range(5))
def test_coverage_never_shrinks(seed):
    rng = random.Random(seed)
    for _ in range(300):
        needs = [f"r{k}" for k in range(rng.randrange(1, 7))]
        rows = {f"c{k}": (rng.random(), frozenset(r for r in needs if rng.random() < 0.3)) for k in range(rng.randrange(1, 14))}
        slots = rng.randrange(1, 6)
        picked = {c: rows[c] for c in rng.sample(sorted(rows), min(len(rows), rng.randrange(0, slots + 1)))}
        out = repair.augment(picked, rows, needs, slots)
        covered = lambda x: {r for _, k in x.values() for r in k}
        assert covered(picked) & set(needs) <= covered(out) and len(out) <= slots and all(rows[c] == v for c, v in out.items())
        if len(picked) < slots:
            assert len(covered(out)) >= min(1, len(set().union(*(k for _, k in rows.values()))))


def test_runs_against_a_golden_one(spark):
    kind = "requirement_id string, item_id string, rank int"
    golden = spark.createDataFrame([("r1", "a", 1), ("r1", "b", 2), ("r1", "c", 3), ("r2", "x", 1), ("r3", "y", 1)], kind)
    run = spark.createDataFrame([("r1", "a", 1), ("r1", "c", 2), ("r1", "d", 3), ("r2", "x", 1), ("r4", "z", 1)], kind)
    got = {r.requirement_id: r for r in regression.align(golden, run, p=0.5).collect()}
    want = (1 * 1 + 0.5 * 1 / 2 + 0.25 * 2 / 3) / (1 + 0.5 + 0.25)
    assert got["r1"].overlap == pytest.approx(want) and (got["r1"].lost, got["r1"].gained) == (["b"], ["d"]) and got["r2"].overlap == 1.0 and got["r3"].overlap == got["r4"].overlap == 0.0
    known = spark.createDataFrame([("r1", "a"), ("r2", "w"), ("r5", "q")], "requirement_id string, item_id string")
    ok = {r.requirement_id: (r.passed, r.missing) for r in regression.passed(regression.align(golden, run), run, known).collect()}
    assert ok == {"r1": (True, []), "r2": (False, ["w"]), "r3": (False, []), "r4": (False, []), "r5": (False, ["q"])}


def test_macro_batches_score_as_one_by_one(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    rows = spark.createDataFrame([(i, f"q{i % 7}", say(1 + i % 7), say(rng.randrange(0, 300))) for i in range(400)] + [(400, "q1", None, None)], "i long, query_id string, q string, p string").repartition(5)
    one = {r.i: r.s for r in plugins.score_pairs(rows, F.col("q"), F.col("p"), plugins.OverlapScorer, "s", batch=1).collect()}
    scored = plugins.score_macro_batches(rows, F.col("q"), F.col("p"), plugins.OverlapScorer, "s", budget=1000)
    got = scored.collect()
    assert {r.i: r.s for r in got} == one and scored.columns == ["i", "query_id", "q", "p", "s", "bucket", "batch_seconds"] and len({r.bucket for r in got}) > 3
    assert plugins.batch_latency(scored).agg(F.sum("pairs")).first()[0] == 401


def test_texts_that_are_no_content(spark):
    rows = spark.createDataFrame([("Funding", "x", True), ("Results", " The authors declare nothing", True), ("Results", "Correction to: that", True), ("Results", "We funded it", False), (None, None, False)], "s string, t string, want boolean")
    assert all(r.want == r.got for r in rows.select("want", tx.non_content(F.col("s"), F.col("t")).alias("got")).collect())
