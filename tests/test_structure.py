"""Chunks, trees, the document index, front matter, the store, plug-ins, hybrid retrieval and reports on small fixtures."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.models import plugins
from foliant.operators import chunks as ck
from foliant.operators import alike, docindex, hybrid, leafmatch, lexical, repair, report, tree, trees
from foliant.sources import articles, front, store

XML = """<article article-type="research"><front><journal-meta><journal-id journal-id-type="nlm">J1</journal-id><journal-title>The Journal</journal-title><issn>1234-5678</issn><publisher><publisher-name>Pub</publisher-name></publisher></journal-meta>
<article-meta><article-id pub-id-type="pmcid">PMC1</article-id><article-id pub-id-type="doi">10.1/x</article-id><article-categories><subj-group><subject>Heart</subject></subj-group></article-categories><title-group><article-title>T one</article-title></title-group>
<contrib-group><contrib contrib-type="author" corresp="yes"><contrib-id contrib-id-type="orcid">0000</contrib-id><name><surname>Roe</surname><given-names>Ann</given-names></name><xref ref-type="aff" rid="a1"/></contrib><contrib contrib-type="author"><collab>The Group</collab></contrib></contrib-group>
<aff id="a1"><label>1</label>Some Place</aff><pub-date pub-type="epub"><day>3</day><month>7</month><year>2021</year></pub-date><pub-date pub-type="collection"><year>2020</year></pub-date><volume>4</volume><fpage>10</fpage><lpage>19</lpage>
<history><date date-type="received" iso-8601-date="2020-01-02"/></history><permissions><copyright-statement>(c) 2021</copyright-statement><license xlink:href="http://l" xmlns:xlink="http://www.w3.org/1999/xlink"><license-p>Open.</license-p></license></permissions>
<kwd-group><kwd>one</kwd><kwd>two</kwd></kwd-group><funding-group><award-group><funding-source>Fund</funding-source><award-id>7</award-id></award-group></funding-group><abstract><p>Abs text.</p></abstract></article-meta></front>
<body><sec><title>Results</title><p>First para <xref rid="t1">Table 1</xref>.</p><p>Second para.</p><sec><title>Sub</title><p>Third <xref rid="f1"/>.</p><p>Items are:</p><list><list-item><p>a</p></list-item><list-item><p>b</p></list-item></list></sec></sec>
<sec><title>Data</title><supplementary-material id="s1"><caption><p>All the data. More words.</p></caption><media href="d.zip"/></supplementary-material></sec></body>
<floats-group><table-wrap id="t1"><label>Table 1</label><caption><p>Cap.</p></caption><table><thead><tr><th>N</th><th>x</th></tr></thead><tbody><tr><td>G</td><td></td></tr><tr><td>r1</td><td>1 (20)</td></tr></tbody></table><table-wrap-foot><fn><label>a</label><p>note</p></fn></table-wrap-foot></table-wrap>
<fig id="f1"><label>Figure 1</label><caption><p>Fig cap.</p></caption></fig></floats-group>
<back><sec><title>Funding</title><p>Paid.</p></sec><ref-list><ref id="b1"><label>1</label><mixed-citation>Ref one</mixed-citation></ref></ref-list></back></article>"""


@pytest.fixture(scope="module")
def blocks(spark):
    return articles.parse(spark.createDataFrame([("p.xml", XML), ("bad", "<a>")], "path string, xml string")).cache()


@pytest.fixture(scope="module")
def chunks(blocks):
    return ck.chunk(blocks).cache()


def test_chunks_of_an_article(blocks, chunks):
    rows = {r.chunk_id: r for r in chunks.collect()}
    assert rows["PMC1_1"].text == "First para Table 1.\n\nSecond para." and rows["PMC1_1"].refs == ["t1"] and rows["PMC1_1"].sources == [1, 2] and rows["PMC1_1"].embedding_text == "Results\n\nFirst para Table 1.\n\nSecond para."
    assert rows["PMC1_2"].breadcrumb == ["Results", "Sub"] and rows["PMC1_2"].subsection == "Sub" and rows["PMC1_3"].text == "Items are:\n\n- a\n- b"
    summary, row, notes = (rows[f"PMC1_table_t1_{k}"] for k in ("summary", "row_0", "footnotes"))
    assert summary.text == "Table 1: Cap.\n\nColumns:\n- N\n- x" and row.text == "Group: G\nRow: r1\nx: 1 (20)" and notes.text == "[a] note"
    assert row.parent_id == notes.parent_id == summary.chunk_id and row.embedding_text.startswith("Table 1\n\n") and (row.row_label, row.group_path) == ("r1", ["G"])
    assert rows["PMC1_figure_f1"].text == "Fig cap." and not rows["PMC1_reference_b1"].retrieval_eligible and rows["PMC1_reference_b1"].embedding_text == ""
    assert [r.chunk_type for r in rows.values() if r.text == "Paid."] == ["administrative"]
    assert sorted(r.position for r in rows.values()) == list(range(len(rows)))
    report_row = ck.coverage(blocks, chunks).collect()
    assert [(r.document_id, r.unhandled, r.coverage) for r in report_row] == [("PMC1", 0, 1.0)] and ck.table_coverage(blocks, chunks).first().passes


def test_chunk_invariants(spark):
    """Random documents: every block is in a chunk, ids and positions are unique, no chunk of prose crosses a section or a structured block."""
    rng = random.Random(3)
    rows = []
    for d in range(12):
        path = ["A"]
        for k in range(rng.randint(1, 40)):
            if rng.random() < 0.2:
                path = rng.choice((["A"], ["A", "B"], ["C"], ["Funding"], ["References"]))
            kind = rng.choice(("paragraph", "paragraph", "paragraph", "list", "table", "figure", "formula", "odd"))
            rows.append((f"D{d}", k, path, kind, rng.choice((None, "x", f"i{k}")), rng.choice((None, "L")), "word " * rng.choice((1, 50, 200, 500, 900)), ["c"], [("r", [], [("c", "1")])] if kind == "table" else None, None, []))
    blocks = spark.createDataFrame(rows, "document_id string, block_seq int, section_path array<string>, block_type string, source_id string, label string, content string, columns array<string>, rows array<struct<label:string,group_path:array<string>,cells:array<struct<col:string,val:string>>>>, footnotes array<struct<marker:string,text:string>>, refs array<string>")
    got = ck.chunk(blocks).collect()
    by_block = {(r[0], r[1]): r for r in rows}
    assert len({r.chunk_id for r in got}) == len(got) and {(r.document_id, s) for r in got for s in r.sources} == set(by_block)
    for d in {r.document_id for r in got}:
        own = sorted((r for r in got if r.document_id == d), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own))) and [r.sources[0] for r in own] == sorted(r.sources[0] for r in own)
    for r in got:
        assert len(r.sources) == 1 or r.chunk_type == "paragraph" and r.sources == list(range(r.sources[0], r.sources[-1] + 1)) and len({tuple(by_block[r.document_id, s][2]) for s in r.sources}) == 1
        assert len(r.text) <= 3200 or len(r.sources) == 1
        assert r.chunk_type not in ("table_row", "table_footnotes") or r.parent_id in {x.chunk_id for x in got if x.chunk_type == "table_summary"}
    assert ck.coverage(blocks, ck.chunk(blocks)).where("unhandled > 0").count() == 0


def test_trees(spark, blocks, chunks):
    placed = {r.source_id: r.section_path for r in trees.place_floats(blocks).where("source_id is not null").collect()}
    assert placed["t1"] == ["Results"] and placed["f1"] == ["Results", "Sub"]
    nodes = trees.from_blocks(trees.place_floats(blocks)).withColumn("chunk_ids", F.array().cast("array<string>")).cache()
    assert tree.audit(nodes, {r.node_type for r in nodes.select("node_type").distinct().collect()}).count() == 0
    shown = trees.render(nodes).first().tree
    assert "    [section] Sub\n      [paragraph] Third .\n      [list] Items are:\n      [figure] Figure 1\n    [table] Table 1\n      [table_row] r1" in shown
    stats = trees.stats(nodes).first()
    assert stats.deepest == 3 and stats.by_type["table_row"] == 1 and stats.nodes == nodes.count()
    own = nodes.where("node_type = 'paragraph'").select("paper_id", F.col("breadcrumb")[0].alias("section"), F.when(F.size("breadcrumb") > 1, F.element_at("breadcrumb", -1)).alias("subsection"), "node_id", F.col("preorder").alias("position"), "text")
    corpus = chunks.select(F.col("document_id").alias("paper_id"), "section", "subsection", "chunk_id", "chunk_type", "position", "text").where("chunk_type = 'paragraph'")
    mapped = trees.align_paragraphs(own, corpus)
    assert {r.chunk_id: (len(r.node_ids), r.status) for r in mapped.collect()}["PMC1_1"] == (2, "merged")
    near = spark.createDataFrame([("p", "s", None, "n1", 1, "one two three four five"), ("p", "s", None, "n2", 2, "nothing alike")], own.schema)
    text = spark.createDataFrame([("p", "s", None, "c1", "paragraph", 1, "one two three four six")], corpus.schema)
    assert [(r.node_ids, r.status) for r in trees.align_paragraphs(near, text).collect()] == [(["n1"], "similar")]
    assert [r.node_id for r in trees.exact_fallback(own, corpus, mapped.where("status = 'merged'")).orderBy("node_id").collect()] == ["b0", "b3"]
    leaf = spark.createDataFrame([("p", "a", "paragraph", 1, "x" * 50), ("p", "b", "paragraph", 2, "left " + "y" * 45 + " right"), ("p", "t", "table", 3, "")], "paper_id string, node_id string, node_type string, position long, text string")
    other = spark.createDataFrame([("p", "c1", "paragraph", 1, "X" * 50), ("p", "c2", "paragraph", 2, "y" * 45), ("p", "c3", "table_summary", 3, "zzz")], "paper_id string, chunk_id string, chunk_type string, position long, text string")
    assert sorted((r.node_id, r.chunk_id, r.score) for r in trees.match_leaves(leaf, other).collect()) == [("a", "c1", 3.0), ("b", "c2", 1.8), ("t", "c3", 0.0)]
    found = trees.navigate_structure(nodes, spark.createDataFrame([("q", "third table para")], "query_id string, text string")).orderBy("place").collect()
    assert found[0].score > 0 and {r.place for r in found} == set(range(1, len(found) + 1))


def test_cycles_end(spark):
    rows = [("p", "root", None, "document", 0, 5), ("p", "a", "root", "section", 1, 1), ("p", "x", "y", "section", 2, 2), ("p", "y", "x", "section", 3, 3), ("p", "z", "z", "section", 4, 4), ("p", "lost", "none", "section", 5, 5)]
    nodes = spark.createDataFrame(rows, "paper_id string, node_id string, parent_id string, node_type string, preorder int, last_preorder int").withColumns({"title": F.lit("t"), "text": F.lit("t"), "chunk_ids": F.array(F.lit("c"))})
    assert {r.node_id: r.depth for r in tree.reachable(nodes).collect()} == {"root": 0, "a": 1}
    codes = {r.code: r.n for r in tree.audit(nodes, {"document", "section"}, spark.createDataFrame([("p", "c")], "paper_id string, chunk_id string")).collect()}
    assert codes["UNREACHABLE"] == 4 and codes["SELF"] == 1 and codes["PARENT"] == 1 and codes["CHUNK_TWICE"] == 1 and "CHUNK" not in codes


def test_markdown(spark, blocks, chunks):
    nodes = trees.from_markdown(spark.createDataFrame([("d", "intro\n# A\nx\n## B\ny\n### C\nz\n## D\nw\n# E\nv")], "doc_id string, text string")).orderBy("line").collect()
    assert [(r.node_id, r.parent_id, r.text, r.breadcrumb) for r in nodes] == [("root", None, "intro", []), ("h1", "root", "x", ["A"]), ("h3", "h1", "y", ["A", "B"]), ("h5", "h3", "z", ["A", "B", "C"]), ("h7", "h1", "w", ["A", "D"]), ("h9", "root", "v", ["E"])]
    md = trees.blocks_to_markdown(blocks).first().markdown
    assert "## Results\n\nFirst para Table 1.\n\n**Table 1** Cap.\n\n| N | x |\n| --- | --- |\n| r1 | 1 (20) |\n\nSecond para.\n\n### Sub" in md
    structure = docindex.structure_of(chunks)
    shown = trees.to_markdown(chunks.select(F.col("document_id").alias("paper_id"), "chunk_id", "chunk_type", "section", "subsection", "position", "text").join(structure.select("chunk_id", "table_id"), "chunk_id")).first()
    assert shown.markdown.startswith("## Abstract\n\n#### Abs text.") and ["PMC1_table_t1_summary", "PMC1_table_t1_row_0", "PMC1_table_t1_footnotes"] in [list(x) for x in shown.leaves]
    row = spark.range(1).select(trees.tidy_markdown(F.lit("**Aim:**\n\n\n\ntext **b** c")).alias("t"), trees.resolve_media(F.lit("![a](x/f.png) ![b](http://h/g.png)"), F.lit("http://base/")).alias("m"), trees.is_image(F.lit("a/b.PNG?x=1")).alias("i")).first()
    assert (row.t, row.m, row.i) == ("#### Aim\n\ntext **b** c", "![a](http://base/x/f.png) ![b](http://h/g.png)", True)


def test_document_index(spark, chunks):
    structure = docindex.structure_of(chunks).cache()
    assert docindex.tables(structure).first().members == ["PMC1_table_t1_summary", "PMC1_table_t1_row_0", "PMC1_table_t1_footnotes"]
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "chunk_id string")
    assert {r.chunk_id for r in docindex.children(structure, ids("PMC1_table_t1_summary")).collect()} == {"PMC1_table_t1_row_0", "PMC1_table_t1_footnotes"}
    assert [r.chunk_id for r in docindex.parents(structure, ids("PMC1_table_t1_row_0", "PMC1_0")).collect()] == ["PMC1_table_t1_summary"]
    assert docindex.figure(structure, "PMC1", "figure_f1").count() == 1 and [r.chunk_id for r in docindex.section(structure, "PMC1", "sub").collect()] == ["PMC1_2", "PMC1_3"]
    assert docindex.paper(structure, "PMC2").count() == 0 and docindex.counts_by_type(structure).first().by_type["figure"] == 1 and docindex.siblings(structure, ids("PMC1_0")).count() == 0
    anchors = spark.createDataFrame([("g", "PMC1_table_t1_row_0", 1), ("g", "PMC1_2", 2)], "g string, chunk_id string, anchor_order int")
    got = [(r.chunk_id, r.expanded_from) for r in docindex.expand(structure, anchors, ["g"]).orderBy("anchor_order", "node_order").collect()]
    assert got == [("PMC1_table_t1_row_0", None), ("PMC1_table_t1_summary", "PMC1_table_t1_row_0"), ("PMC1_table_t1_footnotes", "PMC1_table_t1_row_0"), ("PMC1_2", None), ("PMC1_3", "PMC1_2")]
    keys = spark.createDataFrame([("P_tab_row_12", "P", None), ("P_tab_summary", "P", "own"), ("Q_x", "P", None)], "chunk_id string, paper_id string, table_id string")
    assert [r.k for r in keys.select(docindex.table_key(F.col("chunk_id"), F.col("paper_id"), F.col("table_id")).alias("k")).collect()] == ["tab", "own", None]
    one, two = spark.createDataFrame([("a", "s")], "chunk_id string, text string"), spark.createDataFrame([("a", "c"), ("b", "c")], "chunk_id string, text string")
    assert {r.chunk_id: r.text for r in docindex.resolve(ids("a", "b", "x"), one, two, ["text"]).collect()} == {"a": "s", "b": "c", "x": None}


def test_front_matter(spark):
    rows = {r.document_id: r for r in front.front(spark.createDataFrame([("p.xml", XML), ("q.xml", None), ("r.xml", "<article><front><article-meta><title-group><article-title>Half")], "path string, xml string")).collect()}
    r = rows["PMC1"]
    assert (r.journal, r.publisher, r.issns, r.doi, r.title, r.article_type, r.categories, r.keywords) == ("The Journal", "Pub", ["1234-5678"], "10.1/x", "T one", "research", ["Heart"], ["one", "two"])
    assert r.authors == ["Ann Roe", "The Group"] and r.contributors[0].corresponding and r.contributors[0].affiliations == ["Some Place"] and r.contributors[1].collab and r.contributors[0].orcid == "0000"
    assert (r.epub_date, r.collection_date, r.history["received"], r.volume, r.fpage, r.lpage) == ("2021-07-03", "2020", "2020-01-02", "4", "10", "19")
    assert r.license == "Open." and r.license_url == "http://l" and r.funding[0].source == "Fund" and (r.supplements[0].label, r.supplements[0].href) == ("All the data", "d.zip")
    assert rows["q.xml"].error and rows["r"].title == "Half"
    address = lambda a: spark.range(1).select(front.image_address(F.lit(a), F.lit("http://b/")).alias("x")).first().x
    assert [address(a) for a in ("f1", "x/f.png", "http://h/g.gif", "a.pdf", "#x", "")] == ["http://b/f1.jpg", "http://b/x/f.png", "http://h/g.gif", None, None, None]
    files = spark.createDataFrame([("d/PMC7.1.xml",), ("d/PMC7.nxml",), ("d/PMC77.xml",)], "path string")
    assert sorted(r.path for r in front.find_article(files, "PMC7").collect()) == ["d/PMC7.1.xml", "d/PMC7.nxml"]
    meta = ck.with_metadata(spark.createDataFrame([("c", "PMC1", ["A", "B"])], "chunk_id string, document_id string, breadcrumb array<string>"), front.front(spark.createDataFrame([("p", XML)], "path string, xml string"))).first()
    assert (meta.pages, meta.publication_date, meta.full_breadcrumb) == ("10-19", "2021-07-03", "A > B")


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 3)
    s.create()
    assert s.counts() == {"chunks": 0, "documents": 0, "embeddings": 0}
    rows = spark.createDataFrame([("a", "d1", "one", "paragraph", 1), ("a", "d1", "two", "paragraph", 2), ("b", "d2", "three", "table_row", 1)], "chunk_id string, document_id string, text string, chunk_type string, v int")
    s.upsert_chunks(rows, ["v"])
    s.upsert_chunks(spark.createDataFrame([("b", "d2", "new", "table_row")], "chunk_id string, document_id string, text string, chunk_type string"))
    assert {r.chunk_id: r.text for r in s.table("chunks").collect()} == {"a": "two", "b": "new"}
    with pytest.raises(ValueError):
        s.upsert_vectors(spark.createDataFrame([("a", [1.0, 2.0])], "chunk_id string, embedding array<double>"))
    s.upsert_vectors(spark.createDataFrame([("a", [3.0, 0.0, 4.0]), ("b", [0.0, 0.0, 0.0])], "chunk_id string, embedding array<double>"))
    assert [round(x, 4) for x in s.get(["a"], "embeddings").first().embedding] == [0.6, 0.0, 0.8]
    s.check_alignment()
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, vector array<double>")
    assert [r.id for r in s.search(asked, 5, chunk_type="paragraph").collect()] == ["a"] and s.search(asked, 5).count() == 2
    with pytest.raises(ValueError):
        s.search(asked, 5, text="x")
    s.rebuild()
    s.reload(rows.where("v = 2"), spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("lost", [1.0, 0.0, 0.0])], "chunk_id string, embedding array<double>"))
    with pytest.raises(ValueError, match="1 vectors without"):
        s.check_alignment()
    s.truncate()
    assert s.counts()["chunks"] == 0
    assert store.embedding_path("x/y/part-1.parquet") == "x/y/embeddings/part-1.embeddings.parquet"
    for name in ("c/one.parquet", "c/two.parquet", "c/embeddings/one.embeddings.parquet"):
        store.write_text(spark, f"{tmp_path}/{name}", "x")
    assert [r.stem for r in store.pending_embeddings(spark, f"{tmp_path}/c").collect()] == ["two"]
    trace = store.Trace(spark, f"{tmp_path}/trace", "r1", most=5)
    trace.log("start", text="abcdefgh")
    trace.flush()
    trace.log("end")
    trace.flush()
    assert [(r.n, r.event) for r in spark.read.parquet(f"{tmp_path}/trace").orderBy("n").collect()] == [(0, "start"), (1, "end")]
    store.write_run(spark, f"{tmp_path}/run", {"a": 1}, "# r")
    assert store.read_json(spark, f"{tmp_path}/run/run.json", "a int").first().a == 1
    store.write_text(spark, f"{tmp_path}/t/P1.json", '{"status": "success", "tree": [1]}')
    store.write_text(spark, f"{tmp_path}/t/P2.json", "broken")
    assert {r.paper_id: (r.status, r.tree) for r in store.read_trees(spark, f"{tmp_path}/t").collect()} == {"P1": ("success", "[1]"), "P2": ("broken", None)}
    found = store.encode_file(spark.createDataFrame([("a", "x y"), ("b", None)], "chunk_id string, text string"), lambda: plugins.HashingEncoder(8), 8)
    path = str(tmp_path / "v.parquet")
    found.write.parquet(path)
    ids, matrix = store.load_matrix(spark, path)
    assert ids == ["a", "b"] and matrix.shape == (2, 8) and abs(float((matrix[0] ** 2).sum()) - 1) < 1e-6
    with pytest.raises(ValueError):
        store.load_matrix(spark, path, most=1)


def test_index_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", " ".join(["red", "blue", "green"][: i % 3 + 1])) for i in range(20)], "chunk_id string, text string")
    index, asked = lexical.build(rows), spark.createDataFrame([("q", "green red"), ("z", "none")], "query_id string, text string")
    index.save(str(tmp_path / "i"))
    loaded = lexical.load(spark, str(tmp_path / "i"))
    show = lambda i, **k: sorted((r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in lexical.search(i, asked, 8, **k).collect())
    assert show(loaded) == show(index) and loaded.n_total == 20 and '"n_terms": 3' in lexical.meta(loaded)
    rows.limit(3).selectExpr("chunk_id", "1L as dl").write.mode("overwrite").parquet(str(tmp_path / "i" / "docs"))
    with pytest.raises(ValueError):
        lexical.load(spark, str(tmp_path / "i"))


def test_plugins(spark):
    df = spark.createDataFrame([("a", "red blue"), ("b", None)], "id string, text string").repartition(2)
    got = {r.id: r.vector for r in plugins.encode(df, F.col("text"), lambda: plugins.HashingEncoder(16)).collect()}
    assert abs(sum(x * x for x in got["a"]) - 1) < 1e-6 and set(got["b"]) == {0.0}
    scored = plugins.score_pairs(df, F.lit("red green"), F.col("text"), plugins.OverlapScorer).orderBy("id").collect()
    assert [r.encoder_score for r in scored] == [0.5, 0.0]
    for bad in (np.zeros((1, 3)), np.full((2, 2), np.nan)):
        with pytest.raises(ValueError):
            plugins.checked(bad, 2, 2)
    row = spark.range(1).select(plugins.article_text(F.array().cast("array<string>"), F.lit("figure"), F.lit(""), F.lit("t")).alias("a"), plugins.article_text(F.array(F.lit("A"), F.lit("B")), F.lit("figure"), F.lit("e"), F.lit("t")).alias("b")).first()
    assert (row.a, row.b) == ("figure\nt", "A > B\ne")


def test_local_pipeline(spark):
    """From queries to scored candidates: anchors by rank, navigation and preference, expansion, passages, reranking."""
    rng = random.Random(4)
    chunks = [(f"P{p}_{i}", f"P{p}", i, "table_summary" if i == 15 else "figure" if i == 16 else "paragraph", " ".join(rng.choice(["iron", "blood", "heart", "salt"]) for _ in range(5)) + (" anaemia" if i % 4 == 0 else "")) for p in range(3) for i in range(20)]
    rows = spark.createDataFrame(chunks, "chunk_id string, paper_id string, position int, chunk_type string, text string")
    structure = docindex.structure_of(rows.withColumns({"document_id": F.col("paper_id"), "section": F.lit("S"), "table_id": F.when(F.col("chunk_type") == "table_summary", "t")}))
    queries = spark.createDataFrame([("q1", "anaemia iron"), ("q2", "anaemia iron"), ("q3", "salt")], "query_id string, text string")
    index = lexical.build(rows)
    lists = hybrid.retrieve(index, queries).collect()
    assert sorted((r.chunk_id, r["rank"]) for r in lists if r.query_id == "q1") == sorted((r.chunk_id, r["rank"]) for r in lists if r.query_id == "q2") and {r.method for r in lists} == {"bm25"}
    encoded = plugins.encode(rows, F.col("text"), lambda: plugins.HashingEncoder(32), "embedding").select("chunk_id", "embedding")
    asked = plugins.encode(queries, F.col("text"), lambda: plugins.HashingEncoder(32))
    assert {r.method for r in hybrid.retrieve(index, asked, encoded).collect()} == {"bm25", "dense"}
    pairs = spark.createDataFrame([("P0", "q1"), ("P0", "q3"), ("P1", "q1")], "paper_id string, query_id string")
    local = hybrid.local_search(index, asked, pairs, rows.select("paper_id", "chunk_id"), encoded)
    assert {(r.paper_id, r.query_id) for r in local.collect()} == {("P0", "q1"), ("P0", "q3"), ("P1", "q1")} and local.where("not chunk_id like paper_id || '%'").count() == 0
    bridge = spark.createDataFrame([("q1", "H1"), ("q2", "H1"), ("q3", "H1")], "query_id string, requirement_id string")
    merged = hybrid.merge_variants(local, bridge).cache()
    needs = spark.createDataFrame([("H1", "numerical", ["table_row", "figure"], "Requirement H1: anaemia iron")], "requirement_id string, focus string, evidence_types array<string>, rerank_text string")
    nav = hybrid.navigation_by_chunk(spark.createDataFrame([("H1", "P0", "n1", 0.9, "why", ["P0_19", "P0_0"]), ("H1", "P0", "n2", 0.4, "also", ["P0_19"])], "requirement_id string, paper_id string, node_id string, relevance double, reason string, chunk_ids array<string>"))
    assert {r.chunk_id: (r.relevance, r.node_ids) for r in nav.collect()}["P0_19"] == (0.9, ["n1", "n2"])
    picked = hybrid.anchors(merged, nav, structure, needs).where("paper_id = 'P0'").orderBy("anchor_order").collect()
    lead = [r.chunk_id for r in merged.where("paper_id = 'P0' and rank <= 8").orderBy("rank").collect()]
    assert [r.chunk_id for r in picked[:8]] == lead and all(r.origin != "fused" for r in picked[8:]) and len({r.chunk_id for r in picked}) == len(picked)
    assert {"P0_15", "P0_16", "P0_19"} <= {r.chunk_id for r in picked}
    found = hybrid.candidates(merged, nav, structure, rows, needs).withColumn("context_text", F.lit(None).cast("string"))
    scored = hybrid.rerank(found, needs, plugins.OverlapScorer, most_pairs=10).cache()
    assert scored.where("raw > 0").count() <= 10 and scored.agg(F.max("encoder"), F.min("encoder")).first()[:] == (1.0, 0.0) and scored.count() == found.count()
    text = found.select(hybrid.passage().alias("p")).first().p
    assert text.startswith("Type: ") and "Passage: " in text
    kinds = [("anaemia of iron, 5 percent, p-value", "table_row", "", 1.0), ("iron", "paragraph", "Results", 0.54), ("none", "figure", "", 0.05), (None, None, None, 0.0)]
    df = spark.createDataFrame(kinds, "t string, k string, s string, want double")
    for r in df.select("want", hybrid.intent_score(F.col("t"), F.col("k"), F.col("s"), F.lit("anaemia iron"), F.array(F.lit("Anaemia of iron"))).alias("x")).collect():
        assert abs(r.x - r.want) < 1e-9


def test_repair(spark):
    kind = "question_id string, chunk_id string, final double, covers array<string>"
    chosen = spark.createDataFrame([("q", "a", 0.9, ["r1"]), ("q", "b", 0.8, ["r1"]), ("q", "c", 0.1, [])], kind)
    searched = spark.createDataFrame([("q", "d", 0.5, ["r2"]), ("q", "e", 0.4, ["r2"]), ("q", "a", 0.9, ["r3"])], kind)
    needs = spark.createDataFrame([("q", "r1"), ("q", "r2"), ("q", "r3"), ("q", "r4")], "question_id string, requirement_id string")
    run = lambda slots: sorted(r.chunk_id for r in repair.repair(chosen, searched, needs, slots).collect())
    assert run(4) == ["a", "b", "c", "d"] and run(3) == ["a", "b", "d"]
    only = spark.createDataFrame([("q", "a", 0.9, ["r1"])], kind)
    assert [r.chunk_id for r in repair.repair(only, searched, needs, 1).collect()] == ["a"]


def test_reports(spark):
    fused = spark.createDataFrame([("q1", "P1", 1), ("q1", "P2", 2), ("q2", "P3", 1)], "query_id string, paper_id string, rank int")
    evidence = spark.createDataFrame([("c1", ["H1"], ["n"], "t"), ("c2", ["H1"], [], None)], "chunk_id string, covers array<string>, node_ids array<string>, table_context string")
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    by_query, by_requirement, totals = report.run_report(
        fused, frame([("P2",)], "paper_id string"), evidence, frame([("H1",), ("H2",)], "requirement_id string"), frame([("q1", "P2"), ("q2", "P9")], "query_id string, paper_id string"), frame([("H1", "c1"), ("H1", "c9")], "requirement_id string, chunk_id string")
    )
    assert {r.query_id: (r.recall_5, r.rr) for r in by_query.collect()} == {"q1": (1.0, 0.5), "q2": (0.0, 0.0)}
    assert {r.requirement_id: (r.covered, r.n_evidence, r.chunk_recall) for r in by_requirement.collect()} == {"H1": (True, 2, 0.5), "H2": (False, 0, None)}
    t = totals.first()
    assert (t.final_paper_recall, t.papers_found, t.papers_missing, t.papers_preserved, t.requirement_recall, t.n_evidence, t.n_navigated, t.n_with_table) == (0.5, ["P2"], ["P9"], False, 0.5, 2, 1, 1)
    leak = lambda q, s: spark.range(1).select(report.leaks(F.lit(q), F.lit(s)).alias("x")).first().x
    assert leak("a b c d e f g", "x a b c d e f g y") and not leak("iron", "iron salt water milk") and leak("iron salt", "iron salt water")
    rows = frame([("c", "Iron was low in 12 of 40. It is so. Red Cells were few.", ["iron", "low", "red"], ["Red Cells"])], "chunk_id string, text string, keywords array<string>, phrases array<string>")
    got = {r.level: (r.question, r.leaked) for r in report.levelled_questions(rows, {"was": "is"}).collect()}
    assert got["verbatim"][1] and got["keywords"][0] == "iron low red" and got["paraphrase"][0] == "Iron is low in 12 of 40." and "Red Cells" in got["question"][0]
    assert report.markdown_table([{"a": 1, "b": 0.5}], ["a", "b"]) == "| a | b |\n|---|---|\n| 1 | 0.5000 |"
    ranked = frame([("m", "q", "x", 1), ("m", "q", "y", 2), ("n", "q", "y", 1)], "method string, query_id string, item_id string, rank int")
    methods = report.compare_methods(ranked, frame([("q", "y")], "query_id string, item_id string"), (1,))
    assert {r.method: (r.recall_1, r.mrr) for r in methods.collect()} == {"m": (0.0, 0.5), "n": (1.0, 1.0)}
    assert "## Methods" in report.benchmark_markdown("T", methods, report.worst_queries(by_query, "rr", 1), {"k": "v"}) and report.latency(lambda: fused, 2)["worst"] > 0
    shown = report.evidence_markdown("Q?", frame([(1, "c1", "P", ["H1"], "x" * 2000)], "place int, chunk_id string, paper_id string, covers array<string>, text string"), by_requirement)
    assert shown.startswith("# Q?") and "…" in shown


def test_detectors(spark):
    said = {"12 (34) patients": ["percentage"], "confidence interval": ["confidence_interval"], "n: 45": ["sample_size"], "HR: 2": ["effect_estimate"], "p<.05 and 3 %": ["percentage", "p-value"]}
    for text, fields in said.items():
        assert spark.range(1).select(tx.detect_fields(F.lit(text)).alias("f")).first().f == fields
    row = spark.createDataFrame([("Age", [("adjusted OR", "2.1"), ("more or less", "5")], ["95% CI in brackets"])], "v string, c array<struct<col:string,val:string>>, n array<string>")
    assert row.select(tx.detect_row_fields(F.col("v"), F.col("c"), F.col("n")).alias("f")).first().f == ["confidence_interval", "effect_estimate"]
    assert spark.range(1).select(tx.non_content(F.lit(" Funding "), F.lit("x")).alias("a"), tx.non_content(F.lit("Results"), F.lit(" Copyright 2020")).alias("b"), tx.non_content(F.lit("Results"), F.lit("x")).alias("c")).first()[:] == (True, True, False)


def brute_matches(leaves, texts):
    """Different texts, every pair looked at."""
    from difflib import SequenceMatcher

    flat = lambda s: " ".join(s.lower().split())
    group = lambda rows: {t: sorted((p, n) for n, p, x in rows if flat(x) == t) for t in {flat(x) for *_, x in rows} - {''}}
    a, b = group(leaves), group(texts)
    found = []
    for t in a:
        for u in b:
            if t == u:
                found.append((3.0, t, u))
            elif len(t) >= 40 and t in u:
                found.append((2.0, t, u))
            elif len(u) >= 40 and u in t:
                found.append((1.8, t, u))
            elif len(t) >= 40 and max(len(t), len(u)) <= 1.6 * min(len(t), len(u)):
                w, v = set(re.findall("[a-z0-9]+", t)), set(re.findall("[a-z0-9]+", u))
                if len(w & v) >= 0.45 * len(w) and w and (r := SequenceMatcher(None, u, t).ratio()) >= 0.92:
                    found.append((r, t, u))
    out = []
    for s, t, u in sorted(found, key=lambda x: (-x[0], a[x[1]][0], b[x[2]][0])):
        while a[t] and b[u]:
            out.append((a[t].pop(0)[1], b[u].pop(0)[1], round(s, 6)))
    return sorted(out)


def test_leaf_match_against_all_pairs(spark):
    rng = random.Random(8)
    words = [f"{x}{y}{z}" for x in "bcdfg" for y in "aeiou" for z in "lmnrst"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(6, 30))) for _ in range(60)]

    def changed(t):
        parts = t.split()
        kind = rng.randrange(5)
        if kind == 0:
            return t.upper()
        if kind == 1:
            return f"{rng.choice(words)} {t} {rng.choice(words)}"
        if kind == 2:
            return " ".join(parts[1:-1])
        parts[rng.randrange(len(parts))] = rng.choice(words)
        return "  ".join(parts)

    leaves = [(f"n{i:03d}", i, rng.choice(base)) for i in range(150)] + [("n900", 900, ""), ("n901", 901, "short"), ("n902", 902, "short")]
    texts = [(f"c{i:03d}", i, changed(rng.choice(base))) for i in range(200)] + [("c900", 900, "short"), ("c901", 901, " ")]
    side = lambda rows, name: spark.createDataFrame([(p, *r) for p in ("p", "q") for r in rows], f"paper_id string, {name} string, position long, text string").repartition(5)
    got = leafmatch.match(side(leaves, "node_id"), side(texts, "chunk_id")).collect()
    want = brute_matches(leaves, texts)
    for p in ("p", "q"):
        mine = sorted((r.node_id, r.chunk_id, round(r.score, 6)) for r in got if r.paper_id == p)
        assert [x[2] for x in sorted(mine, key=lambda x: x[2])] == [x[2] for x in sorted(want, key=lambda x: x[2])] and mine == want
    assert {1.8, 2.0, 3.0} < {x[2] for x in want} and min(x[2] for x in want) < 1
    empty = side([], "node_id")
    assert leafmatch.match(empty, side(texts, "chunk_id")).count() == 0


def test_leaf_match_of_a_long_paper(spark):
    rng = random.Random(9)
    words = [f"{x}{y}{z}{k}" for x in "bcdfg" for y in "aeiou" for z in "lmnrst" for k in range(20)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12)) if i % 3 else "Table continued on the next page, with the same columns as before") for i in range(20_000)]
    leaves = spark.createDataFrame([("p", f"n{i}", i, t) for i, t in rows], "paper_id string, node_id string, position long, text string")
    texts = spark.createDataFrame([("p", f"c{i}", i, f"Intro: {t}") for i, t in rows], "paper_id string, chunk_id string, position long, text string")
    got = leafmatch.match(leaves, texts, alike=False)
    assert got.count() == 20_000 and got.where("substring(node_id, 2) <> substring(chunk_id, 2) or score <> 2.0").count() == 0


def shuffled(spark, run):
    """What run() gives, and the rows that its stages wrote for shuffles."""
    context = spark.sparkContext

    def stages():
        found = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    first = max(stages(), default=-1)
    out = run()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(n for k, n in stages().items() if k > first)


def test_leaf_match_writes_no_list_of_pairs(spark):
    rng = random.Random(10)
    words = [f"{x}{y}{z}" for x in "bcdfg" for y in "aeio" for z in "lmn"]
    made = [[rng.choice(words) for _ in range(30)] for _ in range(800)]
    leaves = spark.createDataFrame([("p", f"n{i}", i, " ".join(t)) for i, t in enumerate(made)], "paper_id string, node_id string, position long, text string")
    texts = spark.createDataFrame([("p", f"c{i}", i, " ".join([*t[:15], "xyz", *t[16:]])) for i, t in enumerate(made)], "paper_id string, chunk_id string, position long, text string")
    got, written = shuffled(spark, lambda: leafmatch.match(leaves, texts).collect())
    assert {(r.node_id, r.chunk_id) for r in got} == {(f"n{i}", f"c{i}") for i in range(800)} and len(got) == 800
    assert written < 20_000  # every leaf shares words with every chunk


def test_likeness_is_that_of_difflib():
    from difflib import SequenceMatcher

    rng, high = random.Random(3), 0
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdefgh ", "etaoinshrdlu \x01\x02éß", "the of and in xyz "])
        leaf = "".join(rng.choice(letters) for _ in range(rng.choice([3, 10, 45, 120, 199, 200, 201, 260, 450])))
        chunk = list(leaf)
        for _ in range(rng.randrange(max(2, len(leaf) // 12))):
            chunk[rng.randrange(len(chunk))] = rng.choice(["", letters[0], "q#", letters[1] * 2])
        chunk = "".join(chunk) or "a"
        want = SequenceMatcher(None, chunk, leaf).ratio()
        assert alike.likeness(chunk, leaf) == want if want >= alike.LEAST_RATIO else alike.likeness(chunk, leaf) < alike.LEAST_RATIO
        high += want >= alike.LEAST_RATIO
    assert 300 < high < 1400


def test_deep_trees(spark):
    chain = [("p", f"n{k:04d}", f"n{k - 1:04d}" if k else None, k, 1999) for k in range(2000)] + [("p", "x", "y", 3000, 3000), ("p", "y", "x", 3001, 3001)]
    nodes = spark.createDataFrame(chain, "paper_id string, node_id string, parent_id string, preorder int, last_preorder int")
    got = {r.node_id: r.depth for r in tree.reachable(nodes).collect()}
    assert got == {f"n{k:04d}": k for k in range(2000)}
    assert tree.descendants(nodes.where("preorder < 200")).count() == 200 * 201 // 2


def test_leaf_match_query_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40").collect()
    made = {}
    for r in docs:
        for k, line in enumerate((r.text or "").split("\n")):
            if line.strip():
                made.setdefault(r.lang, ([], []))[r.doc_id % 2].append((f"D_{r.doc_id}_{k}", r.doc_id * (1 << 24) + k, line))
    side = lambda odd, name: spark.createDataFrame([(lang, *x) for lang, both in made.items() for x in both[odd]], f"paper_id string, {name} string, position long, text string")
    got = leafmatch.match(side(0, "node_id"), side(1, "chunk_id")).collect()
    assert sorted((r.node_id, r.chunk_id, round(r.score, 6)) for r in got) == sorted(x for a, b in made.values() for x in brute_matches(a, b))
