from foliant.sources import citations
from foliant.sources.articles import blocks_of, parse

XML = """<article><front><article-meta><article-id pub-id-type="pmc">PMC1</article-id><title-group><article-title>On <i>things</i></article-title></title-group>
<abstract><p>Short.</p></abstract></article-meta></front><body><sec id="s1"><title>Methods</title><p>Text with <xref rid="b1">1</xref>.</p><p><bold>Steps</bold></p>
<list id="l1"><list-item><p>one</p></list-item><list-item><p>two</p></list-item></list><sec><title>Inner</title><p>Deep.</p><odd>Odd one</odd></sec>
<table-wrap id="t1"><label>Table 1</label><caption><p>Cap</p></caption><table><thead><tr><th rowspan="2">Var</th><th colspan="2">Arm</th></tr><tr><th>A</th><th>B</th></tr></thead>
<tbody><tr><td>Sex</td><td></td><td></td></tr><tr><td>&#8195;male</td><td>1</td><td>2</td></tr><tr><td>Age</td><td>3&#160;y</td><td>4</td></tr></tbody></table>
<table-wrap-foot><fn><label>a</label><p>note</p></fn></table-wrap-foot></table-wrap></sec></body>
<back><ref-list><ref id="b1"><label>1</label><mixed-citation>Who, 2020.</mixed-citation></ref><ref id="b1"><mixed-citation>again</mixed-citation></ref></ref-list></back></article>"""


def test_blocks():
    b = blocks_of(XML)
    assert {x["document_id"] for x in b} == {"PMC1"} and b[0]["title"] == "On things"
    assert [(x["block_type"], x["section_path"]) for x in b] == [
        ("paragraph", ["Abstract"]), ("paragraph", ["Methods"]), ("list", ["Methods"]), ("paragraph", ["Methods", "Inner"]), ("paragraph", ["Methods", "Inner"]), ("table", ["Methods"]), ("reference", ["References"]),
    ]
    assert b[1]["refs"] == ["b1"] and b[2]["label"] == "Steps" and b[2]["content"] == "- one\n- two" and b[4]["original_type"] == "odd"
    table = b[5]
    assert table["columns"] == ["Var", "Arm - A", "Arm - B"] and table["footnotes"] == [{"marker": "a", "text": "note"}]
    assert [(r["label"], r["group_path"]) for r in table["rows"]][0] == ("male", ["Sex"]) and table["rows"][0]["cells"] == [{"col": "Arm - A", "val": "1"}, {"col": "Arm - B", "val": "2"}]
    assert table["rows"][1]["label"] == "Age" and table["rows"][1]["cells"][0]["val"] == "3 y"


def test_spark_and_broken_articles(spark):
    rows = parse(spark.createDataFrame([("a.xml", XML), ("b.xml", "<article><p>"), ("c.xml", None)], "path string, xml string")).collect()
    assert len(rows) == 9 and sorted(r.document_id for r in rows if r.error) == ["b.xml", "c.xml"]


def test_abstracts_of_all_kinds():
    drawn = '<abstract abstract-type="graphical"><p><fig id="ga1"><label>Graphical Abstract</label><graphic href="ga.jpg"/></fig></p></abstract>'
    bare = '<abstract abstract-type="graphical"><graphic href="x.jpg"/></abstract>'
    plain = "<abstract><title>Abstract</title><sec><title>Aim</title><p>To see.</p></sec><p>End.</p></abstract>"
    short = '<abstract abstract-type="plain-language-summary"><p>In short.</p></abstract>'
    other = "<trans-abstract><p>Kurz.</p></trans-abstract>"
    sub = "<sub-article><front-stub><abstract><p>Not ours.</p></abstract></front-stub></sub-article>"
    of = lambda *parts: [(b["block_type"], b["section_path"], b["content"], b["source_id"]) for b in blocks_of(f"<article><front><article-meta>{''.join(parts)}</article-meta></front><body><sec><title>R</title><p>Body.</p></sec></body>{sub}</article>")]
    end = ("paragraph", ["R"], "Body.", None)
    assert of(short, drawn, plain, other) == [
        ("figure", ["Graphical Abstract"], "", "ga1"), ("paragraph", ["Abstract", "Aim"], "To see.", None), ("paragraph", ["Abstract"], "End.", None),
        ("paragraph", ["Abstract", "Plain Language Summary"], "In short.", None), ("paragraph", ["Abstract", "Translated Abstract"], "Kurz.", None), end,
    ]
    assert of(bare, "<abstract>Only text.</abstract>") == [("figure", ["Graphical Abstract"], "Graphical Abstract", "graphical_abstract"), ("paragraph", ["Abstract"], "Only text.", None), end]
    assert of("<abstract><title>Abstract</title></abstract>", short) == [("paragraph", ["Abstract"], "In short.", None), end]


def test_loose_text_has_a_section():
    b = blocks_of('<article><body><p>First.<fig id="f"/></p><sec><title>S</title><p>In.</p></sec><list><list-item>x</list-item></list></body><back><p>Thanks.</p></back></article>')
    assert [(x["block_type"], x["section_path"]) for x in b] == [("paragraph", ["Body"]), ("figure", []), ("paragraph", ["S"]), ("list", ["Body"]), ("paragraph", ["Back Matter"])]


def test_nesting_of_any_depth():
    deep = 100_000
    b = blocks_of("<article><body>" + "<sec>" * deep + "<p>Down here.</p>" + "</sec>" * deep + "</body></article>")
    assert len(b) == 1 and b[0]["content"] == "Down here." and len(b[0]["section_path"]) == deep
    b = blocks_of("<article><body><sec><title>T</title><p>" + "<italic>" * deep + "core" + "</italic>" * deep + " end.</p></sec></body></article>")
    assert [(x["content"], x["section_path"]) for x in b] == [("core end.", ["T"])]
    broken = blocks_of("<article><body><sec><title>T</title><p>" + "<b><i>" * deep + "core</x></y>" * 50 + "</p></sec></body></article>")
    assert len(broken) == 1 and broken[0]["content"].startswith("corecore")


def test_references_as_fields_and_lines(spark):
    ids = '<pub-id pub-id-type="doi">10.1/x</pub-id><pub-id pub-id-type="pmid">7</pub-id>'
    full = f'<ref id="r1"><label>1</label><element-citation><person-group><string-name>A <b>One</b></string-name><string-name>B Two</string-name></person-group><article-title>On  it</article-title><source>J</source><year>2020</year><volume>5</volume><fpage>1</fpage><lpage>9</lpage>{ids}</element-citation></ref>'
    rest = '<ref id="r1"><mixed-citation>again</mixed-citation></ref><ref><label>2</label><mixed-citation>Who,\n 2021.</mixed-citation></ref><ref id="r3"/><ref id="r4"><element-citation><fpage>3</fpage><inline-formula><tex-math>x^2</tex-math></inline-formula></element-citation></ref>'
    xml = f"<article><front><article-meta><article-id pub-id-type='pmc'>PMC2</article-id></article-meta></front><back><ref-list>{full}<ref-list>{rest}</ref-list></ref-list></back></article>"
    articles = spark.createDataFrame([("a", xml), ("b", None), ("c", ""), ("d", "<article><p>")], "path string, xml string")
    rows = sorted(citations.references(articles).collect(), key=lambda r: r.number)
    assert [(r.number, r.ref_id, r.citation) for r in rows] == [
        (1, "r1", "A One, B Two. On it. J2020;5:1–9. DOI: [10.1/x](https://doi.org/10.1/x) PMID: [7](https://pubmed.ncbi.nlm.nih.gov/7)"), (2, "ref_2", "Who, 2021."), (3, "r3", "Reference 3"), (4, "r4", ":3. $x^2$"),
    ]
    assert {r.document_id for r in rows} == {"PMC2"} and rows[0].authors == ["A One", "B Two"] and (rows[0].doi, rows[0].pmid, rows[0].pmcid) == ("10.1/x", "7", "")
    blocks = parse(articles)
    lined = citations.with_citations(blocks, citations.references(articles))
    assert lined.columns == blocks.columns and lined.count() == blocks.count()
    assert {r.source_id: r.content for r in lined.where("block_type = 'reference'").collect()} == {"r1": rows[0].citation, None: "Who, 2021.", "r3": "Reference 3", "r4": ":3. $x^2$"}


def test_schema_report(spark):
    deep = "<article><body>" + "<sec>" * 20_000 + "<p/>" + "</sec>" * 20_000 + "</body></article>"
    got = {r.document_id: r for r in citations.schema_report(citations.elements(spark.createDataFrame([("a.xml", XML), ("deep.xml", deep), ("n", None)], "path string, xml string"))).collect()}
    r = got["PMC1"]
    assert set(got) == {"PMC1", "deep"} and r.root_tag == "article" and [tuple(x) for x in r.article_ids] == [("pmc", "PMC1")] and (r.has_body, r.has_back, r.has_floats_group) == (True, True, False)
    assert (r.n_secs, r.n_paragraphs, r.n_lists, r.n_tables, r.n_figures, r.n_table_fns, r.n_refs, r.table_ids, r.figure_ids) == (2, 6, 1, 1, 0, 1, 2, ["t1"], [])
    assert (got["deep"].n_secs, got["deep"].n_paragraphs) == (20_000, 1)
