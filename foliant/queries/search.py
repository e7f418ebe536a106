"""Hybrid retrieval, paper-local search, expansion, reranking, questions and reports: documents are chunks, their sources papers, and
the vector of an id is the document's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import docindex, evidence, fusion, hybrid, lexical, repair, report, structure
from foliant.plans import understanding
from foliant.queries import query, read
from foliant.queries.chunking import BLOCKS_SQL, order_blocks
from foliant.queries.retrieval import _VALUES, CHUNKS_SQL, asked, chunks
from foliant.session import cut

VECTOR_OF = {"q1": 0, "q2": 50, "q3": 100}
_OF = ", ".join(f"('{q}', {v})" for q, v in VECTOR_OF.items())
HYBRID_SQL = f"""
tk AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS paper_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents),
dl AS (SELECT chunk_id, len(ws) AS dl FROM tk),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
po AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ws) AS term FROM tk) GROUP BY ALL),
te AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM po GROUP BY term), st),
qs AS (SELECT * FROM (VALUES {_VALUES}) AS t(query_id, text)),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM qs),
sc AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN po USING (term) JOIN te USING (term) JOIN dl USING (chunk_id), st GROUP BY query_id, chunk_id),
qv AS (SELECT query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM (VALUES {_OF}) AS t(query_id, vec_id) JOIN embeddings USING (vec_id)),
vs AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
ds AS (SELECT query_id, chunk_id, round(list_inner_product(q, v) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(v, v))), 6) + 0.0 AS score FROM qv, vs)"""
FUSED_SQL = HYBRID_SQL + """,
hl AS (SELECT query_id, chunk_id, 'bm25' AS method, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc
       UNION ALL SELECT query_id, chunk_id, 'dense', score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) FROM ds),
hi AS (SELECT * FROM hl WHERE rank <= 100),
fu AS (SELECT query_id, chunk_id, round(sum(1.0 / CAST(60 + rank AS DOUBLE)), 8) AS rrf_score, list_sort(list(DISTINCT method)) AS methods, min(rank) AS best FROM hi GROUP BY query_id, chunk_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, best, chunk_id) AS rank FROM fu)"""


def whole(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("paper_id"), F.coalesce("text", F.lit("")).alias("text"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "embeddings").join(read(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return own.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The asked queries with the vectors that are theirs."""
    of = F.create_map(*[F.lit(x) for pair in VECTOR_OF.items() for x in pair])
    return asked(spark).withColumn("vec_id", of[F.col("query_id")]).join(read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")


def both(spark: SparkSession, d: str) -> DataFrame:
    """Both lists of all queries, 200 rows each at most, written once."""
    return cut(hybrid.retrieve(lexical.build(whole(spark, d)), questions(spark, d), vectors(spark, d), digits=6))


@query("hybrid_lists", f"WITH {FUSED_SQL} SELECT query_id, chunk_id, method, score, CAST(rank AS INTEGER) AS rank FROM hi")
def hybrid_lists(spark: SparkSession, d: str) -> DataFrame:
    return both(spark, d)


@query("hybrid_fused", f"WITH {FUSED_SQL} SELECT query_id, chunk_id, rrf_score, methods, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 40")
def hybrid_fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(both(spark, d), depth=40, digits=8).select("query_id", "chunk_id", "rrf_score", "methods", "rank")


BRIDGE = "VALUES ('q1', 'r1'), ('q2', 'r2'), ('q3', 'r2') AS t(query_id, requirement_id)"


@query("requirement_papers", f"""WITH {FUSED_SQL}, h AS (SELECT requirement_id, paper_id, min(rank) AS best, max(rrf_score) AS score FROM fr JOIN (SELECT * FROM ({BRIDGE.split(' AS ')[0]}) AS t(query_id, requirement_id)) USING (query_id) JOIN tk USING (chunk_id) WHERE rank <= 40 GROUP BY ALL)
SELECT requirement_id, paper_id, CAST(row_number() OVER (PARTITION BY requirement_id ORDER BY best, score DESC, paper_id) AS INTEGER) AS place FROM h""")
def requirement_papers(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.rrf(both(spark, d), depth=40, digits=8)
    return hybrid.papers_by_requirement(fused, spark.sql(f"SELECT * FROM {BRIDGE}"), whole(spark, d).select("chunk_id", "paper_id"))


PAIRS = "VALUES ('src1', 'q1'), ('src1', 'q2'), ('src2', 'q1'), ('src4', 'q3') AS t(paper_id, query_id)"
LOCAL_SQL = HYBRID_SQL + f""",
pr AS (SELECT * FROM ({PAIRS.split(' AS ')[0]}) AS t(paper_id, query_id)),
ins AS (SELECT query_id, chunk_id, paper_id FROM tk JOIN pr USING (paper_id)),
ll AS (SELECT paper_id, query_id, chunk_id, 'bm25' AS method, row_number() OVER (PARTITION BY paper_id, query_id ORDER BY coalesce(score, 0.0) DESC, chunk_id) AS rank, 40 AS depth FROM ins LEFT JOIN sc USING (query_id, chunk_id)
       UNION ALL SELECT paper_id, query_id, chunk_id, 'dense', row_number() OVER (PARTITION BY paper_id, query_id ORDER BY score DESC, chunk_id), 60 FROM ins JOIN ds USING (query_id, chunk_id)),
lf AS (SELECT paper_id, query_id, chunk_id, round(sum(1.0 / CAST(60 + rank AS DOUBLE)), 6) AS rrf_score, list_sort(list(DISTINCT method)) AS methods, min(rank) AS best FROM ll WHERE rank <= depth GROUP BY ALL),
lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, query_id ORDER BY rrf_score DESC, best, chunk_id) AS rank FROM lf) WHERE rank <= 20)"""


def local(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.sql(f"SELECT * FROM {PAIRS}")
    return hybrid.local_search(lexical.build(whole(spark, d)), questions(spark, d), pairs, whole(spark, d).select("paper_id", "chunk_id"), vectors(spark, d), digits=6)


@query("local_search", f"WITH {LOCAL_SQL} SELECT paper_id, query_id, chunk_id, rrf_score, methods, CAST(rank AS INTEGER) AS rank FROM lr")
def local_search(spark: SparkSession, d: str) -> DataFrame:
    return local(spark, d)


@query("local_variants", f"""WITH {LOCAL_SQL}, m AS (SELECT CASE query_id WHEN 'q3' THEN 'r2' ELSE 'r1' END AS requirement_id, paper_id, chunk_id, max(rrf_score) AS rrf_score, list_sort(list(DISTINCT query_id)) AS variants FROM lr GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY requirement_id, paper_id ORDER BY rrf_score DESC, chunk_id) AS INTEGER) AS rank FROM m""")
def local_variants(spark: SparkSession, d: str) -> DataFrame:
    bridge = spark.sql("SELECT * FROM VALUES ('q1', 'r1'), ('q2', 'r1'), ('q3', 'r2') AS t(query_id, requirement_id)")
    return hybrid.merge_variants(local(spark, d), bridge).select("requirement_id", "paper_id", "chunk_id", "rrf_score", "variants", "rank")


@query("anchor_expansion", f"""
WITH {CHUNKS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY position, chunk_id) AS n, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tok FROM ch),
a AS (SELECT document_id, chunk_id AS anchor, n, CAST(row_number() OVER (PARTITION BY document_id ORDER BY position) AS INTEGER) AS anchor_order FROM s WHERE position % 5 = 0),
e AS (SELECT a.document_id, a.anchor_order, b.chunk_id, a.anchor, b.tok, CASE b.n - a.n WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 3 END AS node_order FROM a JOIN s b ON a.document_id = b.document_id AND abs(a.n - b.n) <= 1),
k AS (SELECT *, row_number() OVER w AS i, sum(tok) OVER w AS t FROM e WINDOW w AS (PARTITION BY document_id, anchor_order ORDER BY node_order)),
f AS (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY anchor_order, node_order) AS again FROM k WHERE i = 1 OR (i <= 12 AND t <= 2000)),
g AS (SELECT *, sum(tok) OVER (PARTITION BY document_id ORDER BY anchor_order, node_order) AS total FROM f WHERE again = 1)
SELECT CAST(document_id AS VARCHAR) AS document_id, chunk_id, CASE WHEN anchor <> chunk_id THEN anchor END AS expanded_from, anchor_order, CAST(node_order AS INTEGER) AS node_order, CAST(tok AS BIGINT) AS tokens FROM g WHERE total <= 12000""")
def anchor_expansion(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = chunks(spark, d).withColumn("document_id", F.col("document_id").cast("string"))
    structure = docindex.structure_of(rows.withColumn("chunk_type", F.lit("paragraph")))
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("position"))
    anchors = rows.where("position % 5 = 0").select("document_id", "chunk_id", order.alias("anchor_order"))
    return docindex.expand(structure, anchors, ["document_id"])


@query("table_members", f"""WITH {BLOCKS_SQL}
SELECT document_id AS paper_id, obj AS table_id, list(chunk_id ORDER BY CASE chunk_type WHEN 'table_summary' THEN 0 WHEN 'table_row' THEN 1 ELSE 2 END, position) AS members FROM ch WHERE chunk_type LIKE 'table%' GROUP BY ALL""")
def table_members(spark: SparkSession, d: str) -> DataFrame:
    from foliant.operators.chunks import chunk

    return docindex.tables(docindex.structure_of(chunk(order_blocks(spark, d))))


@query("structure_counts", f"WITH {BLOCKS_SQL} SELECT document_id AS paper_id, count(*) AS n, count(*) FILTER (chunk_type = 'table_row') AS table_rows FROM ch GROUP BY document_id")
def structure_counts(spark: SparkSession, d: str) -> DataFrame:
    from foliant.operators.chunks import chunk

    counts = docindex.counts_by_type(docindex.structure_of(chunk(order_blocks(spark, d))))
    return counts.select("paper_id", "n", F.coalesce(F.try_element_at("by_type", F.lit("table_row")), F.lit(0)).cast("long").alias("table_rows"))


@query("rerank_scaled", f"""WITH {FUSED_SQL}, r AS (SELECT * FROM fr WHERE rank <= 40)
SELECT query_id AS requirement_id, chunk_id, round(CASE WHEN max(rrf_score) OVER w > min(rrf_score) OVER w THEN (rrf_score - min(rrf_score) OVER w) / (max(rrf_score) OVER w - min(rrf_score) OVER w) ELSE 0 END, 6) AS encoder FROM r WINDOW w AS (PARTITION BY query_id)""")
def rerank_scaled(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.rrf(both(spark, d), depth=40, digits=8).withColumnRenamed("query_id", "requirement_id")
    scored = hybrid.rerank(rows, rows.select("requirement_id").distinct())
    return scored.select("requirement_id", "chunk_id", F.round("encoder", 6).alias("encoder"))


@query("intent_diversified", f"""WITH {FUSED_SQL}, q AS (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS asked FROM qs),
i AS (SELECT query_id, chunk_id, paper_id, round(least(1.0, len(list_intersect(list_distinct(ws), asked)) / len(asked)), 5) AS intent FROM (SELECT DISTINCT query_id, chunk_id FROM hi) JOIN tk USING (chunk_id) JOIN q USING (query_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY intent DESC, chunk_id) AS rank FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) AS n FROM k WHERE rank <= 60)
SELECT query_id, chunk_id, intent, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM p WHERE n <= 2) WHERE place <= 8""")
def intent_diversified(spark: SparkSession, d: str) -> DataFrame:
    every = both(spark, d)
    details = whole(spark, d).withColumns({"node_type": F.lit("paragraph"), "section": F.lit("")})
    wanted = asked(spark).withColumn("phrases", F.array().cast("array<string>"))
    return hybrid.union_rerank_diversify({m: every.where(F.col("method") == m) for m in ("bm25", "dense")}, details, wanted).select("query_id", "chunk_id", "intent", "place")


@query("method_comparison", f"""WITH {FUSED_SQL}, re AS (SELECT DISTINCT query_id, chunk_id AS item_id FROM fr WHERE rank <= 30), nn AS (SELECT query_id, count(*) AS n FROM re GROUP BY query_id),
h AS (SELECT method, hi.query_id, rank FROM hi JOIN re ON hi.query_id = re.query_id AND hi.chunk_id = re.item_id),
e AS (SELECT m.method, nn.query_id, max(nn.n) AS n, count(h.rank) FILTER (h.rank <= 10) AS h10, min(h.rank) AS f FROM (SELECT DISTINCT method FROM hi) m CROSS JOIN nn LEFT JOIN h ON h.method = m.method AND h.query_id = nn.query_id GROUP BY ALL)
SELECT method, count(*) AS n, round(avg(h10 / n), 6) AS recall_10, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr FROM e GROUP BY method""")
def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    every = both(spark, d)
    relevant = fusion.rrf(every, depth=30, digits=8).select("query_id", F.col("chunk_id").alias("item_id"))
    return report.compare_methods(every.withColumnRenamed("chunk_id", "item_id"), relevant, (10,))


KINDS = ("How many ", "Compare ", "What is ", "Which drug treats ", "Why does it happen to ", "List ")
_ANSWERS = "['numerical', 'comparison', 'definition', 'treatment', 'mechanism', 'factual']"


@query("question_types", f"SELECT p_partkey, {_ANSWERS}[p_partkey % 6 + 1] AS question_type, CASE p_partkey % 6 WHEN 0 THEN ['sample_size'] ELSE [] END AS fields FROM part")
def question_types(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % 6 + 1).cast("int")), "p_name")
    return read(spark, d, "part").select("p_partkey", understanding.question_type(q).alias("question_type"), understanding.requested_field_array(q).alias("fields"))


@query("row_fields", """SELECT o_orderkey, list_filter(['percentage', 'p-value', 'confidence_interval', 'effect_estimate', 'sample_size'], lambda f: (f = 'percentage' AND o_orderkey % 2 = 0) OR (f = 'p-value' AND o_orderkey % 3 = 0) OR (f = 'confidence_interval' AND o_orderkey % 5 = 0)
  OR (f = 'effect_estimate' AND o_orderkey % 7 = 0) OR (f = 'sample_size' AND o_orderkey % 11 = 0)) AS fields FROM orders""")
def row_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    cell = lambda name, n, yes, no: F.struct(F.lit(name).alias("col"), F.when(k % n == 0, yes).otherwise(no).alias("val"))
    cells = F.array(cell("n (%)", 2, "12 (40)", "twelve"), cell("P value", 3, "<0.001", "none"), cell("95% CI", 5, "1.2-3.4", "wide"), cell("OR", 7, "2.1", "-"), cell("group", 11, "n = 40", "all"), cell("more or less", 1, "5", "5"))
    return read(spark, d, "orders").select("o_orderkey", tx.detect_row_fields(F.lit("Age"), cells, F.array(F.lit("a note"))).alias("fields"))


@query("navigation_chunks", f"""WITH {CHUNKS_SQL}, h AS (SELECT CAST(document_id AS VARCHAR) AS paper_id, chunk_id, position % 10 AS r, 's' || (position // 5) AS node_id FROM ch)
SELECT paper_id, chunk_id, CAST(max(r) AS DOUBLE) AS relevance, list_sort(list(DISTINCT node_id)) AS node_ids FROM (SELECT * FROM h UNION ALL SELECT paper_id, chunk_id, 3, 'root' FROM h) GROUP BY ALL""")
def navigation_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).select(F.lit("r").alias("requirement_id"), F.col("document_id").cast("string").alias("paper_id"), F.concat(F.lit("s"), F.floor(F.col("position") / 5).cast("string")).alias("node_id"), (F.col("position") % 10).cast("double").alias("relevance"), F.lit("why").alias("reason"), F.array("chunk_id").alias("chunk_ids"))
    more = rows.withColumn("node_id", F.lit("root")).withColumn("relevance", F.lit(3.0))
    return hybrid.navigation_by_chunk(rows.unionByName(more)).select("paper_id", "chunk_id", "relevance", "node_ids")


@query("levelled_questions")
def levelled_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text", F.slice(tx.content_tokens(F.col("text")), 1, 6).alias("keywords"), tx.entity_phrases(F.col("text")).alias("phrases"))
    return report.levelled_questions(rows, {"is": "was", "of the": "from any"})



@query("evidence_repair", """
WITH e AS (SELECT CAST(user_id % 23 AS VARCHAR) AS question_id, event_id AS chunk_id, event_type AS requirement_id, value AS final FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY final DESC, chunk_id) AS n, row_number() OVER (PARTITION BY question_id, requirement_id ORDER BY final DESC, chunk_id) AS k FROM e),
s AS (SELECT * FROM r WHERE n <= 6),
o AS (SELECT * FROM r WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.question_id = r.question_id AND s.requirement_id = r.requirement_id)),
w AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY final, chunk_id) AS weak FROM s WHERE k > 1),
c AS (SELECT question_id, count(*) AS n_open FROM o GROUP BY question_id)
SELECT question_id, chunk_id, round(final, 6) AS final, [requirement_id] AS covers FROM o
UNION ALL SELECT question_id, chunk_id, round(final, 6), [requirement_id] FROM s WHERE k = 1
UNION ALL SELECT question_id, chunk_id, round(final, 6), [requirement_id] FROM w LEFT JOIN c USING (question_id) WHERE weak > coalesce(n_open, 0)""")
def evidence_repair(spark: SparkSession, d: str) -> DataFrame:
    """Each question's six best events, and what their types leave open: the weakest of a type that others show too go for the best of
    each open type."""
    rows = read(spark, d, "events").select((F.col("user_id") % 23).cast("string").alias("question_id"), F.col("event_id").alias("chunk_id"), F.col("value").alias("final"), F.array("event_type").alias("covers"))
    best = lexical.top_k(rows, 6, order="final", key="question_id").drop("rank")
    needed = rows.select("question_id", F.col("covers")[0].alias("requirement_id")).distinct()
    return repair.repair(best, rows, needed, slots=6).withColumn("final", F.round("final", 6))


TABLE_ROWS_SQL = f"""
WITH {CHUNKS_SQL},
tc AS (SELECT CAST(document_id AS VARCHAR) AS paper_id, chunk_id, position, text, CASE WHEN position = min(position) OVER (PARTITION BY document_id) THEN 'table_summary' WHEN position % 11 = 10 THEN 'table_footnotes' ELSE 'table_row' END AS kind FROM ch),
hd AS (SELECT paper_id, max(text) FILTER (kind = 'table_summary') AS caption FROM tc GROUP BY paper_id),
nt AS (SELECT paper_id, string_agg(text, chr(10) ORDER BY position, chunk_id) AS notes FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY position, chunk_id) AS n FROM tc WHERE kind = 'table_footnotes') WHERE n <= 2 GROUP BY paper_id),
rw AS (SELECT paper_id, chunk_id, string_agg(text, chr(10)) OVER (PARTITION BY paper_id ORDER BY position, chunk_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS rws FROM tc WHERE kind = 'table_row')
SELECT paper_id, chunk_id, (caption || chr(10) || rws || coalesce(chr(10) || notes, ''))[1:600] AS context FROM rw JOIN hd USING (paper_id) LEFT JOIN nt USING (paper_id)"""


@query("row_context", TABLE_ROWS_SQL)
def row_context(spark: SparkSession, d: str) -> DataFrame:
    """Documents as tables: the first line is the summary, every eleventh a footnote, others are rows."""
    first = F.min("position").over(Window.partitionBy("document_id"))
    kind = F.when(F.col("position") == first, "table_summary").when(F.col("position") % 11 == 10, "table_footnotes").otherwise("table_row")
    rows = chunks(spark, d).select(F.col("document_id").cast("string").alias("paper_id"), F.lit("t").alias("table_id"), "chunk_id", kind.alias("chunk_type"), "position", "text")
    found = structure.table_context(rows, rows_around=3, most=600)
    return found.join(rows.where("chunk_type = 'table_row'").select("chunk_id"), "chunk_id", "left_semi").select("paper_id", "chunk_id", "context")


def _apart_sql(name: str, longer: str) -> str:
    return f"CASE WHEN contains('{longer}', '{name}') THEN replace(low, '{longer}', ' ') ELSE low END"


def _taken_sql(own: str, other: str) -> str:
    return f"(contains({_apart_sql(other, own)}, '{other}') AND NOT contains({_apart_sql(own, other)}, '{own}'))"


@query("confusable_penalty", f"""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS low, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents),
f AS (SELECT doc_id, {_taken_sql('inter', 'er')} OR {_taken_sql('sch', 'che')} AS confused, {_taken_sql('sch', 'che')} AS competing, contains(low, 'the') AS generic, contains(low, 'sch') AS population, contains(low, 'of the') OR list_has_all(ws, ['of', 'the']) AS target,
        list_has_any(ws, ['of', 'the']) AS near FROM t)
SELECT doc_id, round(least(1e0, CASE WHEN NOT target AND NOT near THEN 0.6 ELSE 0 END + CASE WHEN competing THEN 1.05 ELSE 0 END + CASE WHEN confused THEN 1.4 ELSE 0 END
  + CASE WHEN generic AND NOT population AND NOT contains(low, 'of the') THEN 0.5 ELSE 0 END), 6) AS penalty FROM f JOIN t USING (doc_id)""")
def confusable_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a candidate for one requirement, whose names stand for ones that are taken for others."""
    none, one = F.array().cast("array<string>"), lambda x: F.array(F.lit(x))
    pair = lambda own, other: F.struct(F.lit(own).alias("own"), F.lit(other).alias("other"))
    rows = read(spark, d, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("paragraph").alias("chunk_type"), F.lit(0.0).alias("encoder"), F.lit(0.0).alias("paper"), F.lit(0.0).alias("type_match"), none.alias("fields"), one("the").alias("concepts"),
        none.alias("conditions"), one("of the").alias("targets"), none.alias("outcomes"), one("sch").alias("populations"), none.alias("requested"), one("the").alias("generics"),
        F.array(pair("inter", "er"), pair("sch", "che")).alias("confusables"), F.array(pair("sch", "che")).alias("competing"),
    )
    return evidence.score(rows).select("doc_id", F.round("penalty", 6).alias("penalty"))
