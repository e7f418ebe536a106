"""Structure, text functions, evidence scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import evidence, leafmatch, structure, tree
from foliant.queries import query, read
from foliant.queries.retrieval import CHUNKS_SQL, chunks

#: Windows of held-out texts that are broadcast; more are shuffled.
MOST_WINDOWS = 500_000


@query("chunk_breadcrumb", f"WITH {CHUNKS_SQL} SELECT chunk_id, source || ' > ' || lang || chr(10) || chr(10) || ch.text AS embedding_text, source AS section, lang AS subsection FROM ch JOIN (SELECT doc_id, lang FROM documents) ON doc_id = document_id")
def chunk_breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.array("source", "lang").alias("breadcrumb")), "document_id")
    return structure.with_parent_fields(rows).select("chunk_id", structure.embedding_text(F.col("breadcrumb"), F.col("text")).alias("embedding_text"), "section", "subsection")


@query("neighbor_window", f"""
WITH {CHUNKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY position) AS n FROM ch)
SELECT a.chunk_id, b.chunk_id AS neighbour_id, CAST(b.n - a.n AS INTEGER) AS distance FROM r a JOIN r b ON a.document_id = b.document_id AND abs(a.n - b.n) BETWEEN 1 AND 2""")
def neighbor_window(spark: SparkSession, d: str) -> DataFrame:
    return structure.neighbours(chunks(spark, d), 2, ["document_id"])


@query("prose_islands", f"""
WITH {CHUNKS_SQL}, b AS (SELECT *, length(text) < 20 AS edge FROM ch),
s AS (SELECT *, CASE WHEN edge OR coalesce(lag(edge) OVER (PARTITION BY document_id ORDER BY position), true) THEN 1 ELSE 0 END AS st FROM b)
SELECT chunk_id, CAST(sum(st) OVER (PARTITION BY document_id ORDER BY position) AS BIGINT) AS island FROM s""")
def prose_islands(spark: SparkSession, d: str) -> DataFrame:
    return structure.islands(chunks(spark, d), "document_id", "position", F.length("text") < 20).select("chunk_id", "island")


@query("unique_chunk_ids", """
SELECT conv_id, turn, CASE WHEN n > 0 THEN role || '_' || n ELSE role END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS n FROM conversations)""")
def unique_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return structure.unique_ids(read(spark, d, "conversations"), "conv_id", "role", "turn").select("conv_id", "turn", "unique_id")


@query("token_budget_prefix", f"""
WITH {CHUNKS_SQL}, t AS (SELECT *, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tok FROM ch),
r AS (SELECT *, row_number() OVER w AS n, sum(tok) OVER w AS s FROM t WINDOW w AS (PARTITION BY document_id ORDER BY position))
SELECT chunk_id, CAST(tok AS BIGINT) AS tokens FROM r WHERE n = 1 OR (n <= 12 AND s <= 200)""")
def token_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).withColumn("tokens", tx.token_estimate(F.col("text")))
    return structure.token_budget(rows, "document_id", "position", "tokens", 12, 200).select("chunk_id", "tokens")


@query("prose_pack")
def prose_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = structure.islands(chunks(spark, d), "document_id", "position", F.length("text") < 20)
    return structure.prose_chunks(rows.select("document_id", "island", F.col("position").cast("long").alias("block_seq"), F.col("text").alias("content")))


#: What a text's words become, so that invented prose has headings, tables, captions and footnotes.
AS_MARKDOWN = ((". ", "\n### "), (" und ", "\n<table><tr>\n"), (" die ", "</table>\n"), (" of ", "\nTable 1. x\n\n"), (", ", "\n| x |\n"), (" les ", "\n[^a]: "), (" the ", " [^a] "), (" in ", " [^b] "))


def _as_markdown_sql(text: str) -> str:
    for old, new in AS_MARKDOWN:
        text = f"replace({text}, '{old}', " + "'" + new.replace("\n", "' || chr(10) || '") + "')"
    return text


@query("markdown_profile", f"""
WITH t AS (SELECT doc_id, {_as_markdown_sql("coalesce(text, '')")} AS md FROM documents),
l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, unnest(range(len(string_split(md, chr(10))))) AS n FROM t),
o AS (SELECT *, len(regexp_extract_all(line, '(?i)<table\\b')) AS opens, len(regexp_extract_all(line, '(?i)</table>')) AS ends FROM l),
s AS (SELECT *, sum(opens - ends) OVER (PARTITION BY doc_id ORDER BY n) AS ls FROM o),
m AS (SELECT *, opens > 0 OR coalesce(lag(ls) OVER (PARTITION BY doc_id ORDER BY n), 0) - least(0, coalesce(min(ls) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) > 0 AS markup FROM s),
f AS (SELECT *, CASE WHEN NOT markup AND regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN length(regexp_extract(line, '^(#+)', 1)) END AS lv, NOT markup AND regexp_matches(line, '^\\s*\\|.*\\|\\s*$') AS pipe,
        NOT markup AND regexp_matches(line, '^\\s*\\**(?:Table|Tab\\.)\\s*\\d+') AS caption, CASE WHEN NOT markup THEN regexp_extract(line, '^\\s*\\[\\^([^\\]\\s]+)\\]:', 1) END AS note,
        CASE WHEN NOT markup THEN regexp_extract_all(regexp_replace(line, '^\\s*\\[\\^[^\\]\\s]+\\]:', ''), '\\[\\^([^\\]\\s]+)\\]', 1) END AS uses, CASE WHEN regexp_matches(line, '\\S') THEN 1 END AS said FROM m),
g AS (SELECT *, CASE WHEN said = 1 THEN pipe OR markup END AS tb FROM f),
w AS (SELECT *, last_value(lv IGNORE NULLS) OVER b AS bf, coalesce(lag(pipe) OVER (PARTITION BY doc_id ORDER BY n), false) AS pb, coalesce(last_value(tb IGNORE NULLS) OVER b, false) OR coalesce(first_value(tb IGNORE NULLS) OVER a, false) AS near FROM g
      WINDOW b AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT doc_id, count(lv) AS n_headings, CAST(coalesce(max(lv), 0) AS BIGINT) AS deepest, count(*) FILTER (lv - bf > 1) AS n_jumps, CAST(sum(opens) AS BIGINT) AS n_html_tables, count(*) FILTER (pipe AND NOT pb) AS n_pipe_tables,
  count(*) FILTER (caption) AS n_captions, count(*) FILTER (caption AND near) AS n_bound, count(*) FILTER (note <> '') AS n_notes, CAST(coalesce(sum(len(uses)), 0) AS BIGINT) AS n_note_uses,
  CAST(len(list_filter(list_distinct(flatten(list(uses))), lambda x: NOT list_contains(list(note), x))) AS BIGINT) AS n_open_notes FROM w GROUP BY doc_id""")
def markdown_profile(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    for old, new in AS_MARKDOWN:
        text = F.replace(text, F.lit(old), F.lit(new))
    return structure.markdown_profile(read(spark, d, "documents").select("doc_id", text.alias("text")))


@query("section_classify", "SELECT c_custkey, CASE WHEN t IN ('references', 'bibliography') THEN 'references' WHEN t IN ('funding', 'acknowledgements') THEN 'administrative' ELSE 'content' END AS kind FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'references' WHEN 1 THEN 'funding' WHEN 2 THEN 'acknowledgements' WHEN 3 THEN 'results' ELSE 'bibliography' END AS t FROM customer)")
def section_classify(spark: SparkSession, d: str) -> DataFrame:
    titles = F.element_at(F.array(*[F.lit(t) for t in ("References", "Funding:", " Acknowledgements ", "Results", "BIBLIOGRAPHY")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return read(spark, d, "customer").select("c_custkey", tx.section_kind(titles).alias("kind"))


@query("first_n_words", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '\\s+'), lambda x: x <> '')[1:12], ' ') AS head FROM documents")
def first_n_words(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", tx.first_words(F.btrim("text", F.lit(" \t\n\r")), 12).alias("head"))


@query("jaccard_overlap", """
WITH u AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws, lead(regexp_extract_all(lower(text), '[a-z0-9]+')) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(ws, nx))) > 0 THEN len(list_intersect(list_distinct(ws), list_distinct(nx))) / len(list_distinct(list_concat(ws, nx))) ELSE 0 END, 6) AS overlap FROM u WHERE nx IS NOT NULL""")
def jaccard_overlap(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").withColumn("ws", tx.tokens(F.col("text"))).withColumn("nx", F.lead("ws").over(w)).where("nx is not null")
    return rows.select("conv_id", "turn", F.round(tx.jaccard(F.col("ws"), F.col("nx")), 6).alias("overlap"))


@query("ngram_leak", """
WITH g AS (SELECT DISTINCT array_to_string(ws[i:i + 6], ' ') AS g FROM (SELECT ws, unnest(range(1, len(ws) - 5)) AS i FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark) WHERE len(ws) >= 7)),
x AS (SELECT doc_id, array_to_string(ws[i:i + 6], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 5)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents) WHERE len(ws) >= 7))
SELECT doc_id, count(DISTINCT g) AS n FROM x JOIN g USING (g) GROUP BY doc_id""")
def ngram_leak(spark: SparkSession, d: str) -> DataFrame:
    words = tx.tokens(F.col("text")).alias("ws")
    known = read(spark, d, "benchmark").select(words).select(F.explode(tx.ngrams(F.col("ws"), 7)).alias("g")).distinct()
    own = read(spark, d, "documents").select("doc_id", words).select("doc_id", F.explode(F.array_distinct(tx.ngrams(F.col("ws"), 7))).alias("g"))
    # a held-out set's windows are few: while they are, each document's are looked up where they are made
    few = known.limit(MOST_WINDOWS + 1).count() <= MOST_WINDOWS
    return own.join(F.broadcast(known) if few else known, "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("fraction_overlap", """
WITH t AS (SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents)
SELECT doc_id, round(((CASE WHEN contains(low, 'of the') THEN 1 WHEN list_has_all(ws, ['of', 'the']) THEN 0.5 ELSE 0 END) + (CASE WHEN contains(low, 'und der') THEN 1 WHEN list_has_all(ws, ['und', 'der']) THEN 0.5 ELSE 0 END)) / 2, 6) AS share FROM t""")
def fraction_overlap(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(F.lit("of the"), F.lit("und der"))
    return read(spark, d, "documents").select("doc_id", F.round(tx.fraction_overlap(terms, F.col("text")), 6).alias("share"))


@query("field_detect_paragraph", """
SELECT o_orderkey, list_filter(['percentage', 'p-value', 'sample_size'], lambda f: (f = 'percentage' AND o_orderkey % 2 = 0) OR (f = 'p-value' AND o_orderkey % 3 = 0) OR (f = 'sample_size' AND o_orderkey % 5 = 0)) AS fields FROM orders""")
def field_detect_paragraph(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat_ws(" ", F.lit("It was"), F.when(k % 2 == 0, F.lit("12.5% of all,")), F.when(k % 3 == 0, F.lit("p < 0.05,")), F.when(k % 5 == 0, F.lit("n = 40,")), F.lit("as told."))
    return read(spark, d, "orders").select("o_orderkey", tx.detect_fields(text).alias("fields"))


@query("requested_field_fraction", "SELECT o_orderkey, ((CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)) / 2 AS share FROM orders")
def requested_field_fraction(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    found = F.array_compact(F.array(F.when(k % 2 == 0, "percentage"), F.when(k % 3 == 0, "p-value"), F.lit("sample_size")))
    return read(spark, d, "orders").select("o_orderkey", tx.requested_fraction(found, F.array(F.lit("percentage"), F.lit("p-value"))).alias("share"))


@query("synonym_substitution", "SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\bof the\\b', 'from any', 'g'), '(?i)\\bis\\b', 'was', 'g') AS text FROM documents WHERE lang = 'en'")
def synonym_substitution(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("lang = 'en'").select("doc_id", tx.substitute_synonyms(F.col("text"), {"is": "was", "of the": "from any"}).alias("text"))


@query("candidate_merge", """
WITH c AS (SELECT CAST(user_id % 7 AS VARCHAR) AS question_id, CAST(event_id % 400 AS VARCHAR) AS chunk_id, event_type AS requirement_id, value FROM events)
SELECT question_id, chunk_id, round(max(value), 6) AS final, coalesce(list_sort(list(DISTINCT requirement_id) FILTER (value > 50)), []) AS covers FROM c GROUP BY question_id, chunk_id""")
def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(
        (F.col("user_id") % 7).cast("string").alias("question_id"), (F.col("event_id") % 400).cast("string").alias("chunk_id"), F.col("event_type").alias("requirement_id"),
        F.col("value").alias("final"), (F.col("value") > 50).alias("covered"), F.lit("p").alias("paper_id"), F.lit("t").alias("chunk_type"),
    )
    return evidence.merge(rows).select("question_id", "chunk_id", F.round("final", 6).alias("final"), "covers")


@query("coverage_report", """
WITH s AS (SELECT event_id AS chunk_id, user_id AS paper_id, event_type AS requirement_id FROM events WHERE value > 50),
r AS (SELECT DISTINCT event_type AS requirement_id FROM events UNION SELECT 'never')
SELECT requirement_id, count(DISTINCT chunk_id) AS n_evidence, count(DISTINCT paper_id) AS n_papers, count(chunk_id) > 0 AS covered FROM r LEFT JOIN s USING (requirement_id) GROUP BY requirement_id""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events")
    wanted = events.select(F.col("event_type").alias("requirement_id")).distinct().unionByName(spark.sql("SELECT 'never' AS requirement_id"))
    used = events.where("value > 50").select(F.col("event_id").alias("chunk_id"), F.col("user_id").alias("paper_id"), F.array("event_type").alias("covers"))
    return evidence.coverage(wanted, used)


@query("greedy_select")
def greedy_select(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(
        (F.col("user_id") % 5).cast("string").alias("question_id"), (F.col("event_id") % 200).cast("string").alias("chunk_id"), F.col("event_type").alias("requirement_id"),
        F.col("value").alias("final"), (F.col("value") > 50).alias("covered"), (F.col("event_id") % 11).cast("string").alias("paper_id"), F.lit("paragraph").alias("chunk_type"),
    )
    merged = rows.groupBy("question_id", "chunk_id").agg(F.max("final").alias("final"), F.sort_array(F.collect_set(F.when(F.col("covered"), F.col("requirement_id")))).alias("covers"), F.min("paper_id").alias("paper_id"), F.min("chunk_type").alias("chunk_type"))
    return evidence.select_greedily(merged, 5)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """A tree of each document: itself, its lines in sections of five, the lines."""
    rows = chunks(spark, d).select(F.col("document_id").alias("paper_id"), "chunk_id", "position", "text")
    last = rows.groupBy("paper_id").agg(F.max("position").alias("top"))
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    root = last.select("paper_id", F.lit("root").alias("node_id"), none.alias("parent_id"), F.lit("document").alias("node_type"), F.lit("").alias("title"), F.lit("").alias("text"), F.lit("").alias("breadcrumb"), empty.alias("chunk_ids"), F.lit(-1).alias("preorder"), (F.floor(F.col("top") / 5) * 50 + 49).cast("int").alias("last_preorder"))
    part = rows.select("paper_id", F.floor(F.col("position") / 5).cast("int").alias("s")).distinct()
    section = part.select("paper_id", F.concat(F.lit("s"), "s").alias("node_id"), F.lit("root").alias("parent_id"), F.lit("section").alias("node_type"), F.concat(F.lit("Part "), "s").alias("title"), F.lit("").alias("text"), F.lit("").alias("breadcrumb"), empty.alias("chunk_ids"), (F.col("s") * 50).alias("preorder"), (F.col("s") * 50 + 49).alias("last_preorder"))
    leaf = rows.select("paper_id", F.col("chunk_id").alias("node_id"), F.concat(F.lit("s"), F.floor(F.col("position") / 5).cast("int")).alias("parent_id"), F.lit("paragraph").alias("node_type"), F.lit("").alias("title"), "text", F.lit("").alias("breadcrumb"), F.array("chunk_id").alias("chunk_ids"), (F.col("position") * 10 + 1).alias("preorder"), (F.col("position") * 10 + 1).alias("last_preorder"))
    return root.unionByName(section).unionByName(leaf)


@query("tree_descendants", f"WITH {CHUNKS_SQL} SELECT document_id AS paper_id, 's' || (position // 5) AS node_id, list_sort(list(chunk_id)) AS chunk_ids FROM ch GROUP BY ALL UNION ALL SELECT document_id, 'root', list_sort(list(chunk_id)) FROM ch GROUP BY ALL UNION ALL SELECT document_id, chunk_id, [chunk_id] FROM ch")
def tree_descendants(spark: SparkSession, d: str) -> DataFrame:
    return tree.chunk_rollup(nodes(spark, d))


@query("tree_reachability", f"WITH {CHUNKS_SQL} SELECT document_id AS paper_id, 'root' AS node_id, 0 AS depth FROM ch GROUP BY ALL UNION ALL SELECT DISTINCT document_id, 's' || (position // 5), 1 FROM ch UNION ALL SELECT document_id, chunk_id, 2 FROM ch")
def tree_reachability(spark: SparkSession, d: str) -> DataFrame:
    return tree.reachable(nodes(spark, d))


FAULTS_SQL = f"""WITH {CHUNKS_SQL}, c AS (SELECT document_id AS paper_id, count(*) AS n, count(DISTINCT position // 5) AS s, count(*) FILTER (position // 5 = 0) AS s0, count(*) FILTER (position = 0) AS p0 FROM ch GROUP BY document_id)
SELECT paper_id, 'ROOTS' AS code, CAST(2 AS BIGINT) AS n FROM c WHERE paper_id % 7 = 1
UNION ALL SELECT paper_id, 'ROOT_TYPE', 1 FROM c WHERE paper_id % 7 = 1
UNION ALL SELECT paper_id, 'PREORDER', 1 FROM c WHERE paper_id % 7 = 1
UNION ALL SELECT paper_id, 'PARENT', s0 FROM c WHERE paper_id % 7 = 2 AND s0 > 0
UNION ALL SELECT paper_id, 'UNREACHABLE', s0 FROM c WHERE paper_id % 7 = 2 AND s0 > 0
UNION ALL SELECT paper_id, 'TYPE', s FROM c WHERE paper_id % 7 = 3
UNION ALL SELECT paper_id, 'TITLE', s FROM c WHERE paper_id % 7 = 4
UNION ALL SELECT paper_id, 'DUPLICATE', n FROM c WHERE paper_id % 7 = 5
UNION ALL SELECT paper_id, 'PREORDER', n FROM c WHERE paper_id % 7 = 5"""


@query("tree_audit", FAULTS_SQL)
def tree_audit(spark: SparkSession, d: str) -> DataFrame:
    """Trees with a fault that the document's id gives: a second root, a lost section, a type that is not known, sections without titles,
    paragraphs twice; those of ids 0 and 6 modulo 7 are sound."""
    every, part = nodes(spark, d), F.col("paper_id") % 7
    second = every.where((part == 1) & (F.col("node_type") == "document")).withColumn("node_id", F.lit("other")).withColumn("node_type", F.lit("section")).withColumn("title", F.lit("Other"))
    again = every.where((part == 5) & (F.col("node_type") == "paragraph"))
    kept = every.where(~((part == 2) & (F.col("node_id") == "s0"))).unionByName(second).unionByName(again)
    section = F.col("node_type") == "section"
    kept = kept.withColumn("title", F.when((part == 4) & section, F.lit(" ")).otherwise(F.col("title"))).withColumn("node_type", F.when((part == 3) & section, F.lit("odd")).otherwise(F.col("node_type")))
    return tree.audit(kept, {"document", "section", "paragraph"})


DESCENT_SQL = f"""
WITH RECURSIVE {CHUNKS_SQL},
nd AS (SELECT document_id AS paper_id, chunk_id AS node_id, 's' || (position // 5) AS parent_id, 'paragraph' AS node_type, lower(text[1:120]) AS low FROM ch
       UNION ALL SELECT DISTINCT document_id, 's' || (position // 5), 'root', 'section', 'part ' || (position // 5) FROM ch
       UNION ALL SELECT DISTINCT document_id, 'root', NULL, 'document', '' FROM ch),
qs AS (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS terms FROM (VALUES ('a', 'the with that'), ('b', 'und der nicht eine')) AS t(query_id, text)),
wd AS (SELECT paper_id, node_id, parent_id, unnest(list_distinct(regexp_extract_all(low, '[a-z0-9]{{3,}}'))) AS term FROM nd),
up AS (SELECT paper_id, node_id, term FROM wd UNION SELECT paper_id, parent_id, term FROM wd WHERE parent_id IS NOT NULL UNION SELECT paper_id, 'root', term FROM wd),
sc AS (SELECT n.paper_id, n.node_id, n.parent_id, query_id, 2e0 * count(DISTINCT u.term) / max(len(terms)) AS score
       FROM nd n CROSS JOIN qs JOIN up u ON u.paper_id = n.paper_id AND u.node_id = n.node_id AND list_contains(terms, u.term) GROUP BY ALL),
go AS (SELECT paper_id, query_id, 'root' AS node_id, 0 AS level, 0e0 AS score FROM (SELECT DISTINCT paper_id FROM nd) CROSS JOIN qs
       UNION ALL SELECT paper_id, query_id, node_id, level, score FROM (
         SELECT s.paper_id, s.query_id, s.node_id, g.level + 1 AS level, s.score, row_number() OVER (PARTITION BY s.paper_id, s.query_id ORDER BY s.score DESC, s.node_id) AS n
         FROM go g JOIN sc s ON s.paper_id = g.paper_id AND s.query_id = g.query_id AND s.parent_id = g.node_id) WHERE n <= 3),
le AS (SELECT *, row_number() OVER (PARTITION BY paper_id, query_id ORDER BY score DESC, node_id) AS place FROM go WHERE level = 2)
SELECT paper_id, query_id, node_id, level, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM le WHERE place <= 8"""


@query("tree_descent", DESCENT_SQL)
def tree_descent(spark: SparkSession, d: str) -> DataFrame:
    """Every document's tree, searched branch by branch for two questions."""
    asked = spark.sql("SELECT * FROM VALUES ('a', 'the with that'), ('b', 'und der nicht eine') AS t(query_id, text)")
    return tree.descend(nodes(spark, d), asked).select("paper_id", "query_id", "node_id", "level", F.round("score", 6).alias("score"), "place")


@query("leaf_match")
def leaf_match(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents with an even id as leaves, those of the others as chunks, a paper for each language: copies of a document stand on either
    side."""
    rows = structure.line_chunks(read(spark, d, "documents"), keep=("lang",))
    place = (F.col("document_id") * (1 << 24) + F.col("position")).alias("position")
    side = lambda odd, name: rows.where(F.col("document_id") % 2 == odd).select(F.col("lang").alias("paper_id"), F.col("chunk_id").alias(name), place, "text")
    return leafmatch.match(side(0, "node_id"), side(1, "chunk_id")).withColumn("score", F.round("score", 6))


@query("nav_score_topk", f"""
WITH {CHUNKS_SQL},
sc AS (SELECT document_id AS paper_id, chunk_id AS node_id, ((CASE WHEN contains(lower(text[1:400]), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text[1:400]), 'und') THEN 1 ELSE 0 END)) / 2 AS score FROM ch),
r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, node_id) AS place, score / max(score) OVER (PARTITION BY paper_id) AS relevance FROM sc WHERE score >= 0.05)
SELECT paper_id, node_id, round(score, 6) AS score, round(relevance, 6) AS relevance, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8""")
def nav_score_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.lit("n").alias("query_id"), F.lit("the und").alias("text"))
    found = tree.navigate(nodes(spark, d).where("node_type = 'paragraph'"), asked.withColumnRenamed("text", "question").withColumnRenamed("question", "text"))
    return found.select("paper_id", "node_id", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"), "place")


@query("acronyms", "SELECT doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(text, '[\\p{L}\\p{N}-]+')), lambda w: regexp_matches(w, '^[A-Za-z][A-Za-z0-9-]{1,11}$') AND length(regexp_replace(w, '[^A-Z]', '', 'g')) >= 2)) AS found FROM documents")
def acronyms(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sort_array(tx.acronyms(F.col("text"))).alias("found"))
