"""Lexical and vector search, fusion, document scoring, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.models.plugins import OverlapScorer, score_macro_batches
from foliant.operators import dense, evaluate, fusion, graph, impacts, lexical, papers, regression
from foliant.operators.structure import line_chunks
from foliant.queries import query, read
from foliant.session import cut

ASKED = {"q1": "the of and that in", "q2": "der die und von ein", "q3": "les des dans pour avec"}
_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in ASKED.items())
CHUNKS_SQL = """
ch AS (SELECT 'D_' || doc_id || '_' || (i - 1) AS chunk_id, doc_id AS document_id, CAST(i - 1 AS INTEGER) AS position, ls[i] AS text, source
       FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
       WHERE regexp_matches(ls[i], '\\S'))"""
BM25_SQL = f"""
WITH {CHUNKS_SQL},
tk AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM ch),
dl AS (SELECT chunk_id, len(ws) AS dl FROM tk),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
po AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ws) AS term FROM tk) GROUP BY ALL),
te AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM po GROUP BY term), st),
qs AS (SELECT * FROM (VALUES {_VALUES}) AS t(query_id, text)),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM qs),
sc AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
       FROM qt JOIN po USING (term) JOIN te USING (term) JOIN dl USING (chunk_id), st GROUP BY query_id, chunk_id)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return line_chunks(read(spark, d, "documents"))


def asked(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_VALUES} AS t(query_id, text)")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("chunk_split", f"WITH {CHUNKS_SQL} SELECT chunk_id, document_id, position, text FROM ch")
def chunk_split(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d)


@query("term_frequency", BM25_SQL + " SELECT term, chunk_id, tf FROM po")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build(chunks(spark, d)).postings.select("term", "chunk_id", "tf")


@query("document_frequency", BM25_SQL + " SELECT term, df, round(idf, 8) AS idf FROM te")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build(chunks(spark, d)).terms.select("term", "df", F.round("idf", 8).alias("idf"))


@query("length_statistics", BM25_SQL + " SELECT n, round(avgdl, 6) AS avgdl FROM st")
def length_statistics(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build(chunks(spark, d)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_topk", BM25_SQL + """
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, c.chunk_id, coalesce(score, 0.0) AS score FROM qs q CROSS JOIN dl c LEFT JOIN sc USING (query_id, chunk_id))) WHERE rank <= 50""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(lexical.build(chunks(spark, d)), asked(spark), 50, digits=6)


@query("bm25_pruned_topk", BM25_SQL + """
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, c.chunk_id, coalesce(score, 0.0) AS score FROM qs q CROSS JOIN dl c LEFT JOIN sc USING (query_id, chunk_id))) WHERE rank <= 50""")
def bm25_pruned_topk(spark: SparkSession, d: str) -> DataFrame:
    return impacts.search(impacts.build(chunks(spark, d)), asked(spark), 50, digits=6)


@query("bm25_positive_only", BM25_SQL + " SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 20")
def bm25_positive_only(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(lexical.build(chunks(spark, d)), asked(spark), 20, zero_fill=False, digits=6)


@query("bm25_restricted", BM25_SQL + """
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, c.chunk_id, coalesce(score, 0.0) AS score FROM qs q CROSS JOIN (SELECT chunk_id FROM ch WHERE source = 'src3') c LEFT JOIN sc USING (query_id, chunk_id))) WHERE rank <= 40""")
def bm25_restricted(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    inside = line_chunks(docs.where("source = 'src3'")).select("chunk_id")
    scope = inside.join(F.broadcast(asked(spark).select("query_id")))
    return lexical.search(lexical.build(line_chunks(docs)), asked(spark), 40, scope=scope, digits=6)


def _dense_sql(score: str, k: int, where: str = "true") -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id % 50 = 0),
e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE {where}),
s AS (SELECT query_id, id, round({score}, 6) + 0.0 AS score FROM q CROSS JOIN e)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k}"""


@query("dense_cosine_topk", _dense_sql("list_inner_product(q, v) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(v, v)))", 10))
def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(read(spark, d, "embeddings"), query_vectors(spark, d), 10, digits=6)


@query("dense_l2_topk", _dense_sql("-list_distance(q, v)", 10))
def dense_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(read(spark, d, "embeddings"), query_vectors(spark, d), 10, method="l2", digits=6)


@query("dense_filtered_topk", _dense_sql("list_inner_product(q, v)", 5, "label IN (1, 3)"))
def dense_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(read(spark, d, "embeddings").where("label in (1, 3)"), query_vectors(spark, d), 5, method="dot", digits=6)


@query("dense_graph_topk")
def dense_graph_topk(spark: SparkSession, d: str) -> DataFrame:
    """What dense_cosine_topk finds, but from small-world graphs: nearly all of it."""
    return graph.search(graph.build(read(spark, d, "embeddings")), query_vectors(spark, d), 10, digits=6)


LISTS_SQL = BM25_SQL + """,
l1 AS (SELECT query_id, chunk_id, 'bm25' AS method, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc),
lw AS (SELECT query_id, chunk_id, round(100.0 * count(*) / max(dl), 6) AS score FROM qt JOIN po USING (term) JOIN dl USING (chunk_id) GROUP BY query_id, chunk_id),
l2 AS (SELECT query_id, chunk_id, 'share' AS method, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lw),
hits AS (SELECT * FROM l1 WHERE rank <= 100 UNION ALL SELECT * FROM l2 WHERE rank <= 100)"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of the same queries, BM25 and query terms for a hundred words, written once: at most 200 rows a query,
    which the plans on top read several times."""
    index = lexical.build(chunks(spark, d))
    one = lexical.search(index, asked(spark), 100, zero_fill=False, digits=6).withColumn("method", F.lit("bm25"))
    terms = asked(spark).select("query_id", F.explode(F.array_distinct(lexical.tokens(F.col("text")))).alias("term"))
    found = index.words.withColumn("term", F.explode(F.array_distinct("words"))).join(F.broadcast(terms), "term")
    share = found.groupBy("query_id", "chunk_id", "dl").agg(F.count("*").alias("n")).select("query_id", "chunk_id", F.round(100.0 * F.col("n") / F.col("dl"), 6).alias("score"))
    return cut(one.unionByName(lexical.top_k(share, 100).withColumn("method", F.lit("share"))))


@query("hits_provenance", LISTS_SQL + " SELECT query_id, chunk_id, method, score, CAST(rank AS INTEGER) AS rank, CAST(split_part(chunk_id, '_', 2) AS BIGINT) AS paper_id FROM hits")
def hits_provenance(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).withColumn("paper_id", F.split_part("chunk_id", F.lit("_"), F.lit(2)).cast("long")).select("query_id", "chunk_id", "method", "score", "rank", "paper_id")


RRF_SQL = LISTS_SQL + """,
fu AS (SELECT query_id, chunk_id, round(sum(1.0 / CAST(60 + rank AS DOUBLE)), 8) AS rrf_score, list_sort(list(DISTINCT method)) AS methods, min(rank) AS best_rank FROM hits GROUP BY query_id, chunk_id),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, best_rank, chunk_id) AS rank FROM fu)"""


@query("rrf_fuse", RRF_SQL + " SELECT query_id, chunk_id, rrf_score, methods, CAST(rank AS INTEGER) AS rank FROM rr WHERE rank <= 60")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(hits(spark, d), depth=60, digits=8)


@query("minmax_weighted_fuse", LISTS_SQL + """,
mm AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM hits WINDOW w AS (PARTITION BY query_id, method))
SELECT query_id, chunk_id, round(sum(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END * CASE method WHEN 'bm25' THEN 0.7 ELSE 0.3 END), 6) AS fused FROM mm GROUP BY query_id, chunk_id""")
def minmax_weighted_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fusion.weighted(hits(spark, d), {"bm25": 0.7, "share": 0.3}).withColumn("fused", F.round("fused", 6))


@query("paper_diversify", RRF_SQL + """,
pd AS (SELECT *, split_part(chunk_id, '_', 2) AS paper FROM rr),
pn AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper ORDER BY rank) AS n FROM pd)
SELECT query_id, chunk_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM pn WHERE n <= 2) WHERE place <= 8""")
def paper_diversify(spark: SparkSession, d: str) -> DataFrame:
    ranked = fusion.rrf(hits(spark, d), digits=8).withColumn("paper", F.split_part("chunk_id", F.lit("_"), F.lit(2)))
    return fusion.diversify(ranked, "paper", 2, 8).select("query_id", "chunk_id", "place")


@query("union_dedupe_methods", LISTS_SQL + " SELECT chunk_id, list_sort(list(DISTINCT method)) AS methods FROM hits GROUP BY chunk_id")
def union_dedupe_methods(spark: SparkSession, d: str) -> DataFrame:
    every = hits(spark, d)
    return fusion.union_with_methods({m: every.where(F.col("method") == m) for m in ("bm25", "share")})


@query("run_alignment", LISTS_SQL + """,
ra AS (SELECT query_id, chunk_id, rank AS a FROM hits WHERE method = 'bm25'), rb AS (SELECT query_id, chunk_id, rank AS b FROM hits WHERE method = 'share'),
rj AS (SELECT *, max(greatest(coalesce(a, 0), coalesce(b, 0))) OVER (PARTITION BY query_id) AS e FROM ra FULL JOIN rb USING (query_id, chunk_id)),
rw AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN list_sum(list_transform(range(CAST(greatest(a, b) AS BIGINT), e + 1), lambda d: power(0.9e0, d - 1) / d)) END AS w FROM rj)
SELECT query_id, count(a) AS n_golden, count(b) AS n_run, count(w) AS n_both, round(coalesce(sum(w), 0) / list_sum(list_transform(range(1, max(e) + 1), lambda d: power(0.9e0, d - 1))), 6) AS overlap,
  coalesce(list(chunk_id ORDER BY a, chunk_id) FILTER (b IS NULL), []) AS lost, coalesce(list(chunk_id ORDER BY b, chunk_id) FILTER (a IS NULL), []) AS gained FROM rw GROUP BY query_id""")
def run_alignment(spark: SparkSession, d: str) -> DataFrame:
    """One method's lists as the golden run, the other's as the new one."""
    every = hits(spark, d)
    of = lambda m: every.where(F.col("method") == m).select("query_id", "chunk_id", "rank")
    return regression.align(of("bm25"), of("share"), "query_id", "chunk_id").withColumn("overlap", F.round("overlap", 6))


@query("macro_rerank", LISTS_SQL + """,
pt AS (SELECT DISTINCT query_id, chunk_id FROM hits)
SELECT query_id, chunk_id, round(len(list_intersect(list_distinct(string_split(lower(qs.text), ' ')), regexp_split_to_array(trim(lower(ch.text)), '[\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}]+'))) / len(list_distinct(string_split(lower(qs.text), ' '))), 6) AS raw
FROM pt JOIN qs USING (query_id) JOIN ch USING (chunk_id)""")
def macro_rerank(spark: SparkSession, d: str) -> DataFrame:
    """All queries' candidates scored in macro batches by length."""
    pairs = hits(spark, d).select("query_id", "chunk_id").distinct().join(F.broadcast(asked(spark).withColumnRenamed("text", "query")), "query_id").join(chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return score_macro_batches(pairs, F.col("query"), F.col("text"), OverlapScorer, "raw", 512).select("query_id", "chunk_id", F.round("raw", 6).alias("raw"))


PAPER_SQL = RRF_SQL + """,
fs AS (SELECT rr.*, split_part(chunk_id, '_', 2) AS paper_id, CAST(split_part(chunk_id, '_', 3) AS INTEGER) // 5 AS section, CASE WHEN CAST(split_part(chunk_id, '_', 3) AS INTEGER) % 3 = 0 THEN 'lead' ELSE 'body' END AS node_type FROM rr WHERE rank <= 80),
fn AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rrf_score DESC, chunk_id) AS n FROM fs),
fm AS (SELECT query_id, paper_id, count(DISTINCT m) AS k FROM (SELECT query_id, paper_id, unnest(methods) AS m FROM fs) GROUP BY ALL),
pg AS (SELECT query_id, paper_id, max(rrf_score) AS strongest, coalesce(sum(rrf_score) FILTER (n <= 3), 0) / 3 AS mean_top, count(*) AS support,
              count(DISTINCT section) / count(*) AS sd, count(DISTINCT node_type) AS n_types, count(DISTINCT section) AS n_sections FROM fn GROUP BY query_id, paper_id),
pw AS (SELECT *, min(strongest) OVER w AS l1, max(strongest) OVER w AS h1, min(mean_top) OVER w AS l2, max(mean_top) OVER w AS h2, min(support) OVER w AS l3, max(support) OVER w AS h3 FROM pg WINDOW w AS (PARTITION BY query_id)),
ps AS (SELECT query_id, paper_id, n_types, n_sections, k / 2 AS ma,
         0.5 * CASE WHEN h1 = l1 THEN 1 ELSE (strongest - l1) / (h1 - l1) END + 0.2 * CASE WHEN h2 = l2 THEN 1 ELSE (mean_top - l2) / (h2 - l2) END
         + 0.1 * CASE WHEN h3 = l3 THEN 1 ELSE (support - l3) / (h3 - l3) END + 0.1 * sd + 0.1 * k / 2 AS score FROM pw JOIN fm USING (query_id, paper_id))"""


def paper_scores(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.rrf(hits(spark, d), depth=80, digits=8)
    place = F.split_part("chunk_id", F.lit("_"), F.lit(3)).cast("int")
    fused = fused.withColumns({"paper_id": F.split_part("chunk_id", F.lit("_"), F.lit(2)), "section": F.floor(place / 5), "node_type": F.when(place % 3 == 0, "lead").otherwise("body")})
    return papers.score_per_query(fused)


@query("paper_query_score", PAPER_SQL + " SELECT query_id, paper_id, round(score, 6) AS score FROM ps")
def paper_query_score(spark: SparkSession, d: str) -> DataFrame:
    return paper_scores(spark, d).select("query_id", "paper_id", F.round("score", 6).alias("score"))


@query("paper_select", PAPER_SQL + """,
br AS (SELECT * FROM (VALUES ('q1', 'r1'), ('q2', 'r2'), ('q3', 'r2'), ('q3', 'r3')) AS t(query_id, requirement_id)),
rb AS (SELECT requirement_id, paper_id, max(score) AS raw, max(n_types) AS nt, max(n_sections) AS ns, max(ma) AS ma FROM ps JOIN br USING (query_id) GROUP BY ALL),
rn AS (SELECT *, CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 0.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS norm FROM rb WINDOW w AS (PARTITION BY requirement_id)),
rp AS (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY norm DESC, raw DESC, paper_id) AS place FROM rn),
pp AS (SELECT paper_id, max(norm) AS s, count(*) FILTER (norm >= 0.2 OR place <= 5) AS c, sum(norm) AS t, max(nt) AS nt, max(ns) AS ns, max(ma) AS ma, max(CASE WHEN place <= 2 THEN 1 ELSE 0 END) AS g FROM rp GROUP BY paper_id),
pf AS (SELECT paper_id, g, 0.4 * s + 0.25 * c / 3 + 0.2 * t / 3 + 0.1 * (0.5 * least(1.0, nt / 5) + 0.5 * least(1.0, ns / 5)) + 0.05 * ma + 0.05 * greatest(c - 1, 0) AS score FROM pp),
po2 AS (SELECT *, row_number() OVER (ORDER BY score DESC, paper_id) AS place FROM pf)
SELECT paper_id, round(score, 5) AS score, g = 1 AS guaranteed FROM po2 WHERE place <= 12 OR g = 1""")
def paper_select(spark: SparkSession, d: str) -> DataFrame:
    bridge = spark.sql("SELECT * FROM VALUES ('q1', 'r1'), ('q2', 'r2'), ('q3', 'r2'), ('q3', 'r3') AS t(query_id, requirement_id)")
    return papers.select(paper_scores(spark, d), bridge).select("paper_id", F.round("score", 5).alias("score"), "guaranteed")


TRUTH_SQL = LISTS_SQL + """,
re AS (SELECT DISTINCT q.query_id, h.chunk_id AS item_id FROM qs q JOIN hits h USING (query_id) WHERE h.method = 'share' AND h.rank <= 30),
rk AS (SELECT query_id, chunk_id AS item_id, rank FROM hits WHERE method = 'bm25'),
hh AS (SELECT rk.* FROM rk JOIN re USING (query_id, item_id)),
nn AS (SELECT query_id, count(*) AS n FROM re GROUP BY query_id)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    every = hits(spark, d).withColumnRenamed("chunk_id", "item_id")
    return evaluate.recall_at(every.where("method = 'bm25'").select("query_id", "item_id", "rank"), every.where("method = 'share' and rank <= 30").select("query_id", "item_id"), (5, 20, 50))


METRICS_SQL = TRUTH_SQL + """,
me AS (SELECT query_id, count(*) FILTER (rank <= 5) / max(n) AS recall_5, count(*) FILTER (rank <= 20) / max(n) AS recall_20, count(*) FILTER (rank <= 50) / max(n) AS recall_50, coalesce(1.0 / min(rank), 0.0) AS rr
       FROM nn LEFT JOIN hh USING (query_id) GROUP BY query_id)"""


@query("recall_and_mrr", METRICS_SQL + " SELECT query_id, round(recall_5, 6) AS recall_5, round(recall_20, 6) AS recall_20, round(recall_50, 6) AS recall_50, round(rr, 6) AS rr FROM me")
def recall_and_mrr(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("query_id", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_20", "recall_50", "rr")])


@query("metric_rollup", METRICS_SQL + " SELECT query_id AS kind, count(*) AS n, round(avg(recall_20), 6) AS recall_20, round(avg(rr), 6) AS rr FROM me GROUP BY CUBE (query_id)")
def metric_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.roll_up(_metrics(spark, d).withColumnRenamed("query_id", "kind"), ["kind"], ["recall_20", "rr"])


@query("top_keywords", """
WITH w AS (SELECT item_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark)),
c AS (SELECT item_id, word, count(*) AS n, min(pos) AS p FROM w WHERE length(word) > 2 AND word NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'was', 'are', 'had', 'has', 'have', 'how', 'into', 'its', 'may', 'more', 'most', 'not', 'our', 'should', 'such', 'than', 'their', 'them', 'then', 'there', 'these', 'they', 'those', 'were', 'what', 'when', 'where', 'which', 'who', 'why', 'will', 'would', 'been', 'can', 'could', 'did', 'does', 'from') GROUP BY item_id, word)
SELECT item_id, word, n, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, p) AS k FROM c) WHERE k <= 6""")
def top_keywords(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.top_keywords(read(spark, d, "benchmark"), "item_id", "text", 6)


@query("self_retrieval_queries", f"""
WITH {CHUNKS_SQL}, w AS (SELECT chunk_id, source, list_filter(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(13)), '\\s+'), lambda x: x <> '') AS ws FROM ch)
SELECT chunk_id, 'verbatim' AS kind, array_to_string(ws[1:60], ' ') AS query FROM w UNION ALL SELECT chunk_id, 'title', source || ' ' || array_to_string(ws[1:40], ' ') FROM w""")
def self_retrieval_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source"), "document_id")
    return evaluate.self_queries(rows, F.col("source"))
