"""Blocks to chunks, on orders as documents' blocks: each customer is a document, each order a block of a kind that its key
gives, with its lines as table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import chunks as ck
from foliant.queries import query, read

KINDS = ("table", "list", "figure", "equation", "reference", "footer")
_KINDS_SQL = "['table', 'list', 'figure', 'equation', 'reference', 'footer']"
BLOCKS_SQL = f"""
li AS (SELECT l_orderkey, list({{'label': 'line ' || l_linenumber, 'group': l_returnflag, 'q': CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 'm': l_linestatus}} ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rs FROM lineitem GROUP BY l_orderkey),
bl AS (SELECT 'C' || o_custkey AS document_id, o_orderkey AS block_seq, {_KINDS_SQL}[o_orderkey % 6 + 1] AS kind, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'o' || (o_orderkey % 3) END AS source_id,
   CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Order ' || o_orderkey END AS label, o_orderpriority AS content, o_orderkey % 7 = 0 AS admin, coalesce(rs, []) AS rs
   FROM orders LEFT JOIN li ON l_orderkey = o_orderkey),
ro AS (SELECT *, CASE WHEN admin THEN 'administrative' WHEN kind = 'footer' THEN 'other' ELSE kind END AS route FROM bl),
ob AS (SELECT *, CASE WHEN source_id IS NULL THEN route || '_' || (sum(CASE WHEN source_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, route ORDER BY block_seq) - 1) ELSE route || '_' || source_id END AS obj FROM ro),
pa AS (
  SELECT document_id, block_seq, 0 AS sub, 'table_summary' AS chunk_type, CASE WHEN label <> '' THEN label || ': ' ELSE '' END || content || chr(10) || chr(10) || 'Columns:' || chr(10) || '- quantity' || chr(10) || '- status' AS text,
         CASE WHEN label <> '' THEN label ELSE 'Table ' || obj END AS prefix, '_' || obj || '_summary' AS suffix, obj FROM ob WHERE route = 'table'
  UNION ALL SELECT document_id, block_seq, i, 'table_row', 'Group: ' || rs[i]['group'] || chr(10) || 'Row: ' || rs[i]['label'] || chr(10) || 'quantity: ' || rs[i]['q'] || chr(10) || 'status: ' || rs[i]['m'],
         CASE WHEN label <> '' THEN label ELSE 'Table ' || obj END, '_' || obj || '_row_' || (i - 1), obj FROM (SELECT *, unnest(range(1, len(rs) + 1)) AS i FROM ob WHERE route = 'table')
  UNION ALL SELECT document_id, block_seq, 1000000, 'table_footnotes', '[a] ' || content, CASE WHEN label <> '' THEN label ELSE 'Table ' || obj END, '_' || obj || '_footnotes', obj FROM ob WHERE route = 'table' AND block_seq % 2 = 0
  UNION ALL SELECT document_id, block_seq, 0, 'list', CASE WHEN label <> '' THEN label || chr(10) || chr(10) ELSE '' END || content, NULL, NULL, NULL FROM ob WHERE route = 'list'
  UNION ALL SELECT document_id, block_seq, 0, route, content, CASE route WHEN 'figure' THEN 'Figure ' || obj WHEN 'equation' THEN 'Equation ' || obj END, '_' || obj, obj FROM ob WHERE route IN ('figure', 'equation', 'reference')
  UNION ALL SELECT document_id, block_seq, 0, CASE WHEN route = 'other' THEN 'paragraph' ELSE route END, content, NULL, NULL, NULL FROM ob WHERE route IN ('administrative', 'other')),
po AS (SELECT *, row_number() OVER w - 1 AS position, sum(CASE WHEN suffix IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY block_seq, sub) - 1 AS pn FROM pa WINDOW w AS (PARTITION BY document_id ORDER BY block_seq, sub)),
cd AS (SELECT *, document_id || coalesce(suffix, '_' || pn) AS cid FROM po),
un AS (SELECT *, row_number() OVER (PARTITION BY document_id, cid ORDER BY position) - 1 AS again FROM cd),
ch AS (SELECT *, CASE WHEN again > 0 THEN cid || '_' || again ELSE cid END AS chunk_id FROM un)"""


def order_blocks(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda name, value: F.struct(F.lit(name).alias("col"), value.alias("val"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("label"), F.array("l_returnflag").alias("group_path"), F.array(cell("quantity", F.col("l_quantity").cast("int").cast("string")), cell("status", F.col("l_linestatus"))).alias("cells"))
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["label"].alias("label"), x["group_path"].alias("group_path"), x["cells"].alias("cells"))).alias("rows"))
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (key % 6 + 1).cast("int"))
    return read(spark, d, "orders").join(lines, "o_orderkey", "left").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("document_id"), key.cast("int").alias("block_seq"), F.array(F.lit("Main"), F.when(key % 7 == 0, "Funding").otherwise("Orders")).alias("section_path"),
        kind.alias("block_type"), F.when(key % 4 != 0, F.concat(F.lit("o"), (key % 3).cast("string"))).alias("source_id"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("Order "), key.cast("string"))).alias("label"),
        F.col("o_orderpriority").alias("content"), F.array(F.lit("quantity"), F.lit("status")).alias("columns"), "rows",
        F.when((key % 2 == 0) & (kind == "table"), F.array(F.struct(F.lit("a").alias("marker"), F.col("o_orderpriority").alias("text")))).alias("footnotes"), F.array().cast("array<string>").alias("refs"),
    )


@query("block_chunks", f"WITH {BLOCKS_SQL} SELECT chunk_id, document_id, CAST(position AS INTEGER) AS position, chunk_type, text, obj AS object_id, chunk_type NOT IN ('reference', 'administrative') AS retrieval_eligible FROM ch")
def block_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ck.chunk(order_blocks(spark, d)).select("chunk_id", "document_id", "position", "chunk_type", "text", "object_id", "retrieval_eligible")


@query("table_chunks", f"""WITH {BLOCKS_SQL}, h AS (SELECT document_id, block_seq, chunk_id AS parent_id FROM ch WHERE chunk_type = 'table_summary')
SELECT chunk_id, CASE WHEN chunk_type <> 'table_summary' THEN parent_id END AS parent_id,
  prefix || chr(10) || chr(10) || 'Main > Orders' || chr(10) || chr(10) || text AS embedding_text FROM ch JOIN h USING (document_id, block_seq) WHERE chunk_type LIKE 'table%'""")
def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ck.chunk(order_blocks(spark, d)).where("chunk_type like 'table%'").select("chunk_id", "parent_id", "embedding_text")


@query("coverage_audit", f"""WITH {BLOCKS_SQL}, t AS (SELECT document_id, chunk_type, count(*) AS n FROM ch GROUP BY ALL),
s AS (SELECT document_id, count(*) AS source_blocks FROM bl GROUP BY document_id)
SELECT document_id, source_blocks, source_blocks AS consumed, 0 AS unhandled, CAST(sum(n) AS BIGINT) AS chunks, CAST(coalesce(sum(n) FILTER (chunk_type NOT IN ('reference', 'administrative')), 0) AS BIGINT) AS retrieval_eligible, CAST(1 AS DOUBLE) AS coverage
FROM s JOIN t USING (document_id) GROUP BY document_id, source_blocks""")
def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    blocks = order_blocks(spark, d)
    return ck.coverage(blocks, ck.chunk(blocks)).drop("chunks_by_type")


@query("table_coverage_audit", f"WITH {BLOCKS_SQL} SELECT document_id, block_seq, len(rs) AS rows_source, len(rs) AS rows_chunks, true AS footnotes_preserved, true AS passes FROM ob WHERE route = 'table'")
def table_coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    blocks = order_blocks(spark, d)
    return ck.table_coverage(blocks, ck.chunk(blocks))
