"""Scans, filters, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import vector
from foliant.operators.audit import id_set_audit, orphans, vector_audit
from foliant.operators.fusion import keep_first
from foliant.queries import query, read
from foliant.sources.tables import eligible, last_write, with_schema


@query("scan_project_filter", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount > 0.05")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").where("l_shipdate >= timestamp'1995-01-01' and l_discount > 0.05").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("null_false_filter", "SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l USING (doc_id) WHERE coalesce(q = 1, false)")
def null_false_filter(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("retrieval_eligible"))
    return eligible(read(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")).select("doc_id")


@query("schema_cast_union", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_acctbal AS DOUBLE) AS balance, 'customer' AS kind FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL, 'supplier' FROM supplier")
def schema_cast_union(spark: SparkSession, d: str) -> DataFrame:
    schema = "id string, name string, balance double, kind string"
    one = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    two = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return with_schema(one, schema).unionByName(with_schema(two, schema))


@query("upsert_last_write", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_last_write(spark: SparkSession, d: str) -> DataFrame:
    return last_write(read(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("equality_filters", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def equality_filters(spark: SparkSession, d: str) -> DataFrame:
    from foliant.sources.tables import filtered

    return filtered(read(spark, d, "customer"), {"c_mktsegment", "c_nationkey"}, c_mktsegment="BUILDING", c_nationkey=7, c_name=None).select("c_custkey", "c_name")


@query("id_set_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def id_set_filter(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("group_min_size", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 10")
def group_min_size(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 10")


@query("trimmed_length_filter", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(trim(text)) > 40")
def trimmed_length_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").where("role = 'user' and length(trim(text)) > 40").select("conv_id", "turn")


@query("anti_join_orphans", "SELECT 'document' AS side, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'label', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def anti_join_orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id", "document", "label")


@query("id_set_audit", """
SELECT (SELECT count(*) FROM documents) AS n_left, (SELECT count(*) FROM labels) AS n_right,
       (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left,
       (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_right,
       (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)) AS duplicated_right""")
def id_audit(spark: SparkSession, d: str) -> DataFrame:
    return id_set_audit(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


@query("vector_audit", "SELECT label, count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_dimension, count(*) FILTER (list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x)))) AS not_finite, min(round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4)) AS least_norm FROM embeddings GROUP BY label")
def audit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vector_audit(read(spark, d, "embeddings"), "embedding", 64, "label")


@query("join_filtered_aggregate", """
SELECT n_name, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n_name""")
def join_filtered_aggregate(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").where("o_orderdate >= timestamp'1996-01-01'").select("o_custkey", "o_totalprice")
    customers = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("union_distinct_counts", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem")
def union_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))


@query("longest_per_group", "SELECT source, doc_id, n FROM (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS k FROM documents) WHERE k = 1")
def longest_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("source", "doc_id", F.length("text").cast("long").alias("n"))
    best = rows.groupBy("source").agg(F.max(F.struct("n", F.negative("doc_id").alias("m"))).alias("b"))
    return best.select("source", F.negative("b.m").alias("doc_id"), "b.n")


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('17:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    from foliant.operators.evaluate import sample

    return sample(read(spark, d, "documents").select("doc_id"), "doc_id", 50, seed=17)


@query("top_n_per_group", "SELECT c_mktsegment, c_custkey, CAST(k AS INTEGER) AS k FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 5")
def top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return read(spark, d, "customer").withColumn("k", F.row_number().over(w)).where("k <= 5").select("c_mktsegment", "c_custkey", "k")


@query("ordered_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def ordered_limit(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("running_window", "SELECT event_id, user_id, CAST(count(*) OVER w AS BIGINT) AS seen, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, d, "events").select("event_id", "user_id", F.count("*").over(w).alias("seen"), F.round(F.sum("value").over(w), 4).alias("total"))


@query("forward_fill_groups", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def forward_fill_groups(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, d, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_purchase"))


@query("keep_first_dedupe", "SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def keep_first_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return keep_first(read(spark, d, "events"), ["event_type", "user_id"], ["ts", "event_id"]).select("event_type", "user_id", "event_id")


@query("set_operations", """
SELECT 'both' AS kind, count(*) AS n FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)
UNION ALL SELECT 'first', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)
UNION ALL SELECT 'either', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem")
    flags = rows.groupBy("l_partkey").agg(F.max(F.col("l_quantity") > 45).alias("a"), F.max(F.col("l_discount") > 0.08).alias("b"))
    counts = flags.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("first"), F.count_if(F.col("a") | F.col("b")).alias("either"))
    return counts.select(F.expr("stack(3, 'both', both, 'first', first, 'either', either) as (kind, n)"))


@query("cube_rollup_sets", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup_sets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


@query("type_histogram_pivot", """
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""")
def type_histogram_pivot(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "purchase", "view")])


@query("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("position_range_join", """
SELECT a.conv_id, a.turn, CAST(count(*) AS BIGINT) AS near FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 AND b.turn <> a.turn GROUP BY a.conv_id, a.turn""")
def position_range_join(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-2, 2)
    rows = read(spark, d, "conversations").select("conv_id", "turn")
    return rows.withColumn("near", F.count("*").over(w) - F.count("*").over(Window.partitionBy("conv_id", "turn"))).where("near > 0")


@query("ordinal_zip_join", """
SELECT a.conv_id, a.k, a.turn AS user_turn, b.turn AS assistant_turn
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') a
JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant') b USING (conv_id, k)""")
def ordinal_zip_join(spark: SparkSession, d: str) -> DataFrame:
    from foliant.operators.structure import zip_by_order

    rows = read(spark, d, "conversations")
    one = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("user_turn"))
    two = rows.where("role = 'assistant'").select("conv_id", F.col("turn").alias("assistant_turn"))
    return zip_by_order(one, two, "conv_id", "user_turn", "assistant_turn").withColumn("k", F.col("k").cast("long"))


@query("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 5).alias("norm"))


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from foliant.streaming.ingest import windowed_counts

    return windowed_counts(read(spark, d, "events"))
