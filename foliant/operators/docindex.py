"""The structure of documents without their texts: lookups by document, section, table, figure and neighbourhood, as joins.

A structure table has paper_id, chunk_id, parent_id, node_type, section, subsection, position, table_id, figure_id,
breadcrumb and tokens; texts are joined to what is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import token_estimate
from foliant.operators.structure import token_budget
from foliant.sources.tables import with_schema

STRUCTURE = "chunk_id string, paper_id string, parent_id string, node_type string, section string, subsection string, breadcrumb array<string>, table_id string, figure_id string, position bigint, tokens bigint"
TABLE_TYPES = ("table_summary", "table_row", "table_footnotes")
# How much an anchor may bring with it.
MOST_NODES, MOST_TOKENS, MOST_TOTAL, NEIGHBOUR_WINDOW = 12, 2000, 12000, 1


def structure_of(chunks: DataFrame) -> DataFrame:
    """The structure of chunks (as foliant.operators.chunks gives them, or corpus rows); columns that are missing are null."""
    own = set(chunks.columns)
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in own], F.lit(None))
    table = first("table_id") if "table_id" in own else F.when(F.col("chunk_type").startswith("table"), first("object_id"))
    figure = first("figure_id") if "figure_id" in own else F.when(F.col("chunk_type") == "figure", first("object_id"))
    rows = chunks.withColumns({
        "chunk_id": first("chunk_id", "id"), "paper_id": first("paper_id", "document_id").cast("string"), "node_type": first("node_type", "chunk_type"), "table_id": table, "figure_id": figure,
        "position": first("position", "document_position"), "tokens": token_estimate(F.col("text")) if "text" in own else F.lit(0),
    })
    return with_schema(rows, STRUCTURE)


def load_structure(spark: SparkSession, path: str) -> DataFrame:
    """Only the structure columns are read from a corpus; texts stay in the files."""
    rows = spark.read.parquet(path)
    return structure_of(rows.drop("text", "embedding_text"))


def paper(structure: DataFrame, paper_id: str) -> DataFrame:
    """A document's nodes; the filter reaches the files."""
    return structure.where(F.col("paper_id") == paper_id)


def children(structure: DataFrame, ids: DataFrame) -> DataFrame:
    return structure.join(ids.select(F.col("chunk_id").alias("parent_id")), "parent_id", "left_semi")


def parents(structure: DataFrame, ids: DataFrame) -> DataFrame:
    own = structure.join(ids.select("chunk_id"), "chunk_id", "left_semi").select(F.col("parent_id").alias("chunk_id")).where("chunk_id is not null").distinct()
    return structure.join(own, "chunk_id", "left_semi")


def siblings(structure: DataFrame, ids: DataFrame) -> DataFrame:
    """(chunk_id, sibling_id): nodes of one kind in one place of a document."""
    place = ["paper_id", "section", "subsection", "node_type"]
    own = structure.join(ids.select("chunk_id"), "chunk_id", "left_semi")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in place]
    both = own.alias("a").join(structure.alias("b"), (same[0] & same[1] & same[2] & same[3]) & (F.col("a.chunk_id") != F.col("b.chunk_id")))
    return both.select(F.col("a.chunk_id").alias("chunk_id"), F.col("b.chunk_id").alias("sibling_id"))


def section(structure: DataFrame, paper_id: str, title: str) -> DataFrame:
    return paper(structure, paper_id).where(F.lower("section").contains(title.lower()) | F.lower("subsection").contains(title.lower())).orderBy("position")


def figure(structure: DataFrame, paper_id: str, figure_id: str) -> DataFrame:
    return paper(structure, paper_id).where((F.col("figure_id") == figure_id) & (F.col("node_type") == "figure"))


def table_key(chunk_id: Column, paper_id: Column, table_id: Column) -> Column:
    """The table of a chunk: its id, else what is before _summary, _row_n or _footnotes in the chunk's id, after the paper's."""
    named = F.regexp_extract(chunk_id, r"^(.+)_(?:summary|row_\d+|footnotes)$", 1)
    inside = F.when(named.startswith(F.concat(paper_id, F.lit("_"))), F.substring(named, F.length(paper_id) + 2, F.length(named)))
    return F.coalesce(table_id, inside)


def tables(structure: DataFrame) -> DataFrame:
    """(paper_id, table_id, members): summary, rows by position, footnotes."""
    rows = structure.where(F.col("node_type").isin(*TABLE_TYPES)).withColumn("table_id", table_key(F.col("chunk_id"), F.col("paper_id"), F.col("table_id"))).where("table_id is not null")
    kind = F.when(F.col("node_type") == "table_summary", 0).when(F.col("node_type") == "table_row", 1).otherwise(2)
    return rows.groupBy("paper_id", "table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(kind.alias("kind"), "position", "chunk_id"))), lambda x: x["chunk_id"]).alias("members"))


def neighbours(structure: DataFrame, n: int = NEIGHBOUR_WINDOW) -> DataFrame:
    """(chunk_id, neighbour_id, step): up to n nodes before and after in the same section and subsection, by one window."""
    w = Window.partitionBy("paper_id", "section", "subsection").orderBy("position", "chunk_id")
    near = F.array(*[F.struct(F.lit(k).alias("step"), (F.lead("chunk_id", k) if k > 0 else F.lag("chunk_id", -k)).over(w).alias("neighbour_id")) for k in range(-n, n + 1) if k])
    return structure.select("chunk_id", near.alias("near")).select("chunk_id", F.inline("near")).where("neighbour_id is not null")


def expand(structure: DataFrame, anchors: DataFrame, by: list[str], window: int = NEIGHBOUR_WINDOW, most_nodes: int = MOST_NODES, most_tokens: int = MOST_TOKENS, most_total: int = MOST_TOTAL) -> DataFrame:
    """(by, chunk_id, expanded_from, anchor_order, node_order, tokens) of anchors(by, chunk_id, anchor_order): the anchor, then its
    whole table, or the neighbours of a figure or paragraph. An anchor brings most_nodes nodes and most_tokens tokens at most,
    itself always; all anchors of a group together most_total; a node that several bring is kept where it comes first."""
    own = anchors.join(structure.drop(*by), "chunk_id").withColumn("table_id", F.when(F.col("node_type").isin(*TABLE_TYPES), table_key(F.col("chunk_id"), F.col("paper_id"), F.col("table_id"))))
    keys = [*by, "anchor_order"]
    self_rows = own.select(*keys, F.col("chunk_id").alias("anchor"), "chunk_id", F.lit(0).alias("node_order"))
    whole = own.join(tables(structure), ["paper_id", "table_id"]).select(*keys, F.col("chunk_id").alias("anchor"), F.posexplode("members").alias("k", "member"))
    whole = whole.where("member <> anchor").select(*keys, "anchor", F.col("member").alias("chunk_id"), (F.col("k") + 1).alias("node_order"))
    near = own.where(F.col("node_type").isin("figure", "paragraph")).join(neighbours(structure, window), "chunk_id")
    near = near.select(*keys, F.col("chunk_id").alias("anchor"), F.col("neighbour_id").alias("chunk_id"), (F.col("step") + window + 1).alias("node_order"))
    every = self_rows.unionByName(whole).unionByName(near).join(structure.select("chunk_id", "tokens"), "chunk_id")
    every = every.withColumn("_anchor", F.concat_ws("|", *by, F.col("anchor_order").cast("string")))
    kept = token_budget(every, "_anchor", "node_order", "tokens", most_nodes, most_tokens).drop("_anchor")
    order = Window.partitionBy(*by).orderBy("anchor_order", "node_order")
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "chunk_id").orderBy("anchor_order", "node_order"))).where("_n = 1").drop("_n")
    kept = kept.withColumn("_sum", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= most_total)
    return kept.select(*by, "chunk_id", F.when(F.col("anchor") != F.col("chunk_id"), F.col("anchor")).alias("expanded_from"), "anchor_order", "node_order", "tokens")


def counts_by_type(structure: DataFrame) -> DataFrame:
    """(paper_id, n, by_type, by_section)."""
    typed = structure.groupBy("paper_id", "node_type").agg(F.count("*").alias("n")).groupBy("paper_id").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_type", "n")))).alias("by_type"))
    placed = structure.groupBy("paper_id", F.coalesce("section", F.lit("")).alias("section")).agg(F.count("*").alias("n")).groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "n")))).alias("by_section"))
    return typed.join(placed, "paper_id")


def resolve(hits: DataFrame, store: DataFrame, corpus: DataFrame, columns: list[str]) -> DataFrame:
    """hits(chunk_id) with columns from the store, and from the corpus where the store does not have the chunk."""
    one = store.select("chunk_id", *[F.col(c).alias(f"_s_{c}") for c in columns], F.lit(True).alias("_in_store"))
    two = corpus.select("chunk_id", *[F.col(c).alias(f"_c_{c}") for c in columns])
    both = hits.join(one, "chunk_id", "left").join(two, "chunk_id", "left")
    return both.select(*hits.columns, *[F.when(F.col("_in_store"), F.col(f"_s_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in columns])
