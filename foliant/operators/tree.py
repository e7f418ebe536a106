"""Document trees as adjacency tables (paper_id, node_id, parent_id, node_type, title, text, chunk_ids, preorder, last_preorder)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.session import cut


# What each part of a node counts.
@dataclass(frozen=True)
class NavigationWeights:
    title: float = 2.6
    text: float = 1.0
    table: float = 0.45
    figure: float = 0.30
    # How likely a section of this kind holds evidence.
    sections: tuple[tuple[str, float], ...] = (("abstract", 0.15), ("introduction", 0.05), ("methods", 0.08), ("results", 0.20), ("discussion", 0.12), ("conclusion", 0.08))
    least: float = 0.05
    top: int = 8


def ancestors(nodes: DataFrame) -> DataFrame:
    """(paper_id, node_id, ancestor_id, steps), a node itself included: each round joins every open path with the parent of its last
    node, so the work is nodes times depth. A path that would meet a node again ends there."""
    links = nodes.select("paper_id", F.col("node_id").alias("at"), "parent_id")
    front = nodes.select("paper_id", "node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("steps"), F.col("parent_id").alias("at"), F.array("node_id").alias("path"))
    columns = ["paper_id", "node_id", "ancestor_id", "steps"]
    found = front.select(*columns)
    while True:
        front = cut(
            front.where(F.col("at").isNotNull() & ~F.array_contains("path", F.col("at"))).join(links, ["paper_id", "at"])
            .select("paper_id", "node_id", F.col("at").alias("ancestor_id"), (F.col("steps") + 1).alias("steps"), F.col("parent_id").alias("at"), F.concat("path", F.array("at")).alias("path"))
        )
        if front.isEmpty():
            return found
        found = found.unionByName(front.select(*columns))


def intervals(nodes: DataFrame) -> DataFrame:
    """(paper_id, node_id, ancestor_id), a node itself included, from preorder intervals: one sort of each paper's nodes and a stack of
    those that are open, so the work is that of the result. Nodes are (paper_id, node_id, preorder, last_preorder) of sound trees."""
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in ("paper_id", "node_id")}
    rows = nodes.select("paper_id", "node_id", "preorder", "last_preorder").repartition("paper_id").sortWithinPartitions("paper_id", "preorder", F.desc("last_preorder"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paper, stack = None, []
        for batch in batches:
            of, node, above = [], [], []
            for p, n, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != paper:
                    paper, stack = p, []
                while stack and stack[-1][1] < begin:
                    stack.pop()
                stack.append((n, end))
                of += [p] * len(stack)
                node += [n] * len(stack)
                above += [x for x, _ in stack]
                if len(of) >= 65_536:
                    yield _pairs(batch, of, node, above)
                    of, node, above = [], [], []
            if of:
                yield _pairs(batch, of, node, above)

    return rows.mapInArrow(run, f"paper_id {kinds['paper_id']}, node_id {kinds['node_id']}, ancestor_id {kinds['node_id']}")


def _pairs(batch: pa.RecordBatch, of: list, node: list, above: list) -> pa.RecordBatch:
    paper, name = batch.schema.field(0).type, batch.schema.field(1).type
    return pa.RecordBatch.from_arrays([pa.array(of, paper), pa.array(node, name), pa.array(above, name)], names=["paper_id", "node_id", "ancestor_id"])


def descendants(nodes: DataFrame) -> DataFrame:
    """(paper_id, node_id, descendant_id), a node included: by intervals where nodes have them, else by rounds of joins."""
    above = intervals(nodes) if {"preorder", "last_preorder"} <= set(nodes.columns) else ancestors(nodes)
    return above.select("paper_id", F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("descendant_id"))


def chunk_rollup(nodes: DataFrame) -> DataFrame:
    """(paper_id, node_id, chunk_ids): all chunks of a node and of what is below it."""
    held = nodes.select("paper_id", F.col("node_id").alias("descendant_id"), F.explode("chunk_ids").alias("chunk_id"))
    return descendants(nodes).join(held, ["paper_id", "descendant_id"]).groupBy("paper_id", "node_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))


def leaves(nodes: DataFrame) -> DataFrame:
    parents = nodes.select("paper_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct()
    return nodes.join(parents, ["paper_id", "node_id"], "left_anti")


def audit(nodes: DataFrame, types: set[str], chunks: DataFrame | None = None, ends: tuple[str, ...] = ("paragraph", "table_row", "table_footnote", "reference")) -> DataFrame:
    """(paper_id, code, n): what is wrong with a tree; a sound one has no rows. With chunks(paper_id, chunk_id) the nodes' chunks are
    checked too."""
    by = lambda rows, code: rows.groupBy("paper_id").agg(F.count("*").alias("n")).select("paper_id", F.lit(code).alias("code"), "n")
    top = nodes.groupBy("paper_id").agg(F.count_if(F.col("parent_id").isNull()).alias("n")).where("n <> 1").select("paper_id", F.lit("ROOTS").alias("code"), "n")
    known = nodes.select("paper_id", F.col("node_id").alias("parent_id")).distinct()
    parent = nodes.select("paper_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("_type"), F.col("preorder").alias("_from"), F.col("last_preorder").alias("_to"))
    both = nodes.where("parent_id is not null").join(parent, ["paper_id", "parent_id"])
    inner = nodes.select("paper_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct()
    found = [
        top,
        by(nodes.where("parent_id is not null").join(known, ["paper_id", "parent_id"], "left_anti"), "PARENT"),
        by(nodes.groupBy("paper_id", "node_id").count().where("count > 1"), "DUPLICATE"),
        by(nodes.where(~F.col("node_type").isin(*sorted(types))), "TYPE"),
        by(nodes.where("parent_id is null and node_type <> 'document'"), "ROOT_TYPE"),
        by(nodes.where("parent_id is not null and node_type = 'document'"), "INNER_DOCUMENT"),
        by(nodes.where("parent_id = node_id"), "SELF"),
        by(both.where("not (preorder > _from and last_preorder <= _to)"), "ORDER"),
        by(nodes.where("last_preorder < preorder"), "INTERVAL"),
        by(nodes.groupBy("paper_id", "preorder").count().where("count > 1"), "PREORDER"),
        by(both.where(F.col("_type").isin(*ends)), "END_WITH_CHILD"),
        by(nodes.where("node_type = 'section' and trim(coalesce(title, '')) = ''"), "TITLE"),
        by(nodes.where(F.col("node_type").isin(*ends) & (F.trim(F.coalesce("text", F.lit(""))) == "")).join(inner, ["paper_id", "node_id"], "left_anti"), "EMPTY_END"),
        by(nodes.select("paper_id", "node_id").join(reachable(nodes).select("paper_id", "node_id"), ["paper_id", "node_id"], "left_anti"), "UNREACHABLE"),
    ]
    if chunks is not None:
        held = nodes.select("paper_id", F.explode("chunk_ids").alias("chunk_id"))
        found += [by(held.join(chunks.select("paper_id", "chunk_id"), ["paper_id", "chunk_id"], "left_anti"), "CHUNK"), by(held.groupBy("paper_id", "chunk_id").count().where("count > 1"), "CHUNK_TWICE")]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def reachable(nodes: DataFrame) -> DataFrame:
    """(paper_id, node_id, depth) of what hangs on a root; others are cut off or in a cycle. Each node knows how far above it an ancestor is, and
    takes over what that ancestor knows: every round doubles the distance, so there are as many as the depth has binary digits."""
    most = nodes.groupBy("paper_id").count().agg(F.max("count")).first()[0] or 0
    state = nodes.select("paper_id", "node_id", F.col("parent_id").alias("at"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("steps")).distinct()
    done = state.where("at is null").drop("at")
    open_ = state.where("at is not null")
    for _ in range(most.bit_length() + 1):
        known = done.select("paper_id", F.col("node_id").alias("at"), F.lit(None).cast("string").alias("next"), F.col("steps").alias("more"))
        known = known.unionByName(open_.select("paper_id", F.col("node_id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more")))
        state = cut(open_.join(known, ["paper_id", "at"]).select("paper_id", "node_id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps")).distinct())
        done, open_ = done.unionByName(state.where("at is null").drop("at")), state.where("at is not null")
        if open_.isEmpty():
            break
    return done.groupBy("paper_id", "node_id").agg(F.min("steps").alias("depth"))


def _overlap(words: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(F.lit(0.0))


def navigate(nodes: DataFrame, queries: DataFrame, w: NavigationWeights = NavigationWeights()) -> DataFrame:
    """(paper_id, query_id, node_id, score, relevance, place): the best nodes of each paper for queries(paper_id, query_id,
    text). Words count where they occur inside others."""
    asked = queries.select("paper_id", "query_id", F.array_distinct(F.filter(tokens(F.col("text")), lambda t: F.length(t) > 2)).alias("_words"))
    rows = nodes.join(asked, "paper_id")
    title = F.lower(F.concat_ws(" ", "breadcrumb", "title"))
    prior = F.lit(0.0)
    for name, value in w.sections:
        prior = prior + F.when(F.contains(title, F.lit(name)), value).otherwise(0.0)
    score = w.title * _overlap(F.col("_words"), title) + w.text * _overlap(F.col("_words"), F.substring("text", 1, 400)) + prior
    score = score + F.when(F.col("node_type") == "table", w.table).when(F.col("node_type") == "figure", w.figure).otherwise(0.0)
    by = Window.partitionBy("paper_id", "query_id")
    scored = rows.withColumn("score", score).where(F.col("score") >= w.least)
    scored = scored.withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "node_id"))).withColumn("relevance", F.least(F.lit(1.0), F.col("score") / F.max("score").over(by)))
    return scored.where(F.col("place") <= w.top).select("paper_id", "query_id", "node_id", "score", "relevance", "place")


def descend(nodes: DataFrame, queries: DataFrame, beam: int = 3, most: int = 8) -> DataFrame:
    """(paper_id, query_id, node_id, level, score, place): the leaves that a search from the root reaches when it follows, level by level, only the beam
    best children of a paper for each of queries(query_id, text); the best most of them. A branch scores twice the share of the query's terms that occur in
    its path, titles and first words, its own or those below it, and a table 0.6, a place in the results 0.25 more; ties go to the smaller
    id. Rounds are as many as a tree is deep; nodes come with preorder intervals."""
    asked = F.broadcast(queries.select("query_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("terms")).where(F.size("terms") > 0))
    seen = F.lower(F.concat_ws(" ", "breadcrumb", "title", F.substring("text", 1, 120)))
    words = nodes.select("paper_id", "node_id", F.array_distinct(F.regexp_extract_all(seen, F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("words"))
    # only the terms that are asked for go up, and each once for a branch
    hits = words.join(asked.select(F.explode("terms").alias("term")).distinct().groupBy().agg(F.collect_set("term").alias("every"))).select("paper_id", "node_id", F.explode(F.array_intersect("words", "every")).alias("term"))
    held = intervals(nodes).join(hits, ["paper_id", "node_id"]).groupBy("paper_id", F.col("ancestor_id").alias("node_id")).agg(F.collect_set("term").alias("held"))
    path = F.lower(F.coalesce("breadcrumb", F.lit("")))
    own = nodes.join(held, ["paper_id", "node_id"], "left").select(
        "paper_id", "node_id", "parent_id", F.coalesce("held", F.array().cast("array<string>")).alias("held"),
        (F.when(F.col("node_type") == "table", 0.6).otherwise(0.0) + F.when(F.contains(path, F.lit("results")), 0.25).otherwise(0.0)).alias("bonus"),
    )
    own = cut(own)
    inner = own.where("parent_id is not null").select("paper_id", F.col("parent_id").alias("node_id")).distinct()
    front = own.where("parent_id is null").select("paper_id", "node_id").join(asked)
    by = Window.partitionBy("paper_id", "query_id")
    reached, level = None, 0
    while True:
        level += 1
        children = front.select("paper_id", F.col("node_id").alias("parent_id"), "query_id", "terms").join(own, ["paper_id", "parent_id"])
        scored = children.withColumn("score", 2.0 * F.size(F.array_intersect("terms", "held")) / F.size("terms") + F.col("bonus")).where("score > 0")
        best = scored.withColumn("n", F.row_number().over(by.orderBy(F.desc("score"), "node_id"))).where(F.col("n") <= beam)
        kept = cut(best.select("paper_id", "query_id", "node_id", "terms", "score").join(inner.withColumn("inner", F.lit(True)), ["paper_id", "node_id"], "left"))
        ends = kept.where("inner is null").select("paper_id", "query_id", "node_id", F.lit(level).alias("level"), "score")
        reached = ends if reached is None else reached.unionByName(ends)
        front = kept.where("inner")
        if front.isEmpty():
            break
    return reached.withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "node_id"))).where(F.col("place") <= most)
