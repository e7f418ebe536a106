"""Hybrid retrieval: all queries of a plan over the whole corpus, then inside selected papers, up to scored candidates.

Queries and requirements are few and broadcast; chunks are read in place. Nothing loops over papers or queries: a (paper,
query) pair is a key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import vector as vec
from foliant.functions.text import tokens
from foliant.models.plugins import Scorer, score_pairs
from foliant.operators import dense, docindex, fusion, lexical
from foliant.operators.fusion import diversify


@dataclass(frozen=True)
class Depths:
    """How deep each list goes."""

    lexical: int = 100
    dense: int = 100
    local_lexical: int = 40
    local_dense: int = 60
    variant: int = 20
    anchors: int = 8
    nav_anchors: int = 6
    boosted_tables: int = 2
    boosted_figures: int = 1
    boosted: int = 3
    rrf_k: int = 60
    pairs: int = 150

    def wider(self, times: int) -> Depths:
        """Every list that many times as deep."""
        return Depths(**{f.name: getattr(self, f.name) * (1 if f.name == "rrf_k" else times) for f in fields(self)})


def retrieve(index: lexical.LexicalIndex, queries: DataFrame, vectors: DataFrame | None = None, d: Depths = Depths(), digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, method, score, rank): both lists of queries(query_id, text, and vector if there are vectors(chunk_id,
    embedding)). Queries of equal text are searched once. Without vectors only BM25 answers."""
    asked = queries.withColumn("asked", F.min("query_id").over(Window.partitionBy("text")))
    once = asked.where("query_id = asked").drop("asked")
    found = lexical.search(index, once, d.lexical, zero_fill=False, digits=digits).select("query_id", "chunk_id", F.lit("bm25").alias("method"), "score", "rank")
    if vectors is not None and "vector" in queries.columns:
        near = dense.search(vectors, once, d.dense, id_col="chunk_id", digits=digits)
        found = found.unionByName(near.select("query_id", F.col("id").alias("chunk_id"), F.lit("dense").alias("method"), "score", "rank"))
    return found.withColumnRenamed("query_id", "asked").join(F.broadcast(asked.select("asked", "query_id")), "asked").select("query_id", "chunk_id", "method", "score", "rank")


def papers_by_requirement(fused: DataFrame, bridge: DataFrame, papers: DataFrame) -> DataFrame:
    """(requirement_id, paper_id, place): the papers that a requirement's queries hit, in fused order."""
    hit = fused.join(F.broadcast(bridge), "query_id").join(papers, "chunk_id")
    first = hit.groupBy("requirement_id", "paper_id").agg(F.min("rank").alias("best"), F.max("rrf_score").alias("score"))
    place = F.row_number().over(Window.partitionBy("requirement_id").orderBy("best", F.desc("score"), "paper_id"))
    return first.select("requirement_id", "paper_id", place.alias("place"))


def local_search(index: lexical.LexicalIndex, queries: DataFrame, pairs: DataFrame, papers: DataFrame, vectors: DataFrame | None = None, d: Depths = Depths(), digits: int | None = None) -> DataFrame:
    """(paper_id, query_id, chunk_id, rrf_score, methods, rank): each query of pairs(paper_id, query_id) inside its paper, by the whole
    corpus' statistics; papers(paper_id, chunk_id). At most d.variant chunks of a pair."""
    inside = papers.join(F.broadcast(pairs), "paper_id").select("query_id", "chunk_id", "paper_id")
    scored = lexical.score(index, queries.join(F.broadcast(pairs.select("query_id").distinct()), "query_id", "left_semi"), scope=inside.select("query_id", "chunk_id"))
    rounded = lambda c: F.round(c, digits) if digits is not None else c
    scored = inside.join(scored, ["query_id", "chunk_id"], "left").withColumn("score", rounded(F.coalesce("score", F.lit(0.0))))
    ranked = lambda rows, k: rows.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id", "query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= k)
    lists = ranked(scored, d.local_lexical).withColumn("method", F.lit("bm25"))
    if vectors is not None and "vector" in queries.columns:
        near = inside.join(vectors.select("chunk_id", "embedding"), "chunk_id").join(F.broadcast(queries.select("query_id", "vector")), "query_id").withColumn("score", rounded(vec.cosine(F.col("vector"), F.col("embedding"))))
        lists = lists.unionByName(ranked(near.select("query_id", "chunk_id", "paper_id", "score"), d.local_dense).withColumn("method", F.lit("dense")))
    key = F.concat_ws("\u0001", "paper_id", "query_id")
    fused = fusion.rrf(lists.withColumn("_pair", key).select(F.col("_pair").alias("query_id"), "chunk_id", "method", "rank"), d.rrf_k, depth=d.variant, digits=digits)
    return fused.select(F.split_part("query_id", F.lit("\u0001"), F.lit(1)).alias("paper_id"), F.split_part("query_id", F.lit("\u0001"), F.lit(2)).alias("query_id"), "chunk_id", "rrf_score", "methods", "rank")


def merge_variants(local: DataFrame, bridge: DataFrame) -> DataFrame:
    """(requirement_id, paper_id, chunk_id, rrf_score, methods, variants, rank): a chunk's best score over the queries of a requirement,
    with every method and query that found it."""
    every = local.join(F.broadcast(bridge), "query_id")
    merged = every.groupBy("requirement_id", "paper_id", "chunk_id").agg(
        F.max("rrf_score").alias("rrf_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods")))).alias("methods"), F.array_sort(F.collect_set("query_id")).alias("variants")
    )
    place = F.row_number().over(Window.partitionBy("requirement_id", "paper_id").orderBy(F.desc("rrf_score"), "chunk_id"))
    return merged.withColumn("rank", place)


def navigation_by_chunk(hits: DataFrame) -> DataFrame:
    """(requirement_id, paper_id, chunk_id, relevance, node_ids, reasons): navigation hits (requirement_id, paper_id, node_id, relevance,
    reason, chunk_ids) gathered for each chunk."""
    each = hits.withColumn("chunk_id", F.explode("chunk_ids"))
    return each.groupBy("requirement_id", "paper_id", "chunk_id").agg(F.max("relevance").alias("relevance"), F.array_sort(F.collect_set("node_id")).alias("node_ids"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def anchors(merged: DataFrame, navigation: DataFrame, structure: DataFrame, requirements: DataFrame, d: Depths = Depths()) -> DataFrame:
    """(requirement_id, paper_id, chunk_id, anchor_order, origin): the first fused chunks, then the most relevant chunks that navigation
    adds, then tables and figures further down that a requirement prefers (requirements: requirement_id, focus, evidence_types)."""
    key = ["requirement_id", "paper_id"]
    typed = merged.join(structure.select("chunk_id", "node_type"), "chunk_id").join(F.broadcast(requirements.select("requirement_id", "focus", "evidence_types")), "requirement_id")
    lead = typed.where(F.col("rank") <= d.anchors).select(*key, "chunk_id", F.col("rank").cast("int").alias("n"), F.lit(0).alias("part"), F.lit("fused").alias("origin"))
    by_relevance = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("relevance"), "chunk_id"))
    added = navigation.join(lead.select(*key, "chunk_id"), [*key, "chunk_id"], "left_anti").withColumn("n", by_relevance).where(F.col("n") <= d.nav_anchors)
    added = added.select(*key, "chunk_id", F.col("n").cast("int").alias("n"), F.lit(1).alias("part"), F.lit("navigation").alias("origin"))
    known = lead.select(*key, "chunk_id").unionByName(added.select(*key, "chunk_id"))
    wants_table = F.arrays_overlap("evidence_types", F.array(*[F.lit(t) for t in docindex.TABLE_TYPES])) & F.col("node_type").isin("table_summary", "table_row")
    wants_figure = F.array_contains("evidence_types", "figure") & (F.col("focus") != "table_lookup") & (F.col("node_type") == "figure")
    more = typed.join(known, [*key, "chunk_id"], "left_anti").withColumn("kind", F.when(wants_table, "table").when(wants_figure, "figure")).where("kind is not null")
    more = more.withColumn("k", F.row_number().over(Window.partitionBy(*key, "kind").orderBy("rank"))).where(F.col("k") <= F.when(F.col("kind") == "table", d.boosted_tables).otherwise(d.boosted_figures))
    more = more.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("rank"))).where(F.col("n") <= d.boosted)
    more = more.select(*key, "chunk_id", F.col("n").cast("int").alias("n"), F.lit(2).alias("part"), F.lit("boosted").alias("origin"))
    order = F.row_number().over(Window.partitionBy(*key).orderBy("part", "n"))
    return lead.unionByName(added).unionByName(more).withColumn("anchor_order", order).select(*key, "chunk_id", "anchor_order", "origin")


def candidates(merged: DataFrame, navigation: DataFrame, structure: DataFrame, texts: DataFrame, requirements: DataFrame, d: Depths = Depths()) -> DataFrame:
    """What local search hands to scoring: every anchor and what it brings, with text, place, best local score and origin."""
    key = ["requirement_id", "paper_id"]
    chosen = anchors(merged, navigation, structure, requirements, d)
    wide = docindex.expand(structure, chosen, key)
    held = merged.select(*key, "chunk_id", "rrf_score", "methods", "variants", F.col("rank").alias("local_rank"))
    seen = navigation.select(*key, "chunk_id", "relevance", "node_ids")
    rows = wide.join(held, [*key, "chunk_id"], "left").join(seen, [*key, "chunk_id"], "left").join(structure.drop("paper_id", "tokens"), "chunk_id").join(texts.select("chunk_id", "text"), "chunk_id")
    none = F.array().cast("array<string>")
    return rows.withColumn("rrf_score", F.coalesce("rrf_score", F.lit(0.0))).withColumn("methods", F.array_union(F.coalesce("methods", none), F.when(F.col("relevance").isNotNull(), F.array(F.lit("navigation"))).otherwise(none)))


def passage(row: str = "") -> Column:
    """What a pair scorer reads of a candidate: section, kind, table or figure, and the table context or else the text."""
    c = lambda name: F.col(f"{row}.{name}" if row else name)
    given = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    content = F.when(F.coalesce(c("context_text"), F.lit("")) != "", c("context_text")).otherwise(c("text"))
    return F.concat_ws("\n", given("Section", F.array_join(c("breadcrumb"), " > ")), given("Type", c("node_type")), given("Table", c("table_id")), given("Figure", c("figure_id")), given("Passage", content))


def rerank(rows: DataFrame, requirements: DataFrame, make: Callable[[], Scorer] | None = None, most_pairs: int = Depths.pairs, digits: int | None = None) -> DataFrame:
    """rows(requirement_id, chunk_id, rrf_score and what passage() reads) with raw and encoder, the raw score between the least (0) and the
    largest (1) of its requirement. The best rows of each requirement are scored, most_pairs over all together; others have a raw score
    of 0. Without a scorer the raw score is the fused one."""
    scale = Window.partitionBy("requirement_id")
    if make is None:
        scored = rows.withColumn("raw", F.col("rrf_score"))
    else:
        n = F.broadcast(requirements.select(F.count_distinct("requirement_id").alias("_n")))
        place = F.row_number().over(Window.partitionBy("requirement_id").orderBy(F.desc("rrf_score"), "chunk_id"))
        asked = rows.join(n).withColumn("_in", place <= F.greatest(F.lit(1), F.floor(most_pairs / F.col("_n")))).join(F.broadcast(requirements.select("requirement_id", "rerank_text")), "requirement_id")
        inside = score_pairs(asked.where("_in"), F.col("rerank_text"), passage(), make, "raw")
        scored = inside.unionByName(asked.where("not _in").withColumn("raw", F.lit(0.0))).drop("_in", "_n", "rerank_text")
    if digits is not None:
        scored = scored.withColumn("raw", F.round("raw", digits))
    low, high = F.min("raw").over(scale), F.max("raw").over(scale)
    return scored.withColumn("encoder", F.when(high > low, (F.col("raw") - low) / (high - low)).otherwise(F.lit(0.0)))


# What kinds of evidence and statistics add to the first intent score.
TYPE_BONUS = {"table_summary": 0.10, "table_row": 0.07, "figure": 0.05}
RESULTS_BONUS, FIELD_BONUS, MOST_FIELDS, PHRASE_BONUS, MOST_PHRASES = 0.04, 0.05, 2, 0.05, 3
STATISTICS = (r"(?i)\b(?:percent|percentage|proportion|rate)\b", r"(?i)\bp-?values?\b|\bstatistically significant\b|confidence interval", r"(?i)\bodds ratio\b|\bhazard ratio\b|\brisk ratio\b")


def plain_words(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def intent_score(text: Column, node_type: Column, section: Column, asked: Column, phrases: Column) -> Column:
    """The share of the asked text's words that a chunk has, plus what its kind, statistics (two at most) and whole phrases (three at
    most) add, 1 at most."""
    own, wanted = F.array_distinct(tokens(text)), F.array_distinct(tokens(asked))
    share = F.when(F.size(wanted) > 0, F.size(F.array_intersect(own, wanted)) / F.size(wanted)).otherwise(F.lit(0.0))
    kind = F.lower(F.coalesce(node_type, F.lit("paragraph")))
    bonus = F.lit(0.0)
    for name, value in TYPE_BONUS.items():
        bonus = F.when(kind == name, F.lit(value)).otherwise(bonus)
    bonus = F.when((kind == "paragraph") & F.contains(F.lower(F.coalesce(section, F.lit(""))), F.lit("results")), F.lit(RESULTS_BONUS)).otherwise(bonus)
    fields = sum((F.coalesce(text, F.lit("")).rlike(p).cast("int") for p in STATISTICS), F.lit(0))
    flat = plain_words(text)
    found = F.size(F.filter(phrases, lambda p: (plain_words(p) != "") & F.contains(flat, plain_words(p))))
    return F.least(F.lit(1.0), share + bonus + FIELD_BONUS * F.least(fields, F.lit(MOST_FIELDS)) + PHRASE_BONUS * F.least(found, F.lit(MOST_PHRASES)))


def union_rerank_diversify(lists: dict[str, DataFrame], details: DataFrame, asked: DataFrame, keep: int = 60, most_per_paper: int = 2, top: int = 8) -> DataFrame:
    """(query_id, chunk_id, place): all lists' chunks once, scored by intent_score() against asked(query_id, text, phrases), the first keep of
    them, then at most most_per_paper of a paper until there are top; details(chunk_id, paper_id, text, node_type, section)."""
    every = None
    for method, rows in lists.items():
        part = rows.select("query_id", "chunk_id", F.lit(method).alias("method"))
        every = part if every is None else every.unionByName(part)
    once = every.groupBy("query_id", "chunk_id").agg(F.sort_array(F.collect_set("method")).alias("methods"))
    both = once.join(details, "chunk_id").join(F.broadcast(asked.select("query_id", F.col("text").alias("asked"), "phrases")), "query_id")
    scored = both.withColumn("intent", F.round(intent_score(F.col("text"), F.col("node_type"), F.col("section"), F.col("asked"), F.col("phrases")), 5))
    ranked = lexical.top_k(scored, keep, order="intent")
    return diversify(ranked, "paper_id", most_per_paper, top).select("query_id", "chunk_id", "place", "intent", "methods")
