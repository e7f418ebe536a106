"""From a question to its evidence: plan, hybrid retrieval, selected papers, search inside them, scored candidates, greedy choice,
repair of what is left open, coverage and a report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import detect_fields
from foliant.models.plugins import Encoder, Scorer, encode
from foliant.operators import docindex, evidence, fusion, hybrid, lexical, papers, repair, report, structure, tree
from foliant.plans import planner
from foliant.session import cut


@dataclass
class Corpus:
    """chunks(chunk_id, paper_id, text, chunk_type, section, subsection, breadcrumb, position, table_id, figure_id), their index, and
    vectors(chunk_id, embedding) where an encoder asks for them."""

    chunks: DataFrame
    index: lexical.LexicalIndex
    vectors: DataFrame | None = None

    @staticmethod
    def of(chunks: DataFrame, encoder: Callable[[], Encoder] | None = None) -> Corpus:
        vectors = encode(chunks, F.col("text"), encoder, "embedding").select("chunk_id", "embedding") if encoder else None
        return Corpus(chunks, lexical.build(chunks), vectors)


@dataclass
class Answer:
    plan: planner.Plan
    papers: DataFrame
    candidates: DataFrame
    evidence: DataFrame
    coverage: DataFrame

    def markdown(self) -> str:
        return report.evidence_markdown(self.plan.question, self.evidence, self.coverage)


def _nodes(structured: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk as a node that navigation can choose."""
    rows = structured.join(chunks.select("chunk_id", "text"), "chunk_id")
    return rows.select("paper_id", F.col("chunk_id").alias("node_id"), "node_type", F.lit("").alias("title"), F.array_join("breadcrumb", " > ").alias("breadcrumb"), "text", F.array("chunk_id").alias("chunk_ids"))


def _with_tables(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows with the context that each chunk of a table stands in: a row's own neighbours; null for others."""
    return rows.join(structure.table_context(chunks).select("chunk_id", F.col("context").alias("context_text")), "chunk_id", "left")


@dataclass
class _Search:
    """What searches inside the selected papers share."""

    corpus: Corpus
    structured: DataFrame
    chosen: DataFrame
    scorer: Callable[[], Scorer] | None
    weights: evidence.Scoring

    def judge(self, requirements: DataFrame, queries: DataFrame, depths: hybrid.Depths) -> DataFrame:
        """Scored candidates for requirements from queries(query_id, requirement_id, text, and vector) inside the papers; a row for each requirement
        and chunk."""
        corpus, of_paper = self.corpus, self.structured.select("chunk_id", "paper_id")
        papers_ = F.broadcast(self.chosen.select("paper_id"))
        inside = self.structured.join(papers_, "paper_id", "left_semi")
        bridge, asked = queries.select("query_id", "requirement_id"), queries.drop("requirement_id")
        pairs = self.chosen.select("paper_id").join(F.broadcast(asked.select("query_id")))
        merged = cut(hybrid.merge_variants(hybrid.local_search(corpus.index, asked, pairs, of_paper, corpus.vectors, depths), bridge))
        goals = requirements.select(F.col("requirement_id").alias("query_id"), F.col("objective").alias("text")).join(papers_)
        seen = tree.navigate(_nodes(inside, corpus.chunks), goals).join(of_paper.withColumnRenamed("chunk_id", "node_id"), ["paper_id", "node_id"])
        navigation = hybrid.navigation_by_chunk(seen.select(F.col("query_id").alias("requirement_id"), "paper_id", "node_id", "relevance", F.lit("structure").alias("reason"), F.array("node_id").alias("chunk_ids")))
        found = hybrid.candidates(merged, navigation, inside, corpus.chunks, requirements, depths)
        scored = hybrid.rerank(_with_tables(found, corpus.chunks.join(papers_, "paper_id", "left_semi")), requirements, self.scorer, depths.pairs)
        one = lambda c: F.array_compact(F.array(F.nullif(c, F.lit("")))).alias(f"{c}s")
        needs = requirements.select("requirement_id", "focus", "evidence_types", "concepts", one("condition"), one("target"), one("outcome"), one("population"), F.col("fields").alias("requested"), F.col("forms").alias("generics"), "confusables", "competing")
        rows = scored.join(F.broadcast(needs), "requirement_id").join(F.broadcast(self.chosen.select("paper_id", F.col("score").alias("paper"))), "paper_id").withColumns({
            "chunk_type": F.col("node_type"), "type_match": evidence.type_match(F.col("focus"), F.col("node_type"), F.col("section"), F.col("evidence_types")), "fields": detect_fields(F.coalesce("context_text", "text")),
        })
        return cut(evidence.score(rows, self.weights).withColumn("question_id", F.lit("q")))


#: Searches for what is left open, and how much deeper than the one before each goes.
REPAIRS, WIDER = 2, 2


def _focused(requirements: list[planner.Requirement], again: int) -> list[tuple[str, str, str]]:
    """(query_id, requirement_id, text): new queries for open requirements: what to find and where, its names and fields alone, each name
    of its condition with its population."""
    out = []
    for r in requirements:
        texts = [r.objective(), r.search_text(), " ".join([*r.concepts, *r.fields]), *(f"{name} {r.population}" for name in r.forms())]
        known = {text.lower() for _, text in r.variants}
        fresh = [t for t in dict.fromkeys(" ".join(t.split()) for t in texts) if t and t.lower() not in known]
        out += [(f"r{again}_{r.requirement_id}_{k}", r.requirement_id, t) for k, t in enumerate(fresh)]
    return out


def answer(spark: SparkSession, question: str, corpus: Corpus, encoder: Callable[[], Encoder] | None = None, scorer: Callable[[], Scorer] | None = None, config: planner.PlanConfig = planner.PlanConfig(), weights: evidence.Scoring = evidence.Scoring(), slots: int = evidence.GreedyWeights.slots) -> Answer:
    """The evidence for a question. Requirements that the selection leaves open are searched for again in the selected papers, by queries of
    their own and deeper lists; what is found enters without losing what is covered. Tables on the way that several steps read are written
    once: they are as small as the lists' depths make them."""
    plan = planner.plan(question, config)
    requirements, queries = plan.frames(spark)
    with_vectors = lambda rows: encode(rows, F.col("text"), encoder) if encoder else rows
    asked = with_vectors(queries.select("query_id", "requirement_id", "text"))
    structured = docindex.structure_of(corpus.chunks)
    fused = cut(fusion.rrf(hybrid.retrieve(corpus.index, asked.drop("requirement_id"), corpus.vectors)).join(structured.select("chunk_id", "paper_id", "section", "node_type"), "chunk_id"))
    chosen = cut(papers.select(papers.score_per_query(fused), queries.select("query_id", "requirement_id")))
    inside = _Search(corpus, structured, chosen, scorer, weights)

    depths = hybrid.Depths()
    judged = inside.judge(requirements, asked, depths)
    united = evidence.merge(judged)
    greedy = evidence.select_greedily(united, len(plan.requirements), replace(evidence.GreedyWeights(), slots=slots)).join(united.select("chunk_id", "final"), "chunk_id")
    picked = cut(greedy.select("question_id", "chunk_id", "final", "covers", "place"))
    selected, needed = picked.drop("place"), requirements.select(F.lit("q").alias("question_id"), "requirement_id")
    rows = ["question_id", "chunk_id", "final", "covers"]
    for again in range(REPAIRS):
        selected = cut(repair.repair(selected, united.select(*rows), needed, slots))
        left = {r["requirement_id"] for r in repair.open_requirements(selected, needed).collect()}
        more = _focused([r for r in plan.requirements if r.requirement_id in left], again)
        if not more:
            break
        depths = depths.wider(WIDER)
        again_asked = with_vectors(spark.createDataFrame(more, "query_id string, requirement_id string, text string"))
        found = inside.judge(requirements.where(F.col("requirement_id").isin(*left)), again_asked, depths)
        judged = judged.unionByName(found)
        united = evidence.merge(judged)
    selected = cut(repair.repair(selected, united.select(*rows), needed, slots))
    last = selected.join(structured.select("chunk_id", "paper_id"), "chunk_id").join(picked.select("chunk_id", "place"), "chunk_id", "left").join(corpus.chunks.select("chunk_id", "text"), "chunk_id")
    last = cut(last.select("chunk_id", "paper_id", F.coalesce("place", F.lit(2**30)).alias("place"), "final", "covers", "text"))
    return Answer(plan, chosen, judged, last, evidence.coverage(requirements, last))
