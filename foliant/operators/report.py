"""Reports of runs and retrieval experiments: recall of papers, requirements and chunks, summaries of methods, latency, levelled question
sets with a guard against leaks, and their Markdown."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import content_tokens, first_words, information, jaccard, ngrams, sentences, substitute_synonyms, tokens
from foliant.operators.evaluate import recall_at

# When a question gives its source away, how often another wording is tried, and how questions are framed.
LEAK_WORDS, LEAK_OVERLAP, TRIES = 7, 0.5, 6
FRAMES = ("What is reported about {0}?", "Which findings concern {0}?", "How is {0} described?", "What do the results say on {0}?", "What was observed for {0}?", "What is known of {0}?")
LEVELS = ("verbatim", "keywords", "paraphrase", "question")


def run_report(fused: DataFrame, selected: DataFrame, evidence: DataFrame, requirements: DataFrame, known_papers: DataFrame, known_chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by query, by requirement, totals). fused: query_id, paper_id, rank; selected: paper_id; evidence: chunk_id, covers, node_ids,
    table_context; requirements: requirement_id; known_papers: query_id, paper_id; known_chunks: requirement_id, chunk_id. A known paper is
    preserved if it is among the selected ones; without known papers the shares are 0."""
    ranked = fused.groupBy("query_id", F.col("paper_id").alias("item_id")).agg(F.min("rank").alias("r"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "item_id"))).drop("r")
    by_query = recall_at(ranked, known_papers.select("query_id", F.col("paper_id").alias("item_id")), (5, 10, 20))
    covered = evidence.select(F.explode("covers").alias("requirement_id"), "chunk_id")
    found = covered.groupBy("requirement_id").agg(F.count_distinct("chunk_id").alias("n"))
    final = evidence.select("chunk_id").distinct().withColumn("hit", F.lit(1))
    chunk = known_chunks.join(final, "chunk_id", "left").groupBy("requirement_id").agg((F.count("hit") / F.count("*")).alias("chunk_recall"))
    by_requirement = requirements.select("requirement_id").join(found, "requirement_id", "left").join(chunk, "requirement_id", "left")
    by_requirement = by_requirement.select("requirement_id", (F.coalesce("n", F.lit(0)) > 0).alias("covered"), F.coalesce("n", F.lit(0).cast("long")).alias("n_evidence"), F.round("chunk_recall", 4).alias("chunk_recall"))
    known = known_papers.select("paper_id").distinct().join(selected.select("paper_id").distinct().withColumn("in", F.lit(1)), "paper_id", "left")
    papers = known.agg(F.coalesce(F.round(F.count("in") / F.count("*"), 4), F.lit(0.0)).alias("final_paper_recall"), F.array_sort(F.collect_list(F.when(F.col("in") == 1, F.col("paper_id")))).alias("papers_found"), F.array_sort(F.collect_list(F.when(F.col("in").isNull(), F.col("paper_id")))).alias("papers_missing"))
    shares = by_requirement.agg(F.coalesce(F.round(F.count_if("covered") / F.count("*"), 4), F.lit(0.0)).alias("requirement_recall"))
    counts = evidence.agg(F.count("*").alias("n_evidence"), F.count_if(F.size("node_ids") > 0).alias("n_navigated"), F.count_if(F.coalesce("table_context", F.lit("")) != "").alias("n_with_table"))
    totals = papers.crossJoin(shares).crossJoin(counts).withColumn("papers_preserved", F.size("papers_missing") == 0)
    return by_query, by_requirement, totals


def compare_methods(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """(method, n, recall_k ..., mrr) over all queries of ranked(method, query_id, item_id, rank) and relevant(query_id, item_id)."""
    key = F.concat_ws("\u0001", "method", "query_id")
    asked = ranked.select("method").distinct().join(F.broadcast(relevant)).select(key.alias("query_id"), "item_id")
    each = recall_at(ranked.select(key.alias("query_id"), "item_id", "rank"), asked, ks).withColumn("method", F.split_part("query_id", F.lit("\u0001"), F.lit(1)))
    return each.groupBy("method").agg(F.count("*").alias("n"), *[F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in ks], F.round(F.avg("rr"), 6).alias("mrr"))


def worst_queries(metrics: DataFrame, metric: str, n: int = 10) -> DataFrame:
    return metrics.orderBy(metric, "query_id").limit(n)


def latency(run: Callable[[], DataFrame], times: int = 5) -> dict[str, float]:
    """Seconds of a plan, run several times: mean, median, worst."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    took.sort()
    return {"mean": sum(took) / len(took), "median": took[len(took) // 2], "worst": took[-1]}


def leaks(question: Column, source: Column) -> Column:
    """Whether a question gives its source away: seven words in a row, or half of the content words."""
    own, other = tokens(question), tokens(source)
    return F.arrays_overlap(ngrams(own, LEAK_WORDS), ngrams(other, LEAK_WORDS)) | (jaccard(content_tokens(question), content_tokens(source)) >= LEAK_OVERLAP)


def levelled_questions(chunks: DataFrame, synonyms: dict[str, str], words: int = 60) -> DataFrame:
    """(chunk_id, level, question, leaked): for chunks(chunk_id, text, keywords, phrases) its own words, its keywords, its most informative
    sentence with other words, and a question on a phrase of it: the first frame that gives nothing away, or else the keywords' question."""
    rows = chunks.withColumn("_s", sentences(F.col("text")))
    best = F.element_at(F.array_sort(F.transform("_s", lambda s, i: F.struct((-information(s)).alias("score"), i.alias("i"), s.alias("s")))), 1)["s"]
    rows = rows.withColumn("_best", F.when(F.size("_s") > 0, best).otherwise(F.col("text")))
    topic = F.coalesce(F.try_element_at("phrases", F.lit(1)), F.array_join(F.slice("keywords", 1, 3), " "))
    asked = F.array(*[F.concat(F.lit(f.split("{0}")[0]), topic, F.lit(f.split("{0}")[1])) for f in FRAMES[:TRIES]])
    safe = F.try_element_at(F.filter(asked, lambda q: ~leaks(q, F.col("text"))), F.lit(1))
    framed = F.concat(F.lit("What is said of "), F.array_join(F.slice("keywords", 1, 3), ", "), F.lit("?"))
    rows = rows.select(
        "chunk_id", "text", F.struct(first_words(F.col("text"), words).alias("verbatim"), F.array_join("keywords", " ").alias("keywords"), substitute_synonyms(F.col("_best"), synonyms).alias("paraphrase"), F.coalesce(safe, framed).alias("question")).alias("q")
    )
    each = F.array(*[F.struct(F.lit(level).alias("level"), F.col(f"q.{level}").alias("question")) for level in LEVELS])
    out = rows.select("chunk_id", "text", F.inline(each)).where("question <> ''")
    return out.select("chunk_id", "level", "question", F.when(F.col("level") == "verbatim", F.lit(True)).otherwise(leaks(F.col("question"), F.col("text"))).alias("leaked"))


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(show(r.get(c, "")) for c in columns) + " |" for r in rows)])


def benchmark_markdown(title: str, methods: DataFrame, worst: DataFrame, settings: dict[str, str]) -> str:
    """A report of an experiment; the tables in it have a row a method and the few worst queries."""
    parts = [f"# {title}", "\n".join(f"* {k}: {v}" for k, v in settings.items())]
    for name, rows in (("Methods", methods), ("Worst queries", worst)):
        parts += [f"## {name}", markdown_table([r.asDict() for r in rows.collect()], rows.columns)]
    return "\n\n".join(p for p in parts if p) + "\n"


def evidence_markdown(question: str, evidence: DataFrame, coverage: DataFrame, most: int = 1200) -> str:
    """A run's evidence in order of place (place, chunk_id, paper_id, covers, text) and what it covers."""
    parts = [f"# {question}", "## Coverage", markdown_table([r.asDict() for r in coverage.orderBy("requirement_id").collect()], coverage.columns), "## Evidence"]
    for r in evidence.orderBy("place").select("place", "chunk_id", "paper_id", "covers", "text").collect():
        text = r["text"] if len(r["text"]) <= most else r["text"][:most] + "…"
        parts.append(f"### {r['place']}. {r['paper_id']} · {r['chunk_id']}\n\nCovers: {', '.join(r['covers']) or '–'}\n\n{text}")
    return "\n\n".join(parts) + "\n"
