"""Scoring of evidence for requirements, greedy selection and coverage."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import fraction_overlap, requested_fraction, tokens


# The weights, penalties and thresholds of the classes below.
@dataclass(frozen=True)
class IntentWeights:
    concept: float = 0.22
    condition: float = 0.18
    target: float = 0.12
    outcome: float = 0.10
    fields: float = 0.18
    type: float = 0.12
    population: float = 0.08


@dataclass(frozen=True)
class FinalWeights:
    encoder: float = 0.45
    match: float = 0.18
    type: float = 0.12
    fields: float = 0.12
    paper: float = 0.05
    diversity: float = 0.05


@dataclass(frozen=True)
class Penalties:
    target: float = 0.60
    population: float = 1.05
    weak_population: float = 0.30
    outcome: float = 0.30
    fields: float = 0.30
    confusable: float = 1.40
    generic: float = 0.50
    cap: float = 1.0


@dataclass(frozen=True)
class Thresholds:
    encoder: float = 0.30
    match: float = 0.35
    concept: float = 0.10


@dataclass(frozen=True)
class GreedyWeights:
    slots: int = 18
    requirement: float = 0.18
    type: float = 0.04
    paper: float = 0.04
    redundancy: float = 0.35
    soft_cap: int = 4


@dataclass(frozen=True)
class Scoring:
    intent: IntentWeights = field(default_factory=IntentWeights)
    final: FinalWeights = field(default_factory=FinalWeights)
    penalties: Penalties = field(default_factory=Penalties)
    thresholds: Thresholds = field(default_factory=Thresholds)
    table_factor: float = 1.25


# How much a kind of chunk counts for a focus, and what being a preferred kind adds; "results" is a paragraph of the
# Results section.
TYPE_BOOSTS = {
    "definition": {"paragraph": 0.15, "table_summary": 0.25, "table_row": 0.10},
    "numerical": {"table_row": 0.30, "table_summary": 0.20, "table_footnotes": 0.15, "figure": 0.15, "paragraph": 0.05, "results": 0.10},
    "comparative_numerical": {"table_row": 0.35, "table_summary": 0.25, "table_footnotes": 0.20, "results": 0.20, "paragraph": 0.08, "figure": 0.10},
    "mechanism": {"paragraph": 0.10, "figure": 0.20, "table_row": 0.05, "results": 0.10},
    "population": {"table_row": 0.20, "table_summary": 0.15, "paragraph": 0.10},
    "outcome": {"table_row": 0.20, "table_summary": 0.10, "figure": 0.15, "paragraph": 0.10},
    "treatment": {"table_row": 0.20, "table_summary": 0.15, "paragraph": 0.10},
    "comparison": {"table_row": 0.25, "table_summary": 0.15, "paragraph": 0.10},
    "diagnosis": {"table_row": 0.20, "table_summary": 0.25, "paragraph": 0.10},
    "table_lookup": {"table_row": 0.40, "table_summary": 0.30, "table_footnotes": 0.20},
    "figure_interpretation": {"figure": 0.40, "paragraph": 0.10},
}
PREFERRED_BOOST = 0.10


def type_match(focus: Column, kind: Column, section: Column, preferred: Column) -> Column:
    """How well a kind of chunk fits a focus, 1 at most."""
    boost = F.lit(0.0)
    for name, kinds in TYPE_BOOSTS.items():
        for k, value in kinds.items():
            boost = F.when((focus == name) & (kind == k), F.lit(value)).otherwise(boost)
    in_results = F.array_contains(preferred, "results") & (kind == "paragraph") & (F.lower(F.coalesce(section, F.lit(""))) == "results")
    return F.least(F.lit(1.0), boost + F.when(F.array_contains(preferred, kind) | in_results, F.lit(PREFERRED_BOOST)).otherwise(F.lit(0.0)))


def _given(terms: Column, value: Column) -> Column:
    """A slot that a requirement leaves open counts as met."""
    return F.when(F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0, value).otherwise(F.lit(1.0))


# Names that are taken for each other.
CONFUSABLE = (("inoca", "minoca"), ("non-diabetic", "diabetic"))


def confusable_names(names: list[str]) -> list[tuple[str, str]]:
    """(own, other) of the names that have one they are taken for."""
    pairs = [*CONFUSABLE, *((b, a) for a, b in CONFUSABLE)]
    return [pair for pair in pairs if pair[0] in {n.lower() for n in names}]


def confusable_parts(phrase: str) -> list[tuple[str, str]]:
    """(own, other) of the names that a phrase holds; one that is only part of its longer counterpart is not held."""
    low = phrase.lower()
    return [(a, b) for a, b in [*CONFUSABLE, *((b, a) for a, b in CONFUSABLE)] if a in (low.replace(b, " ") if a in b else low)]


def other_name(low: Column, own: Column, other: Column) -> Column:
    """Whether a text has the other name and nowhere its own, each where it is no part of the other."""
    apart = lambda name, longer: F.when(F.contains(longer, name), F.replace(low, longer, F.lit(" "))).otherwise(low)
    return F.contains(apart(other, own), other) & ~F.contains(apart(own, other), own)


def score(candidates: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """candidates with components, match, penalty, final score and covered.

    A candidate is a row (requirement, chunk) with text, chunk_type, encoder (0..1), paper (0..1), type_match (0..1), fields
    (detected), and the requirement's concepts, conditions, targets, outcomes, populations, requested and generics (all names of its condition) as arrays
    of terms, and confusables (of its names) and competing (of its population) as arrays of (own, other). Penalties: a text, not of a table, that has no word of
    the target; another population, or less than a quarter of its own one of several words; no outcome; few of the requested fields; a name
    that is taken for its own; and a text, not of a table, that has the condition and nothing else that is asked for."""
    w, f, p, t = scoring.intent, scoring.final, scoring.penalties, scoring.thresholds
    text = F.col("text")
    is_table = F.col("chunk_type").startswith("table")
    overlap = lambda c: fraction_overlap(F.col(c), text)
    low = F.lower(F.coalesce(text, F.lit("")))
    terms = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    said = lambda c: F.exists(terms(c), lambda x: F.contains(low, F.lower(x)))
    words_of = lambda c: F.flatten(F.transform(terms(c), lambda x: tokens(x)))
    taken_for = lambda c: F.coalesce(F.exists(F.col(c), lambda x: other_name(low, F.lower(x["own"]), F.lower(x["other"]))), F.lit(False))
    nothing_else = (F.size(terms("requested")) <= 0) & ~said("populations") & ~said("targets") & ~said("outcomes")
    fields = _given(F.col("requested"), requested_fraction(F.col("fields"), F.col("requested")))
    rows = candidates.withColumns(
        {
            "s_concept": overlap("concepts"), "s_condition": _given(F.col("conditions"), overlap("conditions")), "s_target": _given(F.col("targets"), overlap("targets")),
            "s_outcome": _given(F.col("outcomes"), overlap("outcomes")), "s_population": _given(F.col("populations"), overlap("populations")),
            "s_fields": F.when(is_table, F.least(F.lit(1.0), fields * scoring.table_factor)).otherwise(fields), "s_type": F.col("type_match"),
        }
    )
    total = w.concept + w.condition + w.target + w.outcome + w.fields + w.type + w.population
    match = (
        w.concept * F.col("s_concept") + w.condition * F.col("s_condition") + w.target * F.col("s_target") + w.outcome * F.col("s_outcome") + w.fields * F.col("s_fields")
        + w.type * F.col("s_type") + w.population * F.col("s_population")
    ) / total
    when = lambda cond, value: F.when(cond, F.lit(value)).otherwise(F.lit(0.0))
    penalty = (
        when(~is_table & (F.size(words_of("targets")) > 0) & (F.col("s_target") < 0.1) & ~F.arrays_overlap(words_of("targets"), tokens(text)), p.target)
        + F.when(taken_for("competing"), F.lit(p.population)).when((F.col("s_population") < 0.25) & (F.size(words_of("populations")) > 1), F.lit(p.weak_population)).otherwise(F.lit(0.0))
        + when(F.col("s_outcome") == 0, p.outcome) + when(F.col("s_fields") < 0.34, p.fields)
        + when(taken_for("confusables"), p.confusable) + when(~is_table & said("generics") & nothing_else, p.generic)
    )
    rows = rows.withColumn("match", match).withColumn("penalty", F.least(F.lit(p.cap), penalty))
    final = f.encoder * F.col("encoder") + f.match * F.col("match") + f.type * F.col("s_type") + f.fields * F.col("s_fields") + f.paper * F.col("paper") + f.diversity - F.col("penalty")
    covered = ((F.col("encoder") >= t.encoder) | (F.col("encoder") == 0)) & (F.col("match") >= t.match) & (F.col("s_concept") >= t.concept)
    return rows.withColumn("final", F.greatest(F.lit(0.0), final)).withColumn("covered", covered)


def merge(candidates: DataFrame) -> DataFrame:
    """One row a chunk: its best score and all requirements that it covers."""
    return candidates.groupBy("question_id", "chunk_id").agg(
        F.max("final").alias("final"), F.sort_array(F.collect_set(F.when(F.col("covered"), F.col("requirement_id")))).alias("covers"), F.min("paper_id").alias("paper_id"), F.min("chunk_type").alias("chunk_type")
    )


def pick_greedily(rows: list[dict], n_requirements: int, w: GreedyWeights = GreedyWeights()) -> Iterable[dict]:
    """Rows (chunk_id, final, covers, paper_id, chunk_type) in the order in which they add most: their score scaled to
    0..1, new requirements, a new type, a new paper, less what their paper has already."""
    scores = [r["final"] for r in rows]
    low, high = min(scores, default=0.0), max(scores, default=0.0)
    left = {r["chunk_id"]: r for r in rows}
    covered: set[str] = set()
    types: set[str] = set()
    papers: dict[str, int] = {}
    for place in range(1, w.slots + 1):
        best = None
        for r in left.values():
            gain = (r["final"] - low) / (high - low) if high > low else 0.0
            gain += w.requirement * len(set(r["covers"]) - covered) / max(1, n_requirements)
            gain += w.type * (r["chunk_type"] not in types) + w.paper * (r["paper_id"] not in papers)
            gain -= w.redundancy * min(1.0, papers.get(r["paper_id"], 0) / w.soft_cap)
            if best is None or (-gain, r["chunk_id"]) < best[0]:
                best = (-gain, r["chunk_id"]), r, gain
        if best is None:
            return
        r = left.pop(best[1]["chunk_id"])
        covered |= set(r["covers"])
        types.add(r["chunk_type"])
        papers[r["paper_id"]] = papers.get(r["paper_id"], 0) + 1
        yield {"chunk_id": r["chunk_id"], "place": place, "gain": best[2], "covers": list(r["covers"])}


def select_greedily(merged: DataFrame, n_requirements: int, w: GreedyWeights = GreedyWeights()) -> DataFrame:
    """(question_id, chunk_id, place, gain, covers): a question's evidence. Its candidates are a few hundred, cut by the pair
    budget before, so one task holds them."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        picked = list(pick_greedily(rows.to_dict("records"), n_requirements, w))
        return pd.DataFrame([{"question_id": key[0], **p} for p in picked], columns=["question_id", "chunk_id", "place", "gain", "covers"])

    return merged.groupBy("question_id").applyInPandas(run, "question_id string, chunk_id string, place int, gain double, covers array<string>")


def coverage(requirements: DataFrame, selected: DataFrame) -> DataFrame:
    """(requirement_id, n_evidence, n_papers, covered) for every requirement."""
    used = selected.select(F.explode("covers").alias("requirement_id"), "chunk_id", "paper_id")
    found = used.groupBy("requirement_id").agg(F.countDistinct("chunk_id").alias("n_evidence"), F.countDistinct("paper_id").alias("n_papers"))
    zero = F.lit(0).cast("long")
    return requirements.select("requirement_id").join(found, "requirement_id", "left").select(
        "requirement_id", F.coalesce("n_evidence", zero).alias("n_evidence"), F.coalesce("n_papers", zero).alias("n_papers"), (F.coalesce("n_evidence", zero) > 0).alias("covered")
    )
