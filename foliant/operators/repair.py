"""Evidence for requirements that a selection leaves open, without losing what it covers.

A row enters while slots are free. When none is, it enters along an augmenting path: a row goes out whose requirements others cover, or whose
lost ones an unselected row covers, which enters in turn. Every step keeps what was covered, so coverage never shrinks; a
requirement that no row covers stays open."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.evidence import GreedyWeights

Rows = dict[str, tuple[float, frozenset[str]]]  # chunk_id -> (final, covers)


def _weakest(rows: Rows) -> list[str]:
    return sorted(rows, key=lambda c: (rows[c][0], c))


def _strongest(rows: Rows) -> list[str]:
    return sorted(rows, key=lambda c: (-rows[c][0], c))


def enter(row: str, chosen: Rows, every: Rows, slots: int, kept: frozenset[str] = frozenset(), tried: set[str] | None = None) -> Rows | None:
    """chosen with row, and with what else has to change so that there are at most slots rows; None if that loses a requirement.
    Rows in kept stay; each row is tried as one that goes out once in a whole path."""
    tried = set() if tried is None else tried
    now = {**chosen, row: every[row]}
    if len(now) <= slots:
        return now
    count = Counter(q for _, covers in now.values() for q in covers)
    kept = kept | {row}
    lost = {c: frozenset(q for q in now[c][1] if count[q] == 1) for c in _weakest(now) if c not in kept}
    for c, only in lost.items():
        if not only:
            return {k: v for k, v in now.items() if k != c}
    for c, only in lost.items():
        if c in tried:
            continue
        tried.add(c)
        rest = {k: v for k, v in now.items() if k != c}
        for other in _strongest({k: v for k, v in every.items() if k not in now and only <= v[1]}):
            found = enter(other, rest, every, slots, kept, tried)
            if found is not None:
                return found
    return None


def augment(chosen: Rows, found: Rows, requirements: list[str], slots: int) -> Rows:
    """chosen with the best rows of found for each open requirement, in the requirements' order."""
    every = {**found, **chosen}
    for wanted in requirements:
        if any(wanted in covers for _, covers in chosen.values()):
            continue
        for c in _strongest({k: v for k, v in every.items() if k not in chosen and wanted in v[1]}):
            better = enter(c, chosen, every, slots)
            if better is not None:
                chosen = better
                break
    return chosen


def open_requirements(selected: DataFrame, requirements: DataFrame) -> DataFrame:
    """The (question_id, requirement_id) that nothing selected covers."""
    covered = selected.select("question_id", F.explode("covers").alias("requirement_id")).distinct()
    return requirements.join(covered, ["question_id", "requirement_id"], "left_anti")


def repair(selected: DataFrame, searched: DataFrame, requirements: DataFrame, slots: int = GreedyWeights.slots) -> DataFrame:
    """selected(question_id, chunk_id, final, covers) with rows of searched for the requirements(question_id, requirement_id) that are open,
    at most slots rows a question. Of searched, the best rows of each requirement, as many as there are slots, are looked at, so that a group
    is as small as slots times requirements. Requirements are served in the order of their ids."""
    key = ["question_id", "chunk_id"]
    rows = lambda df, chosen: df.select(*key, "final", "covers", F.lit(chosen).alias("chosen"))
    near = Window.partitionBy("question_id", "requirement_id").orderBy(F.desc("final"), "chunk_id")
    best = searched.select(*key, "final", "covers", F.explode("covers").alias("requirement_id")).withColumn("n", F.row_number().over(near)).where(F.col("n") <= slots).dropDuplicates(key)
    every = rows(selected, True).unionByName(rows(best.join(selected.select(*key), key, "left_anti"), False))
    asked = requirements.groupBy("question_id").agg(F.sort_array(F.collect_set("requirement_id")).alias("wanted"))
    kinds = {c: selected.schema[c].dataType.simpleString() for c in key}

    def run(group: tuple, table: pd.DataFrame) -> pd.DataFrame:
        of = lambda part: {c: (f, frozenset(covers)) for c, f, covers in zip(part["chunk_id"], part["final"], part["covers"], strict=True)}
        wanted = table["wanted"].iloc[0]
        out = augment(of(table[table["chosen"]]), of(table[~table["chosen"]]), [] if wanted is None else list(wanted), slots)
        return pd.DataFrame([(group[0], c, f, sorted(covers)) for c, (f, covers) in out.items()], columns=["question_id", "chunk_id", "final", "covers"])

    # a question without any selected row starts from none
    return every.join(asked, "question_id", "left").groupBy("question_id").applyInPandas(run, f"question_id {kinds['question_id']}, chunk_id {kinds['chunk_id']}, final double, covers array<string>")
