"""Commands: python -m foliant plan|blocks|chunks|index|search|answer|query ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _articles(spark: SparkSession, folder: str):
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xml,nxml}").text(folder)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("xml"))


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="foliant")
    kinds = top.add_subparsers(dest="command", required=True)
    for name, wanted in (
        ("plan", ["question"]), ("blocks", ["articles", "out"]), ("chunks", ["articles", "out"]), ("index", ["chunks", "out"]), ("search", ["index", "text"]), ("answer", ["chunks", "question"]), ("query", ["name", "tables"]),
    ):
        one = kinds.add_parser(name)
        for w in wanted:
            one.add_argument(w)
        one.add_argument("--top", type=int, default=10)
    a = top.parse_args(argv)
    if a.command == "plan":
        from foliant.plans import planner

        plan = planner.plan(a.question)
        print(json.dumps({"type": plan.understanding.question_type, "requirements": [r.rerank_text() for r in plan.requirements], "queries": plan.queries, "guard": plan.guard}, ensure_ascii=False, indent=2))
        return
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("foliant").getOrCreate()
    if a.command in ("blocks", "chunks"):
        from foliant.operators import chunks
        from foliant.sources import articles

        blocks = articles.parse(_articles(spark, a.articles))
        (blocks if a.command == "blocks" else chunks.chunk(blocks)).write.mode("overwrite").parquet(a.out)
    elif a.command == "index":
        from foliant.operators import lexical

        lexical.build(spark.read.parquet(a.chunks)).save(a.out)
    elif a.command == "search":
        from foliant.operators import lexical

        asked = spark.createDataFrame([("q", a.text)], "query_id string, text string")
        for r in lexical.search(lexical.load(spark, a.index), asked, a.top).orderBy("rank").collect():
            print(r["rank"], r["chunk_id"], round(r["score"], 4), sep="\t")
    elif a.command == "answer":
        from foliant.operators import docindex
        from foliant.plans.answer import Corpus, answer

        rows = spark.read.parquet(a.chunks)
        place = docindex.structure_of(rows)
        chunks = place.withColumnRenamed("node_type", "chunk_type").join(rows.select(F.col("chunk_id"), "text"), "chunk_id")
        print(answer(spark, a.question, Corpus.of(chunks)).markdown())
    else:
        from foliant.queries import QUERIES

        QUERIES[a.name](spark, a.tables).show(a.top, truncate=False)


if __name__ == "__main__":
    main()
