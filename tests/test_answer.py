"""The whole way from a question to evidence, on a small corpus with one paper that answers it, and the commands."""

import random

import pytest

from foliant import __main__ as commands
from foliant.models import plugins
from foliant.operators import evidence
from foliant.plans.answer import Corpus, answer
from pyspark.sql import functions as F

QUESTION = "Which surgical repair techniques were associated with recurrent coarctation and what are the percentages and p-values?"


@pytest.fixture(scope="module")
def corpus_rows(spark):
    rng = random.Random(2)
    words = "heart blood vessel child adult hospital result method pressure flow year group".split()
    rows = []
    for p in range(6):
        for i in range(12):
            text = " ".join(rng.choice(words) for _ in range(25))
            rows.append((f"P{p}_{i}", f"P{p}", text, "paragraph", "Results" if i > 5 else "Methods", None, [], i, None, None))
    rows.append(("P2_t_summary", "P2", "Table 1: Surgical repair techniques and recurrent coarctation\n\nColumns:\n- Technique\n- Recurrence (%)\n- p", "table_summary", "Results", None, ["Results"], 12, "t", None))
    for k, name in enumerate(("End-to-end", "Patch", "Flap")):
        rows.append((f"P2_t_row_{k}", "P2", f"Row: {name} surgical repair techniques\nRecurrence (%): {k + 3} (1{k})%\np: p = 0.0{k + 1} recurrent coarctation", "table_row", "Results", None, ["Results"], 13 + k, "t", None))
    rows.append(("P4_x", "P4", "Recurrent coarctation was seen after surgical repair techniques in 12% (p < 0.05).", "paragraph", "Results", None, ["Results"], 12, None, None))
    return spark.createDataFrame(rows, "chunk_id string, paper_id string, text string, chunk_type string, section string, subsection string, breadcrumb array<string>, position long, table_id string, figure_id string").cache()


@pytest.mark.parametrize("plugged", [False, True])
def test_answer(spark, corpus_rows, plugged):
    encoder = (lambda: plugins.HashingEncoder(64)) if plugged else None
    found = answer(spark, QUESTION, Corpus.of(corpus_rows, encoder), encoder, plugins.OverlapScorer if plugged else None)
    assert {"P2", "P4"} <= {r.paper_id for r in found.papers.collect()}
    rows = found.evidence.orderBy("place").collect()
    assert rows and rows[0].paper_id in ("P2", "P4") and any(r.chunk_id.startswith("P2_t") for r in rows[:4]) and len({r.chunk_id for r in rows}) == len(rows) <= 18
    covered = {r.requirement_id: r.covered for r in found.coverage.collect()}
    assert covered == {"H1": True}
    text = found.markdown()
    assert text.startswith("# Which surgical") and "P2" in text


def test_type_match(spark):
    rows = spark.createDataFrame([("comparative_numerical", "table_row", "", ["table_row"], 0.45), ("numerical", "paragraph", "Results", ["results"], 0.15), ("other", "figure", None, [], 0.0)], "f string, k string, s string, p array<string>, want double")
    for r in rows.select("want", evidence.type_match(F.col("f"), F.col("k"), F.col("s"), F.col("p")).alias("x")).collect():
        assert abs(r.want - r.x) < 1e-9


def test_commands(spark, corpus_rows, tmp_path, capsys):
    commands.main(["plan", QUESTION])
    assert "comparative_numerical" in capsys.readouterr().out
    corpus_rows.write.parquet(str(tmp_path / "chunks"))
    commands.main(["index", str(tmp_path / "chunks"), str(tmp_path / "index")])
    commands.main(["search", str(tmp_path / "index"), "recurrent coarctation", "--top", "3"])
    assert "P4_x" in capsys.readouterr().out
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "a.xml").write_text("<article><body><sec><title>R</title><p>Text.</p></sec></body></article>")
    commands.main(["chunks", str(tmp_path / "xml"), str(tmp_path / "made")])
    assert [(r.document_id, r.text) for r in spark.read.parquet(str(tmp_path / "made")).collect()] == [("a", "Text.")]
