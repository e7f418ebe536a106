"""The whole pipeline on a small fixture, each stage against plain Python."""

import random
import re

import corpus_pipeline
from foliant.llm.decontaminate import WINDOW
from foliant.llm.toxicity import REJECT
from foliant.session import cut_table
from tests.llm.test_edges import BASE, DOCS, WORDS, brute_jaccard

SECRET = "abcdefghijkl0123"


def test_every_stage_against_plain_python(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    item = " ".join(f"bench{k}" for k in range(WINDOW + 2))
    texts = [say(40) + (" scum idiot" if i % 4 == 0 else "") for i in range(400)]
    texts += [texts[k] + " end" for k in (1, 2, 3)] + [f"{say(20)} {item} {say(20)}", f"password: {SECRET} {say(30)}", f"{say(30)} {item} password: {SECRET}", say(30), "", None]
    table = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(table, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = {r[0]: r for r in table}
    rows = {i: r for i, r in rows.items() if "scum" not in (r[1] or "")}
    want = {"toxicity": rows}
    first = brute_jaccard([(i, r[1]) for i, r in rows.items()], 5, 80, 100)
    rows = {i: r for i, r in rows.items() if first[i][1] == i}
    want["near_duplicates"] = rows
    rows = {i: r for i, r in rows.items() if not re.search(" ".join(item.split()[:WINDOW]), r[1] or "")}
    want["decontamination"] = rows
    marked = {i: r[1] and re.sub(BASE["assign"], "[secret]", r[1], flags=re.I) for i, r in rows.items()}
    want["secrets"] = {i: (*r[:1], marked[i], *r[2:4], None if marked[i] is None else len(marked[i])) for i, r in rows.items()}
    assert REJECT == 0.3 and len(want["toxicity"]) > len(want["near_duplicates"]) > len(want["decontamination"])

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_table(stage(spark, docs, str(tmp_path)))
        if name in want:
            assert sorted(tuple(r) for r in docs.collect()) == sorted(want[name].values()), name
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r[c] for c in fields) for r in got) == sorted(tuple(r[c] for c in fields) for r in docs.collect())
    assert {r.doc_id for r in got} == set(marked)
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for spans in used.values():
        spans.sort()
        assert spans[-1][1] <= 4096 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
