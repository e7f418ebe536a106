"""References of articles as fields and as one citation line; a report of what an article's markup holds."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources.articles import _clean, _first, _name, _text, article_id, parse_tree

# Where an id of a kind leads to.
LINKS = {"doi": "https://doi.org/", "pmid": "https://pubmed.ncbi.nlm.nih.gov/", "pmcid": "https://www.ncbi.nlm.nih.gov/pmc/articles/"}
PARTS = {"title": "article-title", "source": "source", "year": "year", "volume": "volume", "first_page": "fpage", "last_page": "lpage"}
REFERENCE_SCHEMA = f"document_id string, number int, ref_id string, authors array<string>, {', '.join(f'{k} string' for k in (*PARTS, *LINKS))}, formulas array<string>, plain string"
ELEMENT_SCHEMA = "document_id string, seq int, tag string, id string, kind string, text string, in_body boolean, in_float boolean"
FLOATS = ("table-wrap", "table", "fig")


def _fields(ref: ET.Element) -> dict:
    """The parts of one reference; its mixed citation comes before its element citation, text without its label stands for either."""
    found = _first(ref, "mixed-citation")
    cited = found if found is not None else _first(ref, "element-citation")
    plain = _clean(_text(cited if cited is not None else ref, ("label",)))
    within = list(cited.iter()) if cited is not None else []
    part = {name: _clean(_text(next((x for x in within if _name(x) == tag), None))) for name, tag in PARTS.items()}
    ids = {x.get("pub-id-type"): _clean(_text(x)) for x in within if _name(x) == "pub-id"}
    named = [_clean(_text(p)) for g in within if _name(g) == "person-group" for p in g if _name(p) == "string-name"]
    drawn = [_clean(_text(t if (t := _first(x, "tex-math")) is not None else x)) for x in within if _name(x) in ("inline-formula", "disp-formula")]
    return {**part, **{k: ids.get(k, "") for k in LINKS}, "authors": [n for n in named if n], "formulas": [x for x in drawn if x], "plain": plain}


def references(articles: DataFrame, name: str = "path", xml: str = "xml") -> DataFrame:
    """REFERENCE_SCHEMA and citation: a row for each reference of each list, numbered from 1 in an article; of references that share
    an id the first stays, one without an id is called by its number. Null, empty and unreadable articles have none. A citation is
    its parts in one line; without parts the plain text, without text the number."""

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split(" ")[0] for f in REFERENCE_SCHEMA.split(", ")]
        for table in tables:
            rows: list[dict] = []
            for path, text in zip(table[name], table[xml], strict=True):
                root, _ = parse_tree(text)
                every = [] if root is None else [r for x in root.iter() if _name(x) == "ref-list" for r in x.iter() if _name(r) == "ref"]
                own, seen = article_id(root, path or "") if root is not None else "", set()
                for r in {id(r): r for r in every}.values():  # lists in lists hold a reference once
                    if not r.get("id") or r.get("id") not in seen:
                        seen.add(r.get("id") or f"\0{len(seen)}")
                        rows.append({"document_id": own, "number": len(seen), "ref_id": r.get("id") or f"ref_{len(seen)}", **_fields(r)})
            yield pd.DataFrame(rows, columns=columns)

    some = lambda c: F.when(c != "", c)
    col = {k: F.col(k) for k in (*PARTS, *LINKS)}
    pages = F.when(col["first_page"] != "", F.concat(F.lit(":"), "first_page", F.when(col["last_page"] != "", F.concat(F.lit("–"), "last_page")).otherwise("")))
    journal = F.concat_ws("", "source", "year", F.when(col["volume"] != "", F.concat(F.lit(";"), "volume")), pages)
    linked = F.concat_ws(" ", *[F.when(col[k] != "", F.concat(F.lit(f"{k.upper()}: ["), k, F.lit(f"]({to}"), k, F.lit(")"))) for k, to in LINKS.items()])
    drawn = F.concat_ws(" ", F.transform("formulas", lambda x: F.concat(F.lit("$"), x, F.lit("$"))))
    line = F.concat_ws(". ", some(F.array_join("authors", ", ")), some(col["title"]), some(journal), some(linked), some(drawn))
    called = F.concat(F.lit("Reference "), F.col("number").cast("string"))
    return articles.select(name, xml).mapInPandas(run, REFERENCE_SCHEMA).withColumn("citation", F.coalesce(some(line), some(F.col("plain")), called))


def with_citations(blocks: DataFrame, cited: DataFrame) -> DataFrame:
    """blocks with the citation line as the content of each reference block; other blocks and columns as they are."""
    lines = cited.groupBy("document_id", F.col("ref_id").alias("source_id")).agg(F.min_by("citation", "number").alias("_line"))
    joined = blocks.join(lines, ["document_id", "source_id"], "left")
    content = F.when(F.col("block_type") == "reference", F.coalesce("_line", "content")).otherwise(F.col("content"))
    return joined.withColumn("content", content).select(*blocks.columns)


def elements(articles: DataFrame, name: str = "path", xml: str = "xml") -> DataFrame:
    """ELEMENT_SCHEMA: a row for each element of each article in document order; kind and text only of article ids."""

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for path, text in zip(table[name], table[xml], strict=True):
                root, _ = parse_tree(text)
                rows: list[tuple] = []
                own = article_id(root, path or "") if root is not None else ""
                todo = [(root, False, False)] if root is not None else []
                while todo:
                    e, body, floating = todo.pop()
                    tag = _name(e)
                    is_id = tag == "article-id"
                    rows.append((own, len(rows), tag, e.get("id"), e.get("pub-id-type") if is_id else None, _clean(_text(e)) if is_id else None, body, floating))
                    todo += [(c, body or tag == "body", floating or tag in FLOATS) for c in reversed(e)]
                yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in ELEMENT_SCHEMA.split(", ")])

    return articles.select(name, xml).mapInPandas(run, ELEMENT_SCHEMA)


def schema_report(found: DataFrame, most_ids: int = 10) -> DataFrame:
    """A row for each article of elements(): its root, parts, ids and counts by kind; paragraphs in tables and figures don't count,
    of tables and figures the first ids are listed."""
    tag = F.col("tag")
    number = lambda test: F.count_if(test)
    any_of = lambda t: F.coalesce(F.bool_or(tag == t), F.lit(False))
    ids = lambda t: F.transform(F.slice(F.array_sort(F.collect_list(F.when(tag == t, F.struct("seq", "id")))), 1, most_ids), lambda x: x["id"])
    return found.groupBy("document_id").agg(
        F.min_by("tag", "seq").alias("root_tag"), F.array_sort(F.collect_set(F.when(tag == "article-id", F.struct("kind", "text")))).alias("article_ids"),
        any_of("body").alias("has_body"), any_of("back").alias("has_back"), any_of("floats-group").alias("has_floats_group"),
        number((tag == "sec") & F.col("in_body")).alias("n_secs"), number((tag == "p") & ~F.col("in_float")).alias("n_paragraphs"), number(tag == "list").alias("n_lists"),
        number(tag == "table-wrap").alias("n_tables"), number(tag == "fig").alias("n_figures"), number(tag == "fn").alias("n_table_fns"), number(tag == "ref").alias("n_refs"),
        ids("table-wrap").alias("table_ids"), ids("fig").alias("figure_ids"),
    )
