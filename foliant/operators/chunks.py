"""Typed blocks to retrieval chunks: routing, packed prose, lists, tables with their rows and footnotes, figures, equations,
references, and an account of what became of every block.

Blocks are rows as foliant.sources.articles gives them (BLOCK_SCHEMA). Everything but the packing of one run of
paragraphs is columns and windows inside a document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import section_kind, strip_markup
from foliant.operators.structure import HARD, TARGET, embedding_text, pack_paragraphs, split_recursively, unique_ids

# Names of block types that mean the same.
BLOCK_ALIASES = {
    "paragraph": "paragraph", "list": "list", "ordered_list": "list", "unordered_list": "list", "list_item_group": "list", "table": "table", "figure": "figure", "fig": "figure",
    "formula": "equation", "equation": "equation", "eq": "equation", "reference": "reference", "ref": "reference", "administrative": "administrative", "admin": "administrative", "heading": "heading",
}
#: Kinds that are kept but not retrieved.
NOT_RETRIEVED = ("reference", "administrative")

_PART = "struct<sub:int,chunk_type:string,text:string,prefix:string,object_id:string,row_label:string,group_path:array<string>,suffix:string>"


def _aliased(kind: Column) -> Column:
    low = F.lower(F.btrim(F.coalesce(kind, F.lit(""))))
    names = F.create_map(*[F.lit(x) for pair in BLOCK_ALIASES.items() for x in pair])
    return F.coalesce(names[low], low)


def route(blocks: DataFrame) -> DataFrame:
    """blocks with route: what a block becomes. In reference and administrative sections every block is of that kind;
    elsewhere its own type decides. Headings and blocks of articles that did not parse have none."""
    kind = section_kind(F.try_element_at("section_path", F.lit(-1)))
    own = _aliased(F.col("block_type"))
    return blocks.withColumn(
        "route",
        F.when(own.isin("error", "heading"), F.lit(None)).when(kind.isin("references"), "reference").when(kind == "administrative", "administrative")
        .when(own.isin(*set(BLOCK_ALIASES.values())), own).otherwise("other"),
    )


def clean(text: Column) -> Column:
    """Trimmed, with no-break spaces as blanks; lines stay."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{00A0}\r\t ]+", " "))


def column_list(names: Column) -> Column:
    return F.concat(F.lit("Columns:\n"), F.array_join(F.transform(names, lambda c: F.concat(F.lit("- "), c)), "\n"))


def table_summary(label: Column, caption: Column, columns: Column, content: Column) -> Column:
    """Label and caption, then the columns; the content without markup where there is none of these."""
    head = F.when((label != "") & (caption != ""), F.concat(label, F.lit(": "), caption)).when(caption != "", caption).when(label != "", label)
    named = F.filter(F.coalesce(columns, F.array().cast("array<string>")), lambda c: c != "")
    parts = F.array_join(F.array_compact(F.array(head, F.when(F.size(named) > 0, column_list(named)))), "\n\n")
    return F.when(parts != "", parts).otherwise(strip_markup(F.coalesce(content, F.lit(""))))


def row_text(row: Column) -> Column:
    """"Group: a > b", "Row: x" and a line "column: value" for each cell."""
    group = F.when(F.size(row["group_path"]) > 0, F.concat(F.lit("Group: "), F.array_join(row["group_path"], " > ")))
    label = F.when(F.coalesce(row["label"], F.lit("")) != "", F.concat(F.lit("Row: "), row["label"]))
    cells = F.transform(row["cells"], lambda c: F.concat(c["col"], F.lit(": "), F.coalesce(c["val"], F.lit(""))))
    return F.array_join(F.concat(F.array_compact(F.array(group, label)), F.coalesce(cells, F.array().cast("array<string>"))), "\n")


def footnote_text(notes: Column) -> Column:
    each = F.transform(notes, lambda n: F.when(F.coalesce(n["marker"], F.lit("")) != "", F.concat(F.lit("["), n["marker"], F.lit("] "), clean(n["text"]))).otherwise(clean(n["text"])))
    return F.array_join(F.filter(each, lambda t: t != ""), "\n")


def _object_ids(rows: DataFrame) -> DataFrame:
    """rows with object: route_id of the source where it has an id, else route_n counted in the document."""
    lacking = F.when(F.col("route").isin("table", "figure", "equation", "reference") & F.col("source_id").isNull(), 1).otherwise(0)
    n = F.sum(lacking).over(Window.partitionBy("document_id", "route").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.withColumn("object", F.concat_ws("_", "route", F.coalesce(F.col("source_id"), n.cast("string"))))


def _parts() -> Column:
    """The chunks of one block that is no prose, in order."""
    text, none = clean(F.col("content")), F.lit(None)
    no_path = F.array().cast("array<string>")

    def part(sub: int, kind: Column, content: Column, prefix: Column, named: Column, label: Column, path: Column, suffix: Column) -> Column:
        return F.struct(F.lit(sub).alias("sub"), kind.alias("chunk_type"), content.alias("text"), prefix.alias("prefix"), named.alias("object_id"), label.alias("row_label"), path.alias("group_path"), suffix.alias("suffix"))

    label, caption = clean(F.col("label")), clean(F.col("content"))
    shown = F.when(label != "", label).otherwise(F.concat(F.lit("Table "), F.col("object")))
    summary = table_summary(label, caption, F.col("columns"), F.col("content"))
    head = part(0, F.lit("table_summary"), F.when(summary != "", summary).otherwise(shown), shown, F.col("object"), none, no_path, F.concat(F.lit("_"), F.col("object"), F.lit("_summary")))
    rows = F.transform(
        F.coalesce("rows", F.array().cast("array<struct<label:string,group_path:array<string>,cells:array<struct<col:string,val:string>>>>")),
        lambda r, i: F.struct(
            (i + 1).cast("int").alias("sub"), F.lit("table_row").alias("chunk_type"), row_text(r).alias("text"), shown.alias("prefix"), F.col("object").alias("object_id"),
            F.when(r["label"] != "", r["label"]).alias("row_label"), F.coalesce(r["group_path"], no_path).alias("group_path"), F.concat(F.lit("_"), F.col("object"), F.lit("_row_"), i.cast("string")).alias("suffix"),
        ),
    )
    notes = F.when(F.size("footnotes") > 0, F.array(part(2**30, F.lit("table_footnotes"), footnote_text(F.col("footnotes")), shown, F.col("object"), none, no_path, F.concat(F.lit("_"), F.col("object"), F.lit("_footnotes")))))
    one = lambda kind, content, prefix=none, named=none, suffix=none: F.array(part(0, F.lit(kind), content, prefix, named, none, no_path, suffix).cast(_PART))
    own = F.concat(F.lit("_"), F.col("object"))
    listed = F.array_join(F.filter(F.array(label, text), lambda x: x != ""), "\n\n")
    figure = F.when(text != "", text).when(label != "", label).otherwise(F.concat(F.lit("Figure "), F.col("object")))
    return (
        F.when(F.col("route") == "table", F.concat(F.array(head.cast(_PART)), rows.cast(f"array<{_PART}>"), F.coalesce(notes.cast(f"array<{_PART}>"), F.array().cast(f"array<{_PART}>"))))
        .when(F.col("route") == "list", one("list", listed))
        .when(F.col("route") == "figure", one("figure", figure, F.concat(F.lit("Figure "), F.col("object")), F.col("object"), own))
        .when(F.col("route") == "equation", one("equation", text, F.concat(F.lit("Equation "), F.col("object")), F.col("object"), own))
        .when(F.col("route") == "reference", one("reference", text, none, F.col("object"), own))
        .when(F.col("route") == "administrative", one("administrative", text))
        .otherwise(one("paragraph", text))
    )


def _prose(paragraphs: DataFrame, target: int, hard: int) -> DataFrame:
    """Packed runs: (document_id, block_seq, sub, text, source_block_ids, refs, section_path, sources)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block_seq")
        texts, out = rows["content"].tolist(), []
        for group in pack_paragraphs(texts, target, hard):
            part = rows.iloc[group]
            joined = "\n\n".join(t for t in part["content"] if t)
            held = [i for i in part["source_id"] if isinstance(i, str) and i]
            refs = list(dict.fromkeys(r for own in part["refs"] for r in (own if own is not None else [])))
            for k, piece in enumerate(split_recursively(joined, target) if len(joined) > hard else [joined]):
                out.append((key[0], int(part["block_seq"].iloc[0]), k, piece, held, refs, list(part["section_path"].iloc[0]), part["block_seq"].tolist()))
        return pd.DataFrame(out, columns=["document_id", "block_seq", "sub", "text", "source_block_ids", "refs", "section_path", "sources"])

    kind = paragraphs.schema["document_id"].dataType.simpleString()
    return paragraphs.groupBy("document_id", "island").applyInPandas(
        run, f"document_id {kind}, block_seq int, sub int, text string, source_block_ids array<string>, refs array<string>, section_path array<string>, sources array<int>"
    )


def chunk(blocks: DataFrame, target: int = TARGET, hard: int = HARD) -> DataFrame:
    """The chunks of all documents, in reading order: (chunk_id, document_id, position, chunk_type, text, embedding_text,
    section, subsection, breadcrumb, parent_id, object_id, row_label, group_path, source_block_ids, refs,
    retrieval_eligible, sources). Paragraphs of one section that follow each other are packed; anything else ends a run.
    Equal ids in a document get _1, _2 ... in reading order."""
    routed = route(blocks).where("route is not null")
    w = Window.partitionBy("document_id").orderBy("block_seq")
    prose = F.col("route") == "paragraph"
    starts = ~(prose & F.coalesce((F.lag("route").over(w) == "paragraph") & (F.lag("section_path").over(w) == F.col("section_path")), F.lit(False)))
    runs = routed.withColumn("_starts", starts.cast("int")).withColumn("island", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    empty = F.array().cast("array<string>")
    packed = _prose(runs.where(prose).select("document_id", "island", "block_seq", "section_path", "source_id", clean(F.col("content")).alias("content"), F.coalesce("refs", empty).alias("refs")), target, hard)
    none = F.lit(None).cast("string")
    packed = packed.select(
        "document_id", "block_seq", "sub", F.lit("paragraph").alias("chunk_type"), "text", none.alias("prefix"), none.alias("object_id"), none.alias("row_label"), empty.alias("group_path"), none.alias("suffix"),
        "source_block_ids", "refs", "section_path", "sources",
    )
    others = _object_ids(runs.where(~prose)).select(
        "document_id", "block_seq", F.array_compact(F.array("source_id")).alias("source_block_ids"), F.coalesce("refs", empty).alias("refs"), "section_path", F.array("block_seq").alias("sources"), F.explode(_parts()).alias("p")
    ).select("document_id", "block_seq", "p.*", "source_block_ids", "refs", "section_path", "sources")
    every = packed.unionByName(others)
    order = Window.partitionBy("document_id").orderBy("block_seq", "sub")
    counted = every.withColumn("position", F.row_number().over(order) - 1).withColumn("_n", F.sum(F.col("suffix").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    named = unique_ids(counted.withColumn("_id", F.concat("document_id", F.coalesce("suffix", F.concat(F.lit("_"), F.col("_n").cast("string"))))), "document_id", "_id", "position")
    head = F.max(F.when(F.col("chunk_type") == "table_summary", F.col("unique_id"))).over(Window.partitionBy("document_id", "block_seq"))
    kept = ~F.col("chunk_type").isin(*NOT_RETRIEVED)
    crumbs = F.col("section_path")
    return named.select(
        F.col("unique_id").alias("chunk_id"), "document_id", "position", "chunk_type", "text",
        F.when(kept, embedding_text(crumbs, F.col("text"), F.coalesce("prefix", F.lit("")))).otherwise("").alias("embedding_text"),
        F.try_element_at(crumbs, F.lit(1)).alias("section"), F.when(F.size(crumbs) > 1, F.try_element_at(crumbs, F.lit(-1))).alias("subsection"), crumbs.alias("breadcrumb"),
        F.when(F.col("chunk_type").isin("table_row", "table_footnotes"), head).alias("parent_id"), "object_id", "row_label", "group_path", "source_block_ids", "refs", kept.alias("retrieval_eligible"), "sources",
    )


def with_metadata(chunks: DataFrame, front: DataFrame) -> DataFrame:
    """chunks with the document's metadata (document_id, title, journal, doi, keywords, authors, dates, pages) of
    foliant.sources.front; the electronic date comes before that of the collection."""
    pages = F.when((F.col("fpage") != "") & (F.col("lpage") != ""), F.concat_ws("-", "fpage", "lpage")).otherwise(F.coalesce("fpage", F.lit("")))
    own = front.select("document_id", "title", "journal", "doi", "keywords", "authors", F.coalesce("epub_date", "collection_date", F.lit("")).alias("publication_date"), pages.alias("pages"))
    return chunks.join(own, "document_id", "left").withColumn("full_breadcrumb", F.array_join("breadcrumb", " > "))


def coverage(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, source_blocks, consumed, unhandled, chunks, retrieval_eligible, chunks_by_type, coverage): whether
    every block is in a chunk."""
    made = chunks.select("document_id", F.explode("sources").alias("block_seq")).distinct().withColumn("used", F.lit(1))
    held = blocks.where(~F.col("block_type").isin("heading", "error")).select("document_id", "block_seq").join(made, ["document_id", "block_seq"], "left")
    source = held.groupBy("document_id").agg(F.count("*").alias("source_blocks"), F.count("used").alias("consumed"))
    by_type = chunks.groupBy("document_id", "chunk_type").agg(F.count("*").alias("n"), F.count_if("retrieval_eligible").alias("e"))
    typed = by_type.groupBy("document_id").agg(F.sum("n").alias("chunks"), F.sum("e").alias("retrieval_eligible"), F.array_sort(F.collect_list(F.struct("chunk_type", "n"))).alias("chunks_by_type"))
    zero = F.lit(0).cast("long")
    return source.join(typed, "document_id", "left").select(
        "document_id", "source_blocks", "consumed", (F.col("source_blocks") - F.col("consumed")).alias("unhandled"), F.coalesce("chunks", zero).alias("chunks"), F.coalesce("retrieval_eligible", zero).alias("retrieval_eligible"),
        "chunks_by_type", F.round(F.col("consumed") / F.col("source_blocks"), 6).alias("coverage"),
    )


def table_coverage(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, block_seq, rows_source, rows_chunks, footnotes_preserved, passes) of each table."""
    source = route(blocks).where("route = 'table'").select("document_id", "block_seq", F.coalesce(F.size("rows"), F.lit(0)).alias("rows_source"), (F.coalesce(F.size("footnotes"), F.lit(0)) > 0).alias("noted"))
    source = source.withColumn("rows_source", F.greatest("rows_source", F.lit(0)))
    made = chunks.where(F.col("chunk_type").isin("table_row", "table_footnotes")).withColumn("block_seq", F.col("sources")[0])
    made = made.groupBy("document_id", "block_seq").agg(F.count_if(F.col("chunk_type") == "table_row").alias("rows_chunks"), F.bool_or(F.col("chunk_type") == "table_footnotes").alias("has_notes"))
    both = source.join(made, ["document_id", "block_seq"], "left").withColumn("rows_chunks", F.coalesce("rows_chunks", F.lit(0).cast("long"))).withColumn("footnotes_preserved", F.col("noted") == F.coalesce("has_notes", F.lit(False)))
    return both.select("document_id", "block_seq", F.col("rows_source").cast("long").alias("rows_source"), "rows_chunks", "footnotes_preserved", ((F.col("rows_source") == F.col("rows_chunks")) & F.col("footnotes_preserved")).alias("passes"))

