"""Document trees from blocks, Markdown and chunks: nodes with preorder intervals, floats at their first mention, nodes matched
to chunks, navigation by structure."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import collapse
from foliant.operators import leafmatch
from foliant.operators.structure import zip_by_order
from foliant.operators.tree import leaves
from foliant.session import cut_table
from foliant.sources.front import IMAGES

# How alike texts must be, and how long, to be matched.
MOST_MERGED, LEAST_RATIO = 40, 0.75
FLOATS = ("figure", "table", "supplementary")
NODE_COLUMNS = ("paper_id", "node_id", "parent_id", "node_type", "title", "text", "breadcrumb", "level", "preorder", "last_preorder", "source_id")


def place_floats(blocks: DataFrame) -> DataFrame:
    """blocks in which figures, tables and supplements that stand in no section go to the section of the first block that refers to
    them; those that nothing mentions stay with the document."""
    said = blocks.select("document_id", "section_path", "block_seq", F.explode("refs").alias("source_id"))
    first = said.where(F.size("section_path") > 0).groupBy("document_id", "source_id").agg(F.min_by("section_path", "block_seq").alias("_path"))
    loose = (F.size("section_path") == 0) & F.col("block_type").isin(*FLOATS)
    return blocks.join(first, ["document_id", "source_id"], "left").withColumn("section_path", F.when(loose, F.coalesce("_path", "section_path")).otherwise(F.col("section_path"))).drop("_path").select(*blocks.columns)


def _path_id(path: Column) -> Column:
    return F.concat(F.lit("s"), F.substring(F.md5(F.array_join(path, "\u0001")), 1, 16))


def from_blocks(blocks: DataFrame) -> DataFrame:
    """NODE_COLUMNS: a document, its sections by their paths, the blocks in them, and the rows and footnotes of tables."""
    own = blocks.where("block_type <> 'error'").withColumn("depth", F.size("section_path"))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    root = own.groupBy("document_id").agg(F.first("title", ignorenulls=True).alias("title")).select(
        "document_id", F.lit("root").alias("node_id"), none.alias("parent_id"), F.lit("document").alias("node_type"), "title", F.lit("").alias("text"), empty.alias("breadcrumb"), F.lit(0).alias("level"),
        F.lit(-1).alias("seq"), F.lit(0).alias("sub"), none.alias("source_id"), empty.alias("path"),
    )
    prefixes = own.where("depth > 0").select("document_id", "block_seq", F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.slice("section_path", 1, i))).alias("path"))
    sections = prefixes.groupBy("document_id", "path").agg(F.min("block_seq").alias("seq")).select(
        "document_id", _path_id(F.col("path")).alias("node_id"), F.when(F.size("path") > 1, _path_id(F.slice("path", F.lit(1), F.size("path") - 1))).otherwise("root").alias("parent_id"), F.lit("section").alias("node_type"),
        F.element_at("path", -1).alias("title"), F.lit("").alias("text"), F.col("path").alias("breadcrumb"), F.size("path").alias("level"), "seq", F.lit(0).alias("sub"), none.alias("source_id"), "path",
    )
    named = F.concat(F.lit("b"), F.col("block_seq").cast("string"))
    leaf = own.select(
        "document_id", named.alias("node_id"), F.when(F.col("depth") > 0, _path_id(F.col("section_path"))).otherwise("root").alias("parent_id"), F.col("block_type").alias("node_type"), F.coalesce("label", F.lit("")).alias("title"),
        F.col("content").alias("text"), F.col("section_path").alias("breadcrumb"), (F.col("depth") + 1).alias("level"), F.col("block_seq").alias("seq"), F.lit(1).alias("sub"), "source_id", F.col("section_path").alias("path"),
    )
    cells = lambda r: F.array_join(F.transform(r["cells"], lambda c: F.concat(c["col"], F.lit(": "), F.coalesce(c["val"], F.lit("")))), "\n")
    parts = F.concat(
        F.coalesce(F.transform("rows", lambda r: F.struct(F.lit("table_row").alias("kind"), r["label"].alias("title"), cells(r).alias("text"))), F.array().cast("array<struct<kind:string,title:string,text:string>>")),
        F.coalesce(F.transform("footnotes", lambda n: F.struct(F.lit("table_footnote").alias("kind"), n["marker"].alias("title"), n["text"].alias("text"))), F.array().cast("array<struct<kind:string,title:string,text:string>>")),
    )
    inside = own.where("block_type = 'table'").select("*", F.posexplode(parts).alias("k", "p")).select(
        "document_id", F.concat(named, F.lit("_"), F.col("k").cast("string")).alias("node_id"), named.alias("parent_id"), F.col("p.kind").alias("node_type"), F.coalesce("p.title", F.lit("")).alias("title"), F.col("p.text").alias("text"),
        F.col("section_path").alias("breadcrumb"), (F.col("depth") + 2).alias("level"), F.col("block_seq").alias("seq"), (F.col("k") + 2).alias("sub"), none.alias("source_id"), F.col("section_path").alias("path"),
    )
    every = root.unionByName(sections).unionByName(leaf).unionByName(inside)
    # a node's place is that of each section above it, then its own: nodes of one section stay together, floats too
    keys = sections.select("document_id", F.col("path").alias("of"), F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))).alias("path"))
    keys = keys.join(sections.select("document_id", "path", "seq"), ["document_id", "path"]).groupBy("document_id", "of")
    keys = keys.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.size("path").alias("n"), "seq"))), lambda x: x["seq"]).alias("key")).withColumnRenamed("of", "path")
    own_key = F.when(F.col("node_type") == "section", F.col("key")).otherwise(F.concat(F.coalesce("key", F.array().cast("array<int>")), F.array("seq", "sub")))
    order = Window.partitionBy("document_id").orderBy("key")
    counted = every.join(keys, ["document_id", "path"], "left").withColumn("key", own_key).withColumn("preorder", F.row_number().over(order) - 1).drop("key")
    # the last node below: of a section among its path's nodes, of a table among its parts, of the document among all
    in_paths = counted.where("sub > 0 and size(path) > 0").select("document_id", "preorder", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: _path_id(F.slice("path", 1, i)))).alias("node_id"))
    in_tables = counted.where(F.col("node_type").isin("table_row", "table_footnote")).select("document_id", "preorder", F.col("parent_id").alias("node_id"))
    in_root = counted.select("document_id", "preorder", F.lit("root").alias("node_id"))
    last = in_paths.unionByName(in_tables).unionByName(in_root).groupBy("document_id", "node_id").agg(F.max("preorder").alias("last"))
    return counted.join(last, ["document_id", "node_id"], "left").select(F.col("document_id").alias("paper_id"), *NODE_COLUMNS[1:9], F.coalesce("last", "preorder").alias("last_preorder"), "source_id")


def from_markdown(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Headings and the text below each: (paper_id, node_id, parent_id, node_type, title, text, breadcrumb, level, line). A heading hangs on
    the last one of a lower level; lines before the first heading are the document's."""
    lines = docs.select(F.col(doc_id).cast("string").alias("paper_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "content"))
    lines = lines.withColumn("level", F.when(F.col("content").rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract("content", "^(#+)", 1))))
    w = Window.partitionBy("paper_id").orderBy("line")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("head", F.last(F.when(F.col("level").isNotNull(), F.col("line")), ignorenulls=True).over(so_far))
    for k in range(1, 7):
        marked = marked.withColumn(f"_l{k}", F.last(F.when(F.col("level") == k, F.struct("line", "content")), ignorenulls=True).over(so_far))
    # the stack at a heading: of each lower level its last heading, if none of a lower level still came after it
    title = lambda c: F.btrim(F.regexp_replace(c, r"^#+\s+|\s+#+\s*$", ""))
    stack = F.array(*[F.when(F.col("level") > k, F.col(f"_l{k}")) for k in range(1, 7)])
    open_ = F.filter(F.array_compact(stack), lambda x: ~F.exists(F.array_compact(stack), lambda y: (y["line"] > x["line"]) & (F.length(F.regexp_extract(y["content"], "^(#+)", 1)) <= F.length(F.regexp_extract(x["content"], "^(#+)", 1)))))
    heads = marked.where("level is not null").withColumn("open", open_)
    parent = F.try_element_at("open", F.lit(-1))
    body = marked.where("level is null and head is not null").groupBy("paper_id", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("text"))
    sections = heads.join(body.withColumnRenamed("head", "line"), ["paper_id", "line"], "left").select(
        "paper_id", F.concat(F.lit("h"), F.col("line").cast("string")).alias("node_id"), F.coalesce(F.concat(F.lit("h"), parent["line"].cast("string")), F.lit("root")).alias("parent_id"), F.lit("section").alias("node_type"),
        title(F.col("content")).alias("title"), F.btrim(F.coalesce("text", F.lit("")), F.lit("\n ")).alias("text"), F.concat(F.transform("open", lambda x: title(x["content"])), F.array(title(F.col("content")))).alias("breadcrumb"), "level", "line",
    )
    front = marked.where("head is null").groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("text"))
    root = lines.select("paper_id").distinct().join(front, "paper_id", "left").select(
        "paper_id", F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("document").alias("node_type"), F.lit("").alias("title"), F.btrim(F.coalesce("text", F.lit("")), F.lit("\n ")).alias("text"),
        F.array().cast("array<string>").alias("breadcrumb"), F.lit(0).alias("level"), F.lit(-1).alias("line"),
    )
    return root.unionByName(sections)


def align_paragraphs(paragraphs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, chunk_id, node_ids, status): in each (paper_id, section, subsection) the chunks in order, each with the next paragraphs
    whose texts, joined by a blank line, are its text ("exact" or "merged"), else with one that is much like it ("similar"). Both tables
    have position and text; a group is one section of one document."""

    def solve(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("position"), right.sort_values("position")
        flat = lambda s: " ".join((s or "").split())
        texts, ids = [flat(t) for t in left["text"]], left["node_id"].tolist()
        free, out, at = set(range(len(texts))), [], 0
        for name, text in zip(right["chunk_id"], [flat(t) for t in right["text"]], strict=True):
            found: list[int] = []
            for begin in [at, *sorted(free)]:
                run, length = [], 0
                for k in range(begin, min(begin + MOST_MERGED, len(texts))):
                    if k not in free or length > len(text):
                        break
                    run.append(k)
                    length += len(texts[k]) + 1
                    if length - 1 == len(text) and " ".join(texts[i] for i in run) == text:
                        found = list(run)
                        break
                if found:
                    break
            status = "merged" if len(found) > 1 else "exact"
            if not found and free:
                likely = [k for k in sorted(free) if 2 * min(len(texts[k]), len(text)) >= LEAST_RATIO * (len(texts[k]) + len(text))]
                ratio, best = max(((SequenceMatcher(None, texts[k], text).ratio(), -k) for k in likely), default=(0.0, 0))
                if ratio >= LEAST_RATIO:
                    found, status = [-best], "similar"
            if found:
                free -= set(found)
                at = found[-1] + 1
                out.append((key[0], name, [ids[k] for k in found], status))
        return pd.DataFrame(out, columns=["paper_id", "chunk_id", "node_ids", "status"])

    place = ["paper_id", "section", "subsection"]
    side = lambda rows, *more: rows.select("paper_id", *[F.coalesce(c, F.lit("")).alias(c) for c in place[1:]], "position", "text", *more)
    return side(paragraphs, "node_id").groupBy(*place).cogroup(side(chunks, "chunk_id").groupBy(*place)).applyInPandas(solve, "paper_id string, chunk_id string, node_ids array<string>, status string")


def exact_fallback(nodes: DataFrame, chunks: DataFrame, mapped: DataFrame) -> DataFrame:
    """(paper_id, node_id, chunk_id) of nodes and chunks that are not mapped yet and have equal texts, the k-th of each with the k-th; never
    a guess. mapped: paper_id, chunk_id, node_ids."""
    text = collapse(F.col("text"))
    left = nodes.join(mapped.select("paper_id", F.explode("node_ids").alias("node_id")), ["paper_id", "node_id"], "left_anti").select("paper_id", "node_id", "position", text.alias("flat")).where("flat <> ''")
    right = chunks.join(mapped.select("paper_id", "chunk_id"), ["paper_id", "chunk_id"], "left_anti").select("paper_id", "chunk_id", "position", text.alias("flat"))
    w = Window.partitionBy("paper_id", "flat").orderBy("position")
    return left.withColumn("k", F.row_number().over(w)).join(right.withColumn("k", F.row_number().over(w)), ["paper_id", "flat", "k"]).select("paper_id", "node_id", "chunk_id")


def match_leaves(nodes: DataFrame, chunks: DataFrame, alike: bool = False) -> DataFrame:
    """(paper_id, node_id, chunk_id, score): leaves (paper_id, node_id, node_type, position, text) with chunks (paper_id, chunk_id, chunk_type,
    position, text) of a paper, one to one, best first: equal texts, a leaf inside a chunk, a chunk inside a leaf, and with alike those much
    like each other. Tables and figures that are left go by their order, with score 0."""
    found = cut_table(leafmatch.match(nodes, chunks, alike))
    by_order = None
    for kind, chunk_kind in (("table", "table_summary"), ("figure", "figure")):
        left = nodes.where(F.col("node_type") == kind).join(found, ["paper_id", "node_id"], "left_anti").select("paper_id", "node_id", "position")
        right = chunks.where(F.col("chunk_type") == chunk_kind).join(found, ["paper_id", "chunk_id"], "left_anti").select("paper_id", "chunk_id", F.col("position").alias("chunk_position"))
        rest = zip_by_order(left, right, "paper_id", "position", "chunk_position").select("paper_id", "node_id", "chunk_id", F.lit(0.0).alias("score"))
        by_order = rest if by_order is None else by_order.unionByName(rest)
    return found.unionByName(by_order)


def navigate_structure(nodes: DataFrame, queries: DataFrame, most: int = 8) -> DataFrame:
    """(paper_id, query_id, node_id, score, place): leaves by twice the share of a query's terms in their path, title and first words, and what
    a table or a results section adds."""
    asked = queries.select("query_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("terms")).where(F.size("terms") > 0)
    rows = leaves(nodes).join(F.broadcast(asked))
    path = F.lower(F.array_join("breadcrumb", " "))
    seen = F.lower(F.concat_ws(" ", F.array_join("breadcrumb", " "), "title", F.substring("text", 1, 120)))
    hits = F.size(F.filter("terms", lambda t: F.contains(seen, t)))
    score = 2.0 * hits / F.size("terms") + F.when(F.contains(path, F.lit("table")), 0.6).otherwise(0.0) + F.when(F.contains(path, F.lit("results")), 0.25).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy("paper_id", "query_id").orderBy(F.desc("score"), "node_id"))
    return rows.withColumn("score", score).where("score > 0").withColumn("place", place).where(F.col("place") <= most).select("paper_id", "query_id", "node_id", "score", "place")


def stats(nodes: DataFrame) -> DataFrame:
    """(paper_id, nodes, leaves, deepest, by_type)."""
    typed = nodes.groupBy("paper_id", "node_type").agg(F.count("*").alias("n")).groupBy("paper_id").agg(F.sum("n").alias("nodes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_type", "n")))).alias("by_type"))
    deep = nodes.groupBy("paper_id").agg(F.max("level").alias("deepest"))
    ends = leaves(nodes).groupBy("paper_id").agg(F.count("*").alias("leaves"))
    return typed.join(deep, "paper_id").join(ends, "paper_id").select("paper_id", "nodes", "leaves", "deepest", "by_type")


def render(nodes: DataFrame, indent: int = 2, most: int = 80) -> DataFrame:
    """(paper_id, tree): a tree as indented lines in reading order."""
    line = F.concat(F.repeat(F.lit(" " * indent), F.col("level")), F.lit("["), "node_type", F.lit("] "), F.substring(F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(collapse(F.col("text"))), 1, most))
    return nodes.select("paper_id", F.struct("preorder", line.alias("line")).alias("x")).groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("tree"))


def to_markdown(chunks: DataFrame) -> DataFrame:
    """(paper_id, markdown, leaves): ## for a section, ### for a subsection, #### for each leaf; a table is one leaf with all its members'
    ids. chunks: paper_id, chunk_id, chunk_type, section, subsection, position, text, table_id."""
    w = Window.partitionBy("paper_id").orderBy("position")
    own = chunks.withColumn("leaf", F.when(F.col("chunk_type").startswith("table") & F.col("table_id").isNotNull(), F.concat(F.lit("t:"), "table_id")).otherwise(F.concat(F.lit("c:"), "chunk_id")))
    leaf = own.groupBy("paper_id", "leaf").agg(
        F.min("position").alias("position"), F.min_by("section", "position").alias("section"), F.min_by("subsection", "position").alias("subsection"), F.min_by("chunk_type", "position").alias("kind"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"),
    )
    first = F.substring(collapse(F.substring_index("text", "\n", 1)), 1, 52)
    changed = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(w))
    new_section = changed("section") | F.lag("leaf").over(w).isNull()
    new_part = F.col("subsection").isNotNull() & (new_section | changed("subsection"))
    lines = F.concat_ws("\n\n", F.when(new_section, F.concat(F.lit("## "), F.coalesce("section", F.lit("Document")))), F.when(new_part, F.concat(F.lit("### "), F.col("subsection"))), F.concat(F.lit("#### "), first), F.col("text"))
    return leaf.withColumn("part", lines).groupBy("paper_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "part"))), lambda x: x["part"]), "\n\n").alias("markdown"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_ids"))), lambda x: x["chunk_ids"]).alias("leaves"),
    )


def blocks_to_markdown(blocks: DataFrame) -> DataFrame:
    """(document_id, markdown): articles as Markdown with headings by depth, lists, tables as pipe tables, equations, and floats after the block
    that mentions them first."""
    mention = blocks.select("document_id", "block_seq", F.explode("refs").alias("source_id")).groupBy("document_id", "source_id").agg(F.min("block_seq").alias("_at"))
    placed = place_floats(blocks).join(mention, ["document_id", "source_id"], "left")
    seq = F.when(F.col("block_type").isin(*FLOATS) & F.col("_at").isNotNull(), F.col("_at") + 0.5).otherwise(F.col("block_seq").cast("double"))
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", "\\\\|")), " | "), F.lit(" |"))
    lines = F.transform("rows", lambda r: row(F.concat(F.array(F.coalesce(r["label"], F.lit(""))), F.transform(r["cells"], lambda c: c["val"]))))
    table = F.concat_ws("\n", row(F.col("columns")), row(F.transform("columns", lambda c: F.lit("---"))), F.array_join(lines, "\n"))
    label = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit("**"), "label", F.lit("** "))).otherwise(F.lit(""))
    body = (
        F.when(F.col("block_type") == "table", F.concat_ws("\n\n", F.concat(label, "content"), table)).when(F.col("block_type") == "equation", F.concat(F.lit("$$"), "content", F.lit("$$")))
        .when(F.col("block_type") == "list", F.concat_ws("\n\n", F.when(label != "", label), "content")).otherwise(F.concat(label, "content"))
    )
    w = Window.partitionBy("document_id").orderBy("seq", "block_seq")
    made = placed.withColumn("seq", seq).withColumn("body", body).withColumn("before", F.coalesce(F.lag("section_path").over(w), F.array().cast("array<string>")))
    fresh = F.filter(F.transform("section_path", lambda t, i: F.struct(t.alias("t"), i.alias("i"), (F.slice("section_path", F.lit(1), i + 1) != F.slice("before", F.lit(1), i + 1)).alias("new"))), lambda x: x["new"])
    heads = F.array_join(F.transform(fresh, lambda x: F.concat(F.repeat(F.lit("#"), F.least(x["i"] + 2, F.lit(6))), F.lit(" "), x["t"])), "\n\n")
    return made.withColumn("part", F.concat_ws("\n\n", F.when(heads != "", heads), "body")).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block_seq", "part"))), lambda x: x["part"]), "\n\n").alias("markdown"))


def tidy_markdown(text: Column) -> Column:
    """A bold line alone becomes a heading; blank lines are not repeated."""
    headed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^\*\*([^*\n]{1,120}?):?\*\*[ \t]*$", "#### $1")
    return F.btrim(F.regexp_replace(headed, r"\n{3,}", "\n\n"), F.lit("\n "))


def is_image(href: Column) -> Column:
    return F.lower(F.regexp_replace(href, r"[?#].*$", "")).rlike(rf"\.(?:{'|'.join(IMAGES)})$")


def resolve_media(text: Column, base: Column) -> Column:
    """Image links of Markdown that are no address of their own, below base."""
    return F.regexp_replace(text, F.lit(r"(!\[[^\]]*\]\()(?![a-z][a-z0-9+.-]*:|/)"), F.concat(F.lit("$1"), F.rtrim(base, F.lit("/")), F.lit("/")))
