"""Chunks from texts and blocks: splitting, packing, neighbours, tables, Markdown profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import token_estimate

TARGET, HARD = 1600, 3200
#: Where an oversized paragraph may be cut, best place first.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", " ")


def line_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, document_id, position, text, the columns to keep): the lines that are not blank, position counting all lines from 0."""
    lines = docs.select(*keep, F.col(doc_id).alias("document_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("position", "text"))
    return lines.where(F.col("text").rlike(r"\S")).select(F.concat_ws("_", F.lit("D"), "document_id", "position").alias("chunk_id"), "document_id", "position", "text", *keep)


def embedding_text(breadcrumb: Column, text: Column, prefix: Column | None = None) -> Column:
    """Prefix, breadcrumb and text as paragraphs; blank parts are left out."""
    crumb = F.concat_ws(" > ", breadcrumb)
    parts = F.array(*([prefix] if prefix is not None else []), crumb, text)
    return F.array_join(F.filter(parts, lambda p: F.coalesce(F.btrim(p), F.lit("")) != ""), "\n\n")


def with_parent_fields(chunks: DataFrame) -> DataFrame:
    """section is the first crumb, subsection the last if there are several."""
    crumbs = F.col("breadcrumb")
    return chunks.withColumn("section", F.try_element_at(crumbs, F.lit(1))).withColumn("subsection", F.when(F.size(crumbs) > 1, F.try_element_at(crumbs, F.lit(-1))))


def unique_ids(rows: DataFrame, document: str, candidate: str, order: str) -> DataFrame:
    """candidate with _1, _2 ... from its second use in a document on."""
    n = F.row_number().over(Window.partitionBy(document, candidate).orderBy(order)) - 1
    return rows.withColumn("unique_id", F.when(n > 0, F.concat_ws("_", candidate, n)).otherwise(F.col(candidate)))


def islands(rows: DataFrame, key: str, order: str, boundary: Column) -> DataFrame:
    """rows with the number of the run they are in; a boundary row is a run of its own."""
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_b", boundary.cast("int"))
    starts = F.when((F.col("_b") == 1) | (F.coalesce(F.lag("_b").over(w), F.lit(1)) == 1), 1).otherwise(0)
    return rows.withColumn("_s", starts).withColumn("island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b", "_s")


def split_recursively(text: str, most: int = TARGET, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most most characters: split at the best separator that occurs, put together again as far as they
    fit, and what is still too long split at the next; a word without any is cut."""
    if len(text) <= most:
        return [text] if text.strip() else []
    rest = separators
    while rest and rest[0] not in text:
        rest = rest[1:]
    if not rest:
        return [text[i : i + most] for i in range(0, len(text), most)]
    parts = text.split(rest[0])
    parts = [p + rest[0] for p in parts[:-1]] + parts[-1:]
    out, now = [], ""
    for p in parts:
        if len(now) + len(p) <= most:
            now += p
            continue
        if now.strip():
            out.append(now.strip())
        if len(p) <= most:
            now = p
        else:
            pieces = split_recursively(p, most, rest[1:])
            out += pieces[:-1]
            now = pieces[-1] if pieces else ""
    if now.strip():
        out.append(now.strip())
    return out


def pack_paragraphs(paragraphs: list[str], target: int = TARGET, hard: int = HARD) -> list[list[int]]:
    """Chunks as lists of paragraph numbers: paragraphs are joined by a blank line while they fit target; a longer one
    stays alone; one beyond hard is a chunk of its own that is split further."""
    out: list[list[int]] = []
    now: list[int] = []
    length = 0
    for i, p in enumerate(paragraphs):
        if len(p) > target:
            if now:
                out.append(now)
            out.append([i])
            now, length = [], 0
        elif now and length + 2 + len(p) > target:
            out.append(now)
            now, length = [i], len(p)
        else:
            length += len(p) + (2 if now else 0)
            now.append(i)
    if now:
        out.append(now)
    return out


def prose_chunks(blocks: DataFrame, target: int = TARGET, hard: int = HARD) -> DataFrame:
    """(document_id, island, seq, text, first_block, last_block) of blocks(document_id, island, block_seq, content):
    paragraphs of one run packed greedily. Runs are as long as a section, so a group is small."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block_seq")
        texts, places = rows["content"].fillna("").tolist(), rows["block_seq"].tolist()
        out = []
        for group in pack_paragraphs(texts, target, hard):
            joined = "\n\n".join(texts[i] for i in group)
            for piece in split_recursively(joined, target) if len(joined) > hard else [joined]:
                out.append((key[0], key[1], len(out), piece, places[group[0]], places[group[-1]]))
        return pd.DataFrame(out, columns=["document_id", "island", "seq", "text", "first_block", "last_block"])

    kind = blocks.schema["document_id"].dataType.simpleString()
    return blocks.groupBy("document_id", "island").applyInPandas(run, f"document_id {kind}, island long, seq int, text string, first_block long, last_block long")


def neighbours(chunks: DataFrame, n: int, by: list[str], order: str = "position") -> DataFrame:
    """(chunk_id, neighbour_id, distance) up to n chunks before and after in the same section, from one window."""
    w = Window.partitionBy(*by).orderBy(order)
    near = F.array(*[F.struct((F.lead("chunk_id", k) if k > 0 else F.lag("chunk_id", -k)).over(w).alias("neighbour_id"), F.lit(k).alias("distance")) for k in range(-n, n + 1) if k])
    return chunks.select("chunk_id", near.alias("near")).select("chunk_id", F.inline("near")).where("neighbour_id is not null")


def token_budget(rows: DataFrame, anchor: str, order: str, tokens: str, most_nodes: int, most_tokens: int) -> DataFrame:
    """Of each anchor's nodes, in order, the first most_nodes that fit most_tokens together; the first always
    stays, and the first that does not fit ends it. Sizes are not negative, so a running sum is exact."""
    w = Window.partitionBy(anchor).orderBy(order)
    kept = rows.withColumn("_n", F.row_number().over(w)).withColumn("_t", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.where((F.col("_n") == 1) | (F.col("_n") <= most_nodes) & (F.col("_t") <= most_tokens)).drop("_n", "_t")


def assemble_tables(chunks: DataFrame, rows_around: int | None = None) -> DataFrame:
    """(paper_id, table_id, caption, headers, rows, footnotes) of table chunks: the summary's first line and column
    list, rows by position, footnotes."""
    parts = chunks.where("table_id is not null").groupBy("paper_id", "table_id").agg(
        F.max(F.when(F.col("chunk_type") == "table_summary", F.col("text"))).alias("summary"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("chunk_type") == "table_row", F.struct("position", "text")))), lambda r: r["text"]).alias("rows"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("chunk_type") == "table_footnotes", F.struct("position", "text")))), lambda r: r["text"]).alias("footnotes"),
    )
    return parts.select("paper_id", "table_id", F.substring_index("summary", "\n", 1).alias("caption"), summary_columns(F.col("summary")).alias("headers"), "rows", "footnotes")


def summary_columns(summary: Column) -> Column:
    """The bullet list after "Columns:" in a table summary."""
    listed = F.regexp_extract(F.coalesce(summary, F.lit("")), r"(?s)Columns:\s*\n((?:\s*-[^\n]*\n?)*)", 1)
    return F.transform(F.filter(F.split(listed, "\n"), lambda x: F.btrim(x) != ""), lambda x: F.regexp_replace(x, r"^\s*-\s*", ""))


def table_context(chunks: DataFrame, rows_around: int = 8, footnotes: int = 2, most: int = 3500) -> DataFrame:
    """(paper_id, table_id, chunk_id, context) of each chunk of a table: caption, headers, the rows around it, footnotes, cut at most
    characters. A row's are those before and after it, a summary's or footnote's the table's first ones. Rows meet in a window, so that a long
    table is not carried along with each of its rows."""
    key = ["paper_id", "table_id"]
    own = chunks.where("table_id is not null").select(*key, "chunk_id", "chunk_type", "position", "text")
    note = F.when(F.col("chunk_type") == "table_footnotes", F.struct("position", "chunk_id", "text"))
    # of footnotes and first rows only as many are gathered as are shown
    place = F.row_number().over(Window.partitionBy(*key, "chunk_type").orderBy("position", "chunk_id"))
    first = own.withColumn("n", place).where((F.col("chunk_type") == "table_summary") | (F.col("n") <= F.when(F.col("chunk_type") == "table_row", 2 * rows_around + 1).otherwise(footnotes)))
    texts = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["text"])
    row = F.when(F.col("chunk_type") == "table_row", F.struct("position", "chunk_id", "text"))
    heads = first.groupBy(*key).agg(F.max(F.when(F.col("chunk_type") == "table_summary", F.col("text"))).alias("summary"), texts(note).alias("notes"), texts(row).alias("lead"))
    w = Window.partitionBy(*key).orderBy("position", "chunk_id").rowsBetween(-rows_around, rows_around)
    rows = own.where("chunk_type = 'table_row'").withColumn("around", F.collect_list("text").over(w)).drop("chunk_type", "position", "text")
    others = own.where("chunk_type <> 'table_row'").select(*key, "chunk_id", F.lit(None).cast("array<string>").alias("around"))
    caption = F.coalesce(F.substring_index("summary", "\n", 1), F.concat(F.lit("Table "), "table_id"))
    text = F.concat_ws("\n", caption, F.nullif(F.concat_ws(" | ", summary_columns(F.col("summary"))), F.lit("")), F.concat_ws("\n", F.coalesce("around", "lead")), F.nullif(F.concat_ws("\n", "notes"), F.lit("")))
    return rows.unionByName(others).join(heads, key).select(*key, "chunk_id", F.substring(text, 1, most).alias("context"))


def zip_by_order(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """The k-th row of left with the k-th of right, in each key."""
    one = left.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(left_order)))
    return one.join(right.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(right_order))), [key, "k"])


def markdown_profile(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_headings, deepest, n_jumps, n_html_tables, n_pipe_tables, n_captions, n_bound, n_notes, n_note_uses, n_open_notes) of Markdown texts: headings, and
    jumps by more than one level; tables in markup, which may span lines, and runs of piped lines outside of them; lines that begin as captions of tables, and
    those with a table as the next or the last line that is not blank; footnotes that are defined, uses of footnotes, and names used without
    a definition. Inside a table in markup nothing else is counted. A line's state follows from windows over the lines before it."""
    own = Window.partitionBy("doc_id").orderBy("n")
    before, after = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    count = lambda p: F.size(F.regexp_extract_all("line", F.lit(p), F.lit(0)))
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "line"))
    lines = lines.withColumns({"opens": count(r"(?i)<table\b"), "ends": count(r"(?i)</table>")})
    # open tables: the sum so far above its least value, since an end without a start closes nothing
    lines = lines.withColumn("level_sum", F.sum(F.col("opens") - F.col("ends")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = F.coalesce(F.lag("level_sum").over(own), F.lit(0))
    least = F.least(F.lit(0), F.coalesce(F.min("level_sum").over(before), F.lit(0)))
    lines = lines.withColumn("inside", so_far - least > 0).withColumn("markup", F.col("inside") | (F.col("opens") > 0))
    free = lambda c: F.when(~F.col("markup"), c)
    lines = lines.withColumns({
        "level": F.when(~F.col("markup") & F.col("line").rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract("line", "^(#+)", 1))), "pipe": ~F.col("markup") & F.col("line").rlike(r"^\s*\|.*\|\s*$"),
        "caption": ~F.col("markup") & F.col("line").rlike(r"^\s*\**(?:Table|Tab\.)\s*\d+"), "note": free(F.regexp_extract("line", r"^\s*\[\^([^\]\s]+)\]:", 1)),
        "uses": free(F.regexp_extract_all(F.regexp_replace("line", r"^\s*\[\^[^\]\s]+\]:", ""), F.lit(r"\[\^([^\]\s]+)\]"), F.lit(1))), "blank": ~F.col("line").rlike(r"\S"),
    })
    table = F.when(~F.col("blank"), F.col("pipe") | F.col("markup"))
    lines = lines.withColumns({
        "heading_before": F.last("level", ignorenulls=True).over(before), "pipe_before": F.coalesce(F.lag("pipe").over(own), F.lit(False)),
        "near": F.coalesce(F.first(table, ignorenulls=True).over(after), F.lit(False)) | F.coalesce(F.last(table, ignorenulls=True).over(before), F.lit(False)),
    })
    named = F.collect_set(F.nullif("note", F.lit("")))
    long = lambda c: c.cast("long")
    return lines.groupBy("doc_id").agg(
        F.count("level").alias("n_headings"), long(F.coalesce(F.max("level"), F.lit(0))).alias("deepest"), F.count_if(F.col("level") - F.col("heading_before") > 1).alias("n_jumps"), long(F.sum("opens")).alias("n_html_tables"),
        F.count_if(F.col("pipe") & ~F.col("pipe_before")).alias("n_pipe_tables"), F.count_if("caption").alias("n_captions"), F.count_if(F.col("caption") & F.col("near")).alias("n_bound"), F.count_if(F.col("note") != "").alias("n_notes"),
        long(F.coalesce(F.sum(F.when(F.col("uses").isNotNull(), F.size("uses"))), F.lit(0))).alias("n_note_uses"), long(F.size(F.array_except(F.array_distinct(F.flatten(F.collect_list("uses"))), named))).alias("n_open_notes"),
    )


def estimated(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.withColumn("tokens", token_estimate(F.col(text)))


def similarity_ratio(pairs: DataFrame, a: str, b: str, name: str = "ratio") -> DataFrame:
    """pairs with the Ratcliff-Obershelp ratio of two string columns; cheap gates belong before this."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(x: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for one, two in x:
            yield pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(one, two, strict=True)])

    return pairs.withColumn(name, ratio(F.col(a), F.col(b)))
