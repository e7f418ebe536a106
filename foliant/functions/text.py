"""Scalar text functions as Column expressions: tokens, cleaning, overlap, statistics detectors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"

# Words that carry no content in overlap measures.
STOP_WORDS = (
    "a an and are as at be been by can could did do does for from had has have how if in into is it its may more most no not of on or our "
    "should so such than that the their them then there these they this those to was we were what when where which who why will with would"
).split()

# How statistics are written in running text, by field.
FIELD_PATTERNS = {
    "percentage": r"\d+(?:\.\d+)?\s*%|\d+\s*\(\s*\d+\s*\)",
    "p-value": r"(?i)\bp(?:-value)?\s*[=<>]\s*0?\.?\d+",
    "confidence_interval": r"(?i)95\s*%\s*ci|confidence interval",
    "effect_estimate": r"(?i)\b(?:or|hr|rr)\s*[=:]\s*\d",
    "sample_size": r"(?i)\bn\s*[=:]\s*\d+",
}
# How table columns and cells say what they hold.
P_COLUMN = r"(?i)^\s*p(?:-value| value)?\s*$"
P_CELL = r"(?i)^\s*(?:p\s*[=<>]\s*)?[=<>]*\s*(?:0?\.\d+|\d+\.\d+|\d+)\s*$"
SHARE_COLUMN, SHARE_CELL = r"(?i)%|percent", r"\d+\s*\(\s*\d+\s*\)|\d+(?:\.\d+)?\s*%"
INTERVAL_COLUMN, INTERVAL_CELL = r"(?i)ci|confidence interval", r"(?i)\b\d+(?:\.\d+)?\s*[-\u2013]\s*\d+(?:\.\d+)?\b|95\s*%\s*ci|confidence interval"
EFFECT_COLUMN, EFFECT_WORDS, SHORT_LABEL = r"(?i)^(?:adjusted\s*)?(?:or|hr|rr|aor|ahr|ahrr)\b", r"(?i)\b(?:odds ratio|hazard ratio|relative risk)\b", 14
EFFECT_NOTE = r"(?i)\b(?:odds ratio|hazard ratio|relative risk|adjusted or|adjusted hr)\b"

# Section titles by kind.
SECTION_EXCLUDED = ("graphical abstract", "supplementary material", "supplementary data", "publisher's note")
SECTION_REFERENCES = ("references", "bibliography", "works cited", "literature cited")
SECTION_ADMINISTRATIVE = (
    "acknowledgements", "acknowledgments", "author contributions", "authors' contributions", "funding", "conflict of interest", "conflicts of interest",
    "competing interests", "data availability", "data availability statement", "ethics statement", "ethics approval", "abbreviations", "disclosure",
)

# How texts begin that are no content.
NO_CONTENT_STARTS = (
    "all claims expressed in this article", "this article was prepared", "publisher's note", "availability of data and materials", "data availability", "conflict of interest", "competing interests", "ethics approval",
    "ethical approval", "ethics statement", "funding statement", "funding sources", "acknowledgements", "acknowledgments", "author contributions", "consent to publish", "consent for publication", "the authors declare",
    "abbreviations (in order of appearance", "abbreviations", "supplementary information", "supplementary materials", "declarations", "editor's note", "correction to:", "this is a summary of",
)


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """The tokens of the lower-cased text, in order; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def content_tokens(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Distinct tokens that are not stop words, in order of first use."""
    return F.array_except(F.array_distinct(tokens(text)), F.array(*[F.lit(w) for w in stop]))


def collapse(text: Column) -> Column:
    """Line ends and no-break spaces as blanks, runs of white space as one, trimmed."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{00A0}]+", " "))


def strip_markup(text: Column) -> Column:
    return collapse(F.regexp_replace(text, "<[^>]+>", " "))


def unwrap_links(text: Column) -> Column:
    """Markdown links as their text."""
    return F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.btrim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), 1, n), " ")


def token_estimate(text: Column) -> Column:
    """A quarter of the length, 1 at least, 0 for an empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def phrase_in(text: Column, phrase: Column) -> Column:
    return F.contains(F.lower(text), F.lower(phrase))


def fraction_overlap(terms: Column, text: Column) -> Column:
    """Mean over terms: 1 where the phrase occurs, one half where all its words do, else 0; 0 without terms."""
    low, words = F.lower(F.coalesce(text, F.lit(""))), tokens(text)
    each = F.transform(
        terms,
        lambda t: F.when(F.contains(low, F.lower(t)), F.lit(1.0))
        .when((F.size(tokens(t)) > 0) & (F.size(F.array_except(tokens(t), words)) == 0), F.lit(0.5))
        .otherwise(F.lit(0.0)),
    )
    return F.when(F.size(terms) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(terms)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, each joined by blanks. words should be a column, not an expression: it is read in each run."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def detect_fields(text: Column) -> Column:
    """The statistics that a text reports, as an array of field names."""
    return F.array_compact(F.array(*[F.when(F.regexp(F.coalesce(text, F.lit("")), F.lit(p)), F.lit(name)) for name, p in FIELD_PATTERNS.items()]))


def detect_row_fields(variable: Column, cells: Column, footnotes: Column) -> Column:
    """The statistics that a table row reports, as an array of field names: what a cell holds depends on its column's name
    (cells: array of struct col, val); the row's name and the table's footnotes count too."""
    named, notes = F.coalesce(variable, F.lit("")), F.array_join(F.coalesce(footnotes, F.array().cast("array<string>")), " ")
    value = lambda c: F.coalesce(c["val"], F.lit(""))
    some = lambda test: F.coalesce(F.exists(cells, test), F.lit(False))
    short = lambda c: (F.length(F.btrim(c["col"])) <= SHORT_LABEL) & F.btrim(c["col"]).rlike(EFFECT_COLUMN)
    found = {
        "percentage": some(lambda c: c["col"].rlike(SHARE_COLUMN) & value(c).rlike(SHARE_CELL)) | named.rlike(SHARE_CELL),
        "p-value": some(lambda c: c["col"].rlike(P_COLUMN) & (value(c).rlike(P_CELL) | value(c).rlike(FIELD_PATTERNS["p-value"]))),
        "confidence_interval": some(lambda c: c["col"].rlike(INTERVAL_COLUMN) & value(c).rlike(INTERVAL_CELL)) | notes.rlike(FIELD_PATTERNS["confidence_interval"]),
        "effect_estimate": some(lambda c: (short(c) | c["col"].rlike(EFFECT_WORDS)) & value(c).rlike(r"\d")) | notes.rlike(EFFECT_NOTE),
        "sample_size": some(lambda c: value(c).rlike(FIELD_PATTERNS["sample_size"])) | named.rlike(FIELD_PATTERNS["sample_size"]),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in found.items()]))


def requested_fraction(detected: Column, requested: Column) -> Column:
    """The share of requested fields that were detected; 1 if none is requested."""
    n = F.size(F.array_distinct(requested))
    return F.when(n > 0, F.size(F.array_intersect(detected, requested)) / n).otherwise(F.lit(1.0))


def section_kind(title: Column) -> Column:
    t = F.lower(F.btrim(F.coalesce(title, F.lit("")), F.lit(" .:")))
    return (
        F.when(t.isin(*SECTION_EXCLUDED), "excluded").when(t.isin(*SECTION_REFERENCES), "references").when(t.isin(*SECTION_ADMINISTRATIVE), "administrative").otherwise("content")
    )


def substitute_synonyms(text: Column, pairs: dict[str, str]) -> Column:
    """Whole words and phrases replaced, longest first, whatever their case."""
    for old, new in sorted(pairs.items(), key=lambda p: (-len(p[0]), p[0])):
        text = F.regexp_replace(text, rf"(?i)\b{re.escape(old)}\b", new.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.btrim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s != "")


def iso_date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def key_values(text: Column, separator: str = ":") -> Column:
    """Lines "label: value" as an array of structs; values may hold the separator."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.contains(x, F.lit(separator)))
    return F.transform(lines, lambda x: F.struct(F.btrim(F.substring_index(x, separator, 1)).alias("label"), F.btrim(F.regexp_replace(x, rf"^[^{separator}]*{separator}", "")).alias("value")))


def non_content(section: Column, text: Column, sections: tuple[str, ...] = SECTION_ADMINISTRATIVE + SECTION_REFERENCES, starts: tuple[str, ...] = (*NO_CONTENT_STARTS, "copyright", "supplementary")) -> Column:
    """Whether a chunk is no content: its section is one of these, or its text begins with one of these."""
    low = F.lower(F.ltrim(F.coalesce(text, F.lit(""))))
    begins = low.rlike("^(?:" + "|".join(map(re.escape, starts)) + ")")
    return F.lower(F.btrim(F.coalesce(section, F.lit("")))).isin(*sections) | begins


def information(sentence: Column) -> Column:
    """How much a sentence says: its content words, and two for each number."""
    return F.size(content_tokens(sentence)) + 2 * F.size(F.regexp_extract_all(F.coalesce(sentence, F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def entity_phrases(text: Column, n: int = 3) -> Column:
    """The first n runs of two words or more that begin with a capital, without repetitions."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{Lu}[\p{L}\p{N}-]*(?: \p{Lu}[\p{L}\p{N}-]*)+"), F.lit(0))), 1, n)


def acronyms(text: Column) -> Column:
    """Words of 2 to 12 ASCII letters, digits and hyphens with two capitals or more, in order of first use."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}-]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: w.rlike("^[A-Za-z][A-Za-z0-9-]{1,11}$") & (F.length(F.regexp_replace(w, "[^A-Z]", "")) >= 2)))
