"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. Its syntax tree yields a Boolean query of trigrams that any match must
contain (an OR of ANDs, over lower-cased text). A block-wise inverted index (block, trigram -> row keys)
holds the postings of the trigrams that the rules ask for; posting lists are intersected and united per
block, and only the rows that come out are verified with the regular expression. A rule without a mandatory
trigram reads every text.

Defined results: null reads as an empty text and has no span; empty tables give empty results; repeated
rows are each reported; positions are code points, end exclusive; other columns pass through, whatever
their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import free_name
from foliant.session import cut

#: Rows in one block of the index: bounds every posting list.
BLOCK_ROWS = 4096
#: Candidates (a key and its rules) up to which their table is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 50_000
#: Trigrams kept of one conjunction; fewer than all are still mandatory.
MOST_TRIGRAMS = 4
#: Strings that a part of an expression may stand for before it counts as unknown.
MOST_STRINGS = 24


@dataclass(frozen=True)
class Rule:
    """group: the group whose length is checked against least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # maximal runs, as [0-9a-f]+ of 16 or more
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9_.~-]+:[A-Za-z0-9_.~!$&*+,;=%-]+@"),
)
RULES = BASE + MORE


# ---- trigram queries ------------------------------------------------------------------------------

Query = frozenset  # of frozensets of trigrams: any of them, all of its trigrams; the empty AND is "true"
TRUE: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    return _absorb(frozenset(x | y for x in a for y in b))


def _absorb(q: Query) -> Query:
    return frozenset(x for x in q if not any(y < x for y in q))


def _of_strings(strings: set[str]) -> Query:
    """What a text with any of these strings must contain."""
    return _absorb(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _strings_of(node) -> set[str] | None:
    """All strings that a node can match, lower-cased, or None if they are many or unknown."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        out: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                out.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < MOST_STRINGS:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 6 else None
    if name == "SUBPATTERN":
        return _strings_of_all(arg[-1])
    if name == "BRANCH":
        parts = [_strings_of_all(x) for x in arg[1]]
        return None if None in parts or sum(map(len, parts)) > MOST_STRINGS else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, body = arg
        one = _strings_of_all(body)
        if one is None or high > 3:
            return None
        out, now = set(), {""}
        for k in range(int(high) + 1):
            if k >= low:
                out |= now
            now = {a + b for a in now for b in one}
            if len(out) + len(now) > MOST_STRINGS * 4:
                return None
        return out
    if name == "AT":
        return {""}
    return None


def _strings_of_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings_of(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query_of_all(nodes) -> Query:
    query, held = TRUE, {""}
    for node in nodes:
        strings = _strings_of(node)
        if strings is not None and len(strings) * len(held) <= MOST_STRINGS:
            held = {a + b for a in held for b in strings}
            continue
        query = _both(query, _of_strings(held))
        held = {""}
        if strings is not None and len(strings) <= MOST_STRINGS:
            held = strings
            continue
        op, arg = node
        name = str(op)
        if name == "SUBPATTERN":
            query = _both(query, _query_of_all(arg[-1]))
        elif name == "BRANCH":
            query = _both(query, _absorb(frozenset().union(*(_query_of_all(x) for x in arg[1]))))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            query = _both(query, _query_of_all(arg[2]))
    return _both(query, _of_strings(held))


def trigram_query(pattern: str) -> list[list[str]] | None:
    """The ORs of ANDs of trigrams that a text must contain, lower-cased, to match; None if there are none."""
    query = _query_of_all(sre.parse(pattern))
    if frozenset() in query:
        return None
    spread = lambda x: [x[i * (len(x) - 1) // (MOST_TRIGRAMS - 1)] for i in range(MOST_TRIGRAMS)] if len(x) > MOST_TRIGRAMS else x
    return sorted(sorted(set(spread(sorted(x)))) for x in query)


# ---- the index ------------------------------------------------------------------------------------


def build_index(rows: DataFrame, key: str, text: str, trigrams: list[str], blocks: int) -> DataFrame:
    """(block, trigram, keys): posting lists of the given trigrams, each of at most a block's rows."""
    low = F.lower(F.col(text))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return (
        rows.select(F.col(key).alias("key"), F.explode(found).alias("trigram"))
        .groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram")
        .agg(F.collect_set("key").alias("keys"))
    )


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(key, kinds): the rows that can match, by intersecting and uniting posting lists block by block."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    none = F.array().cast("array<bigint>")
    of = lambda t: F.coalesce(F.try_element_at("lists", F.lit(t)), none)
    hits = [
        F.struct(F.lit(kind).alias("kind"), reduce(F.array_union, [reduce(F.array_intersect, map(of, ts)) for ts in query]).alias("keys"))
        for kind, query in queries.items()
    ]
    return (
        lists.select(F.inline(F.array(*hits)))
        .select("kind", F.explode("keys").alias("key"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    )


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """All matches that pass the rule's length, as array of (start, order, end, kind). The pieces between
    the matches give the positions."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(
        F.transform(whole, lambda m: F.length(m)).alias("n"),
        F.transform(sized, lambda m: F.length(m)).alias("g"),
        F.transform(F.slice(pieces, F.lit(1), F.size(whole)), lambda p: F.length(p)).alias("gap"),
    )
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")),
        lambda s, m: F.struct(
            (s["at"] + m["gap"] + m["n"]).alias("at"),
            F.when(
                m["g"] >= rule.least,
                F.concat(s["spans"], F.array(F.struct((s["at"] + m["gap"]).alias("start"), F.lit(order).alias("order"), (s["at"] + m["gap"] + m["n"]).alias("end"), F.lit(rule.kind).alias("kind")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return F.when(F.regexp(text, F.lit(rule.pattern)), walked).otherwise(F.array().cast(kind))


def find(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, block_rows: int = BLOCK_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, str]:
    """docs with one more column: the spans of all rules as array of (start, order, end, kind), sorted by
    start and then by the rules' order; and that column's name."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    columns = docs.columns
    key, kinds, out = (free_name(docs, x) for x in ("row_key", "can_match", "spans"))
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    flat = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # these have no hash, wherever they are nested
    # rows of equal content share a key: each stands for the others, and a collision only adds a candidate
    keyed = docs.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in flat]))
    if queries:
        trigrams = sorted({t for q in queries.values() for ts in q for t in ts})
        blocks = max(1, -(-docs.count() // block_rows))
        can = cut(candidates(build_index(keyed.select(F.col(f"`{key}`").alias("key"), content.alias("text")), "key", "text", trigrams, blocks), queries))
        small = can.limit(broadcast_rows + 1).count() <= broadcast_rows
        can = can.select(F.col("key").alias(key), F.col("kinds").alias(kinds))
        keyed = keyed.join(F.broadcast(can) if small else can, key, "left")
    else:
        keyed = keyed.withColumn(kinds, F.array().cast("array<string>"))
    parts = []
    for order, rule in enumerate(rules):
        spans = _spans(content, rule, order)
        parts.append(F.when(F.array_contains(f"`{kinds}`", rule.kind), spans) if rule.kind in queries else spans)
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    spans = F.array_sort(F.concat(*[F.coalesce(p, none) for p in parts]))
    return keyed.select(*[F.col(f"`{c}`") for c in columns], spans.alias(out)), out


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and a digest of the base kinds' spans, and all spans as a string."""
    found, spans = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    shown = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(spans, lambda s: s["order"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(shown(F.filter(spans, lambda s: s["order"] < len(BASE))), 256).alias("base_sha256"),
        shown(F.col(spans)).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by mask; same columns and rows."""
    columns = docs.columns
    found, spans = find(docs, text, rules)
    own = F.col(f"`{text}`")
    piece = lambda s, x: F.substring(own, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
    cleaned = F.aggregate(
        F.col(f"`{spans}`"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("kept")),
        lambda s, x: F.when(
            (x["start"] < s["at"]) & (s["at"] > 0), F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["kept"].alias("kept"))
        ).otherwise(F.struct(x["end"].alias("at"), F.concat(s["kept"], piece(s, x), F.lit(mask)).alias("kept"))),
        lambda s: F.concat(s["kept"], F.substring(own, s["at"] + 1, F.lit(2**31 - 1))),
    )
    return found.withColumn(text, F.when(F.size(F.col(f"`{spans}`")) > 0, cleaned).otherwise(own)).select(*[F.col(f"`{c}`") for c in columns])


def _sql_kind(order: int, rule: Rule) -> str:
    quoted = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, gaps[i] + CAST(coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(ms[i]) AS n
  FROM (SELECT doc_id, ms, g, list_transform(range(1, len(ms) + 1), lambda k: CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) AS BIGINT)) AS gaps, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}', 0) AS ms, regexp_extract_all(text, '{quoted}', {rule.group}) AS g, string_split_regex(text, '{quoted}') AS p
              FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE regexp_matches(text, '{quoted}')))
  WHERE length(g[i]) >= {rule.least}"""


SQL = f"""
WITH s AS ({" UNION ALL ".join(_sql_kind(k, r) for k, r in enumerate(RULES))}),
j AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
         string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) FILTER (o < 3) AS base,
         string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN j USING (doc_id)
"""
