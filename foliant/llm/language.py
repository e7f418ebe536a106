"""Language ID by Bayesian evidence fusion.

The posterior of a language is the product of the likelihood of the text (byte trigrams), of the language that the
markup declares, of the address suffix, and a prior of the host. What declarations and suffixes are worth,
and the priors, come from grouped aggregation of the texts' own posteriors over all rows; a host's prior is
smoothed towards its domain's, that towards its suffix's, and that towards all rows'. A row's own share is
taken out of the counts that judge it.

Defined results: null and empty texts, missing declarations and missing addresses are no evidence; a row
without any evidence gets the most common language; ties go to the first language by name; without labelled
texts the language is null; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import append_column, text_slices
from foliant.llm.pagetext import html_tags, main_texts
from foliant.session import cut, cut_table

#: Labelled texts of each language that the text model is fitted on, those with the smallest hash.
FIT_TEXTS = 500
#: Trigrams whose evidence counts in full; longer texts weigh as this many, since trigrams depend on each other.
FULL_TRIGRAMS = 60
#: Rows that a broader level is worth in the prior of a narrower one.
KAPPA = 5.0
#: Hosts whose counts are broadcast (a few hundred bytes each); more are joined in shares.
MOST_HOSTS = 100_000
#: Bytes of text scored at a time: each has a row of the trigram table in memory meanwhile.
STEP_BYTES = 400_000
_BITS = 16
_NONE = (1 << _BITS) - 1

_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z_-]+)""", re.I)

_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint32)


def _trigrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, trigram codes, offsets of rows + 1); the last two bytes of a text have no code."""
    for at, end, raw, offs in text_slices(column, STEP_BYTES):
        b = np.concatenate([_LOWER[raw], np.zeros(2, np.uint32)])
        codes = (((b[:-2] * np.uint32(0x10001) + b[1:-1]) * np.uint32(0x10201) + b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)
        codes = np.minimum(codes, _NONE - 1).astype(np.uint16)
        for back in (1, 2):
            stops = offs[1:] - back
            codes[stops[stops >= offs[:-1]]] = _NONE
        yield end - at, codes, offs


def fit_texts(labelled: DataFrame, fit_texts: int = FIT_TEXTS) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each trigram code by language) from labelled(lang, text)."""
    known = labelled.where("lang is not null and text is not null")
    languages = [r["lang"] for r in known.select("lang").distinct().orderBy("lang").collect()]
    parts = [known.where(F.col("lang") == name).select("lang", F.xxhash64("text").alias("h"), "text").orderBy("h").limit(fit_texts).select("lang", "text") for name in languages]
    counts = np.ones((1 << _BITS, len(languages)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << _BITS), np.int64)
        for batch in batches:
            of = np.array([languages.index(x) for x in batch.column(0).to_pylist()], np.int64)
            row = 0
            for rows, codes, offs in _trigrams(batch.column(1)):
                np.add.at(total, (np.repeat(of[row : row + rows], np.diff(offs)), codes), 1)
                row += rows
        yield pa.RecordBatch.from_arrays([pa.array(range(len(languages)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["lang", "counts"])

    if languages:
        for lang, held in reduce(DataFrame.unionByName, parts).coalesce(4).mapInArrow(count, "lang int, counts binary").collect():
            counts[:, lang] += np.frombuffer(held, np.int64)
    logs = np.log(counts / counts.sum(0)).astype(np.float32)
    logs[_NONE] = 0
    return languages, logs


def _likelihoods(column: pa.Array, logs: np.ndarray) -> pa.Array:
    out = []
    for rows, codes, offs in _trigrams(column):
        n = np.diff(offs)
        sums = np.zeros((rows, logs.shape[1]))
        some = np.flatnonzero(n > 0)
        if len(some):
            sums[some] = np.add.reduceat(logs[codes], offs[some], axis=0)
        worth = np.maximum(n - 2, 0)
        sums *= np.where(worth > 0, np.minimum(worth, FULL_TRIGRAMS) / np.maximum(worth, 1), 0)[:, None]
        out.append(sums)
    flat = np.concatenate(out) if out else np.zeros((0, logs.shape[1]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * logs.shape[1], pa.int32()), pa.array(flat.ravel()))


def declared_in(column: pa.Array) -> pa.Array:
    """The language that a page's first html start tag with one declares, empty without; the whole page is searched."""
    said = ((found[1] for tag in html_tags(page or "") if (found := _LANG.search(tag))) for at in range(0, len(column), 256) for page in column.slice(at, 256).to_pylist())
    return pa.array([next(s, "") for s in said], pa.string())


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def identify(rows: DataFrame, languages: list[str], logs: np.ndarray, read: Callable[[pa.Array], pa.Array] = lambda c: c, declared: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """rows(id columns, text, declared, host) with lang, probability, text_lang and evidence columns in place of
    text. Priors and worths are aggregated over all of rows. read() makes text of the text column, as of markup;
    declared() finds there what it declares, in place of the declared column."""
    n = len(languages)
    ids = [c for c in rows.columns if c not in ("text", "declared", "host")]
    shared = rows.sparkSession.sparkContext.broadcast(logs)
    known = F.array(*[F.lit(x) for x in languages])
    kind = T.StructType([T.StructField("logs", T.ArrayType(T.DoubleType())), T.StructField("declared", T.StringType())])

    def made(c: pa.Array) -> pa.Array:
        said = declared(c) if declared else pa.nulls(len(c), pa.string())
        return pa.StructArray.from_arrays([_likelihoods(read(c), shared.value), said], names=["logs", "declared"])

    primary = F.regexp_extract(F.lower(F.coalesce("found.declared", "declared", F.lit(""))), r"^([a-z]{2,3})(?:[-_]|$)", 1)
    held = F.struct(*[F.col(f"`{c}`") for c in ids]).alias("ids")  # so that no name of theirs meets one of this plan
    rows = rows.select(held, "text", "declared", "host")
    scored = append_column(rows, "text", "found", kind, made).select(
        "ids",
        F.when(F.array_contains(known, primary), primary).when(primary != "", "other").otherwise("none").alias("declared"),
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"),
        F.coalesce(F.regexp_extract("host", r"([^.]+)$", 1), F.lit("")).alias("suffix"),
        _softmax(F.col("found.logs")).alias("own"), F.col("found.logs").alias("logs"),
    )
    scored = cut_table(scored)  # a few numbers a row; texts are read once
    sums = [F.sum(F.col("own")[k]).alias(f"s{k}") for k in range(n)]
    # a host's rows are summed first: levels above it add up hosts, not rows
    by_host = scored.groupBy("host", "domain", "suffix", "declared").agg(F.count("*").alias("n"), *sums)
    add = [F.sum(c).alias(c) for c in ("n", *(f"s{k}" for k in range(n)))]
    level = lambda name, *keys: by_host.groupBy(*keys).agg(*add).select(*keys, F.col("n").alias(f"n_{name}"), F.array(*[F.col(f"s{k}") for k in range(n)]).alias(f"c_{name}"))
    every = by_host.agg(*add).first()
    hosts = (
        level("host", "host", "domain", "suffix").join(level("domain", "domain", "suffix"), ["domain", "suffix"]).join(level("suffix", "suffix"), "suffix")
        .drop("domain", "suffix").withColumn("n_all", F.lit(every["n"])).withColumn("c_all", F.array(*[F.lit(every[f"s{k}"]) for k in range(n)]))
    )
    joined = _with_hosts(scored.drop("domain"), cut(hosts), every["n"]).join(F.broadcast(level("declared", "declared")), "declared")
    worthless = F.array(*[F.lit(1.0 / n)] * n)

    def less(name: str) -> Column:  # the level's counts without the row's own
        return F.transform(F.arrays_zip(F.col(f"c_{name}").alias("c"), F.col("own").alias("p")), lambda x: F.greatest(x["c"] - x["p"], F.lit(0.0)))

    def smooth(name: str, broader: Column) -> Column:
        total = F.col(f"n_{name}") - 1 + KAPPA
        return F.transform(F.arrays_zip(less(name).alias("c"), broader.alias("b")), lambda x: (x["c"] + KAPPA * x["b"]) / total)

    def worth(name: str) -> Column:  # log P(value | language), up to a constant
        return F.transform(
            F.arrays_zip(less(name).alias("c"), less("all").alias("a"), F.col("p_all").alias("p")),
            lambda x: F.log((x["c"] + KAPPA * x["p"]) / (x["a"] + KAPPA * n * x["p"])),
        )

    fused = joined.withColumn("p_all", smooth("all", worthless)).withColumn("p_suffix", smooth("suffix", F.col("p_all")))
    fused = fused.withColumn("p_domain", F.when(F.col("host") != "", smooth("domain", F.col("p_suffix"))).otherwise(F.col("p_all")))
    fused = fused.withColumn("prior", F.when(F.col("host") != "", smooth("host", F.col("p_domain"))).otherwise(F.col("p_all")))
    zero = F.array(*[F.lit(0.0)] * n)
    fused = fused.select(
        "ids", "declared", "suffix", "logs", "own",
        F.transform("prior", lambda x: F.log(x)).alias("prior"),
        F.when(F.col("declared") != "none", worth("declared")).otherwise(zero).alias("w_declared"),
        F.when(F.col("suffix") != "", worth("suffix")).otherwise(zero).alias("w_suffix"),
    )
    total = F.transform(F.arrays_zip("logs", "prior", "w_declared", "w_suffix"), lambda x: x["logs"] + x["prior"] + x["w_declared"] + x["w_suffix"])
    posterior = fused.withColumn("posterior", _softmax(total))
    best = lambda c: F.element_at(known, F.array_position(c, F.array_max(c)).cast("int"))
    return posterior.select(
        "ids.*",
        best(F.col("posterior")).alias("lang"),
        F.array_max("posterior").alias("probability"),
        best(F.col("own")).alias("text_lang"),
        F.col("declared").alias("declared_lang"),
        "suffix",
    )


def _with_hosts(rows: DataFrame, hosts: DataFrame, total: int) -> DataFrame:
    """rows with their hosts' counts. Up to MOST_HOSTS hosts are broadcast; of more, those that hold more than a quarter of a partition's
    rows (at most four a partition) are broadcast, and only rows of all others are shuffled."""
    if hosts.limit(MOST_HOSTS + 1).count() <= MOST_HOSTS:
        return rows.join(F.broadcast(hosts), "host")
    bound = total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    large = hosts.where(F.col("n_host") > bound)
    rest = rows.join(F.broadcast(large.select("host")), "host", "left_anti").join(hosts.where(F.col("n_host") <= bound), "host")
    return rows.join(F.broadcast(large), "host").unionByName(rest)


def digest(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each page (page_id; markup, address and host) and each document (doc_id; its source as host)."""
    languages, logs = fit_texts(documents.select("lang", "text"))
    web = pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", F.col("html").alias("text"),
        F.lit(None).cast("string").alias("declared"), host_of(F.col("url")).alias("host"),
    )
    own = documents.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    if not languages:
        return web.unionByName(own).select("doc_id", "page_id", *[F.lit(None).cast(k).alias(c) for c, k in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared_lang", "string"), ("suffix", "string"))])
    return identify(web, languages, logs, main_texts, declared_in).unionByName(identify(own, languages, logs).withColumn("suffix", F.lit("")))
