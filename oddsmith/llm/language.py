"""Language identification by Bayesian fusion of four kinds of evidence.

Text: a naive Bayes model over hashed byte trigrams. Declared: the language
that the mark-up names. Address: a language segment of the path, else the last
label of the host. Host: a prior from grouped counts, smoothed from the whole
table to the parent domain to the host. The tables for the last three come from
a first pass by text alone, aggregated over all pages.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, slices, small, text_buffer

CELLS = 1 << 13
MAX_TRAINING = 4_000  # labelled texts at most, those of least hash
TEMPER = 0.25  # trigrams overlap and repeat: each counts for a quarter
SMOOTH_HOST, SMOOTH_PARENT = 5.0, 20.0
_MARKUP = re.compile(r"<(script|style|title)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>?", re.S | re.I)


def _cells(data: np.ndarray) -> np.ndarray:
    x = LOWER[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    return (((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def train(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log P(cell | language), from at most MAX_TRAINING rows (lang, text)."""
    known = documents.where("lang is not null and text is not null")
    ids = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING).distinct()  # ids alone are sorted
    chosen = known.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text")

    def count(batches):
        for whole in batches:
            for b in slices(whole):
                sums: dict[str, np.ndarray] = {}
                data, at = text_buffer(b.column(1))
                for lang, s, e in zip(b.column(0).to_pylist(), at[:-1], at[1:]):
                    x = sums.setdefault(lang, np.zeros(CELLS, np.int64))
                    x += np.bincount(_cells(data[s:e]), minlength=CELLS)
                yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["lang", "n"])

    total: dict[str, np.ndarray] = {}
    parts = chosen.mapInArrow(count, "lang string, n array<long>").select("lang", F.posexplode("n").alias("cell", "n")).where("n > 0")
    for r in parts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect():  # at most CELLS rows for each language
        total.setdefault(r["lang"], np.zeros(CELLS))[r["cell"]] = r["n"]
    langs = sorted(total)
    n = np.array([total[k] for k in langs], float).reshape(len(langs), CELLS) + 0.5
    return langs, np.log(n / n.sum(axis=1, keepdims=True))


def text_scores(pages: DataFrame, table: np.ndarray, col: str, markup: bool) -> DataFrame:
    """pages without the text, with `scores`: the tempered log-likelihood of each language."""
    keep = [c for c in pages.columns if c != col]
    source = pages.select(*keep, F.col(col).cast("string").alias("text"))
    schema = source.select(*keep, F.array(F.lit(0.0)).alias("scores")).schema

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                out = []
                for x in b.column(b.num_columns - 1).to_pylist():
                    x = html.unescape(_MARKUP.sub(" ", x or "")) if markup else x or ""
                    c = np.bincount(_cells(np.frombuffer(" ".join(x.split()).encode(), np.uint8)), minlength=CELLS)
                    at = np.flatnonzero(c)
                    out.append((TEMPER * (table[:, at] @ c[at])).tolist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.float64()))], [*b.schema.names[:-1], "scores"])

    return source.mapInArrow(run, schema)


def _log_table(counts: DataFrame, key: str, langs: list[str], weight: float = 1.0) -> DataFrame:
    """(key, array of log P(key | language)), with add-one smoothing over the keys."""
    sums = counts.groupBy(key).agg(*(F.sum(F.when(F.col("first") == k, F.col("n")).otherwise(0)).alias(f"n{i}") for i, k in enumerate(langs)))
    totals = sums.agg(*(F.sum(f"n{i}").alias(f"t{i}") for i in range(len(langs))), F.count("*").alias("keys"))
    x = sums.crossJoin(F.broadcast(totals))  # one row
    return x.select(key, F.array(*(weight * F.log((F.col(f"n{i}") + 1) / (F.coalesce(f"t{i}", F.lit(0)) + F.col("keys"))) for i in range(len(langs)))).alias(f"{key}_log"))


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host) for each page.

    Null html has no text evidence, null urls the empty host; the other evidence
    then decides, and such pages count for no table. Ties go to the first language in alphabetic order. Without
    training texts lang is null and confidence 0. Repeated rows and null ids stay, other columns are ignored; texts
    are read whole. Pages of one host may be a large share of all: host tables are aggregated before they move,
    and joined back as small tables.
    """
    langs, table = train(documents)
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1))
    segment = F.lower(F.regexp_extract(url, r"://[^/?#]*/([A-Za-z]{2})(?=[/?#]|\z)", 1))
    tag = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b([^<>]*+)", 1)  # of the first such tag
    page = pages.select(
        "page_id",
        host.alias("host"),
        F.when(segment != "", segment).otherwise(F.element_at(F.split(host, r"\."), -1)).alias("address"),
        F.lower(F.regexp_extract(tag, r"(?is)\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)).alias("declared"),
        "html",
    )
    if not langs:
        return page.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    names = F.array(*(F.lit(k) for k in langs))
    argmax = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    x = cut(text_scores(page, table, "html", True).withColumn("first", argmax(F.col("scores"))))
    # Pages whose text says nothing are no evidence about the others.
    counts = x.where(F.array_max("scores") > F.array_min("scores")).groupBy("host", "address", "declared", "first").agg(F.count("*").alias("n"))
    counts = cut(counts.withColumn("parent", F.substring_index("host", ".", -2)))
    of = lambda key, p: counts.groupBy(*key).agg(*(F.coalesce(F.sum(F.when(F.col("first") == k, F.col("n")).otherwise(0)), F.lit(0)).alias(f"{p}{i}") for i, k in enumerate(langs)))
    every, parent, own = of([], "e"), of(["parent"], "p"), of(["host"], "h")
    r = range(len(langs))
    total = lambda p: sum((F.col(f"{p}{i}") for i in r), F.lit(0))
    hosts = x.select("host").distinct().withColumn("parent", F.substring_index("host", ".", -2))
    prior = hosts.join(parent, "parent", "left").join(own, "host", "left").fillna(0, [f"{p}{i}" for p in "ph" for i in r]).crossJoin(F.broadcast(every))  # one row
    top = [(F.col(f"e{i}") + 1) / (total("e") + len(langs)) for i in r]
    mid = [(F.col(f"p{i}") + SMOOTH_PARENT * top[i]) / (total("p") + SMOOTH_PARENT) for i in r]
    low = [F.log((F.col(f"h{i}") + SMOOTH_HOST * mid[i]) / (total("h") + SMOOTH_HOST)) for i in r]
    prior = prior.select("host", F.array(*low).alias("host_log"))
    # One host may have a large share of the pages: its rows stay where they are unless hosts are very many.
    x = x.join(small(cut(prior)), "host", "left")
    for key in ("address", "declared"):
        x = x.join(small(cut(_log_table(counts, key, langs))), key, "left")
    post = F.array(*(sum((F.coalesce(F.get(c, F.lit(i)), F.lit(0.0)) for c in ("host_log", "address_log", "declared_log")), F.get("scores", F.lit(i))) for i in r))
    x = x.withColumn("post", post).withColumn("top", F.array_max("post"))
    share = 1 / F.aggregate("post", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    return x.select("page_id", argmax(F.col("post")).alias("lang"), F.round(share, 6).alias("confidence"), F.col("first").alias("text_lang"), "declared", "host")
