"""Replays of finite data: batches, adaptive windows and cumulative rankings."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, numbered
from .challenge import binary_earnings
from .ranking import ranked


def batches(problems: DataFrame, increment: int = 100, order: str = "sequential", seed: int = 0) -> DataFrame:
    """problems with `batch` from 0, in the order of problem_seq, of end_time, or of a seeded hash.
    Only narrow rows are numbered, in ranges."""
    key = {"sequential": F.col("problem_seq"), "time": F.col("end_time"), "random": F.xxhash64("problem_id", F.lit(seed))}[order]
    ids = numbered(problems.select("problem_id", "problem_seq", key.alias("key")), "key", "problem_seq", "problem_id")
    return problems.join(ids.select("problem_id", F.floor(F.col("n") / increment).alias("batch")), "problem_id")


def _windows(counts: list[tuple[date, int]], step_days: int, least: int) -> list[tuple[date, date]]:
    """(date, last date of its window) for dates in order with their numbers of problems."""
    rows: list[tuple[date, date]] = []
    start, k = counts[0][0], 0
    while k < len(counts):
        end, held, first = start + timedelta(days=step_days), 0, k
        while True:
            while k < len(counts) and counts[k][0] <= end:
                held += counts[k][1]
                k += 1
            if held >= least or k == len(counts):
                break
            end += timedelta(days=step_days)
        rows += [(d, end) for d, _ in counts[first:k]]
        start = end
    return rows


def adaptive_windows(problems: DataFrame, step_days: int = 1, least: int = 1, by: str | None = None) -> DataFrame:
    """problems with `window_end`: windows of step_days that widen until they hold `least`
    problems, for each value of `by` apart. Boundaries come from one count for each date (and value); problems without an end time go."""
    group = F.col(by).cast("string") if by else F.lit("")
    dated = problems.where("end_time is not null").withColumn("_by", F.coalesce(group, F.lit(""))).withColumn("_d", F.to_date("end_time"))
    counts: dict[str, list] = {}
    for r in dated.groupBy("_by", "_d").count().orderBy("_by", "_d").collect():
        counts.setdefault(r["_by"], []).append((r["_d"], r["count"]))
    rows = [(v, d, end) for v, c in counts.items() for d, end in _windows(c, step_days, least)]
    labels = problems.sparkSession.createDataFrame(rows, "_by string, _d date, window_end date")
    return dated.join(labels, ["_by", "_d"]).drop("_by", "_d")


def _running(part: DataFrame, by, at: str, sums: tuple, last: Column) -> DataFrame:
    """part with running totals of `sums` by place `at`, each row repeated for the places up to the next one (or `last`): a forward
    fill without a grid of all places and groups."""
    w = Window.partitionBy(*by).orderBy(at)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = part.select("*", *(F.sum(c).over(run).alias(f"_{c}") for c in sums), F.coalesce(F.lead(at).over(w) - 1, last).alias("_to"))
    fill = F.explode(F.sequence(F.col(at).cast("long"), F.col("_to").cast("long"))).alias("_at")
    return x.where(F.col("_to") >= F.col(at)).select("*", fill).drop(at, "_to", *sums).withColumnsRenamed({"_at": at, **{f"_{c}": c for c in sums}})


def cumulative(scores: DataFrame, label: str, user: str = "username", ascending: bool = False, by=()) -> DataFrame:
    """(*by, label, user, score, n, rank) after each label, over all rows so far. A user
    appears from the first label on and stays. Scores are summed once; labels are numbered, and totals
    carried forward over the numbers."""
    part = cut(scores.groupBy(*by, label, user).agg(F.sum("score").alias("s"), F.count("score").alias("n")))
    places = part.select(*by, label).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last(label))))
    places = cut(places.withColumn("_last", F.count("*").over(Window.partitionBy(*by))))
    key = F.col(f"p.{label}").eqNullSafe(F.col(f"l.{label}"))
    for c in by:
        key = key & F.col(f"p.{c}").eqNullSafe(F.col(f"l.{c}"))
    x = part.alias("p").join(places.alias("l"), key).select(*(F.col(f"p.{c}") for c in (*by, user, "s", "n")), "_k", "_last")
    x = _running(x, [*by, user], "_k", ("s", "n"), F.col("_last")).drop("_last")
    key = F.col("x._k") == F.col("l._k")
    for c in by:
        key = key & F.col(f"x.{c}").eqNullSafe(F.col(f"l.{c}"))
    x = x.alias("x").join(places.alias("l"), key).select(*(F.col(f"x.{c}") for c in by), F.col(f"l.{label}"), F.col(f"x.{user}"), F.try_divide("s", "n").alias("score"), F.col("x.n").alias("n"))
    return ranked(x, ascending, [*by, label])


def every_days(scores: DataFrame, days: int, ascending: bool = True, by=(), include_tail: bool = False, how: str = "mean") -> DataFrame:
    """Weighted means of scores (close_time, weight, score) up to each cutoff, or with
    how="roi" the summed score over the summed cost. Rows after the last whole
    step appear with include_tail only. Scores are computed once, and written as narrow rows."""
    top, low = (F.col("score") * F.col("weight"), F.col("weight")) if how == "mean" else (F.col("score"), F.col("cost"))
    x = cut(scores.select(*by, "forecaster", F.unix_micros("close_time").alias("t"), top.alias("s"), low.alias("w")))
    step = 86_400_000_000 * days
    span = x.groupBy(*by).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).withColumn("last", F.floor((F.col("hi") - F.col("lo")) / step) + int(include_tail))
    if by:
        x = x.join(span, list(by))
    else:
        lo, last = (lambda r: (r["lo"], r["last"]))(span.first())  # one row
        x = x.withColumns({"lo": F.lit(lo).cast("long"), "last": F.lit(last).cast("long")})
    x = x.withColumn("k", F.ceil((F.col("t") - F.col("lo")) / step))
    part = x.where("k <= last").groupBy(*by, "forecaster", "k", "last").agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.count("*").alias("n"))
    y = _running(part, [*by, "forecaster"], "k", ("s", "w", "n"), F.col("last"))
    y = y.select(*by, "forecaster", (F.col("k") * days).alias("day"), F.try_divide("s", "w").alias("score"), F.col("n").alias("n_predictions"))
    return ranked(y, ascending, [*by, "day"])


def return_curves(problems: DataFrame, forecasts: DataFrame, risk_aversions=(0.0, 0.5, 1.0), increment: int = 50) -> DataFrame:
    """(risk_aversion, batch, username, score, n, rank): average returns after each batch of problems, for each aversion to risk."""
    labels = cut(batches(problems, increment).select("problem_id", "batch"))
    parts = [binary_earnings(problems, forecasts, g).select("problem_id", "username", "score", F.lit(float(g)).alias("risk_aversion")) for g in risk_aversions]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return cumulative(every.join(labels, "problem_id"), "batch", by=("risk_aversion",))
