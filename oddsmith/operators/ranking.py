"""From scores to rankings: aggregates, intervals and ranks."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.derive import MAX_FORECASTERS
from ..plans.lineage import cut, numbered


def z_score(level: float) -> float:
    """The two-sided normal quantile."""
    return NormalDist().inv_cdf((1 + level) / 2)


def by_round(scores: DataFrame) -> DataFrame:
    """Weights divided by the rounds of each (forecaster, event)."""
    rounds = F.size(F.collect_set("round").over(Window.partitionBy("event_ticker", "forecaster")))
    return scores.withColumn("weight", F.col("weight") / rounds)


def aggregate_scores(scores: DataFrame, how: str | Callable[[Column], Column] = "mean", by=("forecaster",)) -> DataFrame:
    """how: a name, or an aggregate of the score column."""
    s, w = F.col("score"), F.col("weight")
    fn = {
        "mean": lambda: F.try_divide(F.sum(s * w), F.sum(w)),
        "sum": lambda: F.sum(s),
        "roi": lambda: F.when(F.sum("cost") > 0, F.try_divide(F.sum(s), F.sum("cost"))).otherwise(0.0),
    }.get(how, lambda: how(s))()
    return scores.where("score is not null").groupBy(*by).agg(fn.alias("score"), F.count("*").alias("n_predictions"))


def ranked(df: DataFrame, ascending: bool = True, by=(), col: str = "score") -> DataFrame:
    """Ties share the least rank. Only a row per forecaster gets here."""
    key = F.round(col, 9)
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(key.asc() if ascending else key.desc())))


# Score columns in the order in which they are looked for, and whether less is better.
SCORE_COLUMNS = {"brier_score": True, "average_return": False, "ece_score": True, "sharpe_ratio": False}


def rank_table(df: DataFrame, score_col: str | None = None, ascending: bool | None = None, user: str = "forecaster") -> DataFrame:
    """Mean of the score column for each forecaster, ranked. Without a name the first known score column is
    taken, and without an order the one that suits it."""
    score_col = score_col or next((c for c in SCORE_COLUMNS if c in df.columns), None)
    if score_col is None:
        raise ValueError(f"no score column: name one, or have one of {', '.join(SCORE_COLUMNS)}")
    ascending = SCORE_COLUMNS.get(score_col, False) if ascending is None else ascending
    x = df.where(F.col(score_col).isNotNull()).groupBy(user).agg(F.avg(score_col).alias("score"), F.count("*").alias("n_predictions"))
    return ranked(x, ascending)


def rank_forecasters(scores: DataFrame, how: str = "mean", ascending: bool = True, normalize_by_round: bool = False, by=()) -> DataFrame:
    x = by_round(scores) if normalize_by_round else scores
    return ranked(aggregate_scores(x, how, (*by, "forecaster")), ascending, by)


def rankings(rows: DataFrame, aggregates: dict[str, tuple[Column, bool]]) -> dict[str, DataFrame]:
    """Rankings (forecaster, score, rank) by several aggregates, each with whether less is better, from one pass over rows.
    A forecaster whose aggregate is null is not ranked by it."""
    x = cut(rows.groupBy("forecaster").agg(*(a.alias(k) for k, (a, _) in aggregates.items())))  # a row for each forecaster
    return {k: ranked(x.select("forecaster", F.col(k).alias("score")).where("score is not null"), less) for k, (_, less) in aggregates.items()}


def category_and_overall(scores: DataFrame, ascending: bool = True) -> DataFrame:
    """Rankings of each category and of all, in one aggregate by grouping sets."""
    name = F.when(F.grouping("category") == 1, "(overall)").otherwise(F.col("category"))
    x = scores.where("score is not null").groupingSets([["category", "forecaster"], ["forecaster"]], "category", "forecaster")
    x = x.agg(name.alias("cat"), F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")).alias("score"), F.count("*").alias("n_predictions"))
    return ranked(x.drop("category").withColumnRenamed("cat", "category"), ascending, ["category"])


def kish_interval(scores: DataFrame, level: float = 0.95) -> DataFrame:
    """Weighted mean with the margin z * sqrt(var / n_eff). Central moments come from a
    second pass against the mean, which is joined back (a row per forecaster); the scores are worked out once, and no
    row of them moves for the mean where forecasters are MAX_FORECASTERS at most."""
    return written_interval(cut(scores.where("score is not null").select("forecaster", "score", "weight")), level)


def written_interval(s: DataFrame, level: float) -> DataFrame:
    """`kish_interval` of scores that are a written table already."""
    mean = s.groupBy("forecaster").agg(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")).alias("mean"))
    w, d = F.col("weight"), F.col("score") - F.col("mean")
    mean = cut(mean)
    x = s.join(F.broadcast(mean) if mean.count() <= MAX_FORECASTERS else mean, "forecaster").groupBy("forecaster").agg(F.first("mean").alias("score"), F.count("*").alias("n_predictions"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * d * d).alias("ss"))
    n = F.try_divide(F.col("w") * F.col("w"), F.col("w2"))
    var = F.col("ss") / F.col("w") * F.try_divide(n, n - 1)
    margin = F.when(F.col("n_predictions") <= 1, 0.0).when(F.col("w") <= 0, None).when(n <= 1, 0.0).otherwise(z_score(level) * F.sqrt(var / n))
    return ranked(x.select("forecaster", "score", "n_predictions", margin.alias("ci_margin")))


def sharpe_ratio(returns: DataFrame, baseline: float = 0.0, normalize_by_round: bool = False) -> DataFrame:
    """Mean excess return on cost over its sample deviation; a zero deviation gives 0 or an infinity."""
    x = returns.where("cost > 0").withColumn("excess", F.col("score") / F.col("cost") - baseline)
    if normalize_by_round:
        x = x.groupBy("forecaster", "event_ticker").agg((F.sum(F.col("excess") * F.col("weight")) / F.sum("weight")).alias("excess"))
    x = x.groupBy("forecaster").agg(F.avg("excess").alias("m"), F.coalesce(F.stddev_samp("excess"), F.lit(0.0)).alias("sd"), F.count("*").alias("n_predictions"))
    flat = F.when(F.col("m") == 0, 0.0).otherwise(F.signum("m") * F.lit(float("inf")))
    return ranked(x.select("forecaster", F.when(F.col("sd") == 0, flat).otherwise(F.try_divide(F.col("m"), F.col("sd"))).alias("score"), "n_predictions"), ascending=False)


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson correlation of given ranks on common forecasters; 0 where it is undefined."""
    x = a.select("forecaster", F.col("rank").alias("a")).join(b.select("forecaster", F.col("rank").alias("b")), "forecaster")
    return x.agg(F.coalesce(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")), F.lit(0.0)).alias("correlation"))


BLOCK = 1 << 16  # names whose pairs one task counts, at least
_MOST_PARTS = 1_000  # into which longer lists are cut


def inversions(p: np.ndarray) -> int:
    """Pairs of a permutation of 0 to n - 1 that stand in descending order. Bit by bit from the highest, values that agree so far and differ
    next are counted; each pass is one stable sort."""
    order, total = np.asarray(p, np.int64), 0
    for bit in range(max(1, len(order) - 1).bit_length() - 1, -1, -1):
        group, one = order >> (bit + 1), order >> bit & 1
        before = np.cumsum(one) - one  # ones that stand before, over all groups: groups are contiguous
        first = np.ones(len(order), bool)
        first[1:] = group[1:] != group[:-1]
        base = before[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        total += int((before - base)[one == 0].sum())
        order = order[np.argsort(order >> bit, kind="stable")]
    return total


def _places(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    out[np.argsort(x, kind="stable")] = np.arange(len(x))
    return out


def _tau(a: np.ndarray, b: np.ndarray) -> float:
    """Tau-a of two lists of ranks in n log n."""
    n = len(a)
    ties = lambda *x: sum(int(k) * (int(k) - 1) // 2 for k in np.unique(np.stack(x), axis=1, return_counts=True)[1]) if n else 0
    by_b = np.empty(n, np.int64)
    by_b[np.lexsort((a, b))] = np.arange(n)
    untied = n * (n - 1) // 2 - ties(a) - ties(b) + ties(a, b)
    return (untied - 2 * inversions(by_b[np.lexsort((b, a))])) / (n * (n - 1) / 2) if n > 1 else 0.0


def kendall(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tau-a over pairs of forecasters: concordant less discordant over all. Names without a rank in both are left out; fewer than two give 0.

    Up to BLOCK names are counted in one task. More are numbered in the order of either rank, which makes them a permutation, and its descents are
    counted within parts of the first order, within parts of the second one, and between cells of both from their sizes, so no
    task holds more than a part and only the sizes of cells (at most a million) reach the driver."""
    x = a.select("forecaster", F.col("rank").cast("double").alias("a")).join(b.select("forecaster", F.col("rank").cast("double").alias("b")), "forecaster").where("a is not null and b is not null")
    x = cut(x)
    n = x.count()
    if n <= BLOCK:
        return _by_group(x.withColumn("g", F.lit(0)), ["g"], "g int").select(F.col("kendall").alias("correlation")) if n else _one(a.sparkSession, 0.0)
    pairs = lambda *by: x.groupBy(*by).count().agg(F.sum(F.expr("cast(count as decimal(38, 0)) * (count - 1) / 2"))).first()[0]
    untied = n * (n - 1) // 2 - int(pairs("a")) - int(pairs("b")) + int(pairs("a", "b"))
    x = numbered(x, "a", "b", "forecaster", name="p")
    x = numbered(x, "b", "a", "forecaster", name="q").select("p", "q")
    size = max(BLOCK, -(-n // _MOST_PARTS))
    x = cut(x.select("p", "q", F.floor(F.col("p") / size).alias("i"), F.floor(F.col("q") / size).alias("k")))

    def within(rows: pa.Table) -> pa.Table:  # pairs of one part of the first order
        rows = rows.sort_by("p")
        return pa.table({"n": [inversions(_places(rows["q"].to_numpy()))]})

    def across(rows: pa.Table) -> pa.Table:  # pairs of one part of the second order that differ in the first: others ascend here
        rows = rows.sort_by([("i", "ascending"), ("q", "ascending")])
        return pa.table({"n": [inversions(_places(rows["q"].to_numpy()))]})

    down = sum(x.groupBy(by).applyInArrow(fn, "n long").agg(F.sum("n")).first()[0] for by, fn in (("i", within), ("k", across)))
    cells = x.groupBy("i", "k").count().collect()
    sizes = np.zeros((max(r["i"] for r in cells) + 1, max(r["k"] for r in cells) + 1))
    for r in cells:
        sizes[r["i"], r["k"]] = r["count"]
    above = np.zeros_like(sizes)  # in earlier parts and later cells
    above[1:, :-1] = np.cumsum(sizes, 0)[:-1, ::-1].cumsum(1)[:, ::-1][:, 1:]
    down += int((sizes * above).sum())
    return _one(a.sparkSession, (untied - 2 * down) / (n * (n - 1) / 2))


def _one(spark, value: float) -> DataFrame:
    return spark.createDataFrame([(value,)], "correlation double")


def _by_group(x: DataFrame, by: list[str], schema: str) -> DataFrame:
    """(*by, n, kendall) of rows (a, b) of each group, a group in a task."""

    def one(rows: pa.Table) -> pa.Table:
        return pa.table({**{k: rows[k].slice(0, 1) for k in by}, "n": [len(rows)], "kendall": [_tau(rows["a"].to_numpy(), rows["b"].to_numpy())]})

    return x.groupBy(*by).applyInArrow(one, f"{schema}, n long, kendall double")


def report(ranking: DataFrame, rows: int = 25) -> str:
    """A fixed-width table of the first rows."""
    lines = [f"{'rank':>4}  {'forecaster':<28} {'score':>12}"]
    lines += [f"{r['rank']:>4}  {r['forecaster']:<28} {r['score']:>12.6f}" for r in ranking.orderBy("rank", "forecaster").limit(rows).collect()]
    return "\n".join(lines)


def correlation_grid(rankings: dict[str, DataFrame], user: str = "forecaster") -> DataFrame:
    """(method_a, method_b, n, spearman, kendall) of each pair of named rankings over their
    common forecasters. Pairs of up to BLOCK names are counted in a task each, longer ones as `kendall` does."""
    parts = [r.select(F.lit(name).alias("method"), F.col(user).alias("forecaster"), F.col("rank").cast("double").alias("rank")) for name, r in rankings.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = cut(every)
    a, b = (every.select("forecaster", F.col("method").alias(f"method_{s}"), F.col("rank").alias(s)) for s in "ab")
    x = a.join(b, "forecaster").where("method_a < method_b")
    by = ["method_a", "method_b"]
    rho = F.coalesce(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")), F.lit(0.0))
    rho = x.groupBy(*by).agg(rho.alias("spearman"))
    if (every.groupBy("method").count().agg(F.max("count")).first()[0] or 0) <= BLOCK:
        tau = _by_group(x.where("a is not null and b is not null"), by, "method_a string, method_b string")
    else:
        names = sorted(rankings)
        of = lambda m: every.where(F.col("method") == m)
        rows = [(m, k, of(m).join(of(k), "forecaster").count(), kendall(of(m), of(k)).first()[0]) for i, m in enumerate(names) for k in names[i + 1 :]]
        tau = every.sparkSession.createDataFrame(rows, "method_a string, method_b string, n long, kendall double")
    return tau.join(rho, by).select(*by, "n", "spearman", "kendall")
