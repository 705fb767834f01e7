"""Tables behind plots, and regressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import mean
from .quantiles import exact_quantiles
from .ranking import z_score


def dilution(df: DataFrame) -> DataFrame:
    """df with num_markets and dilution, the share of markets that came true."""
    return df.withColumn("num_markets", F.size("outcome")).withColumn("dilution", mean("outcome"))


def by_num_markets(scores: DataFrame, event_mean: bool = False, by=()) -> DataFrame:
    """Count, mean, deviation and standard error of (num_markets, score), for each value of `by` apart. event_mean: an event's
    scores are averaged first, so that events weigh alike."""
    if event_mean:
        scores = scores.groupBy(*by, "event_ticker", "num_markets").agg(F.avg("score").alias("score"))
    x = scores.groupBy(*by, "num_markets").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
    return x.withColumn("sem", F.col("sd") / F.sqrt("n"))


def over_rounds(scores: DataFrame, merge_every: int = 1) -> DataFrame:
    """Mean score of each forecaster and bucket of rounds."""
    x = scores.groupBy("forecaster", "round").agg(F.avg("score").alias("s"))
    k = F.floor((F.dense_rank().over(Window.partitionBy("forecaster").orderBy("round")) - 1) / merge_every)
    return x.withColumn("bucket", k).groupBy("forecaster", "bucket").agg(F.avg("s").alias("score"))


def histogram(df: DataFrame, col: str, bins: int, low: float, high: float) -> DataFrame:
    return df.where(F.col(col).between(low, high)).groupBy(F.least(F.width_bucket(col, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def column_statistics(df: DataFrame, col: str, by=()) -> DataFrame:
    """(*by, n, mean, median, low, high) of a column, nulls aside; the median is exact, found without gathering values."""
    x = df.withColumn("_all", F.lit(0)).where(F.col(col).isNotNull())
    keys = ["_all", *by]
    middle = exact_quantiles(x, keys, col, [0.5]).select(*(F.col(k).alias(f"_{k}") for k in keys), F.get("quantiles", F.lit(0)).alias("median"))
    x = x.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(col).alias("mean"), F.min(col).alias("low"), F.max(col).alias("high"))
    return x.join(middle, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select(*by, "n", "mean", "median", "low", "high")


def _beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        n = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d if abs(1 + n * d) > 1e-300 else 1e-300)
        c = 1 + n / c if abs(1 + n / c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_p_value(t: float, df: int) -> float:
    """Two-sided."""
    return _beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(level: float, df: int) -> float:
    """The two-sided quantile of Student's t, by Newton's steps on the p-value."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    t = z_score(level)
    for _ in range(100):
        step = (t_p_value(t, df) - (1 - level)) / (2 * scale * (1 + t * t / df) ** (-(df + 1) / 2))
        t += step
        if abs(step) < 1e-12 * t:
            break
    return t


def f_p_value(f: float, df1: int, df2: int) -> float:
    """Upper tail of the F distribution."""
    return _beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def regression(df: DataFrame, target: str, regressors: list[str], by=()) -> DataFrame:
    """Least squares with an intercept: a row for each group and term, with t intervals and p-values, and the F test of
    the whole. One aggregate of cross products; the small systems are solved on the driver (a row for each group)."""
    import numpy as np

    names = ["intercept", *regressors]
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in regressors)]
    y = F.col(target).cast("double")
    full = df.dropna(subset=[target, *regressors])
    sums = [F.sum(a * b).alias(f"x{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)] + [F.sum(a * y).alias(f"y{i}") for i, a in enumerate(cols)] + [F.sum(y * y).alias("yy")]
    out, k = [], len(cols)
    for r in full.groupBy(*by).agg(*sums).collect():
        x = np.array([[r[f"x{i}_{j}"] for j in range(k)] for i in range(k)], float)
        v, n = np.array([r[f"y{i}"] for i in range(k)], float), int(r["x0_0"])
        if n <= k or np.linalg.matrix_rank(x) < k:
            continue
        beta = np.linalg.solve(x, v)
        sse = max(0.0, r["yy"] - beta @ v)
        sst = r["yy"] - v[0] ** 2 / n
        se = np.sqrt(np.diag(np.linalg.inv(x)) * sse / (n - k))
        r2 = 1 - sse / sst if sst > 0 else 0.0
        q = t_quantile(0.95, n - k)
        f = (sst - sse) / (k - 1) / (sse / (n - k)) if sse > 0 and k > 1 else float("inf") if k > 1 else 0.0
        for name, b, s in zip(names, beta, se):
            p = t_p_value(b / s, n - k) if s > 0 else 0.0
            out.append((*(r[c] for c in by), name, float(b), float(s), float(p), float(b - q * s), float(b + q * s), float(r2), float(1 - (1 - r2) * (n - 1) / (n - k)), float(f), float(f_p_value(f, k - 1, n - k) if k > 1 and math.isfinite(f) else k == 1), n))
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "term string, estimate double, se double, p_value double, low double, high double, r2 double, adjusted_r2 double, f_statistic double, f_p_value double, n long"])
    return df.sparkSession.createDataFrame(out, schema)


def _mean_ranks(df: DataFrame, col: str, name: str) -> DataFrame:
    """(col, name): the rank of each distinct value, ties at their average. Values are counted before they are ordered."""
    n = df.groupBy(col).agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy(col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.select(col, (before + (F.col("m") + 1) / 2).alias(name))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, pearson, pearson_p, spearman, spearman_p; 0 where a correlation is undefined."""
    full = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    full = full.join(_mean_ranks(full, "x", "rx"), "x").join(_mean_ranks(full, "y", "ry"), "y")
    of = lambda a, b: F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))
    n, r, s = full.agg(F.count("*"), of("x", "y"), of("rx", "ry")).first()
    p = lambda v: 1.0 if n < 3 else 0.0 if abs(v) >= 1 else t_p_value(v * math.sqrt((n - 2) / (1 - v * v)), n - 2)
    return df.sparkSession.createDataFrame([(n, r, p(r), s, p(s))], "n long, pearson double, pearson_p double, spearman double, spearman_p double")


def line_band(df: DataFrame, target: str, regressor: str, points: list[float], by=(), z: float = 1.96) -> DataFrame:
    """(*by, x, fit, margin): the fitted line at the points and the margin of its mean."""
    y, x = F.col(target), F.col(regressor)
    s = df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icept"), F.regr_avgx(y, x).alias("mx"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    mse = F.greatest(F.lit(0.0), F.try_divide(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.col("n") - 2))
    s = s.withColumn("mse", mse).select("*", F.explode(F.array(*(F.lit(float(p)) for p in points))).alias("x"))
    far = F.col("x") - F.col("mx")
    return s.select(*by, "x", (F.col("icept") + F.col("slope") * F.col("x")).alias("fit"), (z * F.sqrt(F.col("mse") * (1 / F.col("n") + F.try_divide(far * far, "sxx")))).alias("margin"))


def market_count_bins(df: DataFrame, edges: list[int], col: str = "num_markets") -> DataFrame:
    """df with market_bin, the half-open range (low, high] that holds the number of markets; beyond the last edge `(last, inf]`, below the first null."""
    label = F.lit(None).cast("string")
    for lo, hi in zip(edges, [*edges[1:], None]):
        inside = F.col(col) > lo
        label = F.when(inside if hi is None else inside & (F.col(col) <= hi), f"({lo}, {'inf' if hi is None else hi}]").otherwise(label)
    return df.withColumn("market_bin", label)


def market_scatter(df: DataFrame, forecaster: str, won: bool = True, baseline: str = "market-baseline", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(event_ticker, market_index, market_prob, model_prob) on the markets that resolved YES (or
    NO, as complements): the first row by round of each side; extreme probabilities go."""

    def first(name, alias):
        x = df.where(F.col("forecaster") == name).groupBy("event_ticker").agg(F.min_by(F.struct("prediction", "outcome"), "round").alias("f"))
        return x.select("event_ticker", F.posexplode(F.arrays_zip(F.col("f.prediction").alias("p"), F.col("f.outcome").alias("o"))).alias("market_index", alias))

    x = first(baseline, "b").where(F.col("b.o") == (1.0 if won else 0.0)).join(first(forecaster, "m"), ["event_ticker", "market_index"])
    side = lambda c: c if won else 1 - c
    x = x.select("event_ticker", "market_index", side(F.col("b.p")).alias("market_prob"), side(F.col("m.p")).alias("model_prob"))
    return x.where(F.col("market_prob").between(low, high) & F.col("model_prob").between(low, high))


def event_rollup(scores: DataFrame) -> DataFrame:
    """Each event's number of scores, their mean and its number of markets."""
    return scores.groupBy("event_ticker").agg(F.max("num_markets").alias("num_markets"), F.avg("score").alias("mean_score"), F.count("*").alias("n"))
