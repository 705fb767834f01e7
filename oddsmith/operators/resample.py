"""Bootstrap intervals by counter-based draws: the same rows give the same draws, however they are partitioned."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

SHARE = 1 << 17  # distinct rows of a forecaster that one task holds, on average
COUNTED = 1 << 20  # draws of a share in one resample that are made one by one; more are binomial counts of its rows
LANES = 8  # groups of resamples at most into which shares are split where there are few of them
_BLOCK = 1 << 16
_WEYL = 0x9E3779B9
_M = 0xFFFFFFFF


def mix32(x: int) -> int:
    """A finaliser of 32 bits."""
    x = (x ^ x >> 16) * 0x85EBCA6B & _M
    x = (x ^ x >> 13) * 0xC2B2AE35 & _M
    return x ^ x >> 16


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def stream(name: int, seed: int, share: int) -> int:
    return mix32(mix32(name ^ mix32(seed & _M)) + share * _WEYL & _M)


def _keys(key: int, resamples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = _mix((resamples.astype(np.uint64) * _WEYL + key + 1 & _M).astype(np.uint32))
    return a, _mix(a ^ np.uint32(0x5BD1E995))


def _generator(key: int, resample: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[key, int(resample)]))


def _drawn(values: list[np.ndarray], rate: np.ndarray, counts: np.ndarray, resamples: np.ndarray, key: int, fold) -> list[np.ndarray]:
    """fold (sum, max or min) of the drawn values, an array of resamples for each of `values`. A row is drawn in proportion to its rate."""
    out = [np.zeros(len(resamples)) for _ in values]
    total = rate.sum()
    whole = total < 1 << 22 and np.array_equal(rate, np.floor(rate))
    slots = [np.repeat(v, rate.astype(np.int64)) for v in values] if whole else None
    ends = np.cumsum(rate)
    a, c = _keys(key, resamples)

    def take(u):
        if whole:
            at = (u.astype(np.uint64) * np.uint64(total) >> np.uint64(32)).astype(np.int64)
            return [s[at] for s in slots]
        at = np.minimum(np.searchsorted(ends, u * (total / 4294967296.0), side="right"), len(ends) - 1)
        return [v[at] for v in values]

    def uniforms(rows, lo, hi):
        u = np.arange(lo, hi, dtype=np.uint32) * np.uint32(_WEYL) + a[rows, None]
        u = _mix(u)
        u ^= c[rows, None]
        return _mix(u)

    n = int(counts[0]) if len(counts) else 0
    if len(counts) and n * 4 <= _BLOCK and (counts == n).all():  # many short resamples at once
        step = max(1, _BLOCK // max(1, n))
        for k in range(0, len(resamples), step):
            for o, got in zip(out, take(uniforms(slice(k, k + step), 0, n))):
                o[k : k + step] = fold(got, 1) if n else 0.0
        return out
    for k, n in enumerate(counts.tolist()):
        if n > COUNTED:
            times = _generator(key, resamples[k]).multinomial(n, rate / total)
            for o, v in zip(out, values):
                o[k] = times @ v if fold is np.sum else fold(v[times > 0], 0)
            continue
        parts = [[] for _ in values]
        for lo in range(0, n, _BLOCK):
            for p, got in zip(parts, take(uniforms(slice(k, k + 1), lo, min(n, lo + _BLOCK)))):
                p.append(fold(got, 1)[0])
        for o, p in zip(out, parts):
            o[k] = fold(np.array(p), 0) if p else np.nan
    return out


def _resamples(samples: int, lane: int, lanes: int) -> np.ndarray:
    return np.arange(lane, samples, lanes)


_FOLDS = {"mean": np.sum, "sum": np.sum, "roi": np.sum, "max": np.max, "min": np.min}


def bootstrap(
    scores: DataFrame, samples: int = 1000, level: float = 0.95, how: str = "mean", num_se: float | None = None, seed: int = 42, by_weight: bool = True, symmetric: bool = True, rule: str = "nightly"
) -> DataFrame:
    """(forecaster, score, se, ci_margin, low, high, n_predictions) by resamples of as many rows as a forecaster has.

    Rows are drawn in proportion to their weights (by_weight=False, or no positive weight: all alike), and weigh in the mean all the
    same. how: mean, sum, roi (score over cost), max or min. The margin is num_se standard errors, or else the quantile of the deviations from
    the point estimate: the ceil(level * n)-th by rule="nightly", the one after it by rule="challenge". symmetric=False: low and high are
    quantiles of the resamples, by "challenge" at hundredths of the shares that are asked for, as its definition has it. Resamples without any weight are left out.

    Draw j of resample b is a hash of (seed, forecaster, share, b, j), so results hang neither on partitions nor on tasks. Equal rows (scores to nine
    decimals) are counted first. A forecaster with many distinct rows is split into shares by hash; how many draws of a
    resample fall into each is drawn first, by conditional binomials, so the whole is a draw of fixed size. A task holds
    one share. Rows without score are left out; null or negative weights and null costs count as 0. An empty table gives no rows.
    """
    cost = F.coalesce(F.col("cost").cast("double"), F.lit(0.0)) if "cost" in scores.columns else F.lit(0.0)
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    x = scores.where("score is not null").select("forecaster", F.round(F.col("score").cast("double"), 9).alias("s"), weight.alias("w"), cost.alias("c"))
    rows = cut(x.groupBy("forecaster", "s", "w", "c").agg(F.count("*").alias("m")))
    s, w, c, m = (F.col(k) for k in "swcm")
    stats = rows.groupBy("forecaster").agg(F.sum("m").alias("n"), F.sum(w * m).alias("weight"), F.sum(s * w * m).alias("sw"), F.sum(s * m).alias("sum"), F.sum(c * m).alias("cost"), F.max("s").alias("most"), F.min("s").alias("least"), F.count("*").alias("distinct"))
    stats = cut(stats.withColumn("shares", F.ceil(F.col("distinct") / SHARE)))
    shares = stats.agg(F.sum("shares")).first()[0] or 0
    spread = scores.sparkSession.sparkContext.defaultParallelism
    lanes = max(1, min(LANES, samples, -(-2 * spread // max(1, shares))))

    rate = F.when(F.lit(by_weight) & (F.col("weight") > 0), w).otherwise(1.0)
    split = rows.join(stats.select("forecaster", "shares", "n", "weight"), "forecaster")
    split = split.select("forecaster", "s", "w", "c", "m", "n", rate.alias("rate"), F.pmod(F.xxhash64("s", "w", "c"), "shares").alias("share")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    name = F.conv(F.substring(F.md5(F.coalesce("forecaster", F.lit(""))), 1, 8), 16, 10).cast("long")
    sizes = split.groupBy("forecaster", "share", "lane").agg(F.sum(F.col("rate") * m).alias("rate"), F.first("n").alias("n")).withColumn("name", name)

    def allot(table: pa.Table) -> pa.Table:
        """How many draws of each resample fall into each share of a forecaster."""
        table = table.sort_by("share")
        lane, n, key = table["lane"][0].as_py(), table["n"][0].as_py(), stream(table["name"][0].as_py(), seed, -1)
        b = _resamples(samples, lane, lanes)
        p = table["rate"].to_numpy()
        counts = np.array([_generator(key, k).multinomial(n, p / p.sum()) for k in b]).T if len(p) > 1 else np.full((1, len(b)), n)
        return pa.table({"forecaster": table["forecaster"], "share": table["share"], "lane": table["lane"], "name": table["name"], "counts": pa.array(list(counts), pa.list_(pa.int64()))})

    counts = sizes.groupBy("forecaster", "lane").applyInArrow(allot, "forecaster string, share long, lane int, name long, counts array<long>")

    def draw(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("s", "ascending"), ("w", "ascending"), ("c", "ascending")])
        s, w, c, m, rate = (left[k].to_numpy() for k in ("s", "w", "c", "m", "rate"))
        share, lane, name = (right[k][0].as_py() for k in ("share", "lane", "name"))
        b = _resamples(samples, lane, lanes)
        values = {"mean": [s * w, w], "roi": [s, c]}.get(how, [s])
        got = _drawn(values, rate * m, np.array(right["counts"][0].as_py(), np.int64), b, stream(name, seed, share), _FOLDS[how])
        low = got[1] if len(got) > 1 else np.ones(len(b))
        return pa.table({"forecaster": pa.array([left["forecaster"][0].as_py()] * len(b), pa.string()), "k": b, "top": got[0], "low": low})

    by = ("forecaster", "share", "lane")
    parts = split.groupBy(*by).cogroup(counts.groupBy(*by)).applyInArrow(draw, "forecaster string, k long, top double, low double")
    total = {"max": F.max, "min": F.min}.get(how, F.sum)
    value = {"mean": F.try_divide("top", "low"), "roi": F.when(F.col("low") > 0, F.col("top") / F.col("low")).otherwise(0.0)}.get(how, F.col("top"))
    every = parts.where("not isnan(top)").groupBy("forecaster", "k").agg(total("top").alias("top"), F.sum("low").alias("low")).select("forecaster", value.alias("v")).where("v is not null")
    point = {
        "mean": F.when(F.col("weight") > 0, F.col("sw") / F.col("weight")).otherwise(F.col("sum") / F.col("n")),
        "sum": F.col("sum"), "roi": F.when(F.col("cost") > 0, F.col("sum") / F.col("cost")).otherwise(0.0), "max": F.col("most"), "min": F.col("least"),
    }[how]
    every = every.groupBy("forecaster").agg(F.array_sort(F.collect_list("v")).alias("v"), F.stddev_samp("v").alias("se"))  # `samples` values a forecaster
    x = stats.select("forecaster", point.alias("score"), F.col("n").alias("n_predictions")).join(every, "forecaster", "left")
    n = F.size("v")
    place = F.ceil(F.lit(level) * n) - (1 if rule == "nightly" else 0)
    place = F.greatest(F.lit(0), F.least(n - 1, place)).cast("int")
    margin = F.lit(num_se) * F.col("se") if num_se is not None else F.get(F.array_sort(F.transform("v", lambda v: F.abs(v - F.col("score")))), place)
    x = x.withColumn("se", F.when(n == 1, 0.0).otherwise(F.col("se"))).withColumn("ci_margin", margin)

    def quantile(share: float):
        at = (n - 1) * (share if rule == "nightly" else share / 100)
        low = F.get("v", F.floor(at).cast("int"))
        return low + (F.get("v", F.ceil(at).cast("int")) - low) * (at - F.floor(at))

    low, high = (F.col("score") - F.col("ci_margin"), F.col("score") + F.col("ci_margin")) if symmetric else (quantile((1 - level) / 2), quantile((1 + level) / 2))
    return x.select("forecaster", "score", "se", "ci_margin", low.alias("low"), high.alias("high"), "n_predictions")
