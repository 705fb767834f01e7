"""The challenge form: scoring rules, problem weights, bets and earnings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import argmax, bets_crra, bets_log, bets_neutral, filled_stakes, log_score, normalized, one_hot, spherical, stakes_crra, total
from ..plans.lineage import cut
from .quantiles import exact_quantiles


def crowd(forecasts: DataFrame) -> DataFrame:
    """Elementwise mean of the probabilities of each problem."""
    x = forecasts.select("problem_id", F.posexplode("probs").alias("option", "p"))
    return x.groupBy("problem_id", "option").agg(F.avg("p").alias("crowd_prob"))


def problem_weights(parameters: DataFrame) -> DataFrame:
    """(problem_id, problem_weight) from (problem_id, discrimination): clipped to the
    quartiles, scaled to sum to the number of problems."""
    q = parameters.agg(F.percentile("discrimination", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    x = parameters.crossJoin(F.broadcast(q)).withColumn("c", F.greatest(F.get("q", F.lit(0)), F.least(F.get("q", F.lit(1)), "discrimination")))  # q is one row
    s = x.agg(F.sum("c").alias("s"), F.count("*").alias("n"))
    return x.crossJoin(F.broadcast(s)).select("problem_id", (F.col("c") * F.col("n") / F.col("s")).alias("problem_weight"))


def rule_column(rule: str, clip: float = 0.01) -> Column:
    won = one_hot("correct_option_idx", "n_options")
    error = total(F.zip_with("probs", won, lambda p, y: (p - y) * (p - y))) / F.col("n_options")
    return {"brier": 1 - error, "brier_raw": error, "log": log_score("probs", "correct_option_idx", clip), "spherical": spherical("probs", "correct_option_idx")}[rule]


def rule_scores(problems: DataFrame, forecasts: DataFrame, rule: str | Column | Callable[[], Column] = "brier", weights: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """A score for each forecast. rule: a name, a column, or what makes one.
    compat: the last forecast's weight stands for all of a problem."""
    score = rule_column(rule) if isinstance(rule, str) else rule() if callable(rule) else rule
    w = F.max_by("weight", "forecast_seq").over(Window.partitionBy("problem_id")) if compat else F.col("weight")
    x = forecasts.join(problems.select("problem_id", "correct_option_idx", "n_options", "end_time", "category"), "problem_id")
    x = x.select("username", "problem_id", "forecast_seq", "end_time", "category", (score * w).alias("score"))
    if weights is None:
        return x
    return x.join(weights, "problem_id").withColumn("score", F.col("score") * F.col("problem_weight")).drop("problem_weight")


AGGREGATES = {"mean": F.avg, "max": F.max, "min": F.min}  # and the median


def rule_ranking(scores: DataFrame, how: str | Callable[[str], Column] = "mean", ascending: bool = False) -> DataFrame:
    """Ordinal ranks; ties go by first appearance. how: a name, or what makes an aggregate of a column. Medians are found
    without gathering a forecaster's scores."""
    make = F.avg if how == "median" else AGGREGATES.get(how, how)
    x = scores.groupBy("username").agg(make("score").alias("score"), F.min("forecast_seq").alias("seen"), F.count("*").alias("n_predictions"))
    if how == "median":
        middle = exact_quantiles(scores, ["username"], "score", [0.5]).select(F.col("username").alias("_name"), F.get("quantiles", F.lit(0)).alias("score"))
        x = x.drop("score").join(middle, F.col("username").eqNullSafe(F.col("_name")), "left").drop("_name")
    key = F.round("score", 9)
    return x.withColumn("rank", F.row_number().over(Window.orderBy(key.asc() if ascending else key.desc(), "seen", "username"))).drop("seen")


def bets(risk_aversion: float, p="probs", q="odds") -> Column:
    return bets_neutral(p, q) if risk_aversion == 0 else bets_log(p, q) if risk_aversion == 1 else bets_crra(p, q, risk_aversion)


BASELINE = "market-baseline"


def stated_probs(forecasts: DataFrame) -> Column:
    """Earnings are of the probabilities as they were stated, before they were made to sum to 1."""
    return F.coalesce("unnormalized_probs", "probs") if "unnormalized_probs" in forecasts.columns else F.col("probs")


def binary_earnings(problems: DataFrame, forecasts: DataFrame, risk_aversion: float = 0.0, compat: bool = False, approximate: bool = False) -> DataFrame:
    """Each option becomes YES or NO, whichever edge is larger (YES on ties, up to rounding); one unit is
    dealt over them, by the approximate stakes if asked. A forecaster's later forecasts replace earlier ones. The market's own row (BASELINE)
    has its NO edge against 1 - odds, and is neutral to risk where stakes are approximate."""
    own = F.col("username") == BASELINE
    forecasts = forecasts.withColumn("probs", stated_probs(forecasts))
    yes = F.zip_with("probs", "odds", lambda p, q: p / q)
    against = F.when(own, F.transform("odds", lambda q: 1 - q)).otherwise(F.col("no_odds"))
    no = F.zip_with("probs", against, lambda p, q: (1 - p) / q)
    flip = F.zip_with(yes, no, lambda a, b: b - a > 1e-9)
    x = forecasts.where("odds is not null and no_odds is not null").join(problems.select("problem_id", "correct_option_idx", "n_options", "end_time", "category"), "problem_id")
    x = x.withColumn("flip", flip).withColumn("won", one_hot("correct_option_idx", "n_options"))
    x = x.withColumn("p", F.zip_with("probs", "flip", lambda p, f: F.when(f, 1 - p).otherwise(p))).withColumn("q", F.transform(F.arrays_zip("odds", "no_odds", "flip"), lambda m: F.when(m["flip"], m["no_odds"]).otherwise(m["odds"])))
    x = x.withColumn("y", F.zip_with("won", "flip", lambda w, f: F.when(f, 1 - w).otherwise(w)))
    x = x.withColumn("b", F.zip_with(stakes_crra("p", "q", F.when(own, 0.0).otherwise(float(risk_aversion))), "q", lambda s, q: s / q) if approximate else bets(risk_aversion, "p", "q"))
    spent = total(F.zip_with("b", "q", lambda b, q: b * q))
    earned = total(F.zip_with("b", "y", lambda b, y: b * y)) / (F.lit(1.0) if compat else spent)
    x = x.withColumn("earned", earned)
    return x.groupBy("username", "problem_id", "end_time", "category").agg(F.max_by("earned", "forecast_seq").alias("score"), F.max("forecast_seq").alias("forecast_seq"))


def market_earnings(problems: DataFrame, forecasts: DataFrame, risk_aversion: float = 0.0, compat: bool = False) -> DataFrame:
    """The budget is dealt evenly over the options, each a two-way market.
    compat: the NO leg is paid where YES wins."""
    forecasts = forecasts.withColumn("probs", stated_probs(forecasts))
    x = forecasts.where("odds is not null and no_odds is not null").join(problems.select("problem_id", "correct_option_idx", "n_options", "end_time", "category"), "problem_id")
    x = x.withColumn("won", one_hot("correct_option_idx", "n_options"))
    x = x.select("username", "problem_id", "forecast_seq", "end_time", "category", "n_options", F.explode(F.arrays_zip("probs", "odds", "no_odds", "won")).alias("m"))
    x = x.withColumn("b", bets(risk_aversion, F.array("m.probs", 1 - F.col("m.probs")), F.array("m.odds", "m.no_odds")))
    first, second = (1, 0) if compat else (0, 1)
    pay = F.when(F.col("m.won") == 1, F.get("b", F.lit(first))).otherwise(F.get("b", F.lit(second)))
    x = x.groupBy("username", "problem_id", "forecast_seq", "end_time", "category").agg(F.sum(pay / F.col("n_options")).alias("earned"))
    return x.groupBy("username", "problem_id", "end_time", "category").agg(F.max_by("earned", "forecast_seq").alias("score"), F.max("forecast_seq").alias("forecast_seq"))


def with_market_row(forecasts: DataFrame) -> DataFrame:
    """forecasts and, for each problem with odds, one of BASELINE: the mean odds of its options."""
    m = forecasts.where("odds is not null and no_odds is not null").select("problem_id", F.posexplode(F.arrays_zip("odds", "no_odds")).alias("k", "m"))
    m = m.groupBy("problem_id", "k").agg(F.avg("m.odds").alias("odds"), F.avg("m.no_odds").alias("no_odds"))
    m = m.groupBy("problem_id").agg(F.sort_array(F.collect_list(F.struct("k", "odds", "no_odds"))).alias("m"))
    odds = F.transform("m", lambda x: x["odds"])
    m = m.select(F.concat_ws("-", "problem_id", F.lit("market")).alias("forecast_id"), "problem_id", F.lit(-1).cast("long").alias("forecast_seq"), F.lit(BASELINE).alias("username"), normalized(odds).alias("probs"), odds.alias("unnormalized_probs"), F.lit(1.0).alias("weight"), odds.alias("odds"), F.transform("m", lambda x: x["no_odds"]).alias("no_odds"))
    return forecasts.unionByName(m, allowMissingColumns=True)


def sharpe_of_earnings(earnings: DataFrame, kind: str | None = None, money: float = 1.0, baseline: str | None = None) -> DataFrame:
    """None: the mean; marginal: less the money over the deviation; relative: less the baseline's earnings."""
    if kind == "relative":
        earnings = cut(earnings)  # worked out once for both sides
        base = earnings.where(F.col("username") == baseline).select("problem_id", F.col("score").alias("base"))
        earnings = earnings.join(base, "problem_id").withColumn("score", F.col("score") - F.col("base"))
    m, sd = F.avg("score"), F.stddev_pop("score") + 1e-8
    fn = m if kind is None else (m - money) / sd if kind == "marginal" else m / sd
    return earnings.groupBy("username").agg(fn.alias("score"))


def waterfill_bets(forecasts: DataFrame, risk_aversion: float) -> DataFrame:
    """forecasts with `stakes`, the approximate shares of one unit. All columns go through Arrow batches, as Spark fails where filters of a later
    explode reach a call on vectors made by lambdas."""
    if not 0 <= risk_aversion <= 1:
        raise ValueError("risk_aversion must be in [0, 1]")

    def run(batches):
        for b in batches:
            g = pa.array(np.full(len(b), float(risk_aversion)))
            yield b.append_column("stakes", filled_stakes(b["probs"], b["odds"], g))

    return forecasts.mapInArrow(run, T.StructType([*forecasts.schema, T.StructField("stakes", T.ArrayType(T.DoubleType()))]))


def event_earnings(problems: DataFrame, forecasts: DataFrame, risk_aversion: float = 0.0) -> DataFrame:
    """One unit is dealt over the YES legs of all options. Later forecasts replace earlier ones."""
    forecasts = forecasts.withColumn("probs", stated_probs(forecasts))
    x = forecasts.where("odds is not null").join(problems.select("problem_id", "correct_option_idx", "n_options", "end_time", "category"), "problem_id")
    x = x.withColumn("earned", total(F.zip_with(bets(risk_aversion), one_hot("correct_option_idx", "n_options"), lambda b, y: b * y)))
    return x.groupBy("username", "problem_id", "end_time", "category").agg(F.max_by("earned", "forecast_seq").alias("score"), F.max("forecast_seq").alias("forecast_seq"))


def first_option_brier() -> Column:
    """(1 - p)^2 of the first correct option."""
    p = F.get("probs", F.get("correct_option_idx", F.lit(0)))
    return (1 - p) * (1 - p)


def calibration_ranking(problems: DataFrame, forecasts: DataFrame, bins: int = 10, weight_event: bool = False) -> DataFrame:
    """(username, score, rank): calibration error of the probabilities as stated; ranks start at 0, ties by name."""
    from .calibration import calibration_error

    x = forecasts.join(problems.select("problem_id", "correct_option_idx", "n_options"), "problem_id")
    x = x.select(F.col("username").alias("forecaster"), F.col("unnormalized_probs").alias("prediction"), one_hot("correct_option_idx", "n_options").alias("outcome"), "odds", "no_odds", "weight")
    x = calibration_error(x, bins, weight_event=weight_event).withColumnRenamed("forecaster", "username")
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9), "username")) - 1)


def problems_of(problems: DataFrame, forecasts: DataFrame, username: str) -> DataFrame:
    """The problems that a forecaster has answered."""
    return problems.join(forecasts.where(F.col("username") == username).select("problem_id").distinct(), "problem_id", "left_semi")


def problem_by_id(problems: DataFrame, problem_id) -> DataFrame:
    """The problem of this id: one row or none."""
    return problems.where(F.col("problem_id") == problem_id)


def first_problems(problems: DataFrame, n: int = -1) -> DataFrame:
    """The first n problems in their order; -1: all."""
    return problems if n < 0 else problems.orderBy("problem_seq", "problem_id").limit(n)
