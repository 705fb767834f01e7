"""Score frames: (forecaster, event_ticker, round, weight, score, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax, brier, total, within_spread
from .select import MAX_SPREAD, first_per_event, length_matched, liquid, markets, median_round, scored_rows

KEYS = ["forecaster", "event_ticker", "round", "category", "close_time"]


def brier_score(df: DataFrame, per_market: bool = False, max_spread: float = MAX_SPREAD) -> DataFrame:
    """Event rows weigh as many as their markets; market rows weigh 1."""
    x = scored_rows(df, max_spread)
    if per_market:
        p, o = F.col("prediction"), F.col("outcome")
        return markets(x).select(*KEYS, "market_index", F.lit(1.0).alias("weight"), ((p - o) * (p - o)).alias("score"))
    return x.select(*KEYS, F.size("prediction").cast("double").alias("weight"), brier("prediction", "outcome").alias("score"))


def _market_error() -> Column:
    """Summed error of both asks of all markets of a row."""
    yes = F.zip_with("odds", "outcome", lambda q, o: (q - o) * (q - o))
    no = F.zip_with("no_odds", "outcome", lambda q, o: (q - (1 - o)) * (q - (1 - o)))
    return (total(yes) + total(no)) / 2


def global_market_brier(df: DataFrame, max_spread: float = MAX_SPREAD) -> DataFrame:
    """One row: the error of the market itself over all markets; 0 without any."""
    x = liquid(first_per_event(length_matched(df, ("odds", "no_odds", "outcome"))), max_spread)
    return x.agg(F.coalesce(F.try_divide(F.sum(_market_error()), F.sum(F.size("odds"))), F.lit(0.0)).alias("score"), F.sum(F.size("odds")).alias("n_markets"))


def market_brier_per_forecaster(df: DataFrame, max_spread: float = MAX_SPREAD) -> DataFrame:
    """The market's error over the events that each forecaster answered."""
    real = length_matched(df).where(~F.col("forecaster").contains("market-baseline"))
    event = liquid(first_per_event(real), max_spread).select("event_ticker", _market_error().alias("s"), F.size("odds").alias("n"))
    return real.select("forecaster", "event_ticker").distinct().join(event, "event_ticker").groupBy("forecaster").agg((F.sum("s") / F.sum("n")).alias("score"))


def individualized_market_brier(df: DataFrame) -> DataFrame:
    """The ask that the forecaster would have hit; rows with a market inside the spread go."""
    rows = F.arrays_zip("prediction", "outcome", "odds", "no_odds")
    x = median_round(length_matched(df)).withColumn("m", rows)
    x = x.where(~F.exists("m", lambda m: (m["prediction"] >= 1 - m["no_odds"]) & (m["prediction"] <= m["odds"])))
    hit = lambda m: F.when(m["prediction"] > m["odds"], (m["odds"] - m["outcome"]) * (m["odds"] - m["outcome"])).otherwise((m["no_odds"] - (1 - m["outcome"])) * (m["no_odds"] - (1 - m["outcome"])))
    return x.select(*KEYS, F.size("m").cast("double").alias("weight"), (total(F.transform("m", hit)) / F.size("m")).alias("score"))


def market_distance(df: DataFrame, max_spread: float = MAX_SPREAD) -> DataFrame:
    """Mean squared distance between forecasts and the asks they beat."""
    m = markets(scored_rows(df, max_spread)).where(~within_spread("prediction", "odds", "no_odds"))
    p, q, n = F.col("prediction"), F.col("odds"), F.col("no_odds")
    far = F.when(p > q, (p - q) * (p - q)).otherwise((1 - p - n) * (1 - p - n))
    return m.groupBy("forecaster").agg(F.avg(far).alias("score"), F.count("*").alias("n_markets"))


def _bets(m: DataFrame) -> DataFrame:
    """Market rows with the cost and the profit of shares equal to the edge, bought at the ask; nulls where there is no bet."""
    p, q, n, o = (F.col(c) for c in ("prediction", "odds", "no_odds", "outcome"))
    yes = p > q
    shares = F.when(yes, p - q).otherwise(1 - p - n)
    cost = shares * F.when(yes, q).otherwise(n)
    pays = F.when(F.when(yes, o == 1).otherwise(o == 0), shares).otherwise(0.0)
    bet = ~within_spread("prediction", "odds", "no_odds") & (p != q)
    return m.withColumns({"cost": F.when(bet, cost), "profit": F.when(bet, pays - cost), "bet": bet})


def average_return(df: DataFrame, per_market: bool = False, max_spread: float = MAX_SPREAD) -> DataFrame:
    """Shares equal to the edge are bought at the ask; (cost, score = profit). Events without a bet give no row."""
    m = _bets(markets(scored_rows(df, max_spread))).where("bet")
    if per_market:
        return m.select(*KEYS, "market_index", "weight", "cost", F.col("profit").alias("score"))
    return m.groupBy(*KEYS).agg(F.first("weight").alias("weight"), F.sum("cost").alias("cost"), F.sum("profit").alias("score"), F.count("*").alias("num_markets_bet"))


def error_and_return(df: DataFrame, max_spread: float = MAX_SPREAD) -> DataFrame:
    """Market rows with both the squared error and the bet (cost, profit; nulls where there is none), so that one pass serves both scores."""
    p, o = F.col("prediction"), F.col("outcome")
    return _bets(markets(scored_rows(df, max_spread))).select(*KEYS, "market_index", ((p - o) * (p - o)).alias("error"), "cost", "profit")


def legacy_return(df: DataFrame, money: float = 1.0, even: bool = False) -> DataFrame:
    """Gross earnings of the money all on the best edge, or dealt evenly over the markets."""
    zipped = F.arrays_zip("prediction", "odds", "no_odds", "outcome")
    edge = lambda m: F.greatest(m["prediction"] / m["odds"], (1 - m["prediction"]) / m["no_odds"])

    def pay(m):
        yes = m["prediction"] / m["odds"] > (1 - m["prediction"]) / m["no_odds"]
        return F.when(yes, m["outcome"] / m["odds"]).otherwise((1 - m["outcome"]) / m["no_odds"])

    x = median_round(length_matched(df)).withColumn("m", zipped)
    score = total(F.transform("m", pay)) * money / F.size("m") if even else pay(F.get("m", argmax(F.transform("m", edge)))) * money
    return x.select(*KEYS, "weight", score.alias("score"))


BASELINE = "market-baseline"


def with_market_baseline(df: DataFrame, use_both: bool = False) -> DataFrame:
    """df and a forecaster that repeats the market: one row per (event, round), each column the first value that is not null, by forecaster."""
    rest = [c for c in df.columns if c not in ("event_ticker", "round", "forecaster")]
    first = (F.min(F.when(F.col(c).isNotNull(), F.struct("forecaster", F.col(c).alias("x"))))["x"].alias(c) for c in rest)
    x = df.groupBy("event_ticker", "round").agg(*first)
    said = F.zip_with("odds", "no_odds", lambda q, n: (q + 1 - n) / 2) if use_both else F.col("odds")
    return df.unionByName(x.withColumn("prediction", said).withColumn("forecaster", F.lit(BASELINE)))


def with_individual_baselines(scores: DataFrame) -> DataFrame:
    """For each forecaster, the baseline's scores on that forecaster's (event, round) pairs."""
    real = scores.where(~F.col("forecaster").contains(BASELINE))
    keys = real.select(F.concat("forecaster", F.lit(f"-{BASELINE}")).alias("forecaster"), "event_ticker", "round", "weight").dropDuplicates(["forecaster", "event_ticker", "round"])
    base = scores.where(F.col("forecaster") == BASELINE).drop("forecaster", "weight")
    return scores.unionByName(base.join(keys, ["event_ticker", "round"]), allowMissingColumns=True)
