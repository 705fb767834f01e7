"""Canonical schemas and integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.vectors import total
from .plans.lineage import cut

WIDE = (
    "forecaster string, event_ticker string, round int, category string, prediction array<double>, outcome array<double>, "
    "odds array<double>, no_odds array<double>, snapshot_time timestamp, close_time timestamp, time_rank double, weight double"
)
PROBLEMS = "problem_id string, problem_seq long, title string, options array<string>, correct_option_idx array<int>, end_time timestamp, category string, url string"
FORECASTS = (
    "forecast_id string, problem_id string, forecast_seq long, username string, timestamp timestamp, probs array<double>, "
    "unnormalized_probs array<double>, weight double, odds array<double>, no_odds array<double>, submission_id string"
)


def violations(problems: DataFrame, forecasts: DataFrame) -> DataFrame:
    """(rule, key) of each row that breaks a rule; an empty frame means valid data."""
    bad = lambda a: F.coalesce(F.exists(a, lambda x: (x < 0) | (x > 1)), F.lit(False))
    f = forecasts
    rules = {  # of a forecast by itself: one pass for all
        "weight is negative": F.col("weight") < 0,
        "probabilities are no distribution": (F.size("probs") == 0) | bad("probs") | (F.abs(total("probs") - 1) > 1e-6),
        "unnormalized probability outside [0, 1]": bad("unnormalized_probs"),
        "odds do not fit": F.col("odds").isNotNull() & ((F.size("odds") != F.size("probs")) | bad("odds")),
    }
    broken = F.array_compact(F.array(*(F.when(test, F.lit(rule)) for rule, test in rules.items())))
    alone = f.select(F.explode(broken).alias("rule"), F.col("forecast_id").cast("string").alias("key"))
    problems = cut(problems.select("problem_id", "options", "correct_option_idx"))
    checks = [
        ("correct option out of range or repeated", problems.where(F.exists("correct_option_idx", lambda i: (i < 0) | (i >= F.size("options"))) | (F.size(F.array_distinct("correct_option_idx")) != F.size("correct_option_idx"))), "problem_id"),
        ("vector length differs from options", f.join(problems.select("problem_id", "options"), "problem_id").where(F.size("probs") != F.size("options")), "forecast_id"),
        ("forecast id repeated", f.groupBy("problem_id", "forecast_id").count().where("count > 1"), "forecast_id"),
        ("problem id repeated", problems.groupBy("problem_id").count().where("count > 1"), "problem_id"),
    ]
    return reduce(DataFrame.unionByName, (d.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key")) for rule, d, key in checks), alone)
