"""Deterministic forecasts from the tables orders and region.

Every order is an event of one to four markets, every region a forecaster with
its own skill. All values are integers divided by 100, so that any engine
computes the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MAX_FORECASTERS = 100_000  # rows of region that are broadcast; more are joined by Spark's choice
SAYINGS, MAX_SAYINGS = 101 * 20, 1_000_000  # predictions of a forecaster, and of all forecasters, at most, that are looked up
EVENTS = 1 << 17  # of a partition, on average, at most: what a task sorts or groups does not grow with the input


def _vector(body: str, n: str = "e % 4") -> Column:
    """A value for each market m, of hundredths."""
    return F.expr(f"transform(sequence(0, cast({n} as int)), m -> cast({body} as double) / 100)")


OUTCOME = "(case when (e * 3 + m * 11) % 5 < 2 then 1 else 0 end) * 100"
ASK, NO_ASK = "(5 + ({ask} + m * 31) % 91)", "(100 + ({e} + m) % 6 - 1 - (5 + ({ask} + m * 31) % 91))"
SAID = "transform(outcome, (o, m) -> cast((({a} + m * 29) % 101 * (5 - r_regionkey) + cast(o as int) * 100 * r_regionkey) div 5 as double) / 100)"


def forecasts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (forecaster, event, round) with vectors. The narrow rows of orders are dealt by key, then expanded in
    place: all cores share the work, and groups by event, or by forecaster and event, need no further shuffle. They are in the
    order of event, forecaster and round, so sorts by them find them sorted.

    Vectors hang on a few remainders of the key, so each is worked out once in a small table and looked up by them; a key below zero, whose remainders have
    signs, has its vectors worked out in its row. (Compiled forms without lambdas make methods that are too long for the JVM's compiler.)"""
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", F.col("r_name").alias("forecaster"))
    regions = region.count()
    near = F.broadcast(region) if regions <= MAX_FORECASTERS else region
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("e"), F.col("o_orderpriority").alias("category"), F.col("o_orderdate").cast("timestamp").alias("close_time"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-orders.count() // EVENTS))
    x = orders.repartition(parts, "e").sortWithinPartitions("e").withColumn("outcome", _vector(OUTCOME))
    x = x.crossJoin(near).sortWithinPartitions("e", "forecaster")
    x = x.select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("round")).where("(e + r_regionkey * 3 + round) % 7 < 4")
    ask, a = "(e * 17 + round * 3)", "(e * 7 + r_regionkey * 13 + round * 5)"
    x = x.withColumns({"_ask": F.expr(f"case when e >= 0 then {ask} % 91 * 12 + e % 12 end"), "_said": F.expr(f"case when e >= 0 and r_regionkey >= 0 then (r_regionkey * 101 + {a} % 101) * 20 + e % 20 end")})
    of = {"ask": "_ask div 12", "e": "_ask % 12"}
    asks = spark.range(91 * 12).withColumnRenamed("id", "_ask").select("_ask", _vector(ASK.format(**of), "_ask % 4").alias("_odds"), _vector(NO_ASK.format(**of), "_ask % 4").alias("_no_odds"))
    x = x.join(F.broadcast(asks), "_ask", "left")
    said, of = F.expr(SAID.format(a=a)), {"ask": ask, "e": "e"}
    if regions * SAYINGS <= MAX_SAYINGS:
        held = spark.range(SAYINGS).crossJoin(F.broadcast(region.select("r_regionkey").distinct())).withColumns({"a": F.expr("id div 20"), "e": F.expr("id % 20")}).withColumn("outcome", _vector(OUTCOME))
        held = held.select(F.expr("(r_regionkey * 101 + a) * 20 + e").alias("_said"), F.expr(SAID.format(a="a")).alias("_prediction"))
        x = x.join(F.broadcast(held), "_said", "left")
        said = F.coalesce("_prediction", said)
    return x.select(
        "forecaster", F.col("e").alias("event_ticker"), "round", "category", said.alias("prediction"), "outcome", F.coalesce("_odds", _vector(ASK.format(**of))).alias("odds"),
        F.coalesce("_no_odds", _vector(NO_ASK.format(**of))).alias("no_odds"), F.expr("close_time - make_interval(0, 0, 0, 0, cast(1 + (e + round * 7) % 60 as int), 0, 0)").alias("snapshot_time"), "close_time", F.lit(1.0).alias("weight"),
    )


def challenge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(problems, forecasts) of the challenge form: every round is a forecast, in the order of its time; probabilities are made to sum to 1."""
    from ..functions.vectors import normalized, smoothed

    wide = forecasts_wide(spark, sf_dir)
    seq = (F.unix_seconds("snapshot_time") * 10 + F.col("round")).alias("forecast_seq")
    forecasts = wide.select(
        F.concat_ws("-", "forecaster", "event_ticker", "round").alias("forecast_id"), F.col("event_ticker").alias("problem_id"), seq,
        F.col("forecaster").alias("username"), F.col("snapshot_time").alias("timestamp"), normalized(F.transform("prediction", lambda p: p + 0.01)).alias("probs"),
        F.col("prediction").alias("unnormalized_probs"), "weight", smoothed("odds").alias("odds"), smoothed("no_odds").alias("no_odds"),
    )
    problems = wide.groupBy(F.col("event_ticker").alias("problem_id")).agg(F.first("outcome").alias("o"), F.first("close_time").alias("end_time"), F.first("category").alias("category"))
    won = F.filter(F.transform("o", lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    problems = problems.select("problem_id", F.col("problem_id").alias("problem_seq"), won.alias("correct_option_idx"), F.size("o").alias("n_options"), "end_time", "category")
    return problems, forecasts
