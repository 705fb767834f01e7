"""Expected calibration error and reliability tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.derive import MAX_FORECASTERS
from .quantiles import exact_quantiles
from .select import markets


def _weighted(df: DataFrame, weight_event: bool) -> DataFrame:
    """Market rows with their weight, and in one row of each forecast its number of markets."""
    n = F.size("prediction")
    m = df.where("weight > 0 and forecaster is not null").select("forecaster", "prediction", "outcome", "odds", "no_odds", (F.col("weight") / n.cast("double") if weight_event else F.col("weight")).alias("weight"), n.alias("n"))
    return markets(m).withColumn("n", F.when(F.col("market_index") == 0, F.col("n")))


def _placed(m: DataFrame, bins: int, strategy: str) -> DataFrame:
    """m with its bin, between the literal edges of uniform bins or the forecaster's own quantiles."""
    if bins < 2:
        raise ValueError("calibration needs two bins at least")
    steps = [k / bins for k in range(bins + 1)]
    if strategy == "uniform":
        import numpy as np

        k = sum((F.coalesce((F.col("prediction") >= float(x)).cast("int"), F.lit(0)) for x in np.linspace(0, 1, bins + 1)), F.lit(-1))
        return m.withColumn("bin", F.greatest(F.lit(0), F.least(k, F.lit(bins - 1))))
    q = exact_quantiles(m.select("forecaster", "prediction"), ["forecaster"], "prediction", steps).select("forecaster", F.array_distinct("quantiles").alias("edges"))
    q = q.withColumn("edges", F.when(F.size("edges") < 2, F.array(F.get("edges", F.lit(0)), F.get("edges", F.lit(0)) + 1e-12)).otherwise(F.col("edges")))
    m = m.join(F.broadcast(q) if q.count() <= MAX_FORECASTERS else q, "forecaster")
    k = F.size(F.filter("edges", lambda e: F.col("prediction") >= e)) - 1
    return m.withColumn("bin", F.greatest(F.lit(0), F.least(k, F.size("edges") - 2)))


def _bins(df: DataFrame, bins: int, strategy: str, weight_event: bool) -> DataFrame:
    """reliability's rows and n, the forecaster's number of markets. One aggregate of the markets: weights are scaled, so that they sum to
    a forecaster's number of rows, in the sums of its bins, of which there are few."""
    m = _placed(_weighted(df, weight_event), bins, strategy)
    w = F.col("weight")
    x = m.groupBy("forecaster", "bin").agg(F.sum(F.col("prediction") * w).alias("p"), F.sum(F.col("outcome") * w).alias("o"), F.sum(w).alias("w"), F.count("*").alias("rows"), F.sum("n").alias("n"))
    own = Window.partitionBy("forecaster")  # a row for each bin
    scale = F.sum("rows").over(own) / F.sum("w").over(own)
    return x.select("forecaster", "bin", (F.col("p") / F.col("w")).alias("confidence"), (F.col("o") / F.col("w")).alias("accuracy"), F.floor(F.round(F.col("w") * scale, 9)).alias("count"), F.sum("n").over(own).alias("n"))


def reliability(df: DataFrame, bins: int = 10, strategy: str = "uniform", weight_event: bool = True) -> DataFrame:
    """(forecaster, bin, confidence, accuracy, count): counts are whole numbers of weight."""
    return _bins(df, bins, strategy, weight_event).drop("n")


def calibration_error(df: DataFrame, bins: int = 10, strategy: str = "uniform", weight_event: bool = True) -> DataFrame:
    x = _bins(df, bins, strategy, weight_event)
    return x.groupBy("forecaster").agg(F.sum(F.abs(F.col("confidence") - F.col("accuracy")) * F.col("count") / F.col("n")).alias("score"))


def bin_details(table: DataFrame, bins: int = 10) -> DataFrame:
    """A reliability table over uniform bins, with each bin's centre and width and its share of the forecaster's count."""
    all_ = F.sum("count").over(Window.partitionBy("forecaster"))  # a row for each bin
    return table.withColumns({"center": (F.col("bin") + 0.5) / bins, "width": F.lit(1.0 / bins), "share": F.try_divide("count", all_)})
