"""Row selection: lengths, liquidity, one round per event, weights and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import spread_exceeds

MAX_SPREAD = 1.03
PAIR = ["event_ticker", "forecaster"]  # the event first: its values differ most, so sorts compare few names
TIME_BINS = [(0, 3, "0-3h"), (3, 6, "3-6h"), (6, 12, "6-12h"), (12, 24, "12-24h"), (24, 48, "24-48h"), (48, 1e9, "48h+")]


def length_matched(df: DataFrame, columns=("prediction", "outcome", "odds", "no_odds")) -> DataFrame:
    n = F.size(columns[0])
    test = n > 0
    for c in columns[1:]:
        test = test & (F.size(c) == n)
    return df.where(test)


def liquid(df: DataFrame, max_spread: float = MAX_SPREAD) -> DataFrame:
    return df.where(~spread_exceeds("odds", "no_odds", max_spread))


def median_round(df: DataFrame) -> DataFrame:
    """The row of each (forecaster, event) nearest to its median round; ties go to
    the lower one: the middle one in their order, of an even number the lower of both. Rows without round come
    last, and count only where all are such."""
    w = Window.partitionBy(*PAIR)
    order = w.orderBy(F.asc_nulls_last("round"))
    n = F.count("round").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = df.withColumns({"_n": n, "_k": F.row_number().over(order)})
    return x.where("_k = greatest(1, (_n + 1) div 2)").drop("_n", "_k")


def scored_rows(df: DataFrame, max_spread: float = MAX_SPREAD) -> DataFrame:
    return liquid(median_round(length_matched(df)), max_spread)


def first_per_event(df: DataFrame) -> DataFrame:
    """One row per event: the first by (forecaster, round). An aggregate, so hot events combine before the shuffle."""
    rest = [c for c in df.columns if c not in ("event_ticker", "forecaster", "round")]
    x = df.groupBy("event_ticker").agg(F.min(F.struct("forecaster", "round", *rest)).alias("x"))
    return x.select("event_ticker", "x.*")


def markets(df: DataFrame) -> DataFrame:
    """One row per market, exploded once."""
    keep = [c for c in df.columns if c not in ("prediction", "outcome", "odds", "no_odds")]
    x = df.select(*keep, F.posexplode(F.arrays_zip("prediction", "outcome", "odds", "no_odds")).alias("market_index", "m"))
    return x.select(*keep, "market_index", "m.*")


def with_time_rank(df: DataFrame) -> DataFrame:
    """Rank from the latest round down, ties at their average, from 0."""
    w = Window.partitionBy(*PAIR)
    peers = F.count("*").over(Window.partitionBy(*PAIR, "round"))
    return df.withColumn("time_rank", F.rank().over(w.orderBy(F.desc("round"))) + (peers - 1) / 2.0 - 1)


def first_n(df: DataFrame, n: int) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*PAIR).orderBy("round"))
    return df.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def last_n(df: DataFrame, n: int) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*PAIR).orderBy(F.desc("round")))
    return df.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def exponential(df: DataFrame, rate: float) -> DataFrame:
    return with_time_rank(df).withColumn("weight", F.exp(-rate * F.col("time_rank")))


def hours_to_close(df: DataFrame) -> DataFrame:
    """Hours from the snapshot to the close; without a close, to the event's last snapshot."""
    close = F.coalesce("close_time", F.max("snapshot_time").over(Window.partitionBy("event_ticker")))
    return df.withColumn("hours", (F.unix_micros(close) - F.unix_micros("snapshot_time")) / 3.6e9)


def time_to_last(df: DataFrame, low: float, high: float) -> DataFrame:
    return hours_to_close(df).where((F.col("hours") >= low) & (F.col("hours") < high))


def time_bins(df: DataFrame, bins=TIME_BINS) -> DataFrame:
    """hours -> (bin_ord, time_bin); rows outside all bins go."""
    order, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, (lo, hi, name) in enumerate(bins):
        inside = (F.col("hours") >= lo) & (F.col("hours") < hi)
        order, label = F.when(inside, k).otherwise(order), F.when(inside, name).otherwise(label)
    return hours_to_close(df).withColumn("bin_ord", order).withColumn("time_bin", label).where("time_bin is not null")


def min_counts(forecasts: DataFrame, per_problem: int, per_user: int) -> DataFrame:
    """Problems with enough forecasts, then users with enough of what remains."""
    many = forecasts.groupBy("problem_id").count().where(F.col("count") >= per_problem)
    kept = forecasts.join(many, "problem_id", "left_semi")
    users = kept.groupBy("username").count().where(F.col("count") >= per_user)
    return kept.join(users, "username", "left_semi")


def rebalanced(df: DataFrame, quota: dict[str, float], seed: int = 7) -> DataFrame:
    """Rows of an exact stratified sample of events: categories in the quota's proportions.
    Events are drawn by a multiplicative hash of their integer id; other categories count as `Other`."""
    if not quota or sum(quota.values()) <= 0:
        raise ValueError("the quota must have a positive sum")
    cat = F.when(F.col("category").isin(*quota), F.col("category")).otherwise("Other")
    events = df.select("event_ticker", cat.alias("cat")).distinct()
    counts = {r["cat"]: r["count"] for r in events.where(F.col("cat").isin(*quota)).groupBy("cat").count().collect()}  # a row for each category of the quota
    lowest = min(int(counts.get(c, 0) / q) for c, q in quota.items() if q > 0)
    # Events are numbered by hash value: at most 1,000,003 counts for each category are
    # summed up in order, and only events of one value are sorted together.
    events = events.withColumn("h", (F.col("event_ticker") * 48271 + seed) % 1000003)
    before = F.sum("m").over(Window.partitionBy("cat").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    held = events.groupBy("cat", "h").agg(F.count("*").alias("m")).select("cat", "h", F.coalesce(before, F.lit(0)).alias("before"))
    take = F.lit(0)
    for c, q in quota.items():
        take = F.when(F.col("cat") == c, int(lowest * q)).otherwise(take)
    held = held.withColumn("take", take).where("before < take")
    k = F.col("before") + F.row_number().over(Window.partitionBy("cat", "h").orderBy("event_ticker"))
    return df.join(events.join(held, ["cat", "h"]).withColumn("k", k).where("k <= take"), "event_ticker", "left_semi")


def frequent(df: DataFrame, least: int, user: str = "forecaster") -> DataFrame:
    """Rows of forecasters that have at least `least` rows; counts are combined before they move."""
    many = df.groupBy(user).count().where(F.col("count") >= least).select(user)  # a row for each forecaster
    return df.join(many, user, "left_semi")


def dataset_counts(df: DataFrame) -> DataFrame:
    """One row: forecasters, events, submissions and markets (those of each event's first row)."""
    n = df.agg(F.countDistinct("forecaster").alias("n_forecasters"), F.count("*").alias("n_submissions"))
    m = first_per_event(df).agg(F.count("*").alias("n_events"), F.sum(F.size("odds")).alias("n_markets"))
    return n.crossJoin(F.broadcast(m))  # one row each
