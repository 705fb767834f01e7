"""A query for each operator, over the derived forecasts or the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sql as sql_scores
from .functions.vectors import bets_crra, bets_log, bets_neutral, normalized
from .operators import bayes, calibration, challenge, diagnostics, models, ranking, replay, report, resample, scores, select
from .plans.derive import challenge as derive_challenge
from .plans.derive import forecasts_wide
from .plans.lineage import shared_dir
from .schema import violations
from .sources import loaders, paged
from .sources.json_repair import tolerant_json
from .streaming import live, state

QUOTA = {"1-URGENT": 0.4, "2-HIGH": 0.3, "3-MEDIUM": 0.2, "5-LOW": 0.1}
_all: dict = {}


def query(fn):
    _all[fn.__name__] = fn
    return fn


def _r(df: DataFrame, *cols: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in cols})


def _ranking(df: DataFrame) -> DataFrame:
    return _r(df, "score")


@query
def brier_rank_event(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(ranking.rank_forecasters(scores.brier_score(forecasts_wide(spark, d))))


@query
def brier_market_level(spark, d):
    return _ranking(ranking.rank_forecasters(scores.brier_score(forecasts_wide(spark, d), per_market=True)))


@query
def brier_by_category(spark, d):
    return _ranking(ranking.category_and_overall(scores.brier_score(forecasts_wide(spark, d))))


@query
def brier_normalized_by_round(spark, d):
    x = select.liquid(forecasts_wide(spark, d))
    x = x.select("forecaster", "event_ticker", "round", F.size("odds").cast("double").alias("weight"), F.expr("aggregate(zip_with(prediction, outcome, (p, o) -> (p - o) * (p - o)), 0D, (s, v) -> s + v) / size(odds)").alias("score"))
    return _ranking(ranking.rank_forecasters(x, normalize_by_round=True))


@query
def market_brier_global(spark, d):
    return _ranking(scores.global_market_brier(forecasts_wide(spark, d)))


@query
def market_brier_per_forecaster(spark, d):
    return _ranking(scores.market_brier_per_forecaster(forecasts_wide(spark, d)))


@query
def market_brier_individualized(spark, d):
    return _ranking(ranking.rank_forecasters(scores.individualized_market_brier(forecasts_wide(spark, d))))


@query
def market_distance(spark, d):
    return _ranking(scores.market_distance(forecasts_wide(spark, d)))


@query
def market_baseline(spark, d):
    return _ranking(ranking.rank_forecasters(scores.brier_score(scores.with_market_baseline(forecasts_wide(spark, d)))))


@query
def individualized_baseline(spark, d):
    x = scores.brier_score(scores.with_market_baseline(forecasts_wide(spark, d)))
    return _ranking(ranking.rank_forecasters(scores.with_individual_baselines(x)))


@query
def avg_return_event(spark, d):
    return _ranking(ranking.rank_forecasters(scores.average_return(forecasts_wide(spark, d)), ascending=False))


@query
def avg_return_market(spark, d):
    return _ranking(ranking.rank_forecasters(scores.average_return(forecasts_wide(spark, d), per_market=True), "sum", ascending=False))


@query
def roi_rank(spark, d):
    return _ranking(ranking.rank_forecasters(scores.average_return(forecasts_wide(spark, d)), "roi", ascending=False))


@query
def return_legacy_all_in(spark, d):
    return _ranking(ranking.rank_forecasters(scores.legacy_return(forecasts_wide(spark, d)), ascending=False))


@query
def return_legacy_even(spark, d):
    return _ranking(ranking.rank_forecasters(scores.legacy_return(forecasts_wide(spark, d), even=True), ascending=False))


@query
def sharpe_ratio(spark, d):
    return _ranking(ranking.sharpe_ratio(scores.average_return(forecasts_wide(spark, d))))


@query
def sharpe_ratio_by_round(spark, d):
    return _ranking(ranking.sharpe_ratio(scores.average_return(forecasts_wide(spark, d)), normalize_by_round=True))


@query
def ece_uniform(spark, d):
    return _ranking(calibration.calibration_error(forecasts_wide(spark, d), weight_event=False))


@query
def ece_event_weighted(spark, d):
    return _r(calibration.calibration_error(forecasts_wide(spark, d)), "score", to=3)


@query
def reliability_bins(spark, d):
    return _r(calibration.reliability(forecasts_wide(spark, d), weight_event=False), "confidence", "accuracy")


@query
def ece_quantile(spark, d):
    return _ranking(calibration.calibration_error(forecasts_wide(spark, d), strategy="quantile", weight_event=False))


@query
def kish_ci(spark, d):
    return _r(ranking.kish_interval(scores.brier_score(forecasts_wide(spark, d))), "score", "ci_margin")


@query
def time_rank(spark, d):
    return select.with_time_rank(forecasts_wide(spark, d)).select("forecaster", "event_ticker", "round", "time_rank")


@query
def first_n(spark, d):
    return select.first_n(forecasts_wide(spark, d), 2).select("forecaster", "event_ticker", "round")


@query
def last_n(spark, d):
    return select.last_n(forecasts_wide(spark, d), 1).select("forecaster", "event_ticker", "round")


@query
def exponential_weight(spark, d):
    return _r(select.exponential(forecasts_wide(spark, d), 0.5).groupBy("forecaster").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")), "weight")


@query
def time_to_last(spark, d):
    return select.time_to_last(forecasts_wide(spark, d), 6, 24).select("forecaster", "event_ticker", "round", F.round("hours", 6).alias("hours"))


@query
def time_bins(spark, d):
    return select.time_bins(forecasts_wide(spark, d)).groupBy("forecaster", "bin_ord", "time_bin").agg(F.count("*").alias("n"), F.round(F.avg("hours"), 6).alias("mean_hours"))


@query
def median_round_dedup(spark, d):
    return select.median_round(forecasts_wide(spark, d)).select("forecaster", "event_ticker", "round")


def _rule(spark, d, rule, **options):
    problems, forecasts = derive_challenge(spark, d)
    problems = problems.where("size(correct_option_idx) > 0")
    return _ranking(challenge.rule_ranking(challenge.rule_scores(problems, forecasts, rule, **options)))


@query
def rule_brier(spark, d):
    return _rule(spark, d, "brier")


@query
def rule_log(spark, d):
    return _rule(spark, d, "log")


@query
def rule_spherical(spark, d):
    return _rule(spark, d, "spherical")


@query
def weighted_brier(spark, d):
    problems, _ = derive_challenge(spark, d)
    parameters = problems.where("size(correct_option_idx) > 0").select("problem_id", (1 + F.col("problem_id") % 17).cast("double").alias("discrimination"))
    return _rule(spark, d, "brier", weights=challenge.problem_weights(parameters))


@query
def rule_by_category(spark, d):
    problems, forecasts = derive_challenge(spark, d)
    x = challenge.rule_scores(problems.where("size(correct_option_idx) > 0"), forecasts, "brier_raw")
    x = x.select(F.col("username").alias("forecaster"), "category", "score", F.lit(1.0).alias("weight"))
    return _ranking(ranking.category_and_overall(x))


@query
def crowd_probs(spark, d):
    return _r(challenge.crowd(derive_challenge(spark, d)[1]), "crowd_prob")


def _bets(spark, d, make):
    x = derive_challenge(spark, d)[1].select("username", F.posexplode(make("probs", "odds")).alias("option", "bet"))
    return _r(x.groupBy("username", "option").agg(F.avg("bet").alias("bet"), F.count("*").alias("n")), "bet")


@query
def bets_neutral_stakes(spark, d):
    return _bets(spark, d, bets_neutral)


@query
def bets_log_stakes(spark, d):
    return _bets(spark, d, bets_log)


@query
def bets_crra_stakes(spark, d):
    return _bets(spark, d, lambda p, q: bets_crra(p, q, 0.5))


def _earned(spark, d, fn, *a):
    problems, forecasts = derive_challenge(spark, d)
    return _ranking(challenge.rule_ranking(fn(problems, forecasts, *a)))


@query
def avg_return_binary_reduction(spark, d):
    return _earned(spark, d, challenge.binary_earnings, 0.0)


@query
def avg_return_binary_log(spark, d):
    return _earned(spark, d, challenge.binary_earnings, 1.0)


@query
def avg_return_market_two_way(spark, d):
    return _earned(spark, d, challenge.market_earnings, 1.0)


@query
def sharpe_of_earnings(spark, d):
    return _r(challenge.sharpe_of_earnings(challenge.binary_earnings(*derive_challenge(spark, d), 1.0), "marginal"), "score")


def _two(spark, d):
    """Rankings by Brier score and by return on investment. Their event rows weigh as many as their markets, so market rows give the same."""
    x = scores.error_and_return(forecasts_wide(spark, d))
    roi = F.when(F.sum("cost") > 0, F.try_divide(F.sum("profit"), F.sum("cost"))).otherwise(F.when(F.count("profit") > 0, 0.0))
    return ranking.rankings(x, {"brier": (F.avg("error"), True), "roi": (roi, False)}).values()


@query
def spearman(spark, d):
    return _r(ranking.spearman(*_two(spark, d)), "correlation")


@query
def kendall_tau_a(spark, d):
    return _r(ranking.kendall(*_two(spark, d)), "correlation")


@query
def stream_every_k_days(spark, d):
    return _ranking(replay.every_days(scores.brier_score(forecasts_wide(spark, d)), 180))


@query
def stream_every_k_days_by_category(spark, d):
    return _ranking(replay.every_days(scores.brier_score(forecasts_wide(spark, d)), 365, by=("category",)))


@query
def stream_batches_cumulative(spark, d):
    problems, forecasts = derive_challenge(spark, d)
    problems = problems.where("size(correct_option_idx) > 0")
    x = challenge.rule_scores(problems, forecasts, "brier").join(replay.batches(problems, 1000).select("problem_id", "batch"), "problem_id")
    return _ranking(replay.cumulative(x, "batch"))


@query
def stream_over_time_buckets(spark, d):
    return replay.adaptive_windows(derive_challenge(spark, d)[0], 7, 50).groupBy("window_end").agg(F.count("*").alias("n_problems"))


@query
def filter_min_counts(spark, d):
    x = forecasts_wide(spark, d).select(F.col("event_ticker").alias("problem_id"), F.concat_ws("/", "forecaster", F.expr("event_ticker % 500")).alias("username"))
    return select.min_counts(x, 12, 40).groupBy("username").agg(F.count("*").alias("n"))


@query
def num_markets_distribution(spark, d):
    return select.first_per_event(forecasts_wide(spark, d)).groupBy(F.size("odds").alias("num_markets")).agg(F.count("*").alias("n_events"))


@query
def brier_by_num_markets(spark, d):
    x = diagnostics.dilution(select.scored_rows(forecasts_wide(spark, d)))
    from .functions.vectors import brier

    return _r(diagnostics.by_num_markets(x.select("num_markets", brier("prediction", "outcome").alias("score"))), "mean", "sd", "sem")


def _dilution(spark, d):
    from .functions.vectors import brier

    x = diagnostics.dilution(select.scored_rows(forecasts_wide(spark, d)))
    return x.select("forecaster", "num_markets", "dilution", brier("prediction", "outcome").alias("brier"))


@query
def dilution_regression(spark, d):
    x = _dilution(spark, d).groupBy("forecaster").agg(F.regr_slope("brier", "dilution").alias("slope"), F.regr_intercept("brier", "dilution").alias("intercept"), F.regr_r2("brier", "dilution").alias("r2"), F.count("*").alias("n"))
    return _r(x, "slope", "intercept", "r2")


@query
def dilution_regression_full(spark, d):
    x = diagnostics.regression(_dilution(spark, d), "brier", ["dilution", "num_markets"], by=("forecaster",))
    return _r(x, "estimate", "se", "p_value", "low", "high", "r2", "adjusted_r2", "f_statistic", "f_p_value")


@query
def score_over_round(spark, d):
    from .functions.vectors import brier

    x = forecasts_wide(spark, d).select("forecaster", "round", brier("prediction", "outcome").alias("score"))
    return _r(diagnostics.over_rounds(x, 2), "score")


@query
def score_over_time_bins(spark, d):
    from .functions.vectors import brier

    x = select.time_bins(forecasts_wide(spark, d)).groupBy("forecaster", "bin_ord", "time_bin").agg(F.avg(brier("prediction", "outcome")).alias("score"), F.count("*").alias("n"))
    return _r(x, "score")


@query
def gap_histogram(spark, d):
    x = select.hours_to_close(forecasts_wide(spark, d))
    return x.groupBy(F.floor(F.col("hours") / 5).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("hours"), 6).alias("mean_hours"))


@query
def rebalanced_events(spark, d):
    return select.rebalanced(forecasts_wide(spark, d), QUOTA).groupBy("category").agg(F.countDistinct("event_ticker").alias("n_events"), F.sum("event_ticker").alias("id_sum"))


@query
def json_props_parse(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.from_json("props", "k long").alias("p"))
    return x.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("k_sum"))


@query
def json_repair_props(spark, d):
    """Properties of events, five of six damaged in a way of their own, and read all the same."""
    text, kind = F.col("props"), F.col("event_id") % 6
    damaged = F.when(kind == 1, F.rtrim(text, F.lit("}"))).when(kind == 2, F.replace(text, F.lit('"'), F.lit(""))).when(kind == 3, F.replace(text, F.lit(":"), F.lit(": /* note */ ")))
    damaged = damaged.when(kind == 4, F.concat(F.lit("Answer: "), F.replace(text, F.lit("}"), F.lit(" 'left': [1, 2")))).when(kind == 5, F.replace(text, F.lit("}"), F.lit(', "note": "left open')))
    x = spark.read.parquet(f"{d}/events.parquet").select("event_type", kind.alias("damage"), tolerant_json(damaged.otherwise(text), "k long, left array<int>, note string").alias("p"))
    return x.groupBy("event_type", "damage").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("k_sum"), F.sum(F.coalesce(F.size("p.left"), F.lit(0))).alias("left"), F.count("p.note").alias("notes"))


@query
def paged_source(spark, d):
    """Pages stored by a hundred, and read through the paged source."""
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    spark.read.parquet(f"{d}/pages.parquet").withColumn("page", F.floor(F.col("page_id") / 100)).write.partitionBy("page").json(path)
    x = spark.read.format(paged.register(spark)).option("path", path).load()
    return x.groupBy("page").agg(F.count("*").alias("n"), F.sum("page_id").alias("id_sum"), F.sum(F.length("html")).alias("n_chars"), F.max("url").alias("last_url"))


@query
def live_windows(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").select("ts", F.col("event_type").alias("forecaster"), F.col("value").alias("score"), F.lit(1.0).alias("weight"))
    return _r(live.windowed_scores(x), "score")


@query
def problem_violations(spark, d):
    problems, forecasts = derive_challenge(spark, d)
    problems = problems.withColumn("options", F.transform(F.sequence(F.lit(0), F.col("n_options") - 1), lambda i: i.cast("string")))
    bad = forecasts.withColumn("weight", F.when(F.col("problem_id") % 10 == 3, -1.0).otherwise(F.col("weight")))
    return violations(problems, bad).groupBy("rule").agg(F.count("*").alias("n"))


@query
def crra_waterfill(spark, d):
    x = derive_challenge(spark, d)[1].select("username", "problem_id", "forecast_seq", "probs", "odds")
    x = challenge.waterfill_bets(x, 0.5).select("username", "problem_id", "forecast_seq", F.posexplode("stakes").alias("option", "stake"))
    return _r(x, "stake")


@query
def avg_return_binary_approx(spark, d):
    problems, forecasts = derive_challenge(spark, d)
    return _ranking(challenge.rule_ranking(challenge.binary_earnings(problems, forecasts, 0.5, approximate=True)))


@query
def avg_return_binary_baseline(spark, d):
    """With the market itself as a forecaster."""
    problems, forecasts = derive_challenge(spark, d)
    return _ranking(challenge.rule_ranking(challenge.binary_earnings(problems, challenge.with_market_row(forecasts), 0.5, approximate=True)))


@query
def sharpe_relative(spark, d):
    return _r(challenge.sharpe_of_earnings(challenge.binary_earnings(*derive_challenge(spark, d), 1.0), "relative", baseline="EUROPE"), "score")


@query
def rule_max(spark, d):
    problems, forecasts = derive_challenge(spark, d)
    return _ranking(challenge.rule_ranking(challenge.rule_scores(problems.where("size(correct_option_idx) > 0"), forecasts, "brier"), "max"))


@query
def rule_own_aggregate(spark, d):
    """An aggregate that is no name: the ninth decile."""
    problems, forecasts = derive_challenge(spark, d)
    x = challenge.rule_scores(problems.where("size(correct_option_idx) > 0"), forecasts, "brier")
    return _ranking(challenge.rule_ranking(x, lambda c: F.percentile(c, 0.9)))


@query
def rank_auto(spark, d):
    x = scores.brier_score(forecasts_wide(spark, d)).select("forecaster", F.col("score").alias("brier_score"), F.lit(1.0).alias("sharpe_ratio"))
    return _ranking(ranking.rank_table(x))


@query
def rank_with_interval(spark, d):
    x = scores.brier_score(scores.with_market_baseline(forecasts_wide(spark, d))).withColumnRenamed("score", "brier_score")
    return _ranking(report.rank_by_score(x, normalize_by_round=True, analytical_ci=0.9))


@query
def rank_with_bootstrap(spark, d):
    """Event scores ranked, with intervals from resampled markets."""
    x = forecasts_wide(spark, d)
    events, markets = (scores.brier_score(x, per_market=m).withColumnRenamed("score", "brier_score") for m in (False, True))
    return _ranking(report.rank_by_score(events, bootstrap_config={"num_samples": 1000}, bootstrap_scores=markets))


@query
def rank_finished(spark, d):
    return _ranking(report.rank_by_score(calibration.calibration_error(forecasts_wide(spark, d), weight_event=False).withColumnRenamed("score", "ece_score")))


@query
def problems_of_forecaster(spark, d):
    problems, forecasts = derive_challenge(spark, d)
    return challenge.problems_of(problems, forecasts, "EUROPE").groupBy("category").agg(F.count("*").alias("n"), F.sum("problem_id").alias("id_sum"))


@query
def first_problems(spark, d):
    return challenge.first_problems(derive_challenge(spark, d)[0], 50).select("problem_id", "n_options", "category")


@query
def stream_roi_by_category(spark, d):
    return _ranking(replay.every_days(scores.average_return(forecasts_wide(spark, d)), 365, ascending=False, how="roi", by=("category",)))


def _written(spark, df: DataFrame, kind: str) -> str:
    """Path of df as compressed files of a kind, in the shared folder."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    df.write.options(header=True, quoteAll=True, escape='"', compression="gzip").format(kind).save(path)
    return path


def _markets(value) -> Column:
    """A map from the markets' names to `value` of their places."""
    return F.map_from_entries(F.transform(F.sequence(F.lit(0), F.size("odds") - 1), lambda i: F.struct(F.concat(F.lit("m"), i.cast("string")).alias("key"), value(i).alias("value"))))


def _said(p: str) -> Column:
    return F.struct(F.transform(p, lambda x, i: F.struct(F.concat(F.lit("m"), i.cast("string")).alias("market"), x.alias("probability"))).alias("probabilities"))


@query
def load_nightly(spark, d):
    """Forecasts written as the two CSV files of the nightly form, and loaded from them."""
    x = forecasts_wide(spark, d)
    outcome = F.to_json(_markets(lambda i: F.get("outcome", i)))
    p = x.select(F.col("forecaster").alias("predictor_name"), "event_ticker", F.col("round").alias("submission_count"), F.to_json(_said("prediction")).alias("prediction"), outcome.alias("market_outcome"), "category")
    asks = F.to_json(_markets(lambda i: F.struct(F.round(100 * F.get("odds", i)).alias("yes_ask"), F.round(100 * F.get("no_odds", i)).alias("no_ask"))))
    s = x.select("event_ticker", "round", "odds", "no_odds", "snapshot_time", "close_time").dropDuplicates(["event_ticker", "round"])
    s = s.select("event_ticker", F.col("round").alias("submission_count"), asks.alias("market_data"), F.date_format("snapshot_time", "yyyy-MM-dd'T'HH:mm:ss").alias("snapshot_time"), F.date_format("close_time", "yyyy-MM-dd'T'HH:mm:ss").alias("close_time"))
    x = loaders.nightly(spark, _written(spark, p, "csv"), _written(spark, s, "csv"), exclude=("ASIA",))
    cost = F.aggregate(F.zip_with("odds", "no_odds", lambda a, b: a + b), F.lit(0.0), lambda s, v: s + v)
    x = x.groupBy("forecaster", "category").agg(F.count("*").alias("n"), F.sum(cost).alias("asks"), F.sum(F.size("outcome")).alias("n_markets"), F.avg("time_rank").alias("time_rank"), F.max("close_time").alias("last_close"))
    return _r(x, "asks", "time_rank", to=5)


@query
def load_json_challenge(spark, d):
    """Problems and predictions written as JSON, and loaded from it."""
    x = forecasts_wide(spark, d)
    said = x.select(F.col("event_ticker").cast("string").alias("problem_id"), F.col("forecaster").alias("username"), F.date_format("snapshot_time", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.transform("prediction", lambda p: p + 0.01).alias("prediction"))
    name = lambda i: F.concat(F.lit("m"), i.cast("string"))
    first = F.array_position("outcome", 1.0)
    meta = x.groupBy(F.col("event_ticker").cast("string").alias("problem_id")).agg(F.first("outcome").alias("outcome"), F.first("close_time").alias("close_time"))
    meta = meta.select("problem_id", F.lit("t").alias("title"), F.transform("outcome", lambda _, i: name(i)).alias("options"), F.when(first > 0, name(first - 1)).otherwise("none").alias("correct_answer"), F.struct(F.date_format("close_time", "yyyy-MM-dd").alias("end_time")).alias("metadata"))
    read = lambda x: spark.read.schema(x.schema).json(_written(spark, x, "json"))
    # Sizes of compressed files say little of what they hold, so they must not make Spark broadcast the problems.
    loader = loaders.JsonChallenge(read(said), read(meta).hint("merge"))
    problems, forecasts = loader.load()
    score = challenge.rule_scores(problems.where("size(correct_option_idx) > 0"), forecasts, "brier")
    return _r(score.groupBy("username").agg(F.avg("score").alias("score"), F.count("*").alias("n"), F.max(F.to_date("end_time")).alias("last_end")), "score")


@query
def load_csv_challenge(spark, d):
    """Forecasts with their market states written as one CSV file, and loaded from it, with the market as a forecaster."""
    x = forecasts_wide(spark, d)
    state = F.to_json(_markets(lambda i: F.struct(F.lit(100.0 + 0).alias("liquidity"), F.round(100 * F.get("odds", i)).alias("yes_ask"), F.round(100 * F.get("no_odds", i)).alias("no_ask"), F.date_format("close_time", "yyyy-MM-dd").alias("close_time"))))
    rows = x.select("event_ticker", F.col("forecaster").alias("predictor_name"), F.to_json(_said("prediction")).alias("prediction"), state.alias("market_info"), F.to_json(_markets(lambda i: F.get("outcome", i))).alias("market_outcome"), "category")
    problems, forecasts = loaders.CsvChallenge.from_file(spark, _written(spark, rows, "csv"), market_baseline=True).load()
    first = lambda c: F.get(c, F.lit(0))
    x = forecasts.select("problem_id", "username", first("odds").alias("odds"), first("no_odds").alias("no_odds"), first("unnormalized_probs").alias("said"))
    x = x.join(problems.select("problem_id", F.size("correct_option_idx").alias("won")).hint("merge"), "problem_id")
    x = x.groupBy("username").agg(F.count("*").alias("n"), F.sum("won").alias("n_won"), F.avg("odds").alias("odds"), F.avg("no_odds").alias("no_odds"), F.avg("said").alias("said"))
    return _r(x, "odds", "no_odds", "said")


def _interval(df: DataFrame) -> DataFrame:
    return _r(df, "score", "se", "ci_margin", "low", "high")


@query
def bootstrap_ci(spark, d):
    return _interval(resample.bootstrap(scores.brier_score(forecasts_wide(spark, d))))


@query
def bradley_terry(spark, d):
    return _ranking(models.bradley_terry(*derive_challenge(spark, d)))


def _last_errors(spark, d) -> DataFrame:
    """(username, problem_id, score): the raw Brier score of each forecaster's last forecast."""
    problems, forecasts = derive_challenge(spark, d)
    x = challenge.rule_scores(problems.where("size(correct_option_idx) > 0"), forecasts, "brier_raw")
    return x.groupBy("username", "problem_id").agg(F.max_by("score", "forecast_seq").alias("score"))


@query
def irt_abilities(spark, d):
    return models.item_response(_last_errors(spark, d))


@query
def irt_mcmc(spark, d):
    return bayes.item_response_mcmc(_last_errors(spark, d))


@query
def irt_svi(spark, d):
    return bayes.item_response_svi(_last_errors(spark, d))


@query
def rule_median(spark, d):
    problems, forecasts = derive_challenge(spark, d)
    return _ranking(challenge.rule_ranking(challenge.rule_scores(problems.where("size(correct_option_idx) > 0"), forecasts, "brier"), "median"))


@query
def first_option_brier(spark, d):
    problems, forecasts = derive_challenge(spark, d)
    x = challenge.rule_scores(problems.where("size(correct_option_idx) > 0"), forecasts, challenge.first_option_brier)
    return _ranking(challenge.rule_ranking(x, ascending=True))


@query
def avg_return_event_bets(spark, d):
    return _earned(spark, d, challenge.event_earnings, 1.0)


@query
def calibration_ranking(spark, d):
    return _ranking(challenge.calibration_ranking(*derive_challenge(spark, d)))


@query
def reliability_details(spark, d):
    return _r(calibration.bin_details(calibration.reliability(forecasts_wide(spark, d), weight_event=False)), "confidence", "accuracy", "center", "width", "share")


@query
def correlation_grid(spark, d):
    problems, forecasts = derive_challenge(spark, d)
    problems = problems.where("size(correct_option_idx) > 0")
    rankings = {rule: challenge.rule_ranking(challenge.rule_scores(problems, forecasts, rule)) for rule in ("brier", "log", "spherical")}
    return _r(ranking.correlation_grid(rankings, "username"), "spearman", "kendall")


def _events(spark, d):
    return diagnostics.dilution(select.first_per_event(forecasts_wide(spark, d)))


@query
def dilution_correlation(spark, d):
    x = diagnostics.correlations(_events(spark, d), "num_markets", "dilution")
    none = lambda c: F.when(F.abs(c) < 5e-7, 0.0).otherwise(F.round(c, 6)).alias(c)  # no sign on a zero
    return x.select("n", none("pearson"), none("spearman"))


@query
def dilution_band(spark, d):
    return _r(diagnostics.line_band(_dilution(spark, d), "brier", "dilution", [0, 0.25, 0.5, 0.75, 1]), "fit", "margin")


@query
def market_count_bins(spark, d):
    x = diagnostics.market_count_bins(_events(spark, d), [0, 1, 2, 3])
    return x.groupBy("market_bin").agg(F.count("*").alias("n_events"), F.round(F.avg("dilution"), 6).alias("mean_dilution"))


@query
def market_scatter(spark, d):
    return _r(diagnostics.market_scatter(scores.with_market_baseline(forecasts_wide(spark, d)), "EUROPE"), "market_prob", "model_prob")


@query
def event_rollup(spark, d):
    return _r(diagnostics.event_rollup(scores.brier_score(forecasts_wide(spark, d)).withColumn("num_markets", F.col("weight").cast("int"))), "mean_score")


@query
def gap_bins(spark, d):
    return diagnostics.histogram(select.hours_to_close(forecasts_wide(spark, d)), "hours", 50, 0.0, 100.0)


@query
def gap_statistics(spark, d):
    x = select.time_bins(forecasts_wide(spark, d))
    return _r(diagnostics.column_statistics(x, "hours", by=("time_bin",)), "mean", "median", "low", "high")


@query
def event_mean_by_num_markets(spark, d):
    from .functions.vectors import brier

    x = diagnostics.dilution(select.scored_rows(forecasts_wide(spark, d))).select("event_ticker", "num_markets", brier("prediction", "outcome").alias("score"))
    return _r(diagnostics.by_num_markets(x, event_mean=True), "mean", "sd", "sem")


@query
def return_curves(spark, d):
    return _ranking(replay.return_curves(*derive_challenge(spark, d), increment=500))


@query
def frequent_forecasters(spark, d):
    x = forecasts_wide(spark, d).select(F.concat_ws("/", "forecaster", F.expr("event_ticker % 97")).alias("forecaster"))
    return select.frequent(x, 36).groupBy("forecaster").agg(F.count("*").alias("n"))


@query
def dataset_counts(spark, d):
    return select.dataset_counts(forecasts_wide(spark, d))


@query
def time_bin_pivot(spark, d):
    names = [name for _, _, name in select.TIME_BINS]
    x = select.time_bins(forecasts_wide(spark, d)).groupBy("forecaster").pivot("time_bin", names).count()
    return x.select("forecaster", *(F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(f"bin_{k}") for k, n in enumerate(names)))


@query
def stream_roi_every_k_days(spark, d):
    return _ranking(replay.every_days(scores.average_return(forecasts_wide(spark, d)), 180, ascending=False, how="roi"))


@query
def stream_windows_by_category(spark, d):
    problems, forecasts = derive_challenge(spark, d)
    problems = problems.where("size(correct_option_idx) > 0")
    x = challenge.rule_scores(problems, forecasts, "brier").join(replay.adaptive_windows(problems, 30, 200, "category").select("problem_id", "window_end"), "problem_id")
    return _ranking(replay.cumulative(x, "window_end", by=("category",)))


@query
def sql_functions(spark, d):
    sql_scores.register(spark)
    forecasts_wide(spark, d).createOrReplaceTempView("oddsmith_forecasts")
    return spark.sql("SELECT forecaster, round(avg(brier(prediction, outcome)), 6) AS score, count(*) AS n FROM oddsmith_forecasts WHERE NOT spread_exceeds(odds, no_odds, 1.03D) GROUP BY forecaster")


@query
def sql_stakes(spark, d):
    """Stakes as rows from SQL, over the raw columns of the challenge form: `stakes` for the vectors of a row, which are worked out by batches."""
    sql_scores.register_tables(spark)
    derive_challenge(spark, d)[1].select("username", "probs", "odds").createOrReplaceTempView("oddsmith_challenge")
    x = spark.sql("SELECT username, option, avg(stake) AS stake, avg(bet) AS bet, count(*) AS n FROM oddsmith_challenge LATERAL VIEW inline(stake_rows(probs, odds, 0.5D)) s AS option, stake, bet GROUP BY username, option")
    return _r(x, "stake", "bet")


@query
def bootstrap_roi(spark, d):
    return _interval(resample.bootstrap(scores.average_return(forecasts_wide(spark, d)), how="roi"))


@query
def bootstrap_market_level(spark, d):
    return _interval(resample.bootstrap(scores.brier_score(forecasts_wide(spark, d), per_market=True)))


@query
def bradley_terry_trajectory(spark, d):
    return _ranking(models.bradley_terry(*derive_challenge(spark, d), trajectory=True))


def _arriving(spark, d, make, **columns) -> DataFrame:
    """make(stream) over events that come up to four days after their time, in files of ten days of arrival: the stream is
    started anew for each, goes on from its checkpoint, and ends when the files are processed."""
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", *(c.alias(k) for k, c in columns.items()))
    arrival = F.floor((F.unix_micros("ts") / 1_000_000 + F.col("event_id") % 97 * 3600) / 864_000)
    events = events.withColumn("arrival", arrival)
    base, out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", None
    for r in events.select("arrival").distinct().orderBy("arrival").collect():  # a row for each ten days
        events.where(F.col("arrival") == r["arrival"]).write.mode("append").parquet(f"{base}/in")
        stream = make(spark.readStream.schema(events.schema).parquet(f"{base}/in"))
        out = state.run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return out


@query
def live_daily_totals(spark, d):
    x = _arriving(spark, d, state.daily_totals, forecaster=F.col("user_id").cast("string"), score=F.col("value"), weight=F.lit(1.0))
    return _r(x, "score")


@query
def live_first_forecasts(spark, d):
    x = _arriving(spark, d, lambda s: state.first_forecasts(s.withColumnRenamed("event_id", "seq")), forecast_id=F.concat_ws("/", "user_id", "event_type"), score=F.col("value"))
    return x.select("forecast_id", "seq", "score")


@query
def live_sessions(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").select("ts", F.col("event_type").alias("forecaster"), F.col("value").alias("score"))
    return _r(live.sessions(x, gap="30 minutes"), "score")


def queries() -> dict:
    return dict(_all)
