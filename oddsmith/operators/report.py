"""The ranking front door: from any score frame to a ranked table, with an interval as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .ranking import SCORE_COLUMNS, aggregate_scores, by_round, ranked, written_interval
from .resample import bootstrap
from .scores import with_individual_baselines

FINISHED = ("ece_score", "sharpe_ratio")  # one value a forecaster already


def rank_by_score(
    df: DataFrame, score_col: str | None = None, ascending: bool | None = None, normalize_by_round: bool = False, aggregation: str = "mean", bootstrap_config: dict | None = None,
    bootstrap_scores: DataFrame | None = None, analytical_ci: bool | float | None = None, add_individualized_baselines: bool = False,
) -> DataFrame:
    """(rank, forecaster, score[, "95.0% ci"][, "# predictions"]), by rank.

    Without score_col the first known score column is taken, and without ascending the order that suits it. Scores that are
    finished already (ECE, Sharpe ratio) are ranked as they stand, baselines and rounds aside. Others are aggregated by weighted mean, sum or roi after rows
    without score are left out. bootstrap_config (num_samples, ci_level, num_se, random_seed) adds an interval from resamples of bootstrap_scores, or else of df;
    analytical_ci (True: 0.95, or a level) one from the effective sample size, of means only. The interval is written as ±0.0000, null where there is none.
    Ties share the least rank. An empty frame gives an empty table.
    """
    if bootstrap_config is not None and analytical_ci:
        raise ValueError("ask for a bootstrap or an analytical interval, not for both")
    level = 0.95 if analytical_ci is True else analytical_ci if isinstance(analytical_ci, float) else None
    score_col = score_col or next((c for c in SCORE_COLUMNS if c in df.columns), None)
    if score_col is None:
        raise ValueError(f"no score column: name one, or have one of {', '.join(SCORE_COLUMNS)}")
    ascending = SCORE_COLUMNS.get(score_col, False) if ascending is None else ascending
    if score_col in FINISHED:
        if bootstrap_config is not None:
            raise ValueError(f"{score_col} is aggregated already: there is nothing to resample")
        return ranked(df.select("forecaster", F.col(score_col).alias("score")), ascending).select("rank", "forecaster", "score").orderBy("rank", "forecaster")
    if level is not None and aggregation != "mean":
        raise ValueError("an analytical interval is of means only")

    def prepared(x: DataFrame) -> DataFrame:
        if aggregation == "roi" and "cost" not in x.columns:
            raise ValueError("roi needs a column cost")
        x = x.withColumn("score", F.col(score_col)) if score_col != "score" else x
        x = with_individual_baselines(x) if add_individualized_baselines else x
        x = x.where("score is not null")
        return by_round(x) if normalize_by_round else x

    x = prepared(df)
    if level is not None:
        x = cut(x.select("forecaster", "score", "weight"))  # ranking and interval start from scores that are worked out once
    out = ranked(aggregate_scores(x, aggregation), ascending)
    columns = ["rank", "forecaster", "score"]
    if level is not None or bootstrap_config is not None:
        o = {"num_samples": 1000, "ci_level": 0.95, "num_se": None, "random_seed": 42} | (bootstrap_config or {})
        name = f"{(level if level is not None else o['ci_level']) * 100}% ci"
        if level is not None:
            margins = written_interval(x, level)
        else:
            margins = bootstrap(x if bootstrap_scores is None else prepared(bootstrap_scores), o["num_samples"], o["ci_level"], aggregation, o["num_se"], o["random_seed"])
        margins = margins.select("forecaster", F.when(F.col("ci_margin").isNotNull() & ~F.isnan("ci_margin"), F.format_string("±%.4f", "ci_margin")).alias(name))
        out, columns = out.join(margins, "forecaster", "left"), [*columns, f"`{name}`"]
    return out.withColumnRenamed("n_predictions", "# predictions").select(*columns, "# predictions").orderBy("rank", "forecaster")
