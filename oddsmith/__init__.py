"""Scores and ranks forecasters on prediction markets, as Spark jobs."""

import sys

from pyspark import cloudpickle

from .functions.sql import register as register_sql_functions
from .operators.bayes import item_response_mcmc, item_response_svi
from .operators.calibration import calibration_error, reliability
from .operators.challenge import binary_earnings, calibration_ranking, event_earnings, market_earnings, problem_weights, rule_ranking, rule_scores
from .operators.models import bradley_terry, item_response, posterior_summary
from .operators.ranking import kendall, kish_interval, rank_forecasters, rank_table, sharpe_ratio, spearman
from .operators.report import rank_by_score
from .operators.resample import bootstrap
from .operators.scores import average_return, brier_score
from .schema import violations
from .sources.loaders import ChallengeLoader, CsvChallenge, JsonChallenge, nightly

# Functions that run on executors travel by value: a cluster needs no copy of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "ChallengeLoader", "CsvChallenge", "JsonChallenge", "average_return", "binary_earnings", "bootstrap", "bradley_terry", "brier_score", "calibration_error", "calibration_ranking",
    "event_earnings", "item_response", "item_response_mcmc", "item_response_svi", "kendall", "kish_interval", "market_earnings", "nightly", "posterior_summary", "problem_weights", "rank_by_score", "rank_forecasters", "rank_table", "register_sql_functions",
    "reliability", "rule_ranking", "rule_scores", "sharpe_ratio", "spearman", "violations",
]
