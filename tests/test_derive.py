"""The derived forecasts against their definition in plain Python, and what is worked out once only."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from oddsmith import queries
from oddsmith.operators import ranking, report, scores
from oddsmith.plans import derive

D = "/root/testdata/sf0.001"
KEYS = [*range(130), 551_459, 551_460, 10**12 + 7, -1, -8, -83, -84, -1000, None]


def mod(a, b):  # with the sign of a, as in SQL
    return abs(a) % b * (1 if a >= 0 else -1)


def row(e, r, k):
    ms = [m * (1 if mod(e, 4) >= 0 else -1) for m in range(abs(mod(e, 4)) + 1)]
    o = [float(mod(e * 3 + m * 11, 5) < 2) for m in ms]
    ask = [5 + mod(e * 17 + k * 3 + m * 31, 91) for m in ms]
    said = [int((mod(e * 7 + r * 13 + k * 5 + m * 29, 101) * (5 - r) + int(x) * 100 * r) / 5) / 100 for m, x in enumerate(o)]
    no = [(100 + mod(e + m, 6) - 1 - a) / 100 for m, a in zip(ms, ask)]
    return said, o, [a / 100 for a in ask], no, datetime(2024, 1, 1) - timedelta(hours=1 + mod(e + k * 7, 60))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("derive"))
    spark.createDataFrame([(e, "2-HIGH", datetime(2024, 1, 1)) for e in KEYS], "o_orderkey long, o_orderpriority string, o_orderdate timestamp_ntz").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(r, f"f{r}") for r in range(5)], "r_regionkey int, r_name string").write.parquet(f"{at}/region.parquet")
    return at


@pytest.mark.parametrize("most", [1_000_000, 0])  # looked up, and in each row
def test_forecasts_are_as_defined(spark, made, monkeypatch, most):
    monkeypatch.setattr(derive, "MAX_SAYINGS", most)
    x = derive.forecasts_wide(spark, made).select("forecaster", "event_ticker", "round", "prediction", "outcome", "odds", "no_odds", "snapshot_time").collect()
    want = {(f"f{r}", e, k): row(e, r, k) for e in KEYS if e is not None for r in range(5) for k in range(1, 5) if mod(e + r * 3 + k, 7) < 4}
    assert {tuple(r)[:3]: tuple(r)[3:] for r in x} == want and len(x) == len(want)


def test_vectors_are_looked_up(spark):
    """Only keys below zero have their vectors worked out in rows of forecasts."""
    plan = derive.forecasts_wide(spark, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "coalesce(_prediction" in plan


def test_two_rankings_from_one_pass(spark):
    """The same as apart, and by the time they are compared only a row for each forecaster is left to read."""
    a, b = queries._two(spark, D)
    x = derive.forecasts_wide(spark, D)
    plain = ranking.rank_forecasters(scores.brier_score(x)), ranking.rank_forecasters(scores.average_return(x), "roi", ascending=False)
    for got, want in zip((a, b), plain):
        got, want = ({r["forecaster"]: (r["rank"], pytest.approx(r["score"])) for r in y.collect()} for y in (got, want))
        assert got == want and len(got) == 5
        assert "orders.parquet" not in str(a._jdf.queryExecution().optimizedPlan().toString()) and {f.rsplit("/", 2)[1].split("-")[0] for f in a.inputFiles()} == {"table"}


def test_rankings_leave_out_who_has_no_value(spark):
    x = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 5.0)], "forecaster string, s double, t double")
    got = ranking.rankings(x, {"s": (F.avg("s"), True), "t": (F.sum("t"), False)})
    assert {k: sorted(tuple(r) for r in v.collect()) for k, v in got.items()} == {"s": [("a", 1.0, 1), ("b", 2.0, 2)], "t": [("b", 5.0, 1)]}


def test_ranking_and_interval_work_scores_out_once(spark):
    x = scores.brier_score(derive.forecasts_wide(spark, D)).withColumnRenamed("score", "brier_score")
    out = report.rank_by_score(x, normalize_by_round=True, analytical_ci=0.9)
    assert out.count() == 5 and not any("orders.parquet" in f for f in out.inputFiles())
