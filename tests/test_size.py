"""Steps whose work must not grow faster than the rows: single passes, and no rows dealt by a few hot keys."""

import pytest
from pyspark.sql import functions as F

from oddsmith.operators import calibration, ranking, scores, select
from oddsmith.plans.derive import forecasts_wide

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calibration_is_one_aggregate(spark):
    x = forecasts_wide(spark, D)
    for by_event in (False, True):
        df = calibration.calibration_error(x, weight_event=by_event)
        assert "Join" not in plan(df).replace("BroadcastNestedLoopJoin", "")
        got = {r["forecaster"]: r["score"] for r in df.collect()}
        sums = {}
        for r in x.collect():
            n = len(r["prediction"])
            for p, o in zip(r["prediction"], r["outcome"]):
                s = sums.setdefault(r["forecaster"], {}).setdefault(max(0, min(9, sum(p >= k for k in [i * 0.1 for i in range(11)]) - 1)), [0.0, 0.0, 0.0, 0])
                w = 1 / n if by_event else 1.0
                for i, v in enumerate((p * w, o * w, w, 1)):
                    s[i] += v
        for name, bins in sums.items():
            n = sum(b[3] for b in bins.values())
            scale = n / sum(b[2] for b in bins.values())
            assert got[name] == pytest.approx(sum(abs(b[0] - b[1]) / b[2] * int(round(b[2] * scale, 9)) / n for b in bins.values()), abs=2e-3)


def test_median_round_is_one_sort(spark):
    rows = [("a", e, r, float(e)) for e in range(40) for r in range(1, 2 + e % 5)] + [("b", 1, 4, 0.0), ("b", 1, None, 0.0), ("b", 2, None, 0.0)]
    df = select.median_round(spark.createDataFrame(rows, "forecaster string, event_ticker long, round int, x double").repartition(4))
    assert plan(df).count("Sort ") == 1
    got = {(r["forecaster"], r["event_ticker"]): r["round"] for r in df.collect()}
    assert got == {**{("a", e): (1 + e % 5 + 1) // 2 for e in range(40)}, ("b", 1): 4, ("b", 2): None}


def test_hot_forecasters_are_not_dealt_by_name(spark):
    df = ranking.kish_interval(scores.brier_score(forecasts_wide(spark, D)))
    assert "SortMergeJoin" not in plan(df) and df.count() == 5
    assert plan(scores.market_brier_per_forecaster(forecasts_wide(spark, D))).count("Window") == 0


def test_json_that_is_fine_is_not_rewritten(spark):
    from oddsmith.sources.loaders import lenient_json

    texts = ['{"a": 1, "b": 2}', "{'a': None, 'b': 2,}", '{"a": 1', None, '{"None": 3, "x, ]": 4}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(lenient_json(F.col("t"), "map<string, double>").alias("m"))
    assert [r["m"] for r in df.collect()] == [{"a": 1.0, "b": 2.0}, {"a": None, "b": 2.0}, {"a": 1.0}, None, {"None": 3.0, "x, ]": 4.0}]


def test_equal_problems_are_fitted_once(spark):
    from oddsmith.operators import models

    cells = [(u, f"p{j:02}", (j % 3 + i) % 4, 1.0) for j in range(60) for i, u in enumerate("abc")]
    x, like = models._kinds(spark.createDataFrame(cells, "username string, problem_id string, k int, n double"))
    assert x.count() == 9 and {r["m"] for r in x.collect()} == {20.0}
    assert {(r["problem_id"], r["like"]) for r in like.collect()} == {(f"p{j:02}", f"p{j % 3:02}") for j in range(60)}


def test_daily_state_is_one_value():
    """A batch reads and writes a forecaster's state once, however many days it has."""
    import pandas as pd

    from oddsmith.streaming import state

    calls = []

    class Value:
        now = None

        def get(self):
            calls.append("get")
            return self.now

        def update(self, v):
            calls.append("update")
            self.now = v

    class Handle:
        getValueState = lambda self, *_: Value()
        registerTimer = lambda self, at: calls.append(at)

    class Timer:
        getCurrentWatermarkInMs = lambda self: 0

    p = state.DailyTotals()
    p.init(Handle())
    rows = pd.DataFrame({"at": [d * state._DAY * 1000 for d in range(9)], "score": 2.0, "weight": 1.0})
    assert list(p.handleInputRows(("a",), iter([rows]), Timer())) == [] and calls == ["get", state._DAY, "update"]
    assert p.read()[1] == {d: (2.0, 1.0, 1) for d in range(9)}
