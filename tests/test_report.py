"""The ranking front door: its branches, refusals and texts."""

import pytest

from oddsmith import rank_by_score

SCHEMA = "forecaster string, event_ticker string, round int, weight double, brier_score double, cost double"


@pytest.fixture(scope="module")
def scores(spark):
    rows = [("a", f"e{k}", 1, 1.0, 0.1 * (k % 4), 1.0) for k in range(8)] + [("b", f"e{k}", r, 2.0, 0.2, 2.0) for k in range(4) for r in (1, 2)]
    rows += [("market-baseline", f"e{k}", r, 1.0, 0.25, 1.0) for k in range(8) for r in (1, 2)] + [("c", "e0", 1, 1.0, None, 1.0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_plain_and_with_baselines(scores):
    out = rank_by_score(scores)
    assert out.columns == ["rank", "forecaster", "score", "# predictions"]
    assert [tuple(r)[:2] for r in out.collect()] == [(1, "a"), (2, "b"), (3, "market-baseline")]
    names = [r["forecaster"] for r in rank_by_score(scores, add_individualized_baselines=True).collect()]
    assert set(names) == {"a", "b", "market-baseline", "a-market-baseline", "b-market-baseline", "c-market-baseline"}
    assert [r["rank"] for r in rank_by_score(scores, ascending=False).collect()] == [1, 2, 3]


def test_intervals_as_text(scores):
    a, b, m = rank_by_score(scores, analytical_ci=True).collect()
    assert a["95.0% ci"].startswith("±0.0") and b["95.0% ci"] == "±0.0000" == m["95.0% ci"]
    a, b, _ = rank_by_score(scores, bootstrap_config={"num_samples": 50, "ci_level": 0.9}, normalize_by_round=True).collect()
    assert len(a["90.0% ci"]) == 7 and b["90.0% ci"] == "±0.0000" and a["# predictions"] == 8
    roi = rank_by_score(scores, aggregation="roi", bootstrap_config={"num_samples": 20, "num_se": 1.0}).collect()
    assert {r["forecaster"]: round(r["score"], 6) for r in roi} == {"a": 0.15, "b": 0.1, "market-baseline": 0.25}


def test_finished_scores_pass_through(spark):
    x = spark.createDataFrame([("a", 0.3), ("b", 0.1), ("c", 0.3)], "forecaster string, ece_score double")
    assert [tuple(r) for r in rank_by_score(x).collect()] == [(1, "b", 0.1), (2, "a", 0.3), (2, "c", 0.3)]
    assert rank_by_score(x.withColumnRenamed("ece_score", "sharpe_ratio")).first()["score"] == 0.3
    with pytest.raises(ValueError):
        rank_by_score(x, bootstrap_config={})


def test_refusals_and_empty(scores):
    for options in ({"bootstrap_config": {}, "analytical_ci": True}, {"aggregation": "sum", "analytical_ci": 0.9}):
        with pytest.raises(ValueError):
            rank_by_score(scores, **options)
    with pytest.raises(ValueError):
        rank_by_score(scores.drop("brier_score"))
    with pytest.raises(ValueError):
        rank_by_score(scores.drop("cost"), aggregation="roi")
    assert rank_by_score(scores.limit(0), analytical_ci=True).collect() == []
