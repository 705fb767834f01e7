import random

import pytest
from pyspark.sql import functions as F

from oddsmith import schema
from oddsmith.operators import calibration, challenge, diagnostics, models, ranking, replay, resample, scores, select

WIDE = "forecaster string, event_ticker string, round int, category string, prediction array<double>, outcome array<double>, odds array<double>, no_odds array<double>, close_time timestamp, snapshot_time timestamp, weight double"


def wide(spark, rows):
    return spark.createDataFrame([(f, e, r, "c", p, o, q, n, None, None, 1.0) for f, e, r, p, o, q, n in rows], WIDE)


def two(spark):
    return wide(spark, [("alice", f"e{k}", 1, [0.8, 0.2], [1.0, 0.0], [0.5, 0.5], [0.5, 0.5]) for k in range(5)] + [("bob", f"e{k}", 1, [0.3, 0.7], [1.0, 0.0], [0.5, 0.5], [0.5, 0.5]) for k in range(5)])


def test_brier_event_equals_market(spark):
    df = two(spark)
    a = {r["forecaster"]: (r["score"], r["rank"]) for r in ranking.rank_forecasters(scores.brier_score(df)).collect()}
    b = {r["forecaster"]: r["score"] for r in ranking.rank_forecasters(scores.brier_score(df, per_market=True)).collect()}
    assert a["alice"] == (pytest.approx(0.04), 1) and a["bob"][1] == 2
    assert {k: v[0] for k, v in a.items()} == pytest.approx(b)


def test_median_round_and_liquidity(spark):
    df = wide(spark, [("a", "e", r, [0.5], [1.0], [0.5], [0.5]) for r in (1, 2, 3, 4)] + [("a", "wide", 1, [0.5], [1.0], [0.9], [0.9]), ("a", "short", 1, [0.5], [1.0, 0.0], [0.5], [0.5])])
    assert [(r["event_ticker"], r["round"]) for r in select.scored_rows(df).collect()] == [("e", 2)]


def test_average_return_and_roi(spark):
    rows = {r["forecaster"]: r for r in ranking.rank_forecasters(scores.average_return(two(spark)), "roi", ascending=False).collect()}
    assert rows["alice"]["rank"] == 1 and rows["alice"]["score"] == pytest.approx(1.0) and rows["bob"]["score"] == pytest.approx(-1.0)
    flat = wide(spark, [("a", "e", 1, [0.5], [1.0], [0.5], [0.5])])
    assert scores.average_return(flat).count() == 0
    assert scores.average_return(flat.limit(0)).count() == 0


def test_calibration(spark):
    df = wide(spark, [("a", f"e{k}", 1, [0.7], [1.0 if k < 7 else 0.0], [0.5], [0.5]) for k in range(10)])
    for strategy in ("uniform", "quantile"):
        assert calibration.calibration_error(df, 5, strategy).first()["score"] == pytest.approx(0)
    with pytest.raises(ValueError):
        calibration.calibration_error(df, 1)


def challenge_frames(spark):
    """Three forecasters on two problems of four and two options; numbers drawn once from a seeded generator."""
    rng = random.Random(31)
    problems = spark.createDataFrame([("north", 1, [2], 4, "2023-05-04"), ("south", 2, [0], 2, "2023-05-05")], "problem_id string, problem_seq long, correct_option_idx array<int>, n_options int, end_time string")
    problems = problems.withColumn("end_time", F.col("end_time").cast("timestamp")).withColumn("category", F.lit("c"))
    rows = []
    for p, n in (("north", 4), ("south", 2)):
        for u in ("ines", "omar", "yuki"):
            x = [rng.randint(1, 9) for _ in range(n)]
            rows.append((f"{p}{u}", p, len(rows), u, [v / sum(x) for v in x], [v / 10 for v in x], 1.0, [0.4] * n, [0.65] * n))
    forecasts = spark.createDataFrame(rows, "forecast_id string, problem_id string, forecast_seq long, username string, probs array<double>, unnormalized_probs array<double>, weight double, odds array<double>, no_odds array<double>")
    return problems, forecasts


def test_crowd_and_uniform_weights(spark):
    problems, forecasts = challenge_frames(spark)
    said = [r["probs"][0] for r in forecasts.where("problem_id = 'south'").collect()]
    assert challenge.crowd(forecasts).where("problem_id = 'south' and option = 0").first()["crowd_prob"] == pytest.approx(sum(said) / 3)
    w = challenge.problem_weights(spark.createDataFrame([("north", 2.5), ("south", 2.5)], "problem_id string, discrimination double"))
    a, b = (sorted(r["score"] for r in challenge.rule_scores(problems, forecasts, "brier", weights=x).collect()) for x in (None, w))
    assert a == pytest.approx(b)


def test_problem_lookups(spark):
    problems, forecasts = challenge_frames(spark)
    ids = lambda x: sorted(r["problem_id"] for r in x.collect())
    few = forecasts.where("username <> 'omar' or problem_id = 'south'")
    assert ids(challenge.problems_of(problems, few, "omar")) == ["south"] and ids(challenge.problems_of(problems, few, "nobody")) == []
    assert ids(challenge.problem_by_id(problems, "north")) == ["north"] and ids(challenge.problem_by_id(problems, "west")) == []
    assert ids(challenge.first_problems(problems, 1)) == ["north"] and len(ids(challenge.first_problems(problems))) == 2 and ids(challenge.first_problems(problems, 0)) == []


def test_rank_table_finds_column_and_order(spark):
    df = spark.createDataFrame([("x", 0.1, 5.0), ("x", 0.3, 5.0), ("y", 0.4, 9.0), ("y", None, 9.0)], "forecaster string, ece_score double, sharpe_ratio double")
    assert {r["forecaster"]: (r["rank"], r["n_predictions"]) for r in ranking.rank_table(df).collect()} == {"x": (1, 2), "y": (2, 1)}
    assert {r["forecaster"]: r["rank"] for r in ranking.rank_table(df, "sharpe_ratio").collect()} == {"x": 2, "y": 1}
    assert {r["forecaster"]: r["rank"] for r in ranking.rank_table(df, "sharpe_ratio", ascending=True).collect()} == {"x": 1, "y": 2}
    with pytest.raises(ValueError, match="score column"):
        ranking.rank_table(df.select("forecaster"))


def test_aggregates_that_are_functions(spark):
    x = spark.createDataFrame([("a", v, 1.0) for v in (1.0, 2.0, 6.0)], "forecaster string, score double, weight double")
    assert ranking.aggregate_scores(x, lambda s: F.max(s) - F.min(s)).first()["score"] == 5.0


def test_bradley_terry(spark):
    problems = spark.createDataFrame([(f"p{k}", [0]) for k in range(3)], "problem_id string, correct_option_idx array<int>")
    for low, order in ((0.1, ["alice", "bob"]), (0.9, None)):
        rows = [(f"p{k}", u, k, [p, 1 - p]) for k in range(3) for u, p in (("alice", 0.9), ("bob", low))]
        r = models.bradley_terry(problems, spark.createDataFrame(rows, "problem_id string, username string, forecast_seq long, probs array<double>"), 30).orderBy("rank").collect()
        assert [x["username"] for x in r] == order if order else r[0]["score"] == pytest.approx(r[1]["score"])


def test_registered_bradley_terry_runs_to_the_default(spark, monkeypatch):
    from oddsmith import queries

    asked = []
    none = spark.createDataFrame([], "username string, score double")
    monkeypatch.setattr(models, "bradley_terry", lambda *a, **k: asked.append(k) or none)
    for name in ("bradley_terry", "bradley_terry_trajectory"):
        queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked == [{}, {"trajectory": True}]


def test_bradley_terry_against_plain_steps(spark):
    rng = random.Random(4)
    table = {(f"p{k}", u): rng.random() ** (u + 1) for k in range(30) for u in range(4) if rng.random() < 0.8}
    problems = spark.createDataFrame([(f"p{k}", [0]) for k in range(30)], "problem_id string, correct_option_idx array<int>")
    rows = [(p, str(u), 1, [x, 1 - x]) for (p, u), x in table.items()] + [("p0", None, 1, [0.5, 0.5])]
    got = models.bradley_terry(problems, spark.createDataFrame(rows, "problem_id string, username string, forecast_seq long, probs array<double>")).collect()
    skill = dict.fromkeys(range(4), 1.0)
    for _ in range(100):
        win, part = dict.fromkeys(skill, 0.0), dict.fromkeys(skill, 0.0)
        for p in {p for p, _ in table}:
            x = {u: table[p, u] for u in skill if (p, u) in table}
            for u in x:
                win[u] += skill[u] * x[u] / sum(skill[v] * x[v] for v in x)
                part[u] += 1 / sum(skill[v] for v in x)
        new = {u: win[u] / part[u] for u in skill}
        new = {u: 4 * v / sum(new.values()) for u, v in new.items()}
        far, skill = max(abs(new[u] - skill[u]) for u in skill), new
        if far < 1e-3:
            break
    assert {r["username"]: r["score"] for r in got} == pytest.approx({str(u): v for u, v in skill.items()})


def test_item_response_orders_abilities(spark):
    rng = random.Random(1)
    rows = [(f"u{a}", f"p{k}", min(1.0, max(0.0, 0.8 - 0.2 * a + rng.gauss(0, 0.1)))) for a in range(4) for k in range(40)]
    out = models.item_response(spark.createDataFrame(rows, "username string, problem_id string, score double"))
    ability = {r["id"]: r["location"] for r in out.where("kind = 'forecaster'").collect()}
    assert sorted(ability, key=ability.get) == ["u0", "u1", "u2", "u3"]


def test_item_response_reaches_the_mode(spark):
    rng = random.Random(8)
    rows = [(f"u{u}", f"p{k}", min(5, max(0, round(rng.gauss(3.2 - 0.8 * u + k % 4 / 3, 0.8)))) / 5) for u in range(4) for k in range(12)]
    scores = spark.createDataFrame(rows, "username string, problem_id string, score double")
    got = [{(r["kind"], r["id"]): r["location"] for r in models.item_response(scores, tolerance=x).collect()} for x in (0.02, 0.0005)]
    assert max(abs(got[0][i] - got[1][i]) for i in got[1]) < 0.1
    with pytest.raises(RuntimeError, match="still moves"):
        models.item_response(scores, rounds=2)


def test_replay(spark):
    problems, forecasts = challenge_frames(spark)
    x = challenge.rule_scores(problems, forecasts, "brier").withColumn("batch", F.when(F.col("problem_id") == "north", 0).otherwise(1))
    out = replay.cumulative(x, "batch")
    assert out.count() == 6 and out.where("batch = 1").agg(F.min("n")).first()[0] == 2
    assert replay.adaptive_windows(problems, 1, 2).select("window_end").distinct().count() == 1


def test_regression_and_p_value(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(10)], "x double, y double")
    r = {t["term"]: t["estimate"] for t in diagnostics.regression(df, "y", ["x"]).collect()}
    assert r["x"] == pytest.approx(2) and r["intercept"] == pytest.approx(1)
    assert diagnostics.t_p_value(2.0, 10) == pytest.approx(0.0734, abs=1e-3)


def test_t_and_f_against_tables():
    # Fixed values of printed tables of Student's t and of F.
    for df, q in ((1, 12.7062), (5, 2.5706), (30, 2.0423), (1000, 1.9623)):
        assert diagnostics.t_quantile(0.95, df) == pytest.approx(q, abs=1e-4)
    assert diagnostics.f_p_value(4.1028, 2, 10) == pytest.approx(0.05, abs=1e-4) and diagnostics.f_p_value(0.0, 2, 10) == 1


def test_regression_groups_keep_their_type(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k % 2, float(x), 3.0 * x + rng.random()) for k in range(2) for x in range(12)], "g int, x double, y double")
    out = diagnostics.regression(df, "y", ["x"], by=("g",))
    assert dict(out.dtypes)["g"] == "int" and out.count() == 4
    r = out.where("g = 1 and term = 'x'").first()
    half = (r["high"] - r["low"]) / 2
    assert half == pytest.approx(2.2281 * r["se"], rel=1e-4) and r["f_statistic"] == pytest.approx((r["estimate"] / r["se"]) ** 2) and r["f_p_value"] == pytest.approx(r["p_value"], abs=1e-9)


def test_violations(spark):
    problems, forecasts = challenge_frames(spark)
    problems = problems.withColumn("options", F.transform(F.sequence(F.lit(1), F.col("n_options")), lambda i: i.cast("string")))
    assert schema.violations(problems, forecasts).count() == 0
    assert schema.violations(problems, forecasts.withColumn("weight", F.lit(-1.0))).count() == 6


def test_item_response_edge_cases(spark):
    none = spark.createDataFrame([], "username string, problem_id string, score double")
    assert models.item_response(none).count() == 0
    rows = [("a", "p", 0.1), ("a", "p", 0.1), ("b", "p", None), (None, "p", 0.2), ("b", "q", 0.9)]
    out = models.posterior_summary(models.item_response(spark.createDataFrame(rows, none.schema), strategy="quantile"))
    r = {(x["kind"], x["id"]): x for x in out.collect()}
    assert set(r) == {("forecaster", "a"), ("forecaster", "b"), ("problem", "p"), ("problem", "q")}
    assert all(x["p5"] < x["location"] < x["p95"] and x["p50"] == pytest.approx(x["location"]) for x in r.values())
    with pytest.raises(ValueError):
        models.item_response(none, anchors=1)


def test_batches_cover_all_orders(spark):
    problems = spark.createDataFrame([(f"p{k}", 97 - k, f"2024-01-{1 + k % 28:02d}") for k in range(97)], "problem_id string, problem_seq long, end_time string")
    for order in ("sequential", "time", "random"):
        rows = replay.batches(problems, 10, order).collect()
        sizes = [sum(r["batch"] == b for r in rows) for b in range(10)]
        assert sizes == [10] * 9 + [7]
        if order != "random":
            key = {"sequential": "problem_seq", "time": "end_time"}[order]
            assert all(max(r[key] for r in rows if r["batch"] == b) <= min(r[key] for r in rows if r["batch"] == b + 1) for b in range(9))
    assert replay.batches(problems.limit(0)).count() == 0


def test_windows_by_category(spark):
    problems = spark.createDataFrame([("a", "2024-01-01", "x"), ("b", "2024-01-09", "x"), ("c", "2024-01-20", "y"), ("d", None, "y"), ("e", "2024-01-02", None)], "problem_id string, end_time string, category string").withColumn("end_time", F.col("end_time").cast("timestamp"))
    got = {r["problem_id"]: str(r["window_end"]) for r in replay.adaptive_windows(problems, 2, 1, "category").collect()}
    assert got == {"a": "2024-01-03", "b": "2024-01-09", "c": "2024-01-22", "e": "2024-01-04"}


def test_correlation_p_values(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 4.0), (4, 3.0), (5, 5.0), (None, 1.0)], "x int, y double")
    r = diagnostics.correlations(df, "x", "y").first()
    assert r["n"] == 5 and r["pearson"] == pytest.approx(0.8) and r["spearman"] == pytest.approx(0.8) and r["pearson_p"] == pytest.approx(0.1041, abs=1e-3)
    assert diagnostics.correlations(df.limit(0), "x", "y").first()["n"] == 0


def test_bradley_terry_trajectory(spark):
    problems, forecasts = challenge_frames(spark)
    steps = models.bradley_terry(problems, forecasts, 3, trajectory=True)
    assert steps.groupBy("iteration").count().where("count = 3").count() == 4
