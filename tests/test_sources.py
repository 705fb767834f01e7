import json

import pytest
from pyspark.sql import functions as F

from oddsmith.sources import loaders, sinks


def test_nightly(spark, tmp_path):
    said = json.dumps({"probabilities": [{"market": "B", "probability": 0.3}, {"market": "A", "probability": 0.6}]}).replace('"', '""')
    won = json.dumps({"B": 1, "A": 0}).replace('"', '""')
    asks = json.dumps({"B": {"yes_ask": 40, "no_ask": 61}, "A": {"yes_ask": 55, "no_ask": 46}}).replace('"', '""')
    (tmp_path / "p.csv").write_text(f'predictor_name,event_ticker,submission_count,prediction,market_outcome,category\nx,e,1,"{said}","{won}",c\ny,e,1,"{said}","{won}",c\n')
    (tmp_path / "s.csv").write_text(f'event_ticker,submission_count,market_data,snapshot_time,close_time\ne,1,"{asks}",2024-01-01T00:00:00.5+00:00,2024-01-02T00:00:00Z\n')
    r = loaders.nightly(spark, str(tmp_path / "p.csv"), str(tmp_path / "s.csv"), exclude=("y",)).collect()
    assert len(r) == 1 and r[0]["prediction"] == [0.6, 0.3] and r[0]["outcome"] == [0.0, 1.0]
    assert r[0]["odds"] == [0.55, 0.4] and r[0]["no_odds"] == [0.46, 0.61] and r[0]["time_rank"] == 0 and r[0]["close_time"] is not None


def test_lenient_json(spark):
    rows = ["{'a': 'True North', 'b': None, 'c': True,}", '{"a": "x, ]", "b": 1, "c": false, }', "{\"a\": \"it's None\", 'b': [1, 2][0]}", '{"a": "say \\"None\\"", "b": 2}', "{'a': ''}", None]
    x = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t string")
    got = {r["k"]: r["j"] for r in x.select("k", loaders.lenient_json(F.col("t"), "struct<a: string, b: double, c: boolean>").alias("j")).collect()}
    assert tuple(got[0]) == ("True North", None, True) and tuple(got[1]) == ("x, ]", 1.0, False) and got[3]["a"] == 'say "None"' and got[4]["a"] == "" and got[5] is None
    assert got[2]["a"] in ("it's None", None)  # an expression is no literal


def test_json_challenge(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"problem_id": "1", "username": "a", "timestamp": "2024-01-01T00:00:00Z", "prediction": [0.2, 0.6]}]))
    (tmp_path / "m.json").write_text(json.dumps([{"problem_id": "1", "title": "t", "options": ["x", "y"], "correct_answer": "y", "metadata": {"end_time": "2024-01-02"}}]))
    problems, forecasts = loaders.JsonChallenge.from_files(spark, str(tmp_path / "p.json"), str(tmp_path / "m.json")).load()
    assert problems.first()["correct_option_idx"] == [1] and forecasts.first()["probs"] == pytest.approx([0.25, 0.75])


def test_csv_challenge(spark):
    info = "{'A': {'liquidity': 200, 'yes_ask': 60, 'no_ask': 42, 'yes_bid': 50, 'close_time': '2024-01-02'}, 'B': {'liquidity': 5, 'yes_ask': 30, 'no_ask': None}}"
    row = ("e", "x", '{"probabilities": [{"market": "A", "probability": 1.4}]}', info, '{"A": 1, "B": 0}')
    df = spark.createDataFrame([row], "event_ticker string, predictor_name string, prediction string, market_info string, market_outcome string")
    problems, forecasts = loaders.CsvChallenge(df, market_baseline=True).load()
    f = {r["username"]: r for r in forecasts.collect()}
    assert problems.first()["correct_option_idx"] == [0]
    assert f["x"]["unnormalized_probs"] == [1.0, 0.0] and f["x"]["odds"] == pytest.approx([0.6, 0.995]) and "market-baseline" in f


def test_comments(spark):
    one = '<div class="flyover-comment rationale"><span class="membership-username">{}</span><span data-localizable-timestamp="2024-01-01T00:00:00Z"></span><div class="prediction-values"><div class="probability-value">{}%</div><div class="probability-value">-</div></div></div>'
    html = one.format("ann", 25) + one.format("bob", 50) + one.format("ann", 99)
    r = {x["username"]: x["prediction"] for x in loaders.comments(spark.createDataFrame([("1", html)], "problem_id string, html string")).collect()}
    assert r == {"ann": [0.25, 0.0], "bob": [0.5, 0.0]}


def test_question_pages(spark):
    row = '<div class="question-row-component" id="row-table-question-{}"><h5><a href="/q/{}">Will <b>it</b> rain?</a></h5><span class="info-heading">Open</span><span data-localizable-timestamp="2024-05-01"></span><a data-sort="predictors_count">12 people</a><a data-sort="prediction_sets_count"> 40 sets</a></div>'
    r = loaders.question_list(spark.createDataFrame([(row.format(7, 7) + row.format(8, 8),), ("",), (None,)], "html string")).orderBy("problem_id").collect()
    assert [tuple(x) for x in r] == [(k, "Will it rain?", f"/q/{k}", "Open", "2024-05-01", 12, 40) for k in ("7", "8")]
    page = '<table class="consensus-table x"><tbody><tr><td> Yes </td><td><i class="fa fa-check-circle"></i></td><td>1</td></tr><tr><td>No</td><td></td><td>2</td></tr><tr><td>short</td></tr></tbody></table>'
    r = loaders.question_options(spark.createDataFrame([("7", page), ("8", None)], "problem_id string, html string")).orderBy("problem_id").collect()
    assert r[0]["options"] == ["Yes", "No"] and r[0]["correct_answer"] == "Yes" and r[1]["options"] == [] and r[1]["correct_answer"] is None


def test_market_rows(spark):
    said = json.dumps({"probabilities": [{"market": "a", "probability": 1.5}]})
    rows = [("x", said, '{"a": 1, "b": 1}'), ("x", "broken", '{"a": 1}'), ("y", said, '{"a": 1}')]
    r = loaders.market_rows(spark.createDataFrame(rows, "predictor_name string, prediction string, market_outcome string"), ["x"]).collect()
    assert [(x["num_markets"], x["dilution"], x["brier"]) for x in r] == [(2, 1.0, 0.5)]


def test_sinks(spark, tmp_path, caplog):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.25)], "rank int, forecaster string, score double")
    with caplog.at_level("INFO"):
        assert "a" in sinks.log_ranking(df) and "forecaster" in caplog.text
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_parameters(df, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.parquet(str(tmp_path / "p")).count() == 2
    stream = spark.readStream.schema("rank int, forecaster string, score double").json(str(tmp_path / "j"))
    for _ in range(2):  # the second run finds nothing new
        sinks.append_stream(stream, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.schema("rank int, forecaster string, score double").json(str(tmp_path / "s")).count() == 2


def test_metadata_of_challenges(spark, tmp_path):
    rows = [("e1", "s1", "a", "{}", "{}", "{}"), ("e1", "s2", "a", "{}", "{}", "{}"), ("e2", "s2", "b", "{}", "{}", "{}")]
    df = spark.createDataFrame(rows, "event_ticker string, submission_id string, predictor_name string, prediction string, market_info string, market_outcome string")
    path = str(tmp_path / "rows.csv")
    df.write.csv(path, header=True)
    assert loaders.CsvChallenge.from_file(spark, path).metadata() == {"title": "Arena challenge", "problems": 2, "forecasters": 2, "predictions_file": path}
    assert loaders.CsvChallenge(df.drop("submission_id")).metadata()["problems"] == 2
    (tmp_path / "gjo_metadata.json").write_text('[{"problem_id": 1, "title": "t", "options": ["a"], "correct_answer": "a", "metadata": {"end_time": "2024-01-01"}}, {"problem_id": 2, "title": "u", "options": ["a"], "correct_answer": "a", "metadata": {"end_time": null}}]')
    (tmp_path / "said.json").write_text('[{"problem_id": 1, "username": "x", "timestamp": "2024-01-01T00:00:00Z", "prediction": [1.0]}]')
    a, b = str(tmp_path / "said.json"), str(tmp_path / "gjo_metadata.json")
    assert loaders.JsonChallenge.from_files(spark, a, b).metadata() == {"title": "gjo", "problems": 2, "forecasters": 1, "predictions_file": a, "metadata_file": b}


ODD = ['{"A": {"yes_ask": 1, "no_ask": 2}}', "{'A': {'yes_ask': None, 'no_ask': 5,}}", '{"A": {"yes_ask": 1', '{"A": {"yes_ask": 1}, "A": {"yes_ask": 2}}', '{"A": 3, "B": null}', "[1]", "", None]


def test_texts_are_read_once(spark, tmp_path):
    """Conditions on what a text says, with which it was read anew for each element, do not reach the text; and it says what it said."""
    x = spark.createDataFrame(list(enumerate(ODD)), "i int, t string")
    want = {r["i"]: r["v"] for r in x.select("i", loaders.lenient_json(F.col("t"), loaders.ASKS).cast("string").alias("v")).collect()}
    assert {r["i"]: r["v"] for r in loaders._read(x, t=loaders.ASKS).select("i", F.col("t").cast("string").alias("v")).collect()} == want
    (tmp_path / "p.csv").write_text("predictor_name,event_ticker,submission_count,prediction,market_outcome,category\n")
    (tmp_path / "s.csv").write_text("event_ticker,submission_count,market_data,snapshot_time,close_time\n")
    plan = loaders.nightly(spark, str(tmp_path / "p.csv"), str(tmp_path / "s.csv"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and not any("from_json" in line for line in plan.split("\n") if "Join Inner" in line or "Generate" in line or "Filter" in line)
    assert plan.count("ArrowEvalPython") == 2


def test_rows_of_a_csv_challenge_are_not_shuffled(spark):
    """Rows stay where they were read, but where their markets are not those of the first row of their event; and files are compressed."""
    from oddsmith import queries

    state = lambda **asks: json.dumps({k: {"liquidity": 200, "yes_ask": v, "no_ask": 100 - v} for k, v in asks.items()})
    said = lambda **p: json.dumps({"probabilities": [{"market": k, "probability": v} for k, v in p.items()]})
    schema = "event_ticker string, predictor_name string, prediction string, market_info string, market_outcome string"
    same = [("e", u, said(A=0.3, B=0.6), state(A=40, B=50), '{"A": 1, "B": 0}') for u in "xy"]
    f = loaders.CsvChallenge(spark.createDataFrame(same, schema)).load()[1]
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and sorted(r["username"] for r in f.collect()) == ["x", "y"]
    rows = [("e", "x", said(A=0.3, B=0.6), state(A=40, B=50), '{"A": 1, "B": 0}'), ("e", "y", said(B=0.2, A=0.9), state(B=70, C=10), None), (None, "z", None, None, None), ("d", "x", said(C=0.5), "no text", None)]
    problems, f = loaders.CsvChallenge(spark.createDataFrame(rows, schema).coalesce(1), market_baseline=True).load()
    got = {(r["problem_id"], r["username"]): (r["unnormalized_probs"], r["odds"]) for r in f.collect()}
    assert got == {("e", "x"): ([0.3, 0.6], [0.4, 0.5]), ("e", "y"): ([0.9, 0.2], [0.995, 0.7]), ("e", "market-baseline"): ([pytest.approx(0.6975), pytest.approx(0.6)],) * 2, ("d", "x"): (None, None)}
    assert {r["problem_id"]: (r["options"], r["correct_option_idx"]) for r in problems.collect()} == {"e": (["A", "B"], [0]), "d": (None, None), None: (None, None)}
    path = queries._written(spark, spark.createDataFrame(same, schema), "csv")
    assert [r["input"] for r in spark.createDataFrame([(p,) for p in spark.read.text(path).inputFiles()], "input string").collect() if not r["input"].endswith(".csv.gz")] == []


def test_files_of_a_json_challenge_are_compressed(spark):
    """The files are small, and a join of them does not take their size for that of their rows: nothing is broadcast."""
    from oddsmith import queries

    df = queries.load_json_challenge(spark, "/root/testdata/sf0.001")
    assert len(df.inputFiles()) > 1 and all(f.endswith(".json.gz") for f in df.inputFiles())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan and df.count() == 5
