"""The table function for SQL users: its schema, its refusals and its rows."""

import pytest
from pyspark.errors import PySparkException

from oddsmith.functions import sql


@pytest.fixture(scope="module")
def view(spark):
    sql.register_tables(spark)
    rows = [("a", [0.5, 0.25, 0.25], [0.4, 0.3, 0.3], 1), ("b", [0.2, 0.8], [0.5, 0.5], 2), ("c", None, [0.5], 3), ("d", [0.5], [0.5, 0.5], 4), ("e", [], [], 5)]
    spark.createDataFrame(rows, "name string, probs array<double>, odds array<double>, k int").createOrReplaceTempView("said")
    return lambda args: spark.sql(f"SELECT * FROM stakes({args})")


def test_rows(view):
    out = view("TABLE(said)")
    assert out.columns == ["name", "probs", "odds", "k", "option", "stake", "bet"]
    assert sorted((r["name"], r["k"], r["option"], r["stake"], r["bet"]) for r in out.collect()) == [("a", 1, 0, 1.0, 2.5), ("a", 1, 1, 0.0, 0.0), ("a", 1, 2, 0.0, 0.0), ("b", 2, 0, 0.0, 0.0), ("b", 2, 1, 1.0, 2.0)]
    log = {(r["name"], r["option"]): r["stake"] for r in view("TABLE(said), risk_aversion => 1D").collect()}
    assert log == {("a", 0): 0.5, ("a", 1): 0.25, ("a", 2): 0.25, ("b", 0): 0.2, ("b", 1): 0.8}
    crra = {r["option"]: r["stake"] for r in view("TABLE(SELECT name, probs AS p, odds FROM said WHERE name = 'b'), probs => 'p', risk_aversion => 0.5D").collect()}
    assert crra == pytest.approx({0: 0.04 / 0.68, 1: 0.64 / 0.68})


@pytest.mark.parametrize("args", ["TABLE(said), probs => 'nothing'", "TABLE(said), probs => 'name'", "TABLE(said), risk_aversion => 2D", "TABLE(SELECT *, 1 AS stake FROM said)", "1"])
def test_refusals(view, args):
    with pytest.raises(PySparkException):
        view(args).collect()


@pytest.mark.parametrize("risk", [0.0, 0.3, 0.5, 1.0])
def test_rows_by_batches(spark, view, risk):
    """The same rows as those of the table function, to the last forecast that stakes nothing; nulls within a vector give none."""
    rows = [(k, [((k * 7 + m * 3) % 11) / 10 for m in range(k % 5)], [((k * 5 + m * 13) % 19 + 1) / 20 for m in range(k % 5)]) for k in range(200)]
    rows += [(200, [None, 0.5], [0.5, 0.5]), (201, [0.5, 0.5], [None, 0.5]), (202, None, [0.5]), (203, [0.5], None), (204, [0.5], [0.5, 0.5]), (205, [0.0, 0.0], [0.5, 0.5])]
    spark.createDataFrame(rows, "k int, probs array<double>, odds array<double>").repartition(3).createOrReplaceTempView("said_by_batch")
    plain = {(r["k"], r["option"]): (r["stake"], r["bet"]) for r in spark.sql(f"SELECT * FROM stakes(TABLE(said_by_batch), risk_aversion => {risk}D)").collect()}
    got = spark.sql(f"SELECT k, option, stake, bet FROM said_by_batch LATERAL VIEW inline(stake_rows(probs, odds, {risk}D)) s AS option, stake, bet").collect()
    assert len(got) == len(plain) > 300
    for r in got:
        assert (r["stake"], r["bet"]) == pytest.approx(plain[r["k"], r["option"]], rel=1e-12)


def test_rows_by_batches_refuse(spark, view):
    with pytest.raises(PySparkException):
        spark.sql("SELECT stake_rows(array(0.5D), array(0.5D), 2D)").collect()


def test_query_goes_by_batches(spark):
    from oddsmith.queries import sql_stakes

    plan = sql_stakes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "BatchEvalPythonUDTF" not in plan
