import math
import random

import pytest
from pyspark.sql import functions as F

from oddsmith.functions import vectors as V
from oddsmith.operators import challenge, ranking


def one(spark, sql, column):
    return spark.sql(f"SELECT {sql}").select(column.alias("v")).first()["v"]


P = "array(0.25D, 0.15D, 0.5D, 0.1D) AS probs, array(2) AS correct_option_idx, 4 AS n_options"


def test_scoring_rules(spark):
    error = (0.25**2 + 0.15**2 + 0.5**2 + 0.1**2) / 4
    assert one(spark, P, challenge.rule_column("brier")) == pytest.approx(1 - error)
    assert one(spark, P, challenge.rule_column("brier_raw")) == pytest.approx(error)
    assert one(spark, P, challenge.rule_column("log")) == pytest.approx(math.log(0.5))
    assert one(spark, "array(0.004D, 0.996D) AS probs, array(0) AS correct_option_idx, 2 AS n_options", challenge.rule_column("log", 0.02)) == pytest.approx(math.log(0.02))
    assert one(spark, P, challenge.rule_column("spherical")) == pytest.approx(0.5 / math.sqrt(0.345))


def test_bets(spark):
    s = "array(0.15D, 0.85D) AS p, array(0.3D, 0.8D) AS q"
    assert one(spark, s, V.bets_neutral("p", "q")) == [0.0, 1.25]
    assert one(spark, s, V.bets_log("p", "q")) == pytest.approx([0.5, 1.0625])
    assert one(spark, s, V.bets_crra("p", "q", 1.0)) == pytest.approx([0.5, 1.0625])
    for bad in (1.01, -1):
        with pytest.raises(ValueError):
            V.bets_crra("p", "q", bad)


def test_smoothing_and_normalizing(spark):
    assert one(spark, "array(0D, 1D) AS a", V.smoothed("a")) == [0.005, 0.995]
    assert one(spark, "array(0D, 0D) AS a", V.normalized("a")) == [0.5, 0.5]
    assert one(spark, "array(1D, 3D) AS a", V.normalized("a")) == [0.25, 0.75]


def plain_stakes(p, q, g):
    """The same by search: the level at which positive edges above it spend the budget."""
    a, b = [x / y - 1 for x, y in zip(p, q)], [x * (1 - x) / y / y for x, y in zip(p, q)]
    if max(a) - min(a) < 1e-9:
        return [1 / len(p)] * len(p)
    best = a.index(max(a))
    if g == 0 or max(a) <= 0:
        return [float(i == best) for i in range(len(p))]
    spent = lambda v: sum((x - v) / (g * y) for x, y in zip(a, b) if x > 0 and x > v)
    lo, hi = -1e6, max(a)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if spent(mid) > 1 else (lo, mid)
    x = [(x - lo) / (g * y) if x > 0 and x > lo else 0.0 for x, y in zip(a, b)]
    return [v / sum(x) for v in x]


def test_stakes_fill_positive_edges_only(spark):
    rng = random.Random(17)
    rows = [([0.55, 0.45], [0.5, 0.5]), ([0.5, 0.5], [0.25, 0.25]), ([0.2, 0.3], [0.5, 0.6])]
    for n in (2, 3, 5, 8):
        rows += [([rng.uniform(0.02, 0.98) for _ in range(n)], [rng.uniform(0.02, 0.98) for _ in range(n)]) for _ in range(40)]
    df = spark.createDataFrame(rows, "p array<double>, q array<double>")
    for g in (0.0, 0.3, 1.0):
        for r in df.select("p", "q", V.stakes_crra("p", "q", g).alias("s")).collect():
            assert r["s"] == pytest.approx(plain_stakes(r["p"], r["q"], g), abs=1e-6)
    assert df.limit(1).select(V.stakes_crra("p", "q", 0.5).alias("s")).first()["s"] == [1.0, 0.0]
    with pytest.raises(ValueError):
        V.stakes_crra("p", "q", 1.5)


def test_close(spark):
    assert [one(spark, f"{a}D AS a, {b}D AS b", V.close("a", "b")) for a, b in ((1, 1.000001), (1, 1.1), (0, 1e-9), (0, 1e-7))] == [True, False, True, False]


def test_correlations(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "forecaster string, rank int")
    b = a.withColumn("rank", 4 - F.col("rank"))
    for f in (ranking.spearman, ranking.kendall):
        assert f(a, a).first()[0] == pytest.approx(1)
        assert f(a, b).first()[0] == pytest.approx(-1)
    assert ranking.spearman(a, a.withColumn("rank", F.lit(1))).first()[0] == 0


def test_z_score():
    assert ranking.z_score(0.95) == pytest.approx(1.959964, abs=1e-6)


@pytest.mark.parametrize("make", [V.normalized, lambda a: V.bets_neutral(a, "q"), lambda a: V.bets_crra(a, "q", 0.5), V.argmax])
def test_arguments_are_worked_out_once(spark, make):
    """Lambdas share nothing with each other, so an argument that stood in one was worked out again for each element."""
    df = spark.createDataFrame([([0.5, 0.25], [0.4, 0.6])], "p array<double>, q array<double>")
    plan = df.select(make(F.expr("transform(p, x -> x + 7)")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("+ cast(7 as double)") == 1
    if make is not V.argmax and make is not V.normalized:
        assert all(plan.count(f) <= 1 for f in ("array_max(", "power(", "aggregate("))


def test_stakes_of_a_column_of_aversions(spark):
    """One call serves rows of different aversions, as the market's own row needs; null and uneven vectors keep their places."""
    rows = [([0.7, 0.6], [0.5, 0.3], 0.0), ([0.7, 0.6], [0.5, 0.3], 0.5), (None, [0.5], 0.5), ([], [], 0.5), ([0.5], [0.5, 0.5], 0.0)]
    df = spark.createDataFrame(rows, "p array<double>, q array<double>, g double").coalesce(1)
    got = [r["s"] for r in df.select(V.stakes_crra("p", "q", F.col("g")).alias("s")).collect()]
    assert got[0] == [0.0, 1.0] and got[1] == pytest.approx(plain_stakes([0.7, 0.6], [0.5, 0.3], 0.5), abs=1e-6) and got[2:4] == [None, []] and got[4] == [0.0, 1.0]
