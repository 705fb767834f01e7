"""Exact quantiles by narrowing, against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmith.operators import quantiles as Q

PROBS = [0.0, 0.1, 0.25, 0.5, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("bins, limit", [(Q.BINS, Q.LIMIT), (2, 1), (7, 30)])
def test_against_sorting(spark, monkeypatch, bins, limit):
    monkeypatch.setattr(Q, "BINS", bins)
    monkeypatch.setattr(Q, "LIMIT", limit)
    g = np.random.default_rng(1)
    groups = {"wide": g.normal(size=400) * 10.0 ** g.integers(-3, 4, 400), "ties": g.integers(0, 3, 300).astype(float), "one": np.array([2.5]), "same": np.full(50, -1.0), None: g.random(7)}
    groups["near"] = 1 + np.arange(40) * 2.0**-50  # neighbouring numbers
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("wide", None), ("wide", float("nan")), ("nothing", None)]
    df = spark.createDataFrame(rows, "name string, v double").repartition(3)
    got = {r["name"]: r["quantiles"] for r in Q.exact_quantiles(df, ["name"], "v", PROBS).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k] == pytest.approx(np.quantile(x, PROBS).tolist(), rel=1e-12), k
    assert Q.exact_quantiles(df.limit(0), ["name"], "v", [0.5]).collect() == []
    with pytest.raises(ValueError):
        Q.exact_quantiles(df, ["name"], "v", [1.5])


def test_no_buffer_holds_a_group(spark):
    """A hot group: lists that are sorted in one place stay within the limit."""
    df = spark.range(200_000).select(F.lit("hot").alias("name"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e9).alias("v"))
    got = Q.exact_quantiles(df, ["name"], "v", [0.01, 0.5, 0.75]).first()["quantiles"]
    want = df.agg(F.percentile("v", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.75)))).first()[0]
    assert got == pytest.approx(want, rel=1e-12)
