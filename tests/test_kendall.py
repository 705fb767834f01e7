"""Kendall's tau by inversions against all pairs."""

import random

import numpy as np
import pytest

from oddsmith.operators import ranking


def plain(a, b):
    n = len(a)
    return sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(n) for j in range(i)) / (n * (n - 1) / 2)


def test_inversions_against_all_pairs():
    r = random.Random(1)
    for n in [*range(0, 12), 33, 64, 100]:
        p = list(range(n))
        r.shuffle(p)
        assert ranking.inversions(np.array(p, np.int64)) == sum(p[i] > p[j] for j in range(n) for i in range(j))


def test_tau_with_ties_against_all_pairs():
    g = np.random.default_rng(2)
    for n, k in ((2, 1), (5, 3), (40, 6), (60, 100)):
        a, b = g.integers(0, k, n).astype(float), g.integers(0, k, n).astype(float)
        assert ranking._tau(a, b) == pytest.approx(plain(a, b))


@pytest.mark.parametrize("block", [ranking.BLOCK, 37])
def test_kendall_by_parts(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "BLOCK", block)
    g = np.random.default_rng(3)
    n = 400
    a = g.integers(0, 60, n).astype(float)
    b = np.where(g.random(n) < 0.4, 7.0, a + g.integers(-20, 20, n))  # one rank holds two fifths
    names = [f"f{k}" for k in range(n)]
    left = spark.createDataFrame([*zip(names, a.tolist()), ("only here", 1.0), ("none", None)], "forecaster string, rank double")
    right = spark.createDataFrame([*zip(names, b.tolist()), ("only there", 1.0), ("none", 2.0)], "forecaster string, rank double").repartition(3)
    assert ranking.kendall(left, right).first()[0] == pytest.approx(plain(a, b))
    grid = ranking.correlation_grid({"x": left.where("rank is not null"), "y": right}).first()
    assert grid["kendall"] == pytest.approx(plain(a, b)) and grid["n"] == n
    assert ranking.kendall(left.limit(0), right).first()[0] == 0 and ranking.kendall(left.limit(1), right).first()[0] == 0
