"""The bootstrap against plain versions, and under every partitioning."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmith.operators import resample

SCHEMA = "forecaster string, score double, weight double, cost double"


def rows_of(seed, n, names="ab"):
    r = random.Random(seed)
    return [(r.choice(names), r.choice([r.random(), 0.25, -0.5]), r.choice([1.0, 2.0, 0.5, 0.0, 3.0]), r.choice([1.0, 0.2])) for _ in range(n)]


def one_hash(key, b, j):
    m = resample._M
    a = resample.mix32(b * resample._WEYL + key + 1 & m)
    return resample.mix32(resample.mix32(j * resample._WEYL + a & m) ^ resample.mix32(a ^ 0x5BD1E995))


def plain(rows, how, samples, seed, by_weight=True):
    """Every draw one by one: forecaster -> values of the resamples."""
    out = {}
    for name in {r[0] for r in rows}:
        own = sorted((round(s, 9), w, c) for f, s, w, c in rows if f == name)
        rate = [w if by_weight else 1.0 for _, w, _ in own]
        ends = np.cumsum(rate)
        key = resample.stream(int(hashlib.md5(name.encode()).hexdigest()[:8], 16), seed, 0)
        out[name] = []
        for b in range(samples):
            got = [own[int(np.searchsorted(ends, one_hash(key, b, j) / 2**32 * ends[-1], side="right"))] for j in range(len(own))]
            s, w, c = (sum(x[k] for x in got) for k in range(3))
            v = {"mean": sum(x[0] * x[1] for x in got) / w if w else None, "sum": s, "roi": s / c if c > 0 else 0.0, "max": max(x[0] for x in got), "min": min(x[0] for x in got)}[how]
            out[name] += [v] if v is not None else []
    return out


@pytest.mark.parametrize("how", ["mean", "sum", "roi", "max", "min"])
def test_every_draw_against_a_plain_version(spark, how):
    rows = rows_of(1, 90)
    want = plain(rows, how, 60, 7)
    for r in resample.bootstrap(spark.createDataFrame(rows, SCHEMA), samples=60, how=how, seed=7).collect():
        v = np.array(want[r["forecaster"]])
        own = [x for x in rows if x[0] == r["forecaster"]]
        point = {"mean": np.average([x[1] for x in own], weights=[x[2] for x in own]), "sum": sum(x[1] for x in own), "roi": sum(x[1] for x in own) / sum(x[3] for x in own), "max": max(x[1] for x in own), "min": min(x[1] for x in own)}[how]
        assert r["score"] == pytest.approx(point, abs=1e-8) and r["n_predictions"] == len(own)
        assert r["se"] == pytest.approx(v.std(ddof=1), abs=1e-8)
        assert r["ci_margin"] == pytest.approx(np.sort(abs(v - point))[math.ceil(0.95 * 60) - 1], abs=1e-8)


def test_rules_of_the_interval(spark):
    rows = rows_of(3, 60, "a")
    df, v = spark.createDataFrame(rows, SCHEMA), np.sort(plain(rows, "mean", 40, 42, by_weight=False)["a"])
    point = np.average([x[1] for x in rows], weights=[x[2] for x in rows])
    run = lambda **o: resample.bootstrap(df, samples=40, by_weight=False, **o).first()
    assert run(rule="challenge")["ci_margin"] == pytest.approx(np.sort(abs(v - point))[38], abs=1e-8)
    assert run(rule="challenge", level=1.0)["ci_margin"] == pytest.approx(abs(v - point).max(), abs=1e-8)  # the index is kept inside
    assert run(num_se=2.0)["ci_margin"] == pytest.approx(2 * v.std(ddof=1), abs=1e-8)
    r = run(symmetric=False)
    assert [r["low"], r["high"]] == pytest.approx(np.quantile(v, [0.025, 0.975]), abs=1e-8)
    r = run(symmetric=False, rule="challenge")
    assert [r["low"], r["high"]] == pytest.approx(np.percentile(v, [0.025, 0.975]), abs=1e-8)


@pytest.mark.parametrize("share", [resample.SHARE, 40])
def test_results_do_not_hang_on_partitions(spark, monkeypatch, share):
    monkeypatch.setattr(resample, "SHARE", share)
    df = spark.createDataFrame(rows_of(4, 900, "abc"), SCHEMA)
    seen = set()
    for n, lanes in ((1, 1), (4, 8), (16, 3)):
        monkeypatch.setattr(resample, "LANES", lanes)
        out = resample.bootstrap(df.repartition(n), samples=50).collect()
        seen.add(tuple(sorted((r["forecaster"], *(round(r[k], 10) for k in ("score", "se", "ci_margin", "low", "high")), r["n_predictions"]) for r in out)))
    assert len(seen) == 1
    assert {r["se"] for r in resample.bootstrap(df, samples=50, seed=43).collect()}.isdisjoint({r[2] for r in seen.pop()})


@pytest.mark.parametrize("share, counted", [(resample.SHARE, resample.COUNTED), (64, resample.COUNTED), (resample.SHARE, 100), (64, 5)])
def test_distribution(spark, monkeypatch, share, counted):
    """Shares and binomial counts draw from the same distribution as plain resamples."""
    monkeypatch.setattr(resample, "SHARE", share)
    monkeypatch.setattr(resample, "COUNTED", counted)
    g = np.random.default_rng(5)
    s, w = g.random(300), g.integers(1, 6, 300).astype(float)
    df = spark.createDataFrame([("a", float(x), float(y), 1.0) for x, y in zip(s, w)], SCHEMA)
    at = [g.choice(300, 300, p=w / w.sum()) for _ in range(2000)]
    values = np.array([np.average(s[i], weights=w[i]) for i in at])
    r = resample.bootstrap(df, samples=2000, symmetric=False).first()
    assert r["se"] == pytest.approx(values.std(), rel=0.1)
    assert [r["low"], r["high"]] == pytest.approx(np.quantile(values, [0.025, 0.975]), abs=0.25 * values.std())
    n = resample.bootstrap(df.withColumn("score", F.lit(1.0)), samples=30, how="sum")
    assert n.first()["se"] == 0 and n.first()["score"] == 300  # always as many draws as rows


def test_hashes_are_even():
    a, c = resample._keys(resample.stream(12345, 42, 0), np.arange(400))
    out = resample._drawn([np.arange(100.0)], np.ones(100), np.full(400, 100), np.arange(400), 99, np.sum)[0]
    assert len(set(a.tolist())) == 400 and abs(out.mean() - 4950) < 4 * 288.7 / 20 and out.std() == pytest.approx(288.7, rel=0.15)


def test_edge_cases(spark):
    rows = [("a", 1.0, 0.0, 0.0), ("a", 2.0, 0.0, 0.0), ("b", None, 1.0, 1.0), ("c", 3.0, None, None), ("d", 5.0, 1.0, 1.0), ("e", 1.0, -2.0, 1.0), ("e", 4.0, 1.0, 1.0)] + [("f", 0.5, 1.0, 1.0)] * 3000
    out = {r["forecaster"]: r for r in resample.bootstrap(spark.createDataFrame(rows, SCHEMA), samples=50).collect()}
    assert set(out) == set("acdef") and out["a"]["score"] == 1.5 and out["a"]["se"] is None and out["c"]["ci_margin"] is None
    assert (out["d"]["score"], out["d"]["se"], out["d"]["ci_margin"]) == (5.0, 0.0, 0.0)
    assert out["e"]["score"] == 4.0 and out["e"]["se"] == 0 and (out["f"]["se"], out["f"]["n_predictions"]) == (0, 3000)
    assert resample.bootstrap(spark.createDataFrame([], SCHEMA)).collect() == []
    assert resample.bootstrap(spark.createDataFrame(rows, SCHEMA), samples=20, how="roi").where("forecaster = 'a'").first()["score"] == 0
