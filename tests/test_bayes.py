"""The samplers of the item-response model against gradients by differences and a plain Metropolis sampler."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmith.operators import bayes as B

ANCHORS = 6


def made(seed, users, items, levels=ANCHORS, spread=2.0):
    r = np.random.default_rng(seed)
    theta, a, b, p = np.linspace(-1.5, 1.5, users), np.abs(r.normal(0, 5, items)), r.normal(0, spread, items), r.normal(0, 1, levels)
    c = 1 - np.linspace(0, 1, levels)
    u, j = map(np.ravel, np.meshgrid(np.arange(users), np.arange(items)))
    z = a[j][:, None] * c * ((theta[u] - b[j])[:, None] - p)
    q = np.exp(z - z.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    k = (q.cumsum(1) < r.random(len(u))[:, None]).sum(1).clip(0, levels - 1)
    return B.Cells(u, j, k, np.ones(len(u)), c, users, items)


def log_density(cells, t, al, b, p):
    """The definition, cell by cell: in theta, log a, b and p."""
    out = -(t @ t) / 2 - (b @ b + p @ p) / 50 - (np.exp(2 * al)).sum() / 50 + al.sum()
    for u, j, k, n in zip(cells.u, cells.j, cells.k, cells.n):
        z = np.exp(al[j]) * cells.c * (t[u] - (b[j] + p))
        out += n * (z[k] - np.log(np.exp(z - z.max()).sum()) - z.max())
    return out


def test_slopes_against_differences():
    cells, r = made(1, 4, 6), np.random.default_rng(2)
    cells.n[::3] = 2.0
    x = [r.normal(size=4), r.normal(size=6), r.normal(size=6), r.normal(size=ANCHORS)]
    v, gt, ga, gp = cells.slopes(*x)
    prior = log_density(B.Cells(*(np.zeros(0, int),) * 3, np.zeros(0), cells.c, 4, 6), *x)
    assert v.sum() == pytest.approx(log_density(cells, *x) - prior)
    for part, grad in ((0, cells.by_user(gt)), (1, cells.by_item(ga)), (2, -cells.by_item(gt)), (3, gp)):
        for i in range(len(grad)):
            up, down = ([y + (1e-5 if q == part else 0) * s * np.eye(len(y))[min(i, len(y) - 1)] for q, y in enumerate(x)] for s in (1, -1))
            assert grad[i] == pytest.approx((cells.slopes(*up)[0].sum() - cells.slopes(*down)[0].sum()) / 2e-5, rel=1e-4, abs=1e-5)


def test_bound_against_differences():
    cells, r = made(3, 3, 5), np.random.default_rng(4)
    q = {k: r.normal(size=n) * 0.3 for k, n in (("mt", 3), ("st", 3), ("sa", 5), ("mb", 5), ("sb", 5), ("mp", ANCHORS), ("sp", ANCHORS))}
    et, ea, eb, ep = (r.normal(size=n) for n in (3, 5, 5, ANCHORS))

    def at(q):
        return B._elbo(cells, q, q["mt"] + np.exp(q["st"]) * et, q["sa"] + np.log(np.abs(ea)), q["mb"] + np.exp(q["sb"]) * eb, q["mp"] + np.exp(q["sp"]) * ep, et, eb, ep)

    g, _ = at(q)
    for k, v in q.items():
        for i in range(len(v)):
            up, down = ({**q, k: v + s * 1e-5 * np.eye(len(v))[i]} for s in (1, -1))
            assert g[k][i] == pytest.approx((at(up)[1] - at(down)[1]) / 2e-5, rel=1e-4, abs=1e-4), (k, i)


def test_sampler_against_plain_metropolis():
    cells = made(5, 3, 4, levels=3)
    r, x, values = np.random.default_rng(6), np.zeros(3 + 4 + 4 + 3), []
    split = lambda x: (x[:3], x[3:7], x[7:11], x[11:])
    now, size = log_density(cells, *split(x)), np.repeat([0.5, 0.7, 2.0, 1.5], [3, 4, 4, 3])
    for step in range(30_000):  # one coordinate at a time
        i = step % len(x)
        y = x.copy()
        y[i] += 2 * size[i] * r.normal()
        new = log_density(cells, *split(y))
        if np.log(r.random()) < new - now:
            x, now = y, new
        if step > 4000:
            values.append(x[:3])
    values = np.array(values)
    draws = np.concatenate([B.sample(cells, 6000, 500, np.random.default_rng(s))[0] for s in (1, 2)])
    assert draws.mean(0) == pytest.approx(values.mean(0), abs=0.12)
    assert draws.std(0) == pytest.approx(values.std(0), rel=0.12)


def test_sampler_keeps_the_prior():
    """Without evidence the draws are those of the priors."""
    cells = B.Cells(np.arange(4), np.arange(4), np.zeros(4, int), np.zeros(4), 1 - np.linspace(0, 1, 3), 4, 4)
    draws, sums = B.sample(cells, 6000, 300, np.random.default_rng(3))
    assert draws.mean(0) == pytest.approx(0, abs=0.12) and draws.std(0) == pytest.approx(1, abs=0.08)
    assert sums["a"] / 6000 == pytest.approx(5 * np.sqrt(2 / np.pi), rel=0.12) and np.sqrt(sums["bb"] / 6000) == pytest.approx(5, rel=0.12)


def scores_of(spark, cells):
    rows = [(f"u{u}", f"p{j}", float(1 - cells.c[k])) for u, j, k in zip(cells.u, cells.j, cells.k)]
    return spark.createDataFrame(rows, "username string, problem_id string, score double")


def abilities(df):
    return {r["id"]: r for r in df.where("kind = 'forecaster'").collect()}


def test_fits_agree(spark, monkeypatch):
    df = scores_of(spark, made(7, 5, 200))
    mcmc = abilities(B.item_response_mcmc(df, samples=150, warmup=100, chains=4))
    svi = abilities(B.item_response_svi(df))
    order = lambda x: sorted(x, key=lambda k: x[k]["location"])
    assert order(mcmc) == order(svi) == [f"u{k}" for k in range(5)]
    assert all(r["r_hat"] < 1.2 and 0 < r["sd"] < 1.2 and r["p5"] < r["p25"] < r["p50"] < r["p75"] < r["p95"] for r in mcmc.values())
    problems = B.item_response_mcmc(df, samples=50, warmup=50).where("kind = 'problem'").agg(F.count("*"), F.min("discrimination"), F.count("sd")).first()
    assert problems[0] == problems[2] == 200 and problems[1] > 0
    monkeypatch.setattr(B, "CELLS", 300)  # four shards
    apart = abilities(B.item_response_mcmc(df, samples=150, warmup=100, chains=2))
    assert order(apart) == order(mcmc) and np.corrcoef([apart[k]["location"] for k in mcmc], [mcmc[k]["location"] for k in mcmc])[0, 1] > 0.97


def test_bound_rises():
    _, bounds = B.variational(made(8, 4, 60), 600, 0.02, 1 << 15, np.random.default_rng(1))
    assert np.mean(bounds[:30]) < np.mean(bounds[200:230]) < np.mean(bounds[-30:])
    _, part = B.variational(made(8, 4, 60), 600, 0.02, 64, np.random.default_rng(1))
    assert np.mean(part[-60:]) == pytest.approx(np.mean(bounds[-60:]), rel=0.1)


def test_partitions_and_edge_cases(spark):
    df = scores_of(spark, made(9, 3, 20))
    run = lambda x: {(r["kind"], r["id"]): r["location"] for r in B.item_response_mcmc(x, samples=20, warmup=20, chains=2).collect()}
    assert run(df.repartition(1)) == run(df.repartition(7))
    rows = df.unionByName(spark.createDataFrame([(None, "p", 0.5), ("u0", None, 0.5), ("u0", "p0", None)], df.schema))
    assert run(rows) == run(df)
    for fit in (B.item_response_mcmc, B.item_response_svi):
        assert fit(df.limit(0)).collect() == []
        assert len(fit(df.limit(1), **({"samples": 5, "warmup": 5} if fit is B.item_response_mcmc else {"steps": 5})).collect()) == 2


def test_problems_integrated_out_by_kinds(spark, monkeypatch):
    """Six problems of each of three kinds: gradients by differences, and the same posterior as the sampler of all problems."""
    few, m = made(11, 3, 3, levels=3), np.full(3, 6.0)
    kinds, x = B.Kinds(few, m), np.array([0.3, -0.2, 0.5, 0.1, -0.4, 0.2])
    grad = kinds.density(x)[1]
    assert grad == pytest.approx([(kinds.density(x + e)[0] - kinds.density(x - e)[0]) / 2e-5 for e in 1e-5 * np.eye(6)], rel=1e-4, abs=1e-5)
    finer = B.Kinds(few, m, nodes=120, step=0.03)
    assert kinds.density(x)[0] == pytest.approx(finer.density(x)[0], abs=1e-3) and grad == pytest.approx(finer.density(x)[1], abs=1e-3)
    every = B.Cells(np.tile(few.u, 6), np.concatenate([few.j + 3 * k for k in range(6)]), np.tile(few.k, 6), np.ones(54), few.c, 3, 18)
    long = [B.sample(every, 6000, 500, np.random.default_rng(s)) for s in (1, 2)]
    draws, sums = B.sample_kinds(kinds, 1500, 200, np.random.default_rng(3))
    plain = np.concatenate([d for d, _ in long])
    assert draws.mean(0) == pytest.approx(plain.mean(0), abs=0.12) and draws.std(0) == pytest.approx(plain.std(0), rel=0.12)
    for k, near in (("a", 0.5), ("b", 0.5)):
        assert sums[k] / 1500 == pytest.approx(sum(s[k].reshape(6, 3).sum(0) for _, s in long) / 72_000, abs=near)


def test_many_problems_of_few_kinds_need_no_shards(spark, monkeypatch):
    few = made(12, 3, 2, levels=3)
    rows = [(f"u{u}", f"p{j + 2 * k}", float(1 - few.c[v])) for u, j, v in zip(few.u, few.j, few.k) for k in range(20)]
    df = spark.createDataFrame(rows, "username string, problem_id string, score double")
    monkeypatch.setattr(B, "CELLS", 60)
    monkeypatch.setattr(B, "sample", None)  # no shard is sampled
    got = B.item_response_mcmc(df, anchors=3, samples=40, warmup=40, chains=2).collect()
    assert len(got) == 3 + 40 and {r["r_hat"] is not None for r in got} == {True}
    for j in (0, 1):
        assert len({r["location"] for r in got if r["kind"] == "problem" and int(r["id"][1:]) % 2 == j}) == 1


def test_like_problems_share_their_factors(monkeypatch):
    """60 problems of each of 4 kinds: no step works on all cells, weighted kinds have the bound and the slopes of all problems, and the fit is that of all problems."""
    few = made(13, 3, 4, levels=3)
    shuffled = np.random.default_rng(1).permutation(12 * 60)
    u, j, k = (np.tile(x, 60)[shuffled] for x in (few.u, few.j, few.k))
    every = B.Cells(u, j + 4 * np.repeat(np.arange(60), 12)[shuffled], k, np.ones(720), few.c, 3, 240)
    kinds, m, kind = B._alike(every)
    assert len({tuple(few.k[few.j == i]) for i in range(4)}) == kinds.items == len(m) and m.sum() == 240 and len(kinds.u) == 3 * kinds.items
    assert all(sorted(zip(every.u[every.j == i], every.k[every.j == i])) == sorted(zip(kinds.u[kinds.j == kind[i]], kinds.k[kinds.j == kind[i]])) for i in range(240))
    r, n = np.random.default_rng(2), kinds.items
    q = {k: r.normal(size=s) * 0.3 for k, s in (("mt", 3), ("st", 3), ("sa", n), ("mb", n), ("sb", n), ("mp", 3), ("sp", 3))}
    et, ea, eb, ep = (r.normal(size=s) for s in (3, n, n, 3))

    def at(cells, of, **more):
        x = {k: v[of] if k in ("sa", "mb", "sb") else v for k, v in q.items()}
        return B._elbo(cells, x, q["mt"] + np.exp(q["st"]) * et, x["sa"] + np.log(np.abs(ea[of])), x["mb"] + np.exp(x["sb"]) * eb[of], q["mp"] + np.exp(q["sp"]) * ep, et, eb[of], ep, **more)

    g, bound = at(B.Cells(kinds.u, kinds.j, kinds.k, kinds.n * m[kinds.j], kinds.c, 3, n), np.arange(n), weight=m)
    plain, all_bound = at(every, kind)
    assert bound == pytest.approx(all_bound)
    for k in q:
        assert g[k] == pytest.approx(np.bincount(kind, plain[k]) if k in ("sa", "mb", "sb") else plain[k]), k
    slopes, seen = B.Cells.slopes, []
    monkeypatch.setattr(B, "DRAWN", 60)
    monkeypatch.setattr(B.Cells, "slopes", lambda self, *x: seen.append(len(self.u)) or slopes(self, *x))
    got, bounds = B.variational(every, 800, 0.02, 1 << 15, np.random.default_rng(3))
    assert max(seen) <= 60 and all(len(got[k]) == 240 for k in ("sa", "mb", "sb")) and len({(kind[i], got["mb"][i]) for i in range(240)}) == n
    monkeypatch.setattr(B, "_alike", lambda cells: (cells, np.ones(cells.items), np.arange(cells.items)))
    want, all_bounds = B.variational(every, 800, 0.02, 1 << 15, np.random.default_rng(3))
    assert np.mean(bounds[-200:]) == pytest.approx(np.mean(all_bounds[-200:]), rel=0.1)
    assert got["mt"] - got["mt"].mean() == pytest.approx(want["mt"] - want["mt"].mean(), abs=0.25)
