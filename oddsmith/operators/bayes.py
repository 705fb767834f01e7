"""Posterior of the graded item-response model by Hamiltonian Monte Carlo and by stochastic variational inference.

Observations are counted cells (forecaster, problem, level). Problems are dealt into shards of a bounded number of cells, and each
(shard, chain) is a task of its own, so a fit is one pass whatever the size of the data. With one shard the sampler is exact; of several
shards a forecaster's posteriors are multiplied as normal densities, the prior counted once. Where more cells than a shard holds are of few kinds of
problems, the sampler integrates problems out instead, a kind at a time, and needs neither shards nor that approximation.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .models import _kinds, _levels

CELLS = 50_000  # of a shard, on average
KINDS, WIDTH = 256, 240  # kinds of problems, and pairs of forecaster and level, at most, whose problems are integrated out; a kind has REPEATS problems or more
REPEATS = 8
DRAWN = 2_048  # cells, on which a step of variational inference works, where draws are repeated
POINTS = (5, 25, 50, 75, 95)  # per cent of the posterior that a summary gives
_KINDS = "kind string, id string, shard long, chain int, mean double, var double, discrimination double, draws array<double>"


@dataclass
class Cells:
    """Numbered cells: forecaster u, problem j, level k, count n; c is 1 - level."""

    u: np.ndarray
    j: np.ndarray
    k: np.ndarray
    n: np.ndarray
    c: np.ndarray
    users: int
    items: int

    def _chances(self, t, al, b, p, rows):
        """(a of each cell, logits, chances) with a row for each level."""
        u, j = self.u[rows], self.j[rows]
        a = np.exp(al)[j]
        z = a * (t[u] - b[j]) - a * p[:, None]
        z *= self.c[:, None]
        q = z - z.max(0)
        np.exp(q, out=q)
        q /= q.sum(0)
        return a, z, q

    def slopes(self, t, al, b, p, rows=slice(None)):
        """(log-likelihood of each cell, its slopes in ability and in log a, the summed slopes in the shifts)."""
        k, n = self.k[rows], self.n[rows]
        a, z, q = self._chances(t, al, b, p, rows)
        at = np.arange(len(k))
        said, chance, w = z[k, at], q[k, at], n * a
        of_p = self.c * (q @ w) - np.bincount(k, w * self.c[k], len(self.c))
        return n * np.log(np.maximum(chance, 1e-300)), w * (self.c[k] - self.c @ q), n * (said - np.einsum("kr,kr->r", q, z)), of_p

    def curvature(self, t, al, b, p):
        """(expected curvature of each cell in ability, summed curvature in the shifts)."""
        a, _, q = self._chances(t, al, b, p, slice(None))
        w = self.n * a * a
        return w * (self.c**2 @ q - (self.c @ q) ** 2), self.c**2 * ((q * (1 - q)) @ w)

    def by_user(self, x, rows=slice(None)):
        return np.bincount(self.u[rows], x, self.users)

    def by_item(self, x, rows=slice(None)):
        return np.bincount(self.j[rows], x, self.items)


class Steps:
    """Step sizes of blocks, by dual averaging towards an acceptance of 0.8 while warming up, then fixed."""

    def __init__(self, blocks: int):
        self.mu, self.eps, self.mean = np.log(5.0), np.full(blocks, 0.5), np.zeros(blocks)
        self.h, self.m = np.zeros(blocks), 0

    def learn(self, accepted: np.ndarray):
        self.m += 1
        self.h += (0.8 - accepted - self.h) / (self.m + 10)
        log = np.minimum(1.0, self.mu - self.h * np.sqrt(self.m) / 0.05)
        share = self.m**-0.75
        self.mean = share * log + (1 - share) * self.mean
        self.eps = np.exp(log)

    def fix(self):
        self.eps = np.exp(self.mean)


def _trajectory(rng, x, steps, scale, potential, length):
    """One Hamiltonian step of independent blocks. x: (blocks, size); potential gives (log-density of each block, gradient). Returns x and the share accepted."""
    value, grad = potential(x)
    r0 = rng.standard_normal(x.shape)
    e = steps.eps[:, None] * rng.uniform(0.8, 1.2) * scale  # in units of each coordinate's scale
    y, r, g = x, r0, grad
    for _ in range(length):
        r = r + 0.5 * e * g
        y = y + e * r
        new, g = potential(y)
        r = r + 0.5 * e * g
    with np.errstate(over="ignore", invalid="ignore"):
        log = new - value - 0.5 * ((r * r).sum(1) - (r0 * r0).sum(1))
    chance = np.where(np.isfinite(log), np.exp(np.minimum(0.0, np.nan_to_num(log, nan=-np.inf, posinf=0.0, neginf=-np.inf))), 0.0)
    take = rng.random(len(chance)) < chance
    return np.where(take[:, None], y, x), chance


def sample(cells: Cells, samples: int, warmup: int, rng: np.random.Generator) -> tuple[np.ndarray, dict]:
    """Draws of the abilities (samples, forecasters), and sums over draws of the problems' values.

    Given the rest, forecasters are independent of each other, and so are problems: each takes a trajectory of its own and is accepted on
    its own; the shifts go jointly. Then the moves that leave the likelihood as it is (a common shift, and a common
    scale) are drawn from what the priors say, as steps of single blocks would take very long along them."""
    users, items, r = cells.users, cells.items, len(cells.c)
    t, al, b, p = np.zeros(users), np.zeros(items), np.zeros(items), np.zeros(r)
    on_user, on_item, on_shift = Steps(users), Steps(items), Steps(1)
    scale_t, scale_i, scale_p, stretch = np.ones((users, 1)), np.ones((items, 2)), np.ones((1, r)), 0.1
    draws, sums = np.zeros((samples, users)), {k: np.zeros(items) for k in ("a", "b", "bb")}
    for turn in range(warmup + samples):
        warm = turn < warmup
        if warm and turn % 20 == 0:  # scales from the curvature; fixed after the warm-up
            h, hp = cells.curvature(t, al, b, p)
            scale_t = 1 / np.sqrt(cells.by_user(h) + 1)[:, None]
            scale_i = np.stack([np.full(items, 0.7), 1 / np.sqrt(cells.by_item(h) + 1 / 25)], 1)
            scale_p = 1 / np.sqrt(hp + 1 / 25)[None, :]

        def of_items(x):
            v, gt, ga, _ = cells.slopes(t, x[:, 0], x[:, 1], p)
            a2 = np.exp(np.minimum(2 * x[:, 0], 600))
            return cells.by_item(v) - x[:, 1] ** 2 / 50 - a2 / 50 + x[:, 0], np.stack([cells.by_item(ga) - a2 / 25 + 1, -cells.by_item(gt) - x[:, 1] / 25], 1)

        def of_users(x):
            v, gt, _, _ = cells.slopes(x[:, 0], al, b, p)
            return cells.by_user(v) - x[:, 0] ** 2 / 2, (cells.by_user(gt) - x[:, 0])[:, None]

        def of_shifts(x):
            v, _, _, gp = cells.slopes(t, al, b, x[0])
            return np.array([v.sum() - (x * x).sum() / 50]), gp[None, :] - x / 25

        x, acc_i = _trajectory(rng, np.stack([al, b], 1), on_item, scale_i, of_items, 2)
        al, b = x[:, 0], x[:, 1]
        x, acc_t = _trajectory(rng, t[:, None], on_user, scale_t, of_users, 3)
        t = x[:, 0]
        x, acc_p = _trajectory(rng, p[None, :], on_shift, scale_p, of_shifts, 3)
        p = x[0]
        # theta + d, b + d; then p + d, b - d: normal given the priors.
        w = users + items / 25
        d = rng.normal(-(t.sum() + b.sum() / 25) / w, w**-0.5)
        t, b = t + d, b + d
        w = (r + items) / 25
        d = rng.normal(-(p.sum() - b.sum()) / 25 / w, w**-0.5)
        p, b = p + d, b - d
        s = stretch * rng.standard_normal()  # all times e^s, a over e^s
        size, a2 = (t @ t) / 2 + (b @ b + p @ p) / 50, np.exp(2 * al).sum() / 50
        log = -size * np.expm1(2 * s) - a2 * np.expm1(-2 * s) + s * (users + r)
        if np.log(rng.random()) < log:
            t, b, p, al = t * np.exp(s), b * np.exp(s), p * np.exp(s), al - s
        if warm:
            stretch *= np.exp((np.exp(min(0.0, log)) - 0.44) / (1 + turn) ** 0.5)
            on_item.learn(acc_i), on_user.learn(acc_t), on_shift.learn(acc_p)
            if turn == warmup - 1:
                on_item.fix(), on_user.fix(), on_shift.fix()
        else:
            draws[turn - warmup] = t
            for k, v in (("a", np.exp(al)), ("b", b), ("bb", b * b)):
                sums[k] += v
    return draws, sums


class Kinds:
    """Counted cells of kinds of problems (rows) by forecaster and level, m problems of each. A problem's a and b are integrated out on a grid: Gauss-Legendre
    nodes in the cube root of a, even steps in b, both to six deviations of their priors."""

    def __init__(self, cells: Cells, m: np.ndarray, nodes: int = 32, step: float = 0.15):
        self.m, self.c, self.users = m, cells.c, cells.users
        self.counts = np.zeros((cells.items, cells.users * len(cells.c)))
        np.add.at(self.counts, (cells.j, cells.u * len(cells.c) + cells.k), cells.n)
        x, w = np.polynomial.legendre.leggauss(nodes)
        x, w = (x + 1) / 2, w / 2
        a, b = 30 * x**3, np.arange(-30, 30 + step / 2, step)
        log_a = np.log(w * 90 * x * x * 2 / (5 * np.sqrt(2 * np.pi))) - a * a / 50
        log_b = np.log(step / (5 * np.sqrt(2 * np.pi))) - b * b / 50
        self.a, self.b = np.repeat(a, len(b)), np.tile(b, len(a))
        self.w = (log_a[:, None] + log_b).ravel()
        near = self.a**2 + self.b**2 <= 30**2  # six deviations of both together
        self.a, self.b, self.w = self.a[near], self.b[near], self.w[near]

    def density(self, x: np.ndarray, moments: bool = False):
        """(log-posterior, gradient) at abilities and shifts x; with moments also the means of a, b and b * b of each kind."""
        t, p, r = x[: self.users], x[self.users :], len(self.c)
        q = self.c[None, :, None] * ((t[:, None] - p)[:, :, None] - self.b) * self.a
        q -= q.max(1, keepdims=True)
        log = q.copy()
        np.exp(q, out=q)
        s = q.sum(1, keepdims=True)
        q /= s
        log -= np.log(s)
        log = log.reshape(self.users * r, -1)
        value, seen, held = -(t @ t) / 2 - (p @ p) / 50, np.zeros_like(log), []
        for k in range(0, len(self.m), 64):  # what is in memory does not grow with the kinds
            n, m = self.counts[k : k + 64], self.m[k : k + 64]
            e = n @ log + self.w
            top = e.max(1, keepdims=True)
            e = np.exp(e - top)
            total = e.sum(1, keepdims=True)
            value += m @ (top + np.log(total))[:, 0]
            e /= total
            if moments:
                held.append(np.stack([e @ self.a, e @ self.b, e @ (self.b * self.b)]))
            seen += n.T @ (e * m[:, None])
        seen = seen.reshape(q.shape)
        every = seen.sum(1)
        of_t = (self.c @ seen - every * (self.c @ q)) @ self.a
        q *= every[:, None]
        of_p = -self.c * ((seen.sum(0) - q.sum(0)) @ self.a)
        grad = np.concatenate([of_t - t, of_p - p / 25])
        return (value, grad, *np.concatenate(held, 1)) if moments else (value, grad)

    def curvature(self, x: np.ndarray, far: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues, made positive, and eigenvectors of the negative second derivatives, by differences of gradients."""
        h = np.array([self.density(x - far * e)[1] - self.density(x + far * e)[1] for e in np.eye(len(x))]) / (2 * far)
        size, axes = np.linalg.eigh((h + h.T) / 2)
        return np.maximum(np.abs(size), 1e-3), axes

    def mode(self, x: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
        """(a mode, axes whose columns are a posterior deviation long), by Newton's steps uphill."""
        value, grad = self.density(x)
        for _ in range(rounds):
            size, axes = self.curvature(x)
            step = axes @ ((axes.T @ grad) / size)
            if step @ grad < 0.01:  # a tenth of a deviation
                break
            share = min(1.0, 2 / np.abs(step).max())
            while share > 1e-6:
                new, slope = self.density(x + share * step)
                if new > value:
                    break
                share /= 2
            else:
                break
            x, value, grad = x + share * step, new, slope
        return x, axes / np.sqrt(size)


def sample_kinds(kinds: Kinds, samples: int, warmup: int, rng: np.random.Generator) -> tuple[np.ndarray, dict]:
    """Like `sample`, of abilities and shifts alone: Hamiltonian trajectories in the scale of the mode's curvature. The sums are of kinds, not of single draws of problems but of
    their means given the rest."""
    at, axes = kinds.mode(0.1 * rng.standard_normal(kinds.users + len(kinds.c)))
    on, x, scale = Steps(1), rng.standard_normal((1, len(at))), np.ones((1, len(at)))
    draws, sums = np.zeros((samples, kinds.users)), {k: np.zeros(len(kinds.m)) for k in ("a", "b", "bb")}

    known: dict = {}  # a trajectory starts where an earlier one has been

    def potential(y):
        key = y.tobytes()
        if key not in known:
            known[key] = kinds.density(at + axes @ y[0], moments=True)
        return np.array([known[key][0]]), (known[key][1] @ axes)[None, :]

    for turn in range(warmup + samples):
        x, accepted = _trajectory(rng, x, on, scale, potential, 3)
        known = {x.tobytes(): known[x.tobytes()]}
        if turn < warmup:
            on.learn(accepted)
            if turn == warmup - 1:
                on.fix()
        else:
            draws[turn - warmup] = (at + axes @ x[0])[: kinds.users]
            for k, v in zip(sums, known[x.tobytes()][2:]):
                sums[k] += v
    return draws, sums


def _alike(cells: Cells) -> tuple[Cells, np.ndarray, np.ndarray]:
    """(cells of one problem of each kind, numbers of problems of the kinds, kind of each problem); problems of a kind have equal cells."""
    order = np.lexsort((cells.k, cells.u, cells.j))
    sizes, rows = np.bincount(cells.j, minlength=cells.items), np.stack([cells.u, cells.k, cells.n], 1)[order]
    starts, kind, first = np.cumsum(sizes) - sizes, np.zeros(cells.items, np.int64), []
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        held = np.concatenate([np.zeros((len(at), 1)), rows[starts[at][:, None] + np.arange(size)].reshape(len(at), -1)], 1)
        _, one, place = np.unique(held, axis=0, return_index=True, return_inverse=True)
        kind[at] = len(first) + place.ravel()
        first.extend(at[one])
    keep = np.isin(cells.j, first)
    few = Cells(cells.u[keep], kind[cells.j[keep]], cells.k[keep], cells.n[keep], cells.c, cells.users, len(first))
    return few, np.bincount(kind, minlength=len(first)).astype(float), kind


def variational(cells: Cells, steps: int, rate: float, batch: int, rng: np.random.Generator) -> tuple[dict, list[float]]:
    """(parameters, lower bound at each step): normal factors for abilities, difficulties and shifts, half-normal ones for a, by Adam
    on reparametrised gradients of mini-batches of cells.

    The factors of problems with equal cells are equal where the bound is highest, so problems of a kind share theirs and are counted. A step draws several values
    of each kind's factors, each for its share of the kind's problems, as far as DRAWN cells allow: one draw for all of them would make noisier slopes."""
    few, m, kind = _alike(cells)
    if len(m) == cells.items:
        few, m, kind = cells, np.ones(cells.items), np.arange(cells.items)
    copies = max(1, min(int(m.max(initial=1)), DRAWN // max(1, len(few.u))))
    of_items, kinds, weight = ("sa", "mb", "sb"), few.items, np.tile(m / copies, copies)
    cells = Cells(np.tile(few.u, copies), np.concatenate([few.j + kinds * k for k in range(copies)]), np.tile(few.k, copies), np.tile(few.n * (m / copies)[few.j], copies), few.c, few.users, kinds * copies)
    users, items, r = cells.users, cells.items, len(cells.c)
    q = {"mt": np.zeros(users), "st": np.zeros(users), "sa": np.full(kinds, np.log(5.0)), "mb": np.zeros(kinds), "sb": np.full(kinds, np.log(5.0)), "mp": np.zeros(r), "sp": np.full(r, np.log(5.0))}
    first, second, bounds = {k: np.zeros_like(v) for k, v in q.items()}, {k: np.zeros_like(v) for k, v in q.items()}, []
    order, at = rng.permutation(len(cells.u)), 0
    for step in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(order)), 0
        rows = order[at : at + batch] if len(order) > batch else slice(None)
        grow = len(order) / len(rows) if len(order) > batch else 1.0
        at += batch
        et, ea, eb, ep = (rng.standard_normal(k) for k in (users, items, items, r))
        now = q | {k: np.tile(q[k], copies) for k in of_items}
        t, b, p = now["mt"] + np.exp(now["st"]) * et, now["mb"] + np.exp(now["sb"]) * eb, now["mp"] + np.exp(now["sp"]) * ep
        al = now["sa"] + np.log(np.abs(ea) + 1e-12)
        g, bound = _elbo(cells, now, t, al, b, p, et, eb, ep, rows, grow, weight)
        bounds.append(bound)
        for k, v in g.items():
            v = v.reshape(copies, kinds).sum(0) if k in of_items else v
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            q[k] = q[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return q | {k: q[k][kind] for k in of_items}, bounds


def _elbo(cells, q, t, al, b, p, et, eb, ep, rows=slice(None), grow=1.0, weight=1.0):
    """(gradient, value) of the lower bound at one draw of the noise; weight: how many problems each one stands for, as the counts of its cells do already."""
    v, gt, ga, gp = cells.slopes(t, al, b, p, rows)
    w, a2 = np.broadcast_to(weight, b.shape), np.exp(2 * al)
    gt, ga, gb, gp = grow * cells.by_user(gt, rows) - t, grow * cells.by_item(ga, rows), -grow * cells.by_item(gt, rows) - w * b / 25, grow * gp - p / 25
    g = {"mt": gt, "st": gt * np.exp(q["st"]) * et + 1, "sa": ga - w * a2 / 25 + w, "mb": gb, "sb": gb * np.exp(q["sb"]) * eb + w, "mp": gp, "sp": gp * np.exp(q["sp"]) * ep + 1}
    prior = -(t @ t) / 2 - (w @ (b * b) + p @ p + w @ a2) / 50 - 2 * w.sum() * np.log(5) - len(p) * np.log(5)
    free = q["st"].sum() + q["sp"].sum() + w @ (q["sa"] + q["sb"]) + (len(t) + 2 * w.sum() + len(p)) / 2
    return g, float(grow * v.sum() + prior + free)


def _cells(table: pa.Table, levels: list[float]):
    """(cells, names of forecasters, names of problems) of a shard, in an order that hangs on the rows alone."""
    table = table.sort_by([("username", "ascending"), ("problem_id", "ascending"), ("k", "ascending")])
    users, items = (table[c].combine_chunks().dictionary_encode() for c in ("username", "problem_id"))
    number = lambda x: x.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Cells(number(users), number(items), table["k"].to_numpy().astype(np.int64), table["n"].to_numpy(), 1 - np.array(levels), len(users.dictionary), len(items.dictionary)), users.dictionary, items.dictionary


def _counted(scores: DataFrame, anchors: int, strategy: str) -> tuple[DataFrame, list[float]]:
    """(cells (username, problem_id, k, n), levels)."""
    known = scores.where("score is not null and username is not null and problem_id is not null")
    levels = _levels(known, anchors, strategy)
    near = F.array_min(F.transform(F.array(*map(F.lit, levels)), lambda v, i: F.struct(F.abs(F.col("score") - v).alias("far"), i.alias("k"))))["k"]
    x = known.select(F.col("username").cast("string").alias("username"), F.col("problem_id").cast("string").alias("problem_id"), near.alias("k"))
    return cut(x.groupBy("username", "problem_id", "k").agg(F.count("*").cast("double").alias("n"))), levels


def _rows(users, items, shard: int, chain: int, mean, var, draws, b, bb, a) -> pa.Table:
    people = pa.table({"kind": ["forecaster"] * len(users), "id": users, "mean": mean, "var": var, "discrimination": pa.nulls(len(users), pa.float64()), "draws": pa.array(draws, pa.list_(pa.float64()))})
    problems = pa.table({"kind": ["problem"] * len(items), "id": items, "mean": b, "var": bb, "discrimination": a, "draws": pa.nulls(len(items), pa.list_(pa.float64()))})
    out = pa.concat_tables([people, problems])
    return out.add_column(2, "shard", pa.array([shard] * len(out), pa.int64())).add_column(3, "chain", pa.array([chain] * len(out), pa.int32()))


def _chains(x: DataFrame, chains: int) -> DataFrame:
    return x.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))


def _fit(x: DataFrame, levels: list[float], chains: int, run) -> DataFrame:
    """Rows (kind, id, shard, chain, mean, var, discrimination, draws) of each (shard, chain), from run(cells, shard, chain)."""
    shards = max(1, -(-x.count() // CELLS))
    x = _chains(x.withColumn("shard", F.pmod(F.xxhash64("problem_id"), F.lit(shards))), chains)

    def one(key, table):
        shard, chain = (k.as_py() for k in key)
        cells, users, items = _cells(table, levels)
        return _rows(users, items, shard, chain, *run(cells, shard, chain))

    return x.groupBy("shard", "chain").applyInArrow(one, _KINDS)


def _fit_kinds(x: DataFrame, levels: list[float], chains: int, run) -> tuple[DataFrame, DataFrame] | None:
    """(rows like those of `_fit`, with a problem for each kind, (problem_id, like)) from run(kinds, chain); None where cells fit a shard, or
    problems are too many kinds to be integrated out."""
    if x.count() <= CELLS or x.select("username").distinct().count() * len(levels) > WIDTH:
        return None
    cells, like = _kinds(x)
    held = cells.select("problem_id", "m").distinct().agg(F.count("*").alias("kinds"), F.sum("m").alias("m")).first()
    if held["kinds"] > KINDS or held["m"] < REPEATS * held["kinds"]:
        return None

    def one(key, table):
        chain = key[0].as_py()
        cells, users, items = _cells(table, levels)
        m = np.zeros(len(items))
        m[cells.j] = table.sort_by([("username", "ascending"), ("problem_id", "ascending"), ("k", "ascending")])["m"].to_numpy()
        return _rows(users, items, 0, chain, *run(Kinds(cells, m), chain))

    return _chains(cells, chains).groupBy("chain").applyInArrow(one, _KINDS), like


def _combined(parts: DataFrame, samples: int) -> DataFrame:
    """(kind, id, location, discrimination, sd, r_hat, p5, ...): chains are pooled, then shards multiplied."""
    within, between = F.avg("var"), F.coalesce(F.var_samp("mean"), F.lit(0.0))
    rhat = F.when((F.count("*") > 1) & (within > 0), F.sqrt((samples - 1) / samples + between / within))
    x = parts.groupBy("kind", "id", "shard").agg(F.avg("mean").alias("m"), (within + F.coalesce(F.var_pop("mean"), F.lit(0.0))).alias("v"), F.avg("discrimination").alias("a"), rhat.alias("r"), F.array_sort(F.flatten(F.collect_list("draws"))).alias("draws"))
    v = F.greatest(F.col("v"), F.lit(1e-12))
    x = x.groupBy("kind", "id").agg(F.count("*").alias("s"), F.sum(1 / v).alias("w"), F.max(1 / v).alias("least"), F.sum(F.col("m") / v).alias("wm"), F.avg("a").alias("discrimination"), F.max("r").alias("r_hat"), F.first("draws").alias("draws"))
    w = F.greatest(F.col("least"), F.col("w") - (F.col("s") - 1))  # the prior has precision 1 in each shard
    x = x.withColumn("location", F.col("wm") / w).withColumn("sd", 1 / F.sqrt(w))
    n = F.size("draws")

    def point(q):
        normal = F.col("location") + NormalDist().inv_cdf(q / 100) * F.col("sd")
        return F.when((F.col("s") == 1) & (n > 0), F.get("draws", F.floor((n - 1) * q / 100 + 0.5).cast("int"))).otherwise(normal).alias(f"p{q}")

    return x.select("kind", "id", "location", "discrimination", "sd", "r_hat", *(point(q) for q in POINTS))


def item_response_mcmc(scores: DataFrame, anchors: int = 6, strategy: str = "uniform", samples: int = 300, warmup: int = 100, chains: int = 4, seed: int = 42) -> DataFrame:
    """(kind, id, location, discrimination, sd, r_hat, p5, p25, p50, p75, p95) from (username, problem_id, score in [0, 1], low is good).

    kind is forecaster (location: ability) or problem (difficulty; discrimination: mean of a). Priors: abilities N(0, 1), a half-normal with
    scale 5, difficulties and shifts N(0, 5). `samples` draws of each chain are kept after `warmup`; r_hat compares the chains. Equal
    rows and seed give equal draws under every partitioning. Rows with a null are left out; an empty table gives no rows. Where over CELLS cells are of at most KINDS kinds of
    problems, problems are integrated out (`Kinds`), and those of a kind have the same values."""

    def summed(draws, sums):
        b = sums["b"] / samples
        return draws.mean(0), draws.var(0, ddof=1), draws.T.tolist(), b, np.maximum(0, sums["bb"] / samples - b * b), sums["a"] / samples

    def stream(shard, chain):
        return np.random.Generator(np.random.Philox(key=[seed, (shard << 16) + chain]))

    x, levels = _counted(scores, anchors, strategy)
    few = _fit_kinds(x, levels, chains, lambda kinds, chain: summed(*sample_kinds(kinds, samples, warmup, stream(0, chain))))
    if few is None:
        return _combined(_fit(x, levels, chains, lambda cells, shard, chain: summed(*sample(cells, samples, warmup, stream(shard, chain)))), samples)
    out = cut(_combined(few[0], samples))
    problems = few[1].join(F.broadcast(out.where("kind = 'problem'").withColumnRenamed("id", "like")), "like")  # KINDS rows at most
    return out.where("kind = 'forecaster'").unionByName(problems.withColumnRenamed("problem_id", "id").select(*out.columns))


def item_response_svi(scores: DataFrame, anchors: int = 6, strategy: str = "uniform", steps: int = 1000, rate: float = 0.01, batch: int = 1 << 15, seed: int = 42) -> DataFrame:
    """Like item_response_mcmc, by variational inference: location and sd are those of the normal factors, discrimination is the mean of
    the half-normal one; points are normal and r_hat is null. Mini-batches have `batch` cells."""

    def run(cells, shard, chain):
        q, _ = variational(cells, steps, rate, batch, np.random.Generator(np.random.Philox(key=[seed, shard << 16])))
        return q["mt"], np.exp(2 * q["st"]), [[] for _ in q["mt"]], q["mb"], np.exp(2 * q["sb"]), np.exp(q["sa"]) * np.sqrt(2 / np.pi)

    return _combined(_fit(*_counted(scores, anchors, strategy), 1, run), steps)
