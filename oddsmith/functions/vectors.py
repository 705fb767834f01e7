"""Vector expressions: errors, spreads, scores and bets over ARRAY<DOUBLE> columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, body) -> Column:
    """body(value), value worked out once: lambdas share no parts with each other, nor from one element to the next."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def mean(a) -> Column:
    return F.try_divide(total(a), F.size(_c(a)))


def squared_error(p, o) -> Column:
    return F.zip_with(_c(p), _c(o), lambda x, y: (x - y) * (x - y))


def brier(p, o) -> Column:
    return mean(squared_error(p, o))


def one_hot(index, n) -> Column:
    """1.0 at the positions in the array `index`, 0.0 elsewhere, n long."""
    return F.transform(F.sequence(F.lit(0), _c(n) - 1), lambda i: F.when(F.array_contains(_c(index), i), 1.0).otherwise(0.0))


def close(a, b, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether a is as near to b as rounding allows."""
    return F.abs(_c(a) - _c(b)) <= absolute + relative * F.abs(_c(b))


def gather(a, index) -> Column:
    return F.transform(_c(index), lambda i: F.get(_c(a), i))


def argmax(a) -> Column:
    """The first position of the largest value."""
    return bind(_c(a), lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def log_score(p, index, clip: float = 0.01) -> Column:
    return mean(F.transform(gather(p, index), lambda x: F.ln(F.greatest(x, F.lit(clip)))))


def spherical(p, index) -> Column:
    return F.try_divide(total(gather(p, index)), F.sqrt(total(F.transform(_c(p), lambda x: x * x))))


def spread_exceeds(odds, no_odds, limit: float = 1.03) -> Column:
    return F.exists(F.zip_with(_c(odds), _c(no_odds), lambda a, b: a + b), lambda s: s > limit)


def within_spread(p, odds, no_odds) -> Column:
    """True where the forecast lies between the two asks, so that no bet pays."""
    return (_c(p) >= 1 - _c(no_odds)) & (_c(p) <= _c(odds))


def smoothed(a, eps: float = 5e-3) -> Column:
    return F.transform(_c(a), lambda x: F.greatest(F.lit(eps), F.least(F.lit(1 - eps), x)))


def normalized(a) -> Column:
    """Sums to 1; a vector of zeros becomes uniform."""
    of = lambda v, s: F.when(F.abs(s - 1) <= 1e-6, v).when(s > 0, F.transform(v, lambda x: F.try_divide(x, s))).otherwise(F.transform(v, lambda x: F.lit(1.0) / F.size(v)))
    return bind(_c(a), lambda v: bind(total(v), lambda s: of(v, s)))


# -- contracts bought with one unit of money ------------------------------


def bets_neutral(p, q) -> Column:
    """Risk-neutral: all on the first best edge; edges are compared to nine decimals, off the halves."""
    best = argmax(F.zip_with(_c(p), _c(q), lambda x, y: F.round(x / y + 3.3e-10, 9)))
    return bind(best, lambda b: F.transform(_c(q), lambda y, i: F.when(i == b, 1 / y).otherwise(0.0)))


def bets_log(p, q) -> Column:
    return F.zip_with(_c(p), _c(q), lambda x, y: x / y)


def bets_crra(p, q, risk_aversion: float) -> Column:
    """Exact constant-relative-risk-aversion stakes; 0 is neutral, 1 logarithmic."""
    if not 0 <= risk_aversion <= 1:
        raise ValueError("risk_aversion must be in [0, 1]")
    if risk_aversion == 0:
        return bets_neutral(p, q)
    g = 1 / risk_aversion
    stake = F.zip_with(_c(p), _c(q), lambda x, y: F.pow(y, 1 - g) * F.pow(x, g))
    return bind(stake, lambda v: bind(total(v), lambda t: F.zip_with(v, _c(q), lambda s, y: F.try_divide(s, t) / y)))


def stakes_crra(p, q, risk_aversion: float | Column) -> Column:
    """Approximate stakes of one unit for constant relative risk aversion, from first and second moments.

    A leg's edge is p / q - 1, its variance p (1 - p) / q^2. Legs of positive edge share a level that the
    budget fills from the best edge down; each gets its edge above the level over risk aversion times
    variance. Edges are taken to twelve decimals, so that equal ones are ties. All edges alike: even stakes. No positive edge, or no risk aversion: all on the best edge.
    Rows are filled by Arrow batches; a column of risk aversions is one for each row.
    """
    if not isinstance(risk_aversion, Column):
        if not 0 <= risk_aversion <= 1:
            raise ValueError("risk_aversion must be in [0, 1]")
        risk_aversion = F.lit(float(risk_aversion))
    return F.arrow_udf(filled_stakes, "array<double>")(_c(p), _c(q), risk_aversion)


def filled_stakes(p: pa.Array, q: pa.Array, g: pa.Array) -> pa.Array:
    """Rows of one length are a matrix; a leg that is missing on one side counts as near to one."""
    sizes = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (p, q)]
    starts = [x.offsets.to_numpy()[:-1].astype(np.int64) for x in (p, q)]
    flat = [x.values.to_numpy(zero_copy_only=False).astype(float) for x in (p, q)]
    null = p.is_null().to_numpy(zero_copy_only=False) | q.is_null().to_numpy(zero_copy_only=False)
    n, risk = np.where(null, 0, np.maximum(*sizes)), g.to_numpy(zero_copy_only=False).astype(float)
    ends = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(ends[-1])
    for size in np.unique(n[n > 0]):
        rows, at = np.flatnonzero(n == size), np.arange(size)
        legs = []
        for k, x, first in zip(sizes, flat, starts):
            held = at < k[rows, None]
            legs.append(np.where(held, x[np.where(held, first[rows, None] + at, 0)] if len(x) else np.nan, np.nan))
        out[ends[rows, None] + at] = _filled(*legs, risk[rows], sizes[0][rows])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out), mask=pa.array(null))


def _filled(p: np.ndarray, q: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stakes of rows of legs; g: their aversions to risk, n: their numbers of probabilities."""
    p, q = (np.fmax(1e-12, np.fmin(1 - 1e-12, x)) for x in (p, q))
    a, b, row = np.round(p / q - 1, 12), p * (1 - p) / (q * q), np.arange(len(p))
    place = np.arange(a.shape[1])
    top = (place == a.argmax(1)[:, None]).astype(float)
    order = np.argsort(np.where(a > 0, -a, np.inf), axis=1, kind="stable")
    sa, sb = (np.take_along_axis(x, order, 1) for x in (a, b))
    good = sa > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        level = (np.cumsum(np.where(good, sa / sb, 0), 1) - g[:, None]) / np.cumsum(np.where(good, 1 / sb, 0), 1)
        full = np.ones_like(good)  # no leg follows, or one whose edge is below the level
        full[:, :-1] = ~good[:, 1:] | (sa[:, 1:] <= level[:, :-1])
        last = full.argmax(1)
        level = level[row, last][:, None]
        active = np.zeros_like(good)
        np.put_along_axis(active, order, (place <= last[:, None]) & good, 1)
        raw = np.where(active & (a > level), (a - level) / (g[:, None] * b), 0.0)
        spent = np.cumsum(raw, 1)[:, -1:]  # in the order of the legs
        shared = np.where(spent > 1e-12, raw / spent, top)
    alike = (np.abs(a - a[:, :1]) <= 1e-8 + 1e-5 * np.abs(a[:, :1])).all(1)[:, None]
    return np.where(alike, 1.0 / np.maximum(n, 1)[:, None], np.where((g[:, None] < 1e-12) | ~good[:, :1], top, shared))
