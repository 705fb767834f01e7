"""Scores as SQL functions. Their bodies are SQL too, so Catalyst inlines them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SUM = "aggregate({}, 0D, (s, v) -> s + v)"
FUNCTIONS = {
    "brier": ("p ARRAY<DOUBLE>, o ARRAY<DOUBLE>", "DOUBLE", "try_divide(" + SUM.format("zip_with(p, o, (x, y) -> (x - y) * (x - y))") + ", size(p))"),
    "log_score": ("p ARRAY<DOUBLE>, won ARRAY<INT>, clip DOUBLE", "DOUBLE", "try_divide(" + SUM.format("transform(won, i -> ln(greatest(get(p, i), clip)))") + ", size(won))"),
    "spherical": ("p ARRAY<DOUBLE>, won ARRAY<INT>", "DOUBLE", "try_divide(" + SUM.format("transform(won, i -> get(p, i))") + ", sqrt(" + SUM.format("transform(p, x -> x * x)") + "))"),
    "log_bets": ("p ARRAY<DOUBLE>, q ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(p, q, (x, y) -> x / y)"),
    "spread_exceeds": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, most DOUBLE", "BOOLEAN", "exists(zip_with(a, b, (x, y) -> x + y), s -> s > most)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions; their names."""
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)


class Stakes:
    """Table function: stakes(TABLE(rows), probs => 'name', odds => 'name', risk_aversion => 0.5) gives each row once for each of its options, with
    the option's place, the share of one unit that is staked on it, and the contracts that this buys. Columns of the rows stay in front.

    Stakes are those of `bets_neutral`, `bets_log` and `bets_crra`, scaled to spend one unit. Rows whose vectors are null, empty or of two lengths
    give no row, and so does a forecast that stakes nothing."""

    @staticmethod
    def analyze(rows, probs=None, odds=None, risk_aversion=None):
        from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType
        from pyspark.sql.udtf import AnalyzeResult

        if not rows.isTable:
            raise ValueError("the first argument must be TABLE(...)")
        p, q = (a.value if a is not None and a.value is not None else name for a, name in ((probs, "probs"), (odds, "odds")))
        for name in (p, q):
            if name not in rows.dataType.names or not isinstance(rows.dataType[name].dataType, ArrayType):
                raise ValueError(f"no column {name} of arrays")
        g = float(risk_aversion.value) if risk_aversion is not None and risk_aversion.value is not None else 0.0
        if not 0 <= g <= 1:
            raise ValueError("risk_aversion must be in [0, 1]")
        schema = StructType(list(rows.dataType.fields))
        for name, kind in (("option", IntegerType()), ("stake", DoubleType()), ("bet", DoubleType())):
            if name in rows.dataType.names:
                raise ValueError(f"a column is named {name} already")
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema)

    def eval(self, rows, probs="probs", odds="odds", risk_aversion=0.0):
        p, q, g = rows[probs or "probs"], rows[odds or "odds"], float(risk_aversion or 0)
        if not p or not q or len(p) != len(q) or None in p or None in q:
            return
        if g == 0:
            edges = [round(a / b + 3.3e-10, 9) for a, b in zip(p, q)]
            spent = [float(k == edges.index(max(edges))) for k in range(len(p))]
        elif g == 1:
            spent = list(p)
        else:
            spent = [a ** (1 / g) * b ** (1 - 1 / g) for a, b in zip(p, q)]
        total = sum(spent)
        if total <= 0:
            return
        for k, (x, price) in enumerate(zip(spent, q)):
            yield (*rows, k, x / total, x / total / price)


STAKE = pa.struct([("option", pa.int32()), ("stake", pa.float64()), ("bet", pa.float64())])


def stake_rows(p: pa.Array, q: pa.Array, g: pa.Array) -> pa.Array:
    """SQL function: stake_rows(probs, odds, risk_aversion) gives the rows of `stakes` for the vectors of one row, as an array to be made rows of by `inline`. It is
    worked out by Arrow batches, with no other column and no row by row in Python; rows of one length are a matrix."""
    risk = g.to_numpy(zero_copy_only=False).astype(float)
    if not ((risk >= 0) & (risk <= 1)).all():
        raise ValueError("risk_aversion must be in [0, 1]")
    sizes, starts, flat = [], [], []
    for x in (p, q):
        n = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = x.offsets.to_numpy()[:-1].astype(np.int64)
        gone = np.concatenate([[0], np.cumsum(x.values.is_null().to_numpy(zero_copy_only=False))])
        sizes.append(np.where((n > 0) & (gone[first + n] == gone[first]), n, 0)), starts.append(first), flat.append(x.values.to_numpy(zero_copy_only=False).astype(float))
    n = np.where(sizes[0] == sizes[1], sizes[0], 0)
    spent, kept = {}, np.zeros(len(n), np.int64)
    for size in np.unique(n[n > 0]):
        rows, at = np.flatnonzero(n == size), np.arange(size)
        a, b = (x[first[rows, None] + at] for x, first in zip(flat, starts))
        if (b == 0).any():
            raise ZeroDivisionError("odds of 0")
        r = risk[rows, None]
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            x = np.where(r == 1, a, a ** (1 / r) * b ** (1 - 1 / r))
            best = np.round(a / b + 3.3e-10, 9).argmax(1)[:, None] == at
            x = np.where(r == 0, best.astype(float), x)
            total = np.cumsum(x, 1)[:, -1:]  # in the order of the options
            fine = ~(total[:, 0] <= 0)
            x = (x / total)[fine]
        kept[rows[fine]] = size
        spent[size] = rows[fine], x, x / b[fine]
    ends = np.concatenate([[0], np.cumsum(kept)])
    option, stake, bet = np.zeros(ends[-1], np.int32), np.zeros(ends[-1]), np.zeros(ends[-1])
    for size, (rows, x, y) in spent.items():
        to = ends[rows, None] + np.arange(size)
        option[to], stake[to], bet[to] = np.arange(size), x, y
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(option), pa.array(stake), pa.array(bet)], fields=list(STAKE)))


def register_tables(spark) -> None:
    """The table function, and its form for the vectors of a row, for SQL."""
    from pyspark.sql.functions import arrow_udf, udtf

    spark.udtf.register("stakes", udtf(Stakes))
    spark.udf.register("stake_rows", arrow_udf(stake_rows, "array<struct<option: int, stake: double, bet: double>>"))
