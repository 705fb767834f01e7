"""Keyed state: a stream that is stopped and started again against plain sums over its rows in the order of arrival."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from oddsmith.streaming import state

SCHEMA = "ts timestamp, forecaster string, score double, weight double, seq long"
LATE = dt.timedelta(days=2)


def arrivals(seed):
    """Batches of rows in the order of arrival, some of them late."""
    r, day0, out = random.Random(seed), dt.datetime(2024, 3, 1), []
    for b in range(4):
        rows = []
        for k in range(60):
            ts = day0 + dt.timedelta(days=3 * b, hours=r.uniform(-60, 72), microseconds=r.randrange(1000))
            rows.append((ts, r.choice("abc"), r.choice([1.0, 2.5, -3.0]), r.choice([1.0, 2.0, 0.0]), 60 * b + k))
        out.append(rows)
    out[1] += [(None, "a", 1.0, 1.0, 900), (day0, "a", None, 1.0, 901), (out[0][0][0] - dt.timedelta(days=30), "b", 9.0, 1.0, 902)]
    return out


def in_time(batches):
    """(rows that are not late, last watermark)"""
    kept, mark = [], None
    for rows in batches:
        rows = [r for r in rows if r[0] is not None and r[2] is not None]
        ms = lambda t: t.replace(microsecond=t.microsecond // 1000 * 1000)
        kept += [r for r in rows if mark is None or ms(r[0]) >= mark]
        top = max(ms(r[0]) for r in rows) - LATE
        mark = top if mark is None else max(mark, top)
    return kept, mark


def run(spark, tmp_path, batches, make):
    out = None
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        out = state.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return out.collect()


def test_daily_totals(spark, tmp_path):
    batches = arrivals(1)
    kept, mark = in_time(batches)
    assert 0 < len(kept) < sum(map(len, batches)) - 3
    want = {}
    for name in "abc":
        days = sorted({r[0].date() for r in kept if r[1] == name})
        for d in days:
            own = [r for r in kept if r[1] == name and r[0].date() <= d]
            if dt.datetime.combine(d, dt.time()) + dt.timedelta(days=1) <= mark:
                w = sum(r[3] for r in own)
                want[name, d] = (sum(r[2] * r[3] for r in own) / w if w else None, len(own))
    got = {(r["forecaster"], r["day"]): (r["score"], r["n"]) for r in run(spark, tmp_path, batches, state.daily_totals)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 10


def test_first_forecasts(spark, tmp_path):
    batches = arrivals(2)
    kept, mark = in_time(batches)
    ids = lambda r: f"{r[1]}{r[4] % 15}"
    first = {}
    for r in sorted(kept, key=lambda r: (r[0], r[4])):
        first.setdefault(ids(r), r)
    want = {(k, r[0], r[4], r[2]) for k, r in first.items() if r[0] < mark}
    make = lambda s: state.first_forecasts(s.withColumn("forecast_id", F.concat("forecaster", (F.col("seq") % 15).cast("string"))))
    assert {tuple(r) for r in run(spark, tmp_path, batches, make)} == want and len(want) > 10


def test_ids_of_a_bucket_share_a_value_of_state():
    """A batch costs a bucket of forecast ids one read and one write, however many ids it has; and a timer gives out all that are due."""
    import pandas as pd

    calls = []

    class Value:
        now = None

        def get(self):
            calls.append("get")
            return self.now

        def update(self, v):
            calls.append("update")
            self.now = v

    class Handle:
        getValueState = lambda self, *_: value
        registerTimer = lambda self, at: calls.append(at)
        deleteTimer = lambda self, at: calls.append(-at)

    class Timer:
        mark = 0
        getCurrentWatermarkInMs = lambda self: self.mark
        getExpiryTimeInMs = lambda self: self.mark

    value, now = Value(), Timer()
    p = state.FirstForecasts()
    p.init(Handle())
    give = lambda *rows: list(p.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["forecast_id", "at", "seq", "score"])]), now))
    due = lambda: [tuple(r) for x in p.handleExpiredTimer((0,), now, now) for r in x.itertuples(index=False)]
    assert give(*((f"i{k}", (k + 1) * 10_000_000, k, 0.5) for k in range(50)), ("i7", 1_000_000, 99, 2.0)) == [] and calls == ["get", "update", 1001]
    now.mark, calls[:] = 30_001, []
    assert due() == [("i0", 10_000_000, 0, 0.5), ("i1", 20_000_000, 1, 0.5), ("i2", 30_000_000, 2, 0.5), ("i7", 1_000_000, 99, 2.0)] and calls == ["get", "update", 40_001]
    assert give(("i7", 31_000_000, 1, 1.0), ("i3", 35_000_000, 5, 1.0), ("i4", 20_000_000, 6, 1.0)) == [] and calls[3:] == ["get", "update", -40_001, 35_001]
    now.mark = 10**9
    assert len(out := due()) == 46 and ("i3", 35_000_000, 5, 1.0) in out and ("i4", 50_000_000, 4, 0.5) in out and due() == []
