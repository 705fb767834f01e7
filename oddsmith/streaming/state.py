"""Keyed state on Structured Streaming: running totals by day and first forecasts, closed by event-time timers.

A row is late where its time lies before the watermark of its batch; late rows are left out. What a timer
has closed never changes again, so results do not hang on how files fall into batches, but for what is late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 86_400_000


class DailyTotals(StatefulProcessor):
    """Of each forecaster: totals up to the end of each day with rows, given out once the watermark has passed that end. State: one value of the
    totals and a sum for each day that is still open (as many as the lateness spans), read and written once for a batch, and a timer for the first of those days."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.all = handle.getValueState("all", "s double, w double, n long, day array<long>, ds array<double>, dw array<double>, dn array<long>")

    def read(self) -> tuple[tuple, dict]:
        """(totals, sums by open day)"""
        v = self.all.get()
        if v is None:
            return (0.0, 0.0, 0), {}
        return tuple(v[:3]), {d: (s, w, n) for d, s, w, n in zip(*v[3:])}

    def write(self, total: tuple, days: dict) -> None:
        self.all.update((*total, list(days), *(list(k) for k in (zip(*days.values()) if days else ((), (), ())))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        add: dict = {}
        for x in rows:
            for at, score, w in zip(*(x[c].to_numpy().tolist() for c in ("at", "score", "weight"))):
                if at // 1000 >= mark:
                    s = add.setdefault(at // 1000 // _DAY, [0.0, 0.0, 0])
                    s[0], s[1], s[2] = s[0] + score * w, s[1] + w, s[2] + 1
        if add:
            total, days = self.read()
            if not days or min(add) < min(days):
                self.handle.registerTimer((min(add) + 1) * _DAY)
            for day, s in add.items():
                days[day] = tuple(a + b for a, b in zip(days.get(day, (0.0, 0.0, 0)), s))
            self.write(total, days)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        out = []
        total, days = self.read()
        for d in sorted(d for d in days if (d + 1) * _DAY <= end):
            total = tuple(a + b for a, b in zip(total, days.pop(d)))
            out.append((key[0], d, total[0] / total[1] if total[1] else None, total[2]))
        if out:
            self.write(total, days)
            if days:
                self.handle.registerTimer((min(days) + 1) * _DAY)
            yield pd.DataFrame(out, columns=["forecaster", "day", "score", "n"])

    def close(self) -> None:
        pass


BUCKETS = 1 << 12  # of forecast ids, by hash: a call of Python and a value of state serve the ids of a bucket, not one id


class FirstForecasts(StatefulProcessor):
    """Of each forecast id: the row of least time (then least seq), given out once the watermark has reached it. Of a closed
    id a mark stays, so that later rows of it are left out. State: one value for a bucket of ids, read and written once for a batch, and a timer for the first open id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.all = handle.getValueState("all", "id array<string>, at array<long>, seq array<long>, score array<double>, done array<string>")

    def read(self) -> tuple[dict, list]:
        """(rows by open id, closed ids)"""
        v = self.all.get()
        if v is None:
            return {}, []
        return {k: tuple(row) for k, *row in zip(*v[:4])}, list(v[4])

    def write(self, first: dict, done: list) -> None:
        self.all.update((list(first), *(list(k) for k in (zip(*first.values()) if first else ((), (), ()))), done))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        add: dict = {}
        for x in rows:
            for name, at, seq, score in zip(*(x[c].tolist() for c in ("forecast_id", "at", "seq", "score"))):
                if at // 1000 >= mark and (name not in add or (at, seq) < add[name][:2]):
                    add[name] = (at, seq, score)
        if add:
            first, done = self.read()
            soonest, closed = min((r[0] for r in first.values()), default=None), set(done)
            new = {k: r for k, r in add.items() if k not in closed and (k not in first or r[:2] < first[k][:2])}
            if new:
                first.update(new)
                self.write(first, done)
                at = min(r[0] for r in first.values())
                if soonest is None or at != soonest:
                    if soonest is not None:
                        self.handle.deleteTimer(soonest // 1000 + 1)
                    self.handle.registerTimer(at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        first, done = self.read()
        out = {k: r for k, r in first.items() if r[0] // 1000 + 1 <= end}
        if out:
            first = {k: r for k, r in first.items() if k not in out}
            self.write(first, done + list(out))
            if first:
                self.handle.registerTimer(min(r[0] for r in first.values()) // 1000 + 1)
            yield pd.DataFrame([(k, *r) for k, r in out.items()], columns=["forecast_id", "at", "seq", "score"])

    def close(self) -> None:
        pass


def daily_totals(scores: DataFrame, late: str = "2 days") -> DataFrame:
    """(forecaster, day, score, n) of a stream (ts, forecaster, score, weight): weighted means of all
    rows up to the end of each closed day (of UTC). Rows without time, score or weight are left out."""
    x = scores.where("ts is not null and score is not null and weight is not null").select("ts", "forecaster", "score", "weight", F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    x = x.groupBy("forecaster").transformWithStateInPandas(DailyTotals(), "forecaster string, day long, score double, n long", "Append", "EventTime")
    return x.withColumn("day", F.date_from_unix_date(F.col("day").cast("int")))


def first_forecasts(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """(forecast_id, ts, seq, score) of a stream (ts, forecast_id, seq, score): each id's first row, whatever order they come in within the lateness."""
    x = rows.where("ts is not null and seq is not null and score is not null").select("ts", "forecast_id", "seq", "score", F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    x = x.withColumn("bucket", F.pmod(F.xxhash64("forecast_id"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(FirstForecasts(), "forecast_id string, at long, seq long, score double", "Append", "EventTime")
    return x.select("forecast_id", F.timestamp_micros("at").alias("ts"), "seq", "score")


def run_available(stream: DataFrame, path: str, checkpoint: str, timeout: int = 3600) -> DataFrame:
    """All that is there now is processed, batch by batch, into files under path, which are read back. A run that was
    stopped goes on from its checkpoint."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"the stream did not end within {timeout} seconds")
    return spark.read.schema(stream.schema).parquet(path)
