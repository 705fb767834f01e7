"""Where results go: rankings as text, tables as JSON lines or Parquet, streams as appended files."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame

from ..operators.ranking import report


def log_ranking(ranking: DataFrame, logger: logging.Logger | None = None, rows: int = 25) -> str:
    """The first rows as a fixed-width table, logged and returned."""
    text = report(ranking, rows)
    (logger or logging.getLogger("oddsmith")).info("\n%s", text)
    return text


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_parameters(table: DataFrame, path: str, mode: str = "error") -> None:
    """Fitted parameters or posterior summaries."""
    table.write.mode(mode).parquet(path)


def append_stream(df: DataFrame, path: str, checkpoint: str):
    """A running query that appends what arrives as JSON lines, each row once; it stops when all input is read."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
