"""Windowed aggregates that run alike on streams and on tables. With a watermark, rows later than it are dropped on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, length: str, keys: Sequence[str], value: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, end, keys, n, total) by tumbling windows, or sliding ones with a slide."""
    rows = df.withWatermark(time, late) if late else df
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    """(start, end, keys, n) of runs of rows with gaps shorter than `gap`."""
    rows = df.withWatermark(time, late) if late else df
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
