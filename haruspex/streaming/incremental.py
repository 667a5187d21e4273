"""Structured Streaming over samples: aggregates that merge, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_moments(stream: DataFrame, ts: str, value: str, by: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """n, sum and extremes by event-time window; rows later than ``late`` are dropped."""
    win = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    v = F.col(value)
    out = stream.withWatermark(ts, late).groupBy(win.alias("w"), *by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "mean", "var", "min", "max")


def windowed_failures(stream: DataFrame, ts: str, limit_state: Column, by: list[str], width: str, late: str) -> DataFrame:
    """Samples and failures by window: what a failure probability is made of, and merges."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum((limit_state <= 0).cast("long")).alias("failures"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "failures")


def running_gram(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Running X'X of a stream, one row in complete mode."""
    return stream.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j])
