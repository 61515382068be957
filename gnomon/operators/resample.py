"""Resampling by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ohlcv(df: DataFrame, *, keys: list[str], ts: str, price: str, amount: str, tie: str, every: str, exact: int | None = None) -> DataFrame:
    """Open, high, low, close and volume of each tumbling window; empty windows have no row.

    ``tie`` orders rows of one instant.  With ``exact``, rows without an amount
    are left out first and only windows of exactly so many rows remain.
    """
    if exact is not None:
        df = df.where(F.col(amount) > 0)
    at = F.struct(ts, tie)
    out = df.groupBy(*keys, F.window(ts, every).alias("w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(amount).alias("volume"), F.count(F.lit(1)).alias("rows")
    )
    if exact is not None:
        out = out.where(F.col("rows") == exact)
    return out.select(*keys, F.col("w.start").alias(ts), "open", "high", "low", "close", "volume")


def last_per_window(df: DataFrame, *, keys: list[str], ts: str, value: str, tie: str, every: str) -> DataFrame:
    """The last non-null value of each window."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*keys, F.window(ts, every).alias("w")).agg(F.max_by(value, F.struct(ts, tie)).alias(value)).select(*keys, F.col("w.start").alias(ts), value)


def expand_calendar(df: DataFrame, *, keys: list[str], first: str, last: str, business_only: bool = True) -> DataFrame:
    """A row for each day from ``first`` to ``last``; weekdays only unless told otherwise."""
    out = df.select(*keys, F.explode(F.sequence(F.col(first), F.col(last))).alias("day"))
    return out.where(F.weekday("day") < 5) if business_only else out


def walk_forward(df: DataFrame, *, keys: list[str], length: str, estimation: int, signal: int, step: int) -> DataFrame:
    """Walk-forward windows as ``est_start, est_end, sig_start, sig_end`` (ends exclusive)."""
    last = F.col(length) - estimation - signal
    starts = F.when(last >= 0, F.sequence(F.lit(0), last.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))
    out = df.select(*keys, F.explode(starts).alias("est_start"))
    return out.select(*keys, "est_start", (F.col("est_start") + estimation).alias("est_end"), (F.col("est_start") + estimation).alias("sig_start"), (F.col("est_start") + estimation + signal).alias("sig_end"))
