"""Trading signals: +1, -1 or 0 for each row of a series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .folds import Columns, Ema, EmaAdjusted, EwmStd, Lag, Machine, Rolling, Step, ordered_fold
from .indicators import Rsi, TrueRange


def sign_of(a: Column, b: Column) -> Column:
    """+1 where ``a`` is above ``b``, -1 below, 0 if equal or either is missing."""
    return F.when(a > b, 1).when(a < b, -1).otherwise(0)


def sma_crossover(df: DataFrame, *, keys: list[str], order: list[str], value: str = "close", fast: int = 10, slow: int = 50) -> DataFrame:
    w = W.series(keys, *order)
    return df.withColumn("signal", sign_of(W.rolling_mean(value, w, fast), W.rolling_mean(value, w, slow)))


def ema_crossover(df: DataFrame, *, keys: list[str], order: list[str], value: str = "close", fast: int = 12, slow: int = 26) -> DataFrame:
    """Crossover of two exponentially weighted means (weights adjusted)."""

    def make() -> Step:
        a, b = EmaAdjusted(fast), EmaAdjusted(slow)

        def step(c: Columns) -> Columns:
            return {"signal": np.sign(a(c[value]) - b(c[value]))}

        return step

    return ordered_fold(df, keys=keys, order=order, make=make, fields="signal int")


def bollinger_reversion(df: DataFrame, *, keys: list[str], order: list[str], value: str = "close", n: int = 20, threshold: float = 2.0) -> DataFrame:
    """+1 below the lower band, -1 above the upper one."""
    w = W.series(keys, *order)
    sd = W.rolling_std(value, w, n)
    z = F.when(sd > 0, (F.col(value) - W.rolling_mean(value, w, n)) / sd).otherwise(0.0)
    return df.withColumn("__z", z).withColumn("signal", F.when(F.col("__z") < -threshold, 1).when(F.col("__z") > threshold, -1).otherwise(0)).drop("__z")


def price_above_mean(df: DataFrame, *, keys: list[str], order: list[str], value: str = "close", n: int = 20) -> DataFrame:
    w = W.series(keys, *order)
    return df.withColumn("signal", sign_of(F.col(value), W.rolling_mean(value, w, n)))


def spread_zscore(df: DataFrame, *, keys: list[str], order: list[str], weight: float, lookback: int, entry: float, exit_fraction: float = -0.6, a: str = "close_a", b: str = "close_b", carry: bool = True) -> DataFrame:
    """``zscore`` of the spread ``a - weight b`` about its exponential mean, and the ``signal``.

    Short at ``entry`` and above, long at its negative and below; a position is
    carried until the score has come back past ``exit_fraction * entry``.
    Without ``carry`` every row is judged by itself.
    """
    leave = exit_fraction * entry

    def make() -> Step:
        mean, std = Ema(lookback, hold=True), EwmStd(lookback)

        def long_step(pos: float, z: float):
            pos = pos if z != z else 1.0 if z <= -entry else 0.0 if z >= -leave else pos
            return pos, pos

        def short_step(pos: float, z: float):
            pos = pos if z != z else -1.0 if z >= entry else 0.0 if z <= leave else pos
            return pos, pos

        held = Machine(long_step, 0.0), Machine(short_step, 0.0)

        def step(c: Columns) -> Columns:
            spread = c[a] - weight * c[b]
            m, s = mean(spread), std(spread)
            z = np.where(s > 0, (spread - m) / np.where(s > 0, s, 1), 0.0)
            if carry:
                signal = held[0](z) + held[1](z)
            else:
                long = np.where(z >= -leave, 0, np.where(z <= -entry, 1, 0))
                short = np.where(z <= leave, 0, np.where(z >= entry, -1, 0))
                signal = long + short
            return {"zscore": z, "signal": signal}

        return step

    return ordered_fold(df, keys=keys, order=order, make=make, fields="zscore double, signal int")


class TaSignal:
    """One of the eight technical signals; the first row of a series is always 0."""

    TYPES = ("RSI", "MACD", "BOLL", "EMA_CROSS", "STOCH", "ATR_BREAK", "VOL_BREAK", "VWAP_REV")

    def __init__(self, kind: str, *, period: int = 14, low: float = 30.0, high: float = 70.0, fast: int = 12, slow: int = 26, signal: int = 9, multiplier: float = 2.0, surge: float = 2.0):
        self.kind, self.low, self.high, self.multiplier, self.surge, self.started = kind, low, high, multiplier, surge, False
        if kind == "RSI":
            self.rsi = Rsi(period, "span")
        elif kind in ("MACD", "EMA_CROSS"):
            self.fast, self.slow, self.line, self.back = Ema(fast), Ema(slow), Ema(signal), Lag()
        elif kind == "BOLL":
            self.mean, self.std = Rolling(period, "mean"), Rolling(period, "std")
        elif kind == "STOCH":
            self.min, self.max, self.back = Rolling(period, "min"), Rolling(period, "max"), Lag()
        elif kind == "ATR_BREAK":
            self.tr, self.atr, self.mean = TrueRange(), Ema(period), Rolling(period, "mean", 1)
        elif kind == "VOL_BREAK":
            self.mean, self.vol = Rolling(period, "mean", 1), Rolling(period, "mean", 1)
        elif kind == "VWAP_REV":
            self.cv, self.v = Rolling(period, "sum", 1), Rolling(period, "sum", 1)
        else:
            raise ValueError(f"no signal {kind}")

    def __call__(self, c: Columns) -> np.ndarray:
        x = c["close"]
        with np.errstate(invalid="ignore", divide="ignore"):
            if self.kind == "RSI":
                r = self.rsi(x)
                up, down = r < self.low, r > self.high
            elif self.kind in ("MACD", "EMA_CROSS"):
                gap = self.fast(x) - self.slow(x)
                if self.kind == "MACD":
                    gap = gap - self.line(gap)
                before = self.back(gap)
                up, down = (gap > 0) & (before <= 0), (gap < 0) & (before >= 0)
            elif self.kind == "BOLL":
                m, s = self.mean(x), self.std(x)
                up, down = x < m - self.multiplier * s, x > m + self.multiplier * s
            elif self.kind == "STOCH":
                low, high = self.min(c["low"]), self.max(c["high"])
                k = 100 * (x - low) / (high - low + 1e-10)
                before = self.back(k)
                up, down = (k < self.low) & (before >= self.low), (k > self.high) & (before <= self.high)
            elif self.kind == "ATR_BREAK":
                wide, m = self.multiplier * self.atr(self.tr(c)), self.mean(x)
                up, down = x > m + wide, x < m - wide
            elif self.kind == "VOL_BREAK":
                m, v = self.mean(x), self.vol(c["volume"])
                burst = (v > 0) & (c["volume"] / v > self.surge)
                up, down = burst & (x > m), burst & ~(x > m)
            else:
                vw = self.cv(x * c["volume"]) / (self.v(c["volume"]) + 1e-10)
                dev = np.where(vw > 0, (x - vw) / vw * 100, 0.0)
                up, down = dev < -self.low, dev > self.high
        out = np.where(up, 1, np.where(down, -1, 0))
        if not self.started and len(out):
            out[0], self.started = 0, True
        return out


def ta_signal(df: DataFrame, kind: str, *, keys: list[str], order: list[str], **options) -> DataFrame:
    def make() -> Step:
        fold = TaSignal(kind, **options)
        return lambda c: {"signal": fold(c)}

    return ordered_fold(df, keys=keys, order=order, make=make, fields="signal int")


def cooldown_pairs(df: DataFrame, *, keys: list[str], order: list[str], z: str, entry: float = 2.0, leave: float = 0.5, emergency: float = 4.0, cooldown: int = 5) -> DataFrame:
    """Pair signal of a score: ``emergency_exit``, ``exit``, ``enter_long``, ``enter_short`` or ``hold``; entries rest for ``cooldown`` rows."""

    def make() -> Step:
        def rule(state: tuple[int, int], value: float):
            now, last = state
            if value != value:
                return (now + 1, last), "hold"
            if abs(value) >= emergency:
                return (now + 1, last), "emergency_exit"
            if abs(value) <= leave:
                return (now + 1, last), "exit"
            if abs(value) >= entry and now - last >= cooldown:
                return (now + 1, now), "enter_short" if value > 0 else "enter_long"
            return (now + 1, last), "hold"

        fold = Machine(rule, (0, -cooldown))
        return lambda c: {"action": fold(c[z])}

    return ordered_fold(df, keys=keys, order=order, make=make, fields="action string")


def anchor_trigger(df: DataFrame, *, keys: list[str], order: list[str], anchor: float = -60.0, trigger: float = -40.0, leave: float = 0.0, patience: int = 20) -> DataFrame:
    """State machine over two waves: a deep anchor, then a shallower dip with a cross upwards enters; a cross downwards above ``leave`` exits."""

    def make() -> Step:
        def rule(state: tuple[str, int], wt1: float, wt2: float, up: float, down: float):
            phase, age = state
            if wt1 != wt1 or wt2 != wt2:
                return state, ""
            if phase == "in":
                return (("idle", 0), "exit") if down == 1 and wt2 > leave else (("in", age + 1), "")
            if wt2 <= anchor:
                return ("anchored", 0), "anchor"
            if phase == "anchored":
                if age >= patience:
                    return ("idle", 0), ""
                if up == 1 and anchor < wt2 <= trigger:
                    return ("in", 0), "enter"
                return ("anchored", age + 1), ""
            return ("idle", 0), ""

        fold = Machine(rule, ("idle", 0))

        def step(c: Columns) -> Columns:
            flags = [np.array([0.0 if v is None else float(v) for v in c[k].tolist()]) for k in ("wt_cross_up", "wt_cross_down")]
            return {"event": fold(c["wt1"], c["wt2"], *flags)}

        return step

    return ordered_fold(df, keys=keys, order=order, make=make, fields="event string")


def zero_line_rejection(w, wt1: str = "wt1", wt2: str = "wt2", band: float = 10.0) -> Column:
    """Entry where the waves turn up from near zero after having been above it."""
    near = F.abs(wt2) <= band
    return near & (F.lag(wt1).over(w) <= F.lag(wt2).over(w)) & (F.col(wt1) > F.col(wt2)) & (F.max(wt2).over(w.rowsBetween(-10, -1)) > band)


def mfi_momentum(w, flow: str = "rsi_mfi") -> Column:
    """Entry where the money flow turns positive, exit (-1) where it turns negative."""
    before = F.lag(flow).over(w)
    return F.when((before <= 0) & (F.col(flow) > 0), 1).when((before >= 0) & (F.col(flow) < 0), -1).otherwise(0)


# --- short-horizon momentum -----------------------------------------------------------------------------------


def momentum_panel(df: DataFrame, *, keys: list[str], order: list[str], n: int = 20, volume_times: float = 2.0, velocity: float = 0.005, runs: int = 3, flow: float = 0.3) -> DataFrame:
    """Five signals in -1..1: volume spike, velocity, consecutive moves, breakout and flow imbalance; and their weighted vote."""
    w = W.series(keys, *order)
    before = w.rowsBetween(-n, -1)
    ret = W.pct_change("close", w)
    rows = df.withColumn("__r", ret).withColumn("__v", F.avg("volume").over(before)).withColumn("__hi", F.max("high").over(before)).withColumn("__lo", F.min("low").over(before)).withColumn("__m", W.pct_change("close", w, 5))
    side = F.signum("__r")
    rows = rows.withColumn("__s", side)
    rows = W.run_ids(rows, keys, order, F.col("__s") == F.lag("__s").over(w), "__run")
    rows = rows.withColumn("__len", F.row_number().over(W.series([*keys, "__run"], *order)))
    up = F.sum(F.when(F.col("__r") > 0, F.col("volume")).otherwise(0.0)).over(w.rowsBetween(-(n - 1), 0))
    total = F.sum("volume").over(w.rowsBetween(-(n - 1), 0))
    rows = rows.withColumn("volume_spike", F.when(F.col("volume") >= volume_times * F.col("__v"), F.col("__s")).otherwise(0.0))
    rows = rows.withColumn("velocity", F.when(F.abs("__m") >= velocity, F.signum("__m")).otherwise(0.0))
    rows = rows.withColumn("consecutive", F.when(F.col("__len") >= runs, F.col("__s")).otherwise(0.0))
    rows = rows.withColumn("breakout", F.when(F.col("close") > F.col("__hi"), 1.0).when(F.col("close") < F.col("__lo"), -1.0).otherwise(0.0))
    balance = F.when(total > 0, 2 * up / total - 1).otherwise(0.0)
    rows = rows.withColumn("flow_imbalance", F.when(F.abs(balance) >= flow, F.signum(balance)).otherwise(0.0))
    weights = {"volume_spike": 0.2, "velocity": 0.25, "consecutive": 0.15, "breakout": 0.25, "flow_imbalance": 0.15}
    vote = sum((F.coalesce(F.col(k), F.lit(0.0)) * v for k, v in weights.items()), F.lit(0.0))
    rows = rows.withColumn("score", vote).withColumn("actionable", F.abs("score") >= 0.5)
    return rows.drop("__r", "__v", "__hi", "__lo", "__m", "__s", "__run", "__len")


def cross_sectional_momentum(df: DataFrame, *, key: str, day: str, value: str, lookbacks: tuple[int, ...] = (5, 20), top: int = 1) -> DataFrame:
    """Mean return over the lookbacks, ranked per day; the best ``top`` weigh +1/top, the worst -1/top."""
    w = W.series([key], day)
    rows = df
    for n in lookbacks:
        rows = rows.withColumn(f"__m{n}", W.pct_change(value, w, n))
    score = sum((F.col(f"__m{n}") for n in lookbacks), F.lit(0.0)) / len(lookbacks)
    rows = rows.withColumn("score", score).where(F.col("score").isNotNull())
    rank = F.row_number().over(W.series([day], F.desc("score"), key))
    last = F.row_number().over(W.series([day], F.asc("score"), F.desc(key)))
    rows = rows.withColumn("__a", rank).withColumn("__b", last)
    weight = F.when(F.col("__a") <= top, 1.0 / top).when(F.col("__b") <= top, -1.0 / top).otherwise(0.0)
    return rows.withColumn("weight", weight).drop("__a", "__b", *(f"__m{n}" for n in lookbacks))


def composite_alpha(df: DataFrame, *, day: str, parts: dict[str, float], winsor: float = 0.05) -> DataFrame:
    """Weighted sum of per-day z-scores of winsorised columns."""
    limits = [F.percentile(c, F.lit(q)).alias(f"__{c}{i}") for c in parts for i, q in enumerate((winsor, 1 - winsor))]
    rows = df.join(df.groupBy(day).agg(*limits), day)
    for c in parts:
        rows = rows.withColumn(f"__{c}", F.greatest(F.least(F.col(c), F.col(f"__{c}1")), F.col(f"__{c}0")))
    from pyspark.sql import Window

    w = Window.partitionBy(day)
    score = F.lit(0.0)
    for c, weight in parts.items():
        sd = F.stddev_samp(f"__{c}").over(w)
        score = score + weight * F.when(sd > 0, (F.col(f"__{c}") - F.avg(f"__{c}").over(w)) / sd).otherwise(0.0)
    return rows.withColumn("alpha", score).select(*df.columns, "alpha")


def decayed(value: Column, age: Column, half_life: float, shape: str = "exp") -> Column:
    """A signal that fades with age, exponentially or in a line to zero at twice its half life."""
    if shape == "exp":
        return value * F.exp(-age * math.log(2) / half_life)
    return value * F.greatest(F.lit(0.0), 1 - age / (2 * half_life))
