"""Technical indicators.

Those that look at a fixed number of rows are window expressions; those with an
endless memory are folds.  Names of the variants say how they smooth.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from . import windows as W
from .folds import Columns, Ema, EmaAdjusted, EwmStd, Lag, Rma, Rolling, Step, ordered_fold

# --- window expressions ---------------------------------------------------------------------------------------


def zscore(c: str, w: WindowSpec, n: int, ddof: int = 1) -> Column:
    mean, sd = W.rolling_mean(c, w, n), W.rolling_std(c, w, n, ddof)
    return F.when(sd > 0, (F.col(c) - mean) / sd).when(sd.isNotNull(), F.lit(0.0))


def mfi(df: DataFrame, w: WindowSpec, n: int, name: str = "mfi") -> DataFrame:
    """Money flow index; 100 where nothing flowed down; from row ``n`` on."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    rows = df.withColumn("__t", typical).withColumn("__b", F.lag("__t").over(w))
    flow = F.col("__t") * F.col("volume")
    rows = rows.withColumn("__u", F.when(F.col("__t") > F.col("__b"), flow).otherwise(0.0)).withColumn("__d", F.when(F.col("__t") < F.col("__b"), flow).otherwise(0.0))
    frame = w.rowsBetween(-(n - 1), 0)
    up, down = F.sum("__u").over(frame), F.sum("__d").over(frame)
    value = F.when(F.count("__b").over(frame) == n, F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + up / down)))
    return rows.withColumn(name, value).drop("__t", "__b", "__u", "__d")


def donchian_width(w: WindowSpec, n: int) -> Column:
    up, down = W.rolling_max("high", w, n), W.rolling_min("low", w, n)
    mid = (up + down) / 2
    return F.when(mid != 0, (up - down) / mid).when(mid.isNotNull(), F.lit(0.0))


def awesome_oscillator(df: DataFrame, w: WindowSpec, fast: int = 5, slow: int = 34, name: str = "ao") -> DataFrame:
    return df.withColumn("__m", (F.col("high") + F.col("low")) / 2).withColumn(name, W.rolling_mean("__m", w, fast) - W.rolling_mean("__m", w, slow)).drop("__m")


def bollinger(c: str, w: WindowSpec, n: int, k: float) -> tuple[Column, Column, Column, Column]:
    """Upper, middle and lower band, and the bandwidth (4 deviations by the mean)."""
    mean, sd = W.rolling_mean(c, w, n), W.rolling_std(c, w, n)
    return mean + k * sd, mean, mean - k * sd, 4 * sd / mean


def stochastic(df: DataFrame, w: WindowSpec, n: int, smooth: int) -> DataFrame:
    low, high = W.rolling_min("low", w, n), W.rolling_max("high", w, n)
    rows = df.withColumn("stoch_k", 100 * (F.col("close") - low) / (high - low + 1e-10))
    return rows.withColumn("stoch_d", F.when(F.col("stoch_k").isNotNull(), F.avg("stoch_k").over(w.rowsBetween(-(smooth - 1), 0))))


def vwap(w: WindowSpec, n: int) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.sum(F.col("close") * F.col("volume")).over(frame) / (F.sum("volume").over(frame) + 1e-10)


def true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


# --- folds ----------------------------------------------------------------------------------------------------


def _apply(df: DataFrame, keys: list[str], order: list[str], make, fields: str) -> DataFrame:
    return ordered_fold(df, keys=keys, order=order, make=make, fields=fields)


def ema(df: DataFrame, *, keys: list[str], order: list[str], value: str, span: float, name: str = "ema", adjusted: bool = False, hold: bool = False) -> DataFrame:
    def make() -> Step:
        fold = EmaAdjusted(span) if adjusted else Ema(span, hold=hold)
        return lambda c: {name: fold(c[value])}

    return _apply(df, keys, order, make, f"{name} double")


def ewm_std(df: DataFrame, *, keys: list[str], order: list[str], value: str, span: float, name: str = "ewm_std") -> DataFrame:
    def make() -> Step:
        fold = EwmStd(span)
        return lambda c: {name: fold(c[value])}

    return _apply(df, keys, order, make, f"{name} double")


def rma(df: DataFrame, *, keys: list[str], order: list[str], value: str, n: int, name: str = "rma") -> DataFrame:
    def make() -> Step:
        fold = Rma(n)
        return lambda c: {name: fold(c[value])}

    return _apply(df, keys, order, make, f"{name} double")


def dema(df: DataFrame, *, keys: list[str], order: list[str], value: str, span: float, name: str = "dema") -> DataFrame:
    """``2 ema - ema(ema)``."""

    def make() -> Step:
        one, two = Ema(span), Ema(span)

        def step(c: Columns) -> Columns:
            a = one(c[value])
            return {name: 2 * a - two(a)}

        return step

    return _apply(df, keys, order, make, f"{name} double")


def hull(df: DataFrame, *, keys: list[str], order: list[str], value: str, n: int, name: str = "hull") -> DataFrame:
    """Mean over ``sqrt(n)`` rows of twice the half-length mean less the full one."""

    def make() -> Step:
        half, whole, last = Rolling(max(n // 2, 1), "mean", 1), Rolling(n, "mean", 1), Rolling(max(int(n**0.5), 1), "mean", 1)
        return lambda c: {name: last(2 * half(c[value]) - whole(c[value]))}

    return _apply(df, keys, order, make, f"{name} double")


def macd(df: DataFrame, *, keys: list[str], order: list[str], value: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    def make() -> Step:
        a, b, s = Ema(fast), Ema(slow), Ema(signal)

        def step(c: Columns) -> Columns:
            line = a(c[value]) - b(c[value])
            return {"macd": line, "macd_signal": s(line)}

        return step

    return _apply(df, keys, order, make, "macd double, macd_signal double")


def force_index(df: DataFrame, *, keys: list[str], order: list[str], span: int) -> DataFrame:
    def make() -> Step:
        lag, fold = Lag(), Ema(span)
        return lambda c: {"force_index": fold(np.nan_to_num((c["close"] - lag(c["close"])) * c["volume"]))}

    return _apply(df, keys, order, make, "force_index double")


class Rsi:
    """Relative strength: smoothing ``span`` (EWM), ``wilder`` (EWM with 1/n), ``seeded`` (Wilder's mean) or ``simple`` (plain mean)."""

    def __init__(self, n: int, smoothing: str):
        self.lag, self.smoothing = Lag(), smoothing
        make = {"span": lambda: Ema(n), "wilder": lambda: Ema(alpha=1.0 / n), "seeded": lambda: Rma(n), "simple": lambda: Rolling(n, "mean")}[smoothing]
        self.up, self.down = make(), make()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        change = x - self.lag(x)
        if self.smoothing == "span":
            change = np.nan_to_num(change)
        up, down = self.up(np.maximum(change, 0)), self.down(np.maximum(-change, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.smoothing == "span":
                return 100 - 100 / (1 + up / (down + 1e-10))
            ratio = np.where(down == 0, np.nan, up / np.where(down == 0, 1, down))
            full = np.where((down == 0) & (up > 0) & (self.smoothing != "wilder"), 100.0, np.nan)
            return np.where(np.isnan(ratio), full, 100 - 100 / (1 + ratio))


def rsi(df: DataFrame, *, keys: list[str], order: list[str], value: str = "close", n: int = 14, smoothing: str = "wilder", name: str = "rsi") -> DataFrame:
    def make() -> Step:
        fold = Rsi(n, smoothing)
        return lambda c: {name: fold(c[value])}

    return _apply(df, keys, order, make, f"{name} double")


class TrueRange:
    def __init__(self) -> None:
        self.lag = Lag()

    def __call__(self, c: Columns) -> np.ndarray:
        before = self.lag(c["close"])
        before = np.where(np.isnan(before), c["close"], before)
        return np.maximum(c["high"] - c["low"], np.maximum(np.abs(c["high"] - before), np.abs(c["low"] - before)))


def atr(df: DataFrame, *, keys: list[str], order: list[str], n: int = 14, smoothing: str = "rma", name: str = "atr") -> DataFrame:
    """Average true range: ``rma`` (Wilder, seeded), ``span`` (EWM) or ``simple`` (rolling mean); ``normalised`` is ``span`` by the close."""

    def make() -> Step:
        tr = TrueRange()
        fold = {"rma": lambda: Rma(n), "span": lambda: Ema(n), "normalised": lambda: Ema(n), "simple": lambda: Rolling(n, "mean")}[smoothing]()

        def step(c: Columns) -> Columns:
            out = fold(tr(c))
            return {name: out / c["close"] if smoothing == "normalised" else out}

        return step

    return _apply(df, keys, order, make, f"{name} double")


class Adx:
    """Average directional index with Wilder's means; directional indexes before the seed count as 0."""

    def __init__(self, n: int):
        self.tr, self.high, self.low = TrueRange(), Lag(), Lag()
        self.means = [Rma(n) for _ in range(3)]
        self.out = Rma(n)

    def __call__(self, c: Columns) -> np.ndarray:
        up, down = c["high"] - self.high(c["high"]), self.low(c["low"]) - c["low"]
        up, down = np.nan_to_num(up), np.nan_to_num(down)
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        tr, plus, minus = (m(x) for m, x in zip(self.means, (self.tr(c), plus, minus), strict=True))
        with np.errstate(invalid="ignore", divide="ignore"):
            plus, minus = np.where(tr > 0, plus / tr * 100, 0.0), np.where(tr > 0, minus / tr * 100, 0.0)
            both = plus + minus
            return self.out(np.where(both > 0, np.abs(plus - minus) / both * 100, 0.0))


def adx(df: DataFrame, *, keys: list[str], order: list[str], n: int = 14) -> DataFrame:
    def make() -> Step:
        fold = Adx(n)
        return lambda c: {"adx": fold(c)}

    return _apply(df, keys, order, make, "adx double")


class WaveTrend:
    """Two waves: the smoothed distance of the typical price from its mean, and its short mean."""

    def __init__(self, channel: int, average: int, smooth: int):
        self.mean, self.dev, self.wave, self.slow = Ema(channel), Ema(channel), Ema(average), Rolling(smooth, "mean")

    def __call__(self, c: Columns) -> tuple[np.ndarray, np.ndarray]:
        typical = (c["high"] + c["low"] + c["close"]) / 3.0
        mean = self.mean(typical)
        dev = self.dev(np.abs(typical - mean))
        with np.errstate(divide="ignore", invalid="ignore"):
            index = np.where(dev == 0, np.nan, (typical - mean) / (0.015 * np.where(dev == 0, 1, dev)))
        fast = self.wave(index)
        return fast, self.slow(fast)


class Cipher:
    """The wave oscillator's whole panel: waves, money flow, RSI, stochastic RSI, crosses and dots.

    Fixed values of the panel: zones at +-53, the extreme zone at -80, RSI below 20
    for a gold dot.
    """

    FIELDS = "wt1 double, wt2 double, rsi_mfi double, rsi double, stoch_k double, stoch_d double, wt_cross_up boolean, wt_cross_down boolean, buy_dot boolean, sell_dot boolean, gold_dot boolean"

    def __init__(self, *, channel: int = 10, average: int = 21, smooth: int = 4, rsi_length: int = 14, mfi_period: int = 60, mfi_factor: float = 150.0, stoch_rsi: int = 14, stoch: int = 14, k: int = 3, d: int = 3, oversold: float = -53.0, overbought: float = 53.0, extreme: float = -80.0, gold_rsi: float = 20.0):
        self.waves, self.rsi, self.flow, self.srsi = WaveTrend(channel, average, smooth), Rsi(rsi_length, "wilder"), Rsi(mfi_period, "wilder"), Rsi(stoch_rsi, "wilder")
        self.low, self.high, self.k, self.d = Rolling(stoch, "min"), Rolling(stoch, "max"), Rolling(k, "mean"), Rolling(d, "mean")
        self.one, self.two, self.factor = Lag(), Lag(), mfi_factor
        self.oversold, self.overbought, self.extreme, self.gold_rsi = oversold, overbought, extreme, gold_rsi

    def __call__(self, c: Columns) -> Columns:
        wt1, wt2 = self.waves(c)
        signed = c["volume"] * np.sign(c["close"] - c["open"])
        rsi = self.rsi(c["close"])
        s = self.srsi(c["close"])
        low, high = self.low(s), self.high(s)
        with np.errstate(divide="ignore", invalid="ignore"):
            k = self.k(np.where(high > low, (s - low) / (high - low) * 100, np.nan))
            before1, before2 = self.one(wt1), self.two(wt2)
            cross_up, cross_down = (before1 <= before2) & (wt1 > wt2), (before1 >= before2) & (wt1 < wt2)
            buy, sell = cross_up & (wt2 < self.oversold), cross_down & (wt2 > self.overbought)
            gold = cross_up & (wt2 <= self.extreme) & (rsi < self.gold_rsi)
        return {"wt1": wt1, "wt2": wt2, "rsi_mfi": (self.flow(signed) - 50) * self.factor / 100, "rsi": rsi, "stoch_k": k, "stoch_d": self.d(k), "wt_cross_up": cross_up, "wt_cross_down": cross_down, "buy_dot": buy, "sell_dot": sell, "gold_dot": gold}


def cipher(df: DataFrame, *, keys: list[str], order: list[str], **options) -> DataFrame:
    return _apply(df, keys, order, lambda: Cipher(**options), Cipher.FIELDS)
