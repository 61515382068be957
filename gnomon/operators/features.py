"""Feature vectors: strictly backward-looking columns of a series, for learning.

Everything is a frame of rows at or before the row.  ``as_of_previous`` moves a
vector to the next day, so that a day's features never see that day.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W
from .folds import Columns, Ema, Lag, Rolling, ordered_fold

#: Lookbacks of the minute vector, and its indicators.
LOOKBACKS = (50, 100, 200, 400, 800, 1600, 3200)
INDICATORS = ("bb_zscore", "bb_bandwidth", "mfi", "force_index", "donchian_width", "atr", "awesome_osc", "adx")
#: Bars that a series must have beyond the longest lookback before it has a minute vector.
WARM_UP = 50
#: Bars after which nothing of a mean with the directional index's longest period, 14, is left in a double, twice over.
FADED = 512
TINY = 1e-12


def feature_names(lookbacks: tuple[int, ...] = LOOKBACKS, legs: tuple[str, ...] = ("target", "hedge")) -> list[str]:
    """Names of the minute vector: 8 indicators for 2 legs and 7 lookbacks are 112."""
    return [f"{ind}_{leg}_{n}" for ind in INDICATORS for leg in legs for n in lookbacks]


class _FrameEma:
    """The mean ``y = a x + (1 - a) y`` of span ``n``, begun anew ``n`` rows before each row.

    An endless mean less what is left of it from before the frame.
    """

    def __init__(self, n: int):
        self.ema, self.left = Ema(n, seed=0.0), ((n - 1) / (n + 1)) ** (n - 1)
        self.old, self.first = Lag(n - 1, 0.0), Lag(n - 1, 0.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = self.ema(x)
        return y - self.left * (self.old(y) - self.first(x)) if self.left < 1 else x


class _FrameAdx:
    """The directional index over the last ``n`` moves, all its means begun anew with the frame.

    All rows of a batch take the steps of their frames together.  Of a frame of
    more than ``FADED`` moves the older ones weigh nothing.
    """

    def __init__(self, n: int, period: int):
        self.a, self.n = 2.0 / (period + 1), min(n, FADED)
        self.tails = [np.full(self.n - 1, np.nan) for _ in range(3)]

    def __call__(self, *moves: np.ndarray) -> np.ndarray:
        size = len(moves[0])
        both = [np.concatenate([t, x]) for t, x in zip(self.tails, moves, strict=True)]
        self.tails = [x[size:] for x in both]
        state = [np.full(size, np.nan) for _ in range(4)]

        def follow(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.where(np.isnan(y), x, self.a * x + (1 - self.a) * y)

        for j in range(self.n):
            rng, plus, minus = (follow(y, x[j : j + size]) for y, x in zip(state, both, strict=False))
            p, m = 100 * plus / (rng + 1e-10), 100 * minus / (rng + 1e-10)
            state = [rng, plus, minus, follow(state[3], 100 * np.abs(p - m) / (p + m + 1e-10))]
        return np.clip(state[3], 0, 100)


class _Vector:
    """The eight indicators over each lookback, along one series."""

    def __init__(self, lookbacks: tuple[int, ...]):
        self.seen, self.lookbacks = 0, lookbacks
        self.before = {c: Lag() for c in ("high", "low", "close", "typical")}
        self.rolls = {n: {w: Rolling(n, w.split()[0]) for w in ("mean close", "std close", "sum pos", "sum neg", "sum falls", "mean worth", "max high", "min low", "mean mid")} for n in lookbacks}
        self.short = {n: Rolling(max(5, n // 7), "mean") for n in lookbacks}
        self.force, self.range = ({n: _FrameEma(n) for n in lookbacks} for _ in range(2))
        self.period = {n: max(3, min(14, n // 3)) for n in lookbacks}
        self.adx = {k: _FrameAdx(*k) for k in {(min(n, FADED), self.period[n]) for n in lookbacks}}

    def __call__(self, c: Columns) -> Columns:
        high, low, close, volume = (c[x].astype(float) for x in ("high", "low", "close", "volume"))
        typical, mid = (high + low + close) / 3, (high + low) / 2
        hi, lo, last, was = (self.before[n](x) for n, x in (("high", high), ("low", low), ("close", close), ("typical", typical)))
        at = self.seen + 1 + np.arange(len(close))
        self.seen += len(close)
        out = {"__bar": at}
        with np.errstate(all="ignore"):
            spread = np.maximum(high - low, np.maximum(np.abs(high - last), np.abs(low - last)))
            up, down = np.maximum(high - hi, 0), np.maximum(lo - low, 0)
            plus, minus = np.where(up > down, up, np.where(at == 1, np.nan, 0.0)), np.where(down > up, down, np.where(at == 1, np.nan, 0.0))
            pushed = np.where(at == 1, 0.0, (close - last) * volume)
            calm = np.where(at == 1, 0.0, spread)
            falls = (typical < was).astype(float)
            given = {"close": close, "pos": np.where(typical > was, typical * volume, 0.0), "neg": falls * typical * volume, "falls": falls, "worth": close * volume, "high": high, "low": low, "mid": mid}
            index = {k: f(spread, plus, minus) for k, f in self.adx.items()}
            for n in self.lookbacks:
                r = {w: f(given[w.split()[1]]) for w, f in self.rolls[n].items()}
                neg = np.where(r["sum falls"] > 0.5, r["sum neg"], 0.0)
                made = {
                    "bb_zscore": (at >= n, np.where(r["std close"] < TINY, 0.0, (close - r["mean close"]) / r["std close"]), 0.0),
                    "bb_bandwidth": (at >= n, np.where(r["mean close"] < TINY, 0.0, 4 * r["std close"] / r["mean close"]), 0.0),
                    "mfi": (at > n, np.where(neg < TINY, 100.0, 100 - 100 / (1 + r["sum pos"] / neg)), 50.0),
                    "force_index": (at > n, np.where(r["mean worth"] < TINY, 0.0, self.force[n](pushed) / r["mean worth"]), 0.0),
                    "donchian_width": (at >= n, np.where(close < TINY, 0.0, (r["max high"] - r["min low"]) / close), 0.0),
                    "atr": (at > n, np.where(close < TINY, 0.0, self.range[n](calm) / close), 0.0),
                    "awesome_osc": (at >= n, np.where(r["mean mid"] < TINY, 0.0, (self.short[n](mid) - r["mean mid"]) / r["mean mid"]), 0.0),
                    "adx": (at >= 3 * self.period[n], index[min(n, FADED), self.period[n]], 25.0),
                }
                for name, (enough, value, neutral) in made.items():
                    value = np.where(enough, value, neutral)
                    out[f"{name}_{n}"] = np.where(np.isfinite(value), value, 0.0)
        return out


def bar_features(df: DataFrame, *, keys: list[str], order: list[str], lookbacks: tuple[int, ...], leg: str = "", least: int = 1) -> DataFrame:
    """The eight indicators over each lookback, from the ``least``-th bar on; a neutral value where there are too few bars.

    Bars are ``high, low, close, volume``.  Neutral are 50 for the money flow, 25
    for the directional index and 0 for the others.  Columns are
    ``<indicator>_<lookback>``, with a leg ``<indicator>_<leg>_<lookback>``.
    """
    bars = df.select(*keys, *order, *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")))
    names = [f"{ind}_{n}" for ind in INDICATORS for n in lookbacks]
    rows = ordered_fold(bars, keys=keys, order=order, make=lambda: _Vector(lookbacks), fields=", ".join(["__bar bigint", *(f"{x} double" for x in names)]))
    return rows.where(F.col("__bar") >= least).select(*keys, *order, *(F.col(f"{ind}_{n}").alias(f"{ind}_{leg}_{n}" if leg else f"{ind}_{n}") for ind in INDICATORS for n in lookbacks))


def minute_vector(target: DataFrame, hedge: DataFrame, *, keys: list[str], ts: str, lookbacks: tuple[int, ...] = LOOKBACKS) -> DataFrame:
    """Features of both legs at each common time from which on both have the longest lookback and ``WARM_UP`` bars more."""
    a, b = (bar_features(bars, keys=keys, order=[ts], lookbacks=lookbacks, leg=leg, least=max(lookbacks) + WARM_UP) for bars, leg in ((target, "target"), (hedge, "hedge")))
    return a.join(b, [*keys, ts]).select(*keys, ts, *feature_names(lookbacks))


def daily_vector(df: DataFrame, *, keys: list[str], day: str, value: str = "close", horizons: tuple[int, ...] = (1, 5, 20), vols: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Returns, volatilities, gaps to means, range position and momentum of each day."""
    w = W.series(keys, day)
    rows = df.withColumn("__r", W.pct_change(value, w))
    out = [W.pct_change(value, w, n).alias(f"ret_{n}") for n in horizons]
    out += [W.rolling_std("__r", w, n).alias(f"vol_{n}") for n in vols]
    out += [(F.col(value) / W.rolling_mean(value, w, n) - 1).alias(f"gap_{n}") for n in vols]
    for n in vols:
        hi, lo = W.rolling_max(value, w, n), W.rolling_min(value, w, n)
        out.append(F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).when(hi.isNotNull(), F.lit(0.5)).alias(f"place_{n}"))
    return rows.select(*keys, day, *out)


def as_of_previous(features: DataFrame, *, keys: list[str], day: str) -> DataFrame:
    """Each day with the vector of the day before it in its series: nothing of the day itself is known."""
    w = W.series(keys, day)
    cols = [c for c in features.columns if c not in (*keys, day)]
    return features.select(*keys, day, *(F.lag(c).over(w).alias(c) for c in cols))


def funding_vector(df: DataFrame, *, keys: list[str], order: list[str], rate: str = "rate", per_day: int = 3) -> DataFrame:
    """Level, mean, spread and share of positive funding over 3, 7 and 30 days."""
    w = W.series(keys, *order)
    out = []
    for days in (3, 7, 30):
        frame = w.rowsBetween(-(days * per_day - 1), 0)
        out += [F.avg(rate).over(frame).alias(f"mean_{days}d"), F.stddev_pop(rate).over(frame).alias(f"sd_{days}d"), F.avg((F.col(rate) > 0).cast("double")).over(frame).alias(f"positive_{days}d")]
    return df.select(*keys, *order, F.col(rate).alias("rate"), *out)


def spike_features(df: DataFrame, *, keys: list[str], ts: str, price: str, minutes: tuple[int, ...] = (1, 5, 15, 30, 60), tolerance: int = 180) -> DataFrame:
    """Returns against the newest price some minutes back (within the tolerance), speed, its change, and the place in the hour's range.

    Against a price that isn't positive the return is 0.  Of prices of one time
    the highest is the newest.
    """
    w = Window.partitionBy(*keys).orderBy("__t")
    rows = df.withColumn("__t", F.unix_seconds(ts)).withColumn("__p", F.struct(F.unix_micros(ts).alias("t"), F.col(price).alias("p")))
    for m in minutes:
        back = F.max("__p").over(w.rangeBetween(-60 * m - tolerance, -60 * m))["p"]
        rows = rows.withColumn("__back", back).withColumn(f"ret_{m}m", F.when(F.col("__back") <= 0, F.lit(0.0)).otherwise(F.col(price) / F.nullif(F.col("__back"), F.lit(0.0)) - 1))
    hi, lo = F.max(price).over(w.rangeBetween(-3600, 0)), F.min(price).over(w.rangeBetween(-3600, 0))
    first, last = minutes[0], minutes[1]
    speed, before = F.col(f"ret_{first}m") / first, F.col(f"ret_{last}m") / last
    return rows.withColumn("velocity", speed).withColumn("acceleration", speed - before).withColumn("place", F.when(hi > lo, (F.col(price) - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(0.5)).drop("__t", "__p", "__back")
