"""The twelve market regimes, for every bar of a series.

Each state looks only at its bar and those before it; a bar without enough
history has the neutral state.  The thresholds are fixed values.  Series are
bars ``open, high, low, close, volume`` per key.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W
from .folds import Columns, Ema, Lag, Step, ordered_fold
from .indicators import TrueRange


def _ladder(x: Column, steps: list[tuple[float, int]], last: int) -> Column:
    """The state of the first step that ``x`` is below."""
    out = F.when(x < steps[0][0], steps[0][1])
    for edge, state in steps[1:]:
        out = out.when(x < edge, state)
    return out.otherwise(last)


def trend(df: DataFrame, *, keys: list[str], order: list[str]) -> DataFrame:
    """A: -2..2 by the directional index (EMA of 14) and whether returns over 1, 7 and 30 bars agree; neutral below 35 bars."""

    def make() -> Step:
        tr, hi, lo = TrueRange(), Lag(), Lag()
        means, out = [Ema(14) for _ in range(3)], Ema(14)
        lags = {n: Lag(n) for n in (1, 7, 30)}
        seen = [0]

        def step(c: Columns) -> Columns:
            n = seen[0] + 1 + np.arange(len(c["close"]))
            seen[0] += len(n)
            with np.errstate(divide="ignore", invalid="ignore"):
                up, down = np.maximum(c["high"] - hi(c["high"]), 0), np.maximum(lo(c["low"]) - c["low"], 0)
                first = np.isnan(up)
                rng = np.where(first, np.nan, tr(c))
                plus, minus = np.where(first, np.nan, np.where(up > down, up, 0.0)), np.where(first, np.nan, np.where(down > up, down, 0.0))
                a, p, m = (f(x) for f, x in zip(means, (rng, plus, minus), strict=True))
                p, m = 100 * p / (a + 1e-10), 100 * m / (a + 1e-10)
                adx = out(100 * np.abs(p - m) / (p + m + 1e-10))
                r = {k: np.log(c["close"] / lag(c["close"])) for k, lag in lags.items()}
            side = np.where(r[7] > 0, 1, -1)
            same = (np.sign(r[1]) == np.sign(r[7])) & (np.sign(r[7]) == np.sign(r[30])) & (r[1] != 0)
            state = np.where((adx > 40) & same, 2 * side, np.where(adx > 25, side, 0))
            moved = {f"ret_{k}d": x for k, x in r.items()}
            return {"adx_14": adx, "plus_di_14": p, "minus_di_14": m, **moved, "trend_state": np.where(n < 35, 0, state)}

        return step

    return ordered_fold(df, keys=keys, order=order, make=make, fields="adx_14 double, plus_di_14 double, minus_di_14 double, ret_1d double, ret_7d double, ret_30d double, trend_state int")


def garman_klass() -> Column:
    """Variance of a bar from its four prices."""
    hl, co = F.ln(F.col("high") / (F.col("low") + 1e-10)), F.ln(F.col("close") / (F.col("open") + 1e-10))
    return 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co


def volatility(df: DataFrame, *, keys: list[str], order: list[str], bars: int = 24, rank_days: int = 252) -> DataFrame:
    """B and C: level 0..3 by the rank of a day's volatility among the last days, trend -1..1 by its ratio to the week's.

    The rank is taken over whole days counted back from the bar; the array of a
    bar has ``rank_days`` numbers.
    """
    w = W.series(keys, *order)
    year = bars * 365
    mean = lambda n: F.avg("__gk").over(w.rowsBetween(-(n - 1), 0))
    rows = df.withColumn("__gk", garman_klass()).withColumn("__n", F.row_number().over(w))
    rows = rows.withColumn("rv_1d", F.sqrt(F.greatest(mean(bars), F.lit(0.0)) * year)).withColumn("rv_7d", F.sqrt(F.greatest(mean(7 * bars), F.lit(0.0)) * year)).withColumn("rv_30d", F.sqrt(F.greatest(mean(30 * bars), F.lit(0.0)) * year))
    same_hour = Window.partitionBy(*keys, F.col("__n") % bars).orderBy(*order).rowsBetween(-(rank_days - 1), 0)
    rows = rows.withColumn("__h", F.collect_list(F.when(F.col("__n") >= bars, F.col("rv_1d"))).over(same_hour))
    rank = F.when(F.size("__h") < 10, 0.5).otherwise(F.size(F.filter("__h", lambda x: x <= F.col("rv_1d"))) / F.size("__h"))
    rows = rows.withColumn("vol_pct_rank", rank).withColumn("vol_ratio", F.col("rv_1d") / (F.col("rv_7d") + 1e-10))
    enough = F.col("__n") >= 30 * bars
    level = _ladder(F.col("vol_pct_rank"), [(0.20, 0), (0.60, 1), (0.85, 2)], 3)
    way = F.when(F.col("vol_ratio") > 1.25, 1).when(F.col("vol_ratio") < 0.80, -1).otherwise(0)
    return rows.withColumn("vol_level", F.when(enough, level).otherwise(0)).withColumn("vol_trend", F.when(enough, way).otherwise(0)).drop("__gk", "__n", "__h")


def microstructure(df: DataFrame, *, keys: list[str], order: list[str], bars: int = 24) -> DataFrame:
    """E: buy or sell pressure by the mean order-flow imbalance of a day."""
    w = W.series(keys, *order)
    buy = F.col("volume") * F.greatest(F.least((F.col("close") - F.col("open")) / (F.col("high") - F.col("low") + 1e-10), F.lit(1.0)), F.lit(0.0))
    rows = df.withColumn("__ofi", (2 * buy - F.col("volume")) / (F.col("volume") + 1e-10))
    rows = rows.withColumn("ofi_24h", W.full(F.col("__ofi"), F.avg("__ofi"), w, bars))
    return rows.withColumn("flow_state", F.when(F.col("ofi_24h") > 0.15, 1).when(F.col("ofi_24h") < -0.15, -1).otherwise(0)).drop("__ofi")


def funding(df: DataFrame, *, keys: list[str], order: list[str], rate: str = "rate", interest: str = "oi", lag: int = 21) -> DataFrame:
    """F: -2..2 by the annual funding rate and the week's change of open interest."""
    w = W.series(keys, *order)
    back = F.lag(interest, lag).over(w)
    change = F.coalesce(F.when(back > 0, F.col(interest) / back - 1), F.lit(0.0))
    rows = df.withColumn("fr_ann", F.col(rate) * 3 * 365 * 100).withColumn("oi_change_7d", change)
    fr, oi = F.col("fr_ann"), F.col("oi_change_7d")
    state = F.when((fr > 30) & (oi > 0.10), 2).when(fr > 10, 1).when((fr < -15) & (oi < -0.10), -2).when(fr < -5, -1).otherwise(0)
    return rows.withColumn("funding_state", F.when(F.row_number().over(w) >= 3, state).otherwise(0))


def corwin_schultz(high: Column, low: Column, high0: Column, low0: Column, undefined: float | None = None) -> Column:
    """Bid-ask spread from two days' highs and lows; null where a price is missing, ``undefined`` where one isn't positive."""
    sq = lambda a, b: F.pow(F.ln(a / b), 2)
    k = 3 - 2 * math.sqrt(2)
    beta, gamma = sq(high, low) + sq(high0, low0), sq(F.greatest(high, high0), F.least(low, low0))
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    spread = F.greatest(2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), F.lit(0.0))
    known = low.isNotNull() & low0.isNotNull() & high.isNotNull() & high0.isNotNull()
    return F.when((low > 0) & (low0 > 0) & (high > 0) & (high0 > 0), spread).when(known, F.lit(undefined).cast("double"))


def daily_rows(df: DataFrame, *, keys: list[str], ts: str) -> DataFrame:
    """Bars of a day."""
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"), F.min_by("open", ts).alias("open"), F.sum("volume").alias("volume"), F.sum(F.col("close") * F.col("volume")).alias("dollars"))


def liquidity(days: DataFrame, *, keys: list[str], least: int = 30, undefined: float | None = None) -> DataFrame:
    """G: 0..3 by the volume's z-score over 30 days and the spread of the last five; on daily bars.

    Days whose spread a price of 0 or less leaves undefined don't count, as in
    the reference; with ``undefined`` NaN, the mean over such a day is NaN.
    """
    w = W.series(keys, "day")
    frame = w.rowsBetween(-(least - 1), 0)
    cs = corwin_schultz(F.col("high"), F.col("low"), F.lag("high").over(w), F.lag("low").over(w), undefined)
    rows = days.withColumn("__cs", cs).withColumn("cs_spread", F.coalesce(F.avg("__cs").over(w.rowsBetween(-3, 0)), F.lit(0.0)))
    rows = rows.withColumn("amihud", F.abs(F.ln(F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)))) / (F.col("dollars") + 1e-10))
    sd = F.stddev_samp("volume").over(frame)
    z = F.when(sd >= 1e-12, (F.col("volume") - F.avg("volume").over(frame)) / sd).otherwise(0.0)
    rows = rows.withColumn("vol_z", z)
    state = F.when((F.col("vol_z") > 1) & (F.col("cs_spread") < 0.002), 0).when(F.col("vol_z") > -0.5, 1).when(F.col("vol_z") > -2, 2).otherwise(3)
    return rows.withColumn("liquidity_state", F.when(F.count(F.lit(1)).over(frame) == least, state).otherwise(1)).drop("__cs")


def cross_correlation(returns: DataFrame, *, key: str, ts: str, value: str, bucket: Column) -> DataFrame:
    """H: 0..2 by the mean correlation of all pairs of series in each bucket of time."""
    rows = returns.select(key, ts, value, bucket.alias("bucket"))
    other = rows.select(F.col(key).alias("__k"), ts, F.col(value).alias("__v"))
    pairs = rows.join(other, ts).where(F.col(key) < F.col("__k")).groupBy("bucket", key, "__k").agg(F.corr(value, "__v").alias("c"))
    out = pairs.where(F.col("c").isNotNull() & ~F.isnan("c")).groupBy("bucket").agg(F.avg("c").alias("mean_corr"), F.count(F.lit(1)).alias("pairs"))
    return out.withColumn("corr_state", F.when(F.col("mean_corr") > 0.75, 2).when(F.col("mean_corr") > 0.45, 1).otherwise(0))


def participation(days: DataFrame, *, keys: list[str], least: int = 30) -> DataFrame:
    """I: 0..3 by a day's volume against the mean of 30 days; on daily bars."""
    w = W.series(keys, "day")
    frame = w.rowsBetween(-(least - 1), 0)
    rows = days.withColumn("vol_ratio_24h", F.col("volume") / (F.avg("volume").over(frame) + 1e-10)).withColumn("ret_24h", F.coalesce(F.ln(F.col("close") / F.lag("close").over(w)), F.lit(0.0)))
    r = F.col("vol_ratio_24h")
    conviction = (F.col("ret_24h") != 0) & (r > 1)
    state = F.when(r < 0.5, 0).when((r < 1.5) & conviction, 1).when((r < 3) & conviction, 2).when(r >= 3, 3).otherwise(1)
    return rows.withColumn("volume_state", F.when(F.count(F.lit(1)).over(frame) == least, state).otherwise(1))


def term_structure(df: DataFrame, *, keys: list[str], order: list[str], rate: str = "rate", per_day: int = 3) -> DataFrame:
    """J: contango or backwardation by the slope of 7- against 30-day funding."""
    w = W.series(keys, *order)
    mean = lambda days: F.avg(rate).over(w.rowsBetween(-(days * per_day - 1), 0)) * per_day * 365 * 100
    rows = df.withColumn("fr_7d_ann", mean(7)).withColumn("fr_30d_ann", mean(30))
    slope = (F.col("fr_30d_ann") - F.col("fr_7d_ann")) / (F.abs("fr_30d_ann") + 1e-6)
    rows = rows.withColumn("fr_slope", slope)
    state = F.when(F.col("fr_slope") > 0.15, 1).when(F.col("fr_slope") < -0.15, -1).otherwise(0)
    return rows.withColumn("term_state", F.when(F.row_number().over(w) >= 30 * per_day, state).otherwise(0))


def dispersion(returns: DataFrame, *, ts: str, value: str, least: int = 20) -> DataFrame:
    """K: 0..2 by the rank of the spread of returns across series among all times before."""
    by = returns.groupBy(ts).agg(F.stddev_pop(value).alias("dispersion"), F.count(value).alias("n"))
    w = Window.orderBy(ts)  # one row for each time, not for each series
    rows = by.withColumn("__h", F.collect_list("dispersion").over(w.rowsBetween(-252, -1)))
    rank = F.when(F.size("__h") > least, F.size(F.filter("__h", lambda x: x <= F.col("dispersion"))) / F.size("__h")).otherwise(0.5)
    rows = rows.withColumn("dispersion_pct_rank", rank)
    state = F.when(F.col("dispersion_pct_rank") > 0.70, 2).when(F.col("dispersion_pct_rank") > 0.30, 1).otherwise(0)
    return rows.withColumn("dispersion_state", F.when(F.col("n") < 3, 1).otherwise(state)).drop("__h")


def rv_iv(rv: Column, dvol: Column) -> Column:
    """L: cheap or dear volatility by implied less realised, in points; 0 without an implied one."""
    gap = dvol - rv
    return F.when(gap > 10, 1).when(gap < -10, -1).otherwise(0)


def serial_state(hurst: np.ndarray) -> np.ndarray:
    score = (hurst - 0.5) * 4
    return np.where(score > 1.5, 2, np.where(score > 0.4, 1, np.where(score < -1.5, -2, np.where(score < -0.4, -1, 0))))


def serial_correlation(df: DataFrame, *, keys: list[str], order: list[str], bars: int = 504, every: int = 1, slow: int = 24) -> DataFrame:
    """D: -2..2 by the Hurst exponent of the last ``bars`` prices, with the variance ratios of 4 and ``slow`` bars.

    Figures are given at every ``every``-th bar of a series that has so many
    before it; elsewhere they are null and the state is 0.
    """
    from .statistics import hurst_rs

    lags = {"vr_4": 4, "vr_24": slow}

    def make() -> Step:
        tail, seen = [np.empty(0)], [0]

        def step(c: Columns) -> Columns:
            both = np.concatenate([tail[0], np.log(c["close"] + 1e-10)])
            n = len(c["close"])
            out = {name: np.full(n, np.nan) for name in ("hurst", *lags)}
            for i in range(n):
                end = len(both) - n + i + 1
                if end >= bars and (seen[0] + i + 1) % every == 0:
                    x = both[end - bars : end]
                    out["hurst"][i] = hurst_rs(x)
                    one = np.var(np.diff(x), ddof=1)
                    for name, q in lags.items():
                        out[name][i] = np.var(x[q:] - x[:-q], ddof=1) / (q * one) if one >= 1e-15 else 1.0
            seen[0] += n
            tail[0] = both[max(0, len(both) - bars + 1) :]
            return {**out, "serial_state": serial_state(out["hurst"])}

        return step

    return ordered_fold(df, keys=keys, order=order, make=make, fields="hurst double, vr_4 double, vr_24 double, serial_state int")


#: The classes and their names.
CLASSES = {
    "A": "trend",
    "B": "vol_level",
    "C": "vol_trend",
    "D": "serial_corr",
    "E": "microstructure",
    "F": "funding_positioning",
    "G": "liquidity",
    "H": "cross_asset_corr",
    "I": "volume_participation",
    "J": "term_structure",
    "K": "dispersion",
    "L": "rv_iv_spread",
}

FIRST_DAY = 35  # the directional index needs so many days
CORRELATED_BARS = 168


def _bar_columns(df: DataFrame, keys: list[str], ts: str, bars: int) -> DataFrame:
    """Bars with their number in the series, the day they fall in (days are runs of ``bars``) and their own figures."""
    w = W.series(keys, ts)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("__day", F.ceil(F.col("__i") / bars).cast("int"))
    buy = F.col("volume") * F.greatest(F.least((F.col("close") - F.col("open")) / (F.col("high") - F.col("low") + 1e-10), F.lit(1.0)), F.lit(0.0))
    rows = rows.withColumn("__ofi", (2 * buy - F.col("volume")) / (F.col("volume") + 1e-10)).withColumn("__gk", F.nanvl(garman_klass(), F.lit(None).cast("double")))
    log = F.ln(F.col("close") + 1e-10)
    return rows.withColumn("__ret", log - F.lag(log).over(w))


def _mean_correlation(rows: DataFrame, keys: list[str], bars: int) -> DataFrame:
    """Mean, largest and smallest correlation of all pairs of series over the last week of bars, at each full day.

    Bars meet by their number.  Days are summed before they are combined, so a
    pair sends one row of moments a day, not its bars.
    """
    x = rows.select("__i", "__day", F.struct(*keys).alias("a"), F.coalesce("__ret", F.lit(0.0)).alias("x"))
    y = x.select("__i", F.col("a").alias("b"), F.col("x").alias("y"))
    m = {"n": F.lit(1), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")}
    pairs = x.join(y, "__i").where("a < b").groupBy("a", "b", "__day").agg(*(F.sum(v).alias(k) for k, v in m.items()))
    days = CORRELATED_BARS // bars
    w = Window.partitionBy("a", "b").orderBy("__day").rowsBetween(-(days - 1), 0)
    week = pairs.select("__day", *(F.sum(k).over(w).alias(k) for k in m)).where(F.col("n") == days * bars)
    n = F.col("n")
    sd = lambda s, ss: F.greatest(n * F.col(ss) - F.col(s) * F.col(s), F.lit(0.0))
    c = (n * F.col("xy") - F.col("x") * F.col("y")) / F.nullif(F.sqrt(sd("x", "xx") * sd("y", "yy")), F.lit(0.0))
    return week.select("__day", c.alias("c")).groupBy("__day").agg(F.avg("c").alias("H_mean_pairwise_corr"), F.max("c").alias("H_max_corr"), F.min("c").alias("H_min_corr"))


def _funding_days(funding_rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """F and J at every third payment, and at the last one, by the day it closes."""
    w = W.series(keys, *order)
    rows = funding(funding_rows, keys=keys, order=order).withColumnRenamed("funding_state", "__F")
    rows = term_structure(rows, keys=keys, order=order).withColumnRenamed("term_state", "__J")
    n, last = F.row_number().over(w), F.lead(F.lit(1)).over(w).isNull()
    rows = rows.withColumn("__n", n).withColumn("__last", last).where((F.col("__n") % 3 == 0) | F.col("__last"))
    return rows.select(*keys, F.ceil(F.col("__n") / 3).cast("int").alias("__day"), "__n", "__last", "__F", "__J", F.col("fr_ann").alias("F_fr_ann"), (F.col("rate") * 100).alias("F_fr_8h_pct"), F.col("oi_change_7d").alias("F_oi_change_7d"), F.col("fr_7d_ann").alias("J_fr_7d_ann"), F.col("fr_30d_ann").alias("J_fr_30d_ann"), F.col("fr_slope").alias("J_fr_slope"))


def daily_states(df: DataFrame, *, keys: list[str], ts: str, bars: int = 24, funding_rows: DataFrame | None = None, funding_order: list[str] | None = None) -> DataFrame:
    """All twelve classes with their raw figures, at the last bar of every full day from the 35th on.

    A day is a run of ``bars`` bars (a divisor of 168) counted from the start of
    a series; one that isn't full gives no row.  ``funding_rows`` holds ``rate``
    and ``oi`` per key, three to a day, in ``funding_order``; where a series'
    payments end its last ones hold.  An implied volatility may come as column
    ``dvol`` of ``df`` (the last one known by the bar).  H and K look across all
    series of ``df``, bar by bar.  A class without data is 0 and listed in
    ``missing``; K has no history here and is 1.  Null prices give null figures.
    Rows that repeat a key and a time are bars of their own, in no fixed order.
    """
    if CORRELATED_BARS % bars:
        raise ValueError(f"{bars} bars a day don't divide {CORRELATED_BARS}")
    implied = F.col("dvol").cast("double") if "dvol" in df.columns else F.lit(None).cast("double")
    rows = _bar_columns(df.select(*keys, ts, *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")), implied.alias("dvol")), keys, ts, bars)
    at = lambda c, pick=F.max_by: pick(c, "__i")
    days = rows.groupBy(*keys, "__day").agg(
        F.count(F.lit(1)).alias("__bars"), at(ts).alias(ts), F.max("high").alias("high"), F.min("low").alias("low"), at("close").alias("close"), at("close", F.min_by).alias("__first"),
        F.sum("volume").alias("volume"), F.sum(F.col("close") * F.col("volume")).alias("__dollars"), F.sum("__gk").alias("__gk"), F.count("__gk").alias("__gks"),
        F.avg("__ofi").alias("E_ofi_24h"), at("__ofi").alias("E_ofi_bar_last"), F.max_by("dvol", F.when(F.col("dvol").isNotNull(), F.col("__i"))).alias("dvol"),
    ).where(F.col("__bars") == bars)
    w = W.series(keys, "__day")
    over = lambda n: w.rowsBetween(-(n - 1), 0)
    year = bars * 365
    rv = lambda n: F.when(F.sum("__gk").over(over(n)) >= 0, F.sqrt(F.sum("__gk").over(over(n)) / F.sum("__gks").over(over(n)) * year))
    out = trend(days, keys=keys, order=["__day"])
    out = out.withColumn("rv_1d", rv(1)).withColumn("rv_7d", rv(7)).withColumn("rv_30d", rv(30)).withColumn("__h", F.collect_list("rv_1d").over(over(252)))
    share = F.coalesce(F.size(F.filter("__h", lambda x: x <= F.col("rv_1d"))), F.lit(0)) / F.size("__h")
    out = out.withColumn("vol_pct_rank", F.when(F.size("__h") < 10, 0.5).otherwise(F.when(F.col("rv_1d").isNull(), 0.0).otherwise(share))).withColumn("vol_ratio", F.col("rv_1d") / (F.col("rv_7d") + 1e-10))
    cs = corwin_schultz(F.col("high"), F.col("low"), F.lag("high").over(w), F.lag("low").over(w))
    out = out.withColumn("__cs", cs).withColumn("cs_spread", F.coalesce(F.avg("__cs").over(over(4)), F.lit(0.0))).withColumn("dvol", F.last("dvol", ignorenulls=True).over(w))
    sd, mean = F.stddev_samp("volume").over(over(30)), F.avg("volume").over(over(30))
    out = out.withColumn("vol_z", F.when(sd >= 1e-12, (F.col("volume") - mean) / sd).otherwise(0.0)).withColumn("vol_ratio_24h", F.col("volume") / (mean + 1e-10))
    out = out.withColumn("ret_24h", F.ln(F.col("close") / (F.col("__first") + 1e-10))).withColumn("amihud", F.abs("ret_24h") / (F.col("__dollars") + 1e-10))

    serial = serial_correlation(rows.select(*keys, "__i", "__day", "close"), keys=keys, order=["__i"], bars=21 * bars, every=bars, slow=bars).where(F.col("__i") % bars == 0)
    out = out.where(F.col("__day") >= FIRST_DAY).join(serial.select(*keys, "__day", "hurst", "vr_4", "vr_24", "serial_state"), [*keys, "__day"])
    across = days.groupBy("__day").agg(F.count(F.lit(1)).alias("__assets"), F.stddev_pop(F.ln(F.col("close") / (F.col("__first") + 1e-10))).alias("K_dispersion"))
    out = out.join(across, "__day").join(_mean_correlation(rows, keys, bars), "__day", "left")
    if funding_rows is None:
        none = {"__F": "int", "__J": "int", "__n": "int", **dict.fromkeys(("F_fr_ann", "F_fr_8h_pct", "F_oi_change_7d", "J_fr_7d_ann", "J_fr_30d_ann", "J_fr_slope"), "double")}
        out = out.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in none.items()))
    else:
        f = _funding_days(funding_rows, keys, funding_order or [ts])
        facts = [c for c in f.columns if c not in (*keys, "__day", "__last")]
        ends = f.where("__last").select(*keys, F.col("__day").alias("__end"), F.struct(*facts).alias("__held"))
        out = out.join(f.where("not __last or __n % 3 = 0").select(*keys, "__day", F.struct(*facts).alias("__now")), [*keys, "__day"], "left").join(ends, keys, "left")
        both = F.coalesce("__now", F.when(F.col("__day") >= F.col("__end"), F.col("__held")))
        out = out.withColumn("__paid", both).select("*", *(F.col(f"__paid.{c}").alias(c) for c in facts))
    paid = F.coalesce(F.col("__n"), F.lit(0))
    r = F.col("vol_ratio_24h")
    sure = (F.col("ret_24h") != 0) & (r > 1)
    gap = F.when(F.col("rv_1d").isNotNull(), F.col("dvol") - F.col("rv_1d"))
    states = {
        "A": F.col("trend_state"),
        "B": _ladder(F.col("vol_pct_rank"), [(0.20, 0), (0.60, 1), (0.85, 2)], 3),
        "C": F.when(F.col("vol_ratio") > 1.25, 1).when(F.col("vol_ratio") < 0.80, -1).otherwise(0),
        "D": F.col("serial_state"),
        "E": F.when(F.col("E_ofi_24h") > 0.15, 1).when(F.col("E_ofi_24h") < -0.15, -1).otherwise(0),
        "F": F.coalesce("__F", F.lit(0)),
        "G": F.when((F.col("vol_z") > 1) & (F.col("cs_spread") < 0.002), 0).when(F.col("vol_z") > -0.5, 1).when(F.col("vol_z") > -2, 2).otherwise(3),
        "H": F.when(F.col("H_mean_pairwise_corr") > 0.75, 2).when(F.col("H_mean_pairwise_corr") > 0.45, 1).otherwise(0),
        "I": F.when(r < 0.5, 0).when((r < 1.5) & sure, 1).when((r < 3) & sure, 2).when(r >= 3, 3).otherwise(1),
        "J": F.coalesce("__J", F.lit(0)),
        "K": F.when(F.col("__assets") >= 3, 1).otherwise(0),
        "L": F.when(gap > 10, 1).when(gap < -10, -1).otherwise(0),
    }
    raw = {
        "A": ["adx_14", "plus_di_14", "minus_di_14", "ret_1d", "ret_7d", "ret_30d"],
        "BC": ["rv_1d", "rv_7d", "rv_30d", "vol_pct_rank", "vol_ratio"],
        "D": ["hurst", "vr_4", "vr_24"],
        "G": ["cs_spread", "vol_z"],
        "I": ["vol_ratio_24h", "ret_24h"],
    }
    missing = {"F": paid < 3, "J": paid < 90, "H": F.col("__assets") < 2, "K": F.col("__assets") < 3}
    enough = F.col("__assets") >= 3
    return out.select(
        *keys, ts, *(states[c].cast("double").alias(f"regime_{name}") for c, name in CLASSES.items()),
        *(F.col(c).alias(f"{k}_{c}") for k, names in raw.items() for c in names),
        ((F.col("hurst") - 0.5) * 4).alias("D_serial_score"), "E_ofi_24h", "E_ofi_bar_last", F.col("amihud").alias("E_amihud"), "F_fr_ann", "F_fr_8h_pct", "F_oi_change_7d",
        F.col("amihud").alias("G_amihud_ratio"), F.col("vol_z").alias("G_liq_score"), "H_mean_pairwise_corr", "H_max_corr", "H_min_corr", F.col("__assets").cast("double").alias("H_n_assets"),
        sure.cast("double").alias("I_conviction"), "J_fr_7d_ann", "J_fr_30d_ann", "J_fr_slope", F.when(enough, F.col("K_dispersion")).alias("K_dispersion"), F.when(enough, 0.5).alias("K_dispersion_pct_rank"),
        F.col("rv_1d").alias("L_rv_current"), F.col("dvol").alias("L_dvol"), gap.alias("L_vrp"),
        F.array_compact(F.array(*(F.when(x, c) for c, x in missing.items()))).alias("missing"),
    )


def snapshot(df: DataFrame, *, keys: list[str], ts: str, bars: int = 24) -> DataFrame:
    """All states of the hourly classes at each bar, with those of its day before."""
    o = {"keys": keys, "order": [ts]}
    rows = microstructure(volatility(trend(df, **o), **o, bars=bars), **o, bars=bars)
    days = daily_rows(df, keys=keys, ts=ts)
    slow = liquidity(days, keys=keys).join(participation(days, keys=keys).select(*keys, "day", "volume_state"), [*keys, "day"])
    slow = slow.select(*keys, F.date_add("day", 1).alias("__day"), "liquidity_state", "volume_state")
    out = rows.withColumn("__day", F.to_date(ts)).join(slow, [*keys, "__day"], "left").drop("__day")
    return out.withColumn("liquidity_state", F.coalesce("liquidity_state", F.lit(1))).withColumn("volume_state", F.coalesce("volume_state", F.lit(1)))
