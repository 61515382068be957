"""Indicators, signals, sizing and back-tests as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest, indicators, labels, signals, windows
from .base import BARS, DAILY, bars, daily, query

K = {"keys": ["asset"], "order": ["ts"]}
_NUM = f"{BARS}, b AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i, lag(close) OVER (PARTITION BY asset ORDER BY ts) AS pc, lag(high) OVER (PARTITION BY asset ORDER BY ts) AS ph, lag(low) OVER (PARTITION BY asset ORDER BY ts) AS pl FROM bars)"


def rec(name: str, source: str, seed: dict[str, str], step: dict[str, str], seed_at: str = "i = 0") -> str:
    """A recursive fold over numbered rows: ``s`` is the row, ``e`` the state before."""
    return f"{name} AS (SELECT asset, ts, i, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in seed.items())} FROM {source} s WHERE {seed_at} UNION ALL SELECT s.asset, s.ts, s.i, {', '.join(f'({v})::DOUBLE' for v in step.values())} FROM {name} e JOIN {source} s ON s.asset = e.asset AND s.i = e.i + 1)"


def ema_step(state: str, x: str, alpha: float) -> str:
    return f"{alpha!r}::DOUBLE * ({x}) + {1 - alpha!r}::DOUBLE * e.{state}"


def rma(name: str, source: str, column: str, n: int) -> list[str]:
    seeds = f"{name}_s AS (SELECT asset, avg({column}) AS seed FROM {source} WHERE i < {n} GROUP BY 1)"
    joined = f"{name}_j AS (SELECT s.*, seed FROM {source} s JOIN {name}_s USING (asset))"
    return [seeds, joined, rec(name, f"{name}_j", {"y": "s.seed"}, {"y": ema_step("y", f"s.{column}", 1 / n)}, f"i = {n - 1}")]


A = 2 / 21
@query("ema", f"WITH RECURSIVE {_NUM}, {rec('f', 'b', {'y': 's.close'}, {'y': ema_step('y', 's.close', A)})} SELECT asset, ts, round(y, 6) AS ema FROM f")
def _(spark, sf):
    return indicators.ema(bars(spark, sf), **K, value="close", span=20).select("asset", "ts", F.round("ema", 6).alias("ema"))


@query("ema_adjusted", f"WITH RECURSIVE {_NUM}, {rec('f', 'b', {'n': 's.close', 'd': '1'}, {'n': f's.close + {1 - A!r}::DOUBLE * e.n', 'd': f'1 + {1 - A!r}::DOUBLE * e.d'})} SELECT asset, ts, round(n / d, 6) AS ema FROM f")
def _(spark, sf):
    return indicators.ema(bars(spark, sf), **K, value="close", span=20, adjusted=True).select("asset", "ts", F.round("ema", 6).alias("ema"))


_DIFF = "(s.close - e.m)"
@query("ewm_std", f"WITH RECURSIVE {_NUM}, {rec('f', 'b', {'m': 's.close', 'v': '0', 'w': '1'}, {'m': ema_step('m', 's.close', A), 'v': f'{1 - A!r}::DOUBLE * (e.v + {A!r}::DOUBLE * {_DIFF} * {_DIFF})', 'w': f'{(1 - A) ** 2!r}::DOUBLE * e.w + {A * A!r}::DOUBLE'})} SELECT asset, ts, round(CASE WHEN 1 - w > 1e-15 AND v > 0 THEN sqrt(v / (1 - w)) ELSE 0 END, 6) AS ewm_std FROM f")
def _(spark, sf):
    return indicators.ewm_std(bars(spark, sf), **K, value="close", span=20).select("asset", "ts", F.round("ewm_std", 6).alias("ewm_std"))


@query("rma", f"WITH RECURSIVE {_NUM}, {', '.join(rma('f', 'b', 'close', 14))} SELECT b.asset, b.ts, round(f.y, 6) AS rma FROM b LEFT JOIN f USING (asset, i)")
def _(spark, sf):
    return indicators.rma(bars(spark, sf), **K, value="close", n=14).select("asset", "ts", F.round("rma", 6).alias("rma"))


@query("dema", f"WITH RECURSIVE {_NUM}, {rec('f', 'b', {'y': 's.close', 'z': 's.close'}, {'y': ema_step('y', 's.close', A), 'z': ema_step('z', ema_step('y', 's.close', A), A)})} SELECT asset, ts, round(2 * y - z, 6) AS dema FROM f")
def _(spark, sf):
    return indicators.dema(bars(spark, sf), **K, value="close", span=20).select("asset", "ts", F.round("dema", 6).alias("dema"))


@query("hull", f"WITH {BARS}, h AS (SELECT asset, ts, 2 * avg(close) OVER (PARTITION BY asset ORDER BY ts ROWS 6 PRECEDING) - avg(close) OVER (PARTITION BY asset ORDER BY ts ROWS 14 PRECEDING) AS d FROM bars) SELECT asset, ts, round(avg(d) OVER (PARTITION BY asset ORDER BY ts ROWS 2 PRECEDING), 6) AS hull FROM h")
def _(spark, sf):
    return indicators.hull(bars(spark, sf), **K, value="close", n=15).select("asset", "ts", F.round("hull", 6).alias("hull"))


@query("macd", f"WITH RECURSIVE {_NUM}, {rec('f', 'b', {'x': 's.close', 'y': 's.close', 'g': '0'}, {'x': ema_step('x', 's.close', 2 / 13), 'y': ema_step('y', 's.close', 2 / 27), 'g': ema_step('g', f'({ema_step("x", "s.close", 2 / 13)}) - ({ema_step("y", "s.close", 2 / 27)})', 2 / 10)})} SELECT asset, ts, round(x - y, 6) + 0.0 AS macd, round(g, 6) + 0.0 AS macd_signal FROM f")
def _(spark, sf):
    return indicators.macd(bars(spark, sf), **K).select("asset", "ts", (F.round("macd", 6) + 0.0).alias("macd"), (F.round("macd_signal", 6) + 0.0).alias("macd_signal"))


@query("force_index", f"WITH RECURSIVE {_NUM}, r AS (SELECT *, coalesce((close - pc) * volume, 0) AS raw FROM b), {rec('f', 'r', {'y': 's.raw'}, {'y': ema_step('y', 's.raw', 2 / 14)})} SELECT asset, ts, round(y, 5) + 0.0 AS force_index FROM f")
def _(spark, sf):
    return indicators.force_index(bars(spark, sf), **K, span=13).select("asset", "ts", (F.round("force_index", 5) + 0.0).alias("force_index"))


_TR = f"{_NUM}, r AS (SELECT *, greatest(high - low, abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close))) AS tr FROM b)"
@query("atr_rma", f"WITH RECURSIVE {_TR}, {', '.join(rma('f', 'r', 'tr', 14))} SELECT r.asset, r.ts, round(f.y, 6) AS atr FROM r LEFT JOIN f USING (asset, i)")
def _(spark, sf):
    return indicators.atr(bars(spark, sf), **K, n=14).select("asset", "ts", F.round("atr", 6).alias("atr"))


@query("atr_span", f"WITH RECURSIVE {_TR}, {rec('f', 'r', {'y': 's.tr'}, {'y': ema_step('y', 's.tr', 2 / 15)})} SELECT asset, ts, round(y, 6) AS atr FROM f")
def _(spark, sf):
    return indicators.atr(bars(spark, sf), **K, n=14, smoothing="span").select("asset", "ts", F.round("atr", 6).alias("atr"))


@query("adx", f"WITH RECURSIVE {_TR}, d AS (SELECT *, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dn FROM r), {', '.join(rma('ft', 'd', 'tr', 14) + rma('fu', 'd', 'up', 14) + rma('fd', 'd', 'dn', 14))}, x AS (SELECT d.asset, d.ts, d.i, CASE WHEN ft.y > 0 THEN fu.y / ft.y * 100 ELSE 0 END AS p, CASE WHEN ft.y > 0 THEN fd.y / ft.y * 100 ELSE 0 END AS m FROM d LEFT JOIN ft USING (asset, i) LEFT JOIN fu USING (asset, i) LEFT JOIN fd USING (asset, i)), dx AS (SELECT asset, ts, i, CASE WHEN p + m > 0 THEN abs(p - m) / (p + m) * 100 ELSE 0 END AS v FROM x), {', '.join(rma('o', 'dx', 'v', 14))} SELECT dx.asset, dx.ts, round(o.y, 5) AS adx FROM dx LEFT JOIN o USING (asset, i)")
def _(spark, sf):
    return indicators.adx(bars(spark, sf), **K, n=14).select("asset", "ts", F.round("adx", 5).alias("adx"))


_GL = f"{_NUM}, r AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS g, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS l FROM b)"
@query("rsi_wilder", f"WITH RECURSIVE {_GL}, {rec('f', 'r', {'u': 's.g', 'd': 's.l'}, {'u': ema_step('u', 's.g', 1 / 14), 'd': ema_step('d', 's.l', 1 / 14)}, 'i = 1')} SELECT r.asset, r.ts, round(CASE WHEN d > 0 THEN 100 - 100 / (1 + u / d) END, 6) AS rsi FROM r LEFT JOIN f USING (asset, i)")
def _(spark, sf):
    return indicators.rsi(bars(spark, sf), **K, n=14).select("asset", "ts", F.round("rsi", 6).alias("rsi"))


@query("rsi_span", f"WITH RECURSIVE {_GL}, {rec('f', 'r', {'u': '0', 'd': '0'}, {'u': ema_step('u', 's.g', 2 / 15), 'd': ema_step('d', 's.l', 2 / 15)})} SELECT asset, ts, round(100 - 100 / (1 + u / (d + 1e-10)), 5) AS rsi FROM f")
def _(spark, sf):
    return indicators.rsi(bars(spark, sf), **K, n=14, smoothing="span").select("asset", "ts", F.round("rsi", 5).alias("rsi"))


@query("rsi_simple", f"WITH {_GL} SELECT asset, ts, CASE WHEN count(g) OVER w = 14 THEN round(CASE WHEN avg(l) OVER w = 0 THEN 100 ELSE 100 - 100 / (1 + avg(g) OVER w / avg(l) OVER w) END, 5) END AS rsi FROM r WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 13 PRECEDING)")
def _(spark, sf):
    return indicators.rsi(bars(spark, sf), **K, n=14, smoothing="simple").select("asset", "ts", F.round("rsi", 5).alias("rsi"))


_W = lambda n: f"WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS {n - 1} PRECEDING)"


@query("zscore", f"WITH {BARS} SELECT asset, ts, CASE WHEN count(*) OVER w = 20 THEN round((close - avg(close) OVER w) / stddev_samp(close) OVER w, 6) END AS z FROM bars {_W(20)}")
def _(spark, sf):
    return bars(spark, sf).select("asset", "ts", F.round(indicators.zscore("close", windows.series(["asset"], "ts"), 20), 6).alias("z"))


@query("mfi", f"WITH {BARS}, t AS (SELECT asset, ts, volume, (high + low + close) / 3 AS t, lag((high + low + close) / 3) OVER (PARTITION BY asset ORDER BY ts) AS p FROM bars), f AS (SELECT asset, ts, p, CASE WHEN t > p THEN t * volume ELSE 0 END AS u, CASE WHEN t < p THEN t * volume ELSE 0 END AS d FROM t) SELECT asset, ts, CASE WHEN count(p) OVER w = 14 THEN round(CASE WHEN sum(d) OVER w = 0 THEN 100 ELSE 100 - 100 / (1 + sum(u) OVER w / sum(d) OVER w) END, 6) END AS mfi FROM f {_W(14)}")
def _(spark, sf):
    return indicators.mfi(bars(spark, sf), windows.series(["asset"], "ts"), 14).select("asset", "ts", F.round("mfi", 6).alias("mfi"))


@query("donchian_width", f"WITH {BARS} SELECT asset, ts, CASE WHEN count(*) OVER w = 20 THEN round((max(high) OVER w - min(low) OVER w) / ((max(high) OVER w + min(low) OVER w) / 2), 6) END AS width FROM bars {_W(20)}")
def _(spark, sf):
    return bars(spark, sf).select("asset", "ts", F.round(indicators.donchian_width(windows.series(["asset"], "ts"), 20), 6).alias("width"))


@query("awesome_oscillator", f"WITH {BARS}, m AS (SELECT asset, ts, (high + low) / 2 AS m FROM bars) SELECT asset, ts, CASE WHEN count(*) OVER s = 34 THEN round(avg(m) OVER f - avg(m) OVER s, 6) END AS ao FROM m WINDOW f AS (PARTITION BY asset ORDER BY ts ROWS 4 PRECEDING), s AS (PARTITION BY asset ORDER BY ts ROWS 33 PRECEDING)")
def _(spark, sf):
    return indicators.awesome_oscillator(bars(spark, sf), windows.series(["asset"], "ts")).select("asset", "ts", F.round("ao", 6).alias("ao"))


@query("bollinger", f"WITH {BARS} SELECT asset, ts, CASE WHEN count(*) OVER w = 20 THEN round(avg(close) OVER w + 2 * stddev_samp(close) OVER w, 6) END AS upper, CASE WHEN count(*) OVER w = 20 THEN round(avg(close) OVER w - 2 * stddev_samp(close) OVER w, 6) END AS lower, CASE WHEN count(*) OVER w = 20 THEN round(4 * stddev_samp(close) OVER w / avg(close) OVER w, 6) END AS bandwidth FROM bars {_W(20)}")
def _(spark, sf):
    up, _, low, width = indicators.bollinger("close", windows.series(["asset"], "ts"), 20, 2.0)
    return bars(spark, sf).select("asset", "ts", F.round(up, 6).alias("upper"), F.round(low, 6).alias("lower"), F.round(width, 6).alias("bandwidth"))


@query("stochastic", f"WITH {BARS}, k AS (SELECT asset, ts, CASE WHEN count(*) OVER w = 14 THEN 100 * (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w + 1e-10) END AS k FROM bars {_W(14)}) SELECT asset, ts, round(k, 6) AS stoch_k, CASE WHEN k IS NOT NULL THEN round(avg(k) OVER w, 6) END AS stoch_d FROM k {_W(3)}")
def _(spark, sf):
    return indicators.stochastic(bars(spark, sf), windows.series(["asset"], "ts"), 14, 3).select("asset", "ts", F.round("stoch_k", 6).alias("stoch_k"), F.round("stoch_d", 6).alias("stoch_d"))


@query("vwap", f"WITH {BARS} SELECT asset, ts, round(sum(close * volume) OVER w / (sum(volume) OVER w + 1e-10), 6) AS vwap FROM bars {_W(20)}")
def _(spark, sf):
    return bars(spark, sf).select("asset", "ts", F.round(indicators.vwap(windows.series(["asset"], "ts"), 20), 6).alias("vwap"))


_WT = [
    rec("f", "t0", {"m": "s.t", "d": "0"}, {"m": ema_step("m", "s.t", 2 / 11), "d": ema_step("d", f"abs(s.t - ({ema_step('m', 's.t', 2 / 11)}))", 2 / 11)}),
    "ci AS (SELECT t0.asset, t0.ts, t0.i, (t0.t - f.m) / (0.015::DOUBLE * f.d) AS c FROM t0 JOIN f USING (asset, i) WHERE t0.i > 0)",
    rec("wv", "ci", {"y": "s.c"}, {"y": ema_step("y", "s.c", 2 / 22)}, "i = 1"),
]
@query("wavetrend", f"WITH RECURSIVE {_NUM}, t0 AS (SELECT asset, ts, i, (high + low + close) / 3 AS t FROM b), {', '.join(_WT)} SELECT asset, ts, round(y, 5) + 0.0 AS wt1, CASE WHEN count(*) OVER w = 4 THEN round(avg(y) OVER w, 5) + 0.0 END AS wt2 FROM wv {_W(4)}")
def _(spark, sf):
    c = indicators.cipher(bars(spark, sf), **K)
    return c.where("wt1 IS NOT NULL").select("asset", "ts", (F.round("wt1", 5) + 0.0).alias("wt1"), (F.round("wt2", 5) + 0.0).alias("wt2"))


@query("cipher_dots")
def _(spark, sf):
    c = indicators.cipher(bars(spark, sf), **K)
    return c.groupBy("asset").agg(*(F.count_if(x).alias(x) for x in ("wt_cross_up", "wt_cross_down", "buy_dot", "sell_dot", "gold_dot")))


_CROSS = lambda a, b: f"CASE WHEN {a} > {b} THEN 1 WHEN {a} < {b} THEN -1 ELSE 0 END"
_SMA = f"{BARS}, sg AS (SELECT *, {_CROSS('CASE WHEN count(*) OVER f = 3 THEN avg(close) OVER f END', 'CASE WHEN count(*) OVER s = 8 THEN avg(close) OVER s END')} AS signal FROM bars WINDOW f AS (PARTITION BY asset ORDER BY ts ROWS 2 PRECEDING), s AS (PARTITION BY asset ORDER BY ts ROWS 7 PRECEDING))"


@query("signal_sma_crossover", f"WITH {_SMA} SELECT asset, ts, signal FROM sg")
def _(spark, sf):
    return signals.sma_crossover(bars(spark, sf), **K, fast=3, slow=8).select("asset", "ts", "signal")


@query("signal_ema_crossover", f"WITH RECURSIVE {_NUM}, {rec('f', 'b', {'n': 's.close', 'd': '1', 'o': 's.close', 'q': '1'}, {'n': f's.close + {1 - 2 / 13!r}::DOUBLE * e.n', 'd': f'1 + {1 - 2 / 13!r}::DOUBLE * e.d', 'o': f's.close + {1 - 2 / 27!r}::DOUBLE * e.o', 'q': f'1 + {1 - 2 / 27!r}::DOUBLE * e.q'})} SELECT asset, ts, CASE WHEN i = 0 THEN 0 WHEN n / d > o / q THEN 1 WHEN n / d < o / q THEN -1 ELSE 0 END AS signal FROM f")
def _(spark, sf):
    return signals.ema_crossover(bars(spark, sf), **K).select("asset", "ts", "signal")


@query("signal_bollinger", f"WITH {BARS}, z AS (SELECT asset, ts, CASE WHEN count(*) OVER w = 20 THEN (close - avg(close) OVER w) / stddev_samp(close) OVER w END AS z FROM bars {_W(20)}) SELECT asset, ts, CASE WHEN z < -1.5 THEN 1 WHEN z > 1.5 THEN -1 ELSE 0 END AS signal FROM z")
def _(spark, sf):
    return signals.bollinger_reversion(bars(spark, sf), **K, threshold=1.5).select("asset", "ts", "signal")


@query("signal_price_above_mean", f"WITH {BARS} SELECT asset, ts, CASE WHEN count(*) OVER w < 20 THEN 0 WHEN close > avg(close) OVER w THEN 1 WHEN close < avg(close) OVER w THEN -1 ELSE 0 END AS signal FROM bars {_W(20)}")
def _(spark, sf):
    return signals.price_above_mean(bars(spark, sf), **K).select("asset", "ts", "signal")


_PAIR = "p0 AS (SELECT a.day AS ts, 'P' AS asset, a.price AS ca, b.price AS cb, row_number() OVER (ORDER BY a.day) - 1 AS i, a.price - 0.8::DOUBLE * b.price AS x FROM daily a JOIN daily b USING (day) WHERE a.asset = '1-URGENT' AND b.asset = '5-LOW')"
_PZ = f"{DAILY}, {_PAIR}, " + rec("f", "p0", {"m": "s.x", "v": "0", "w": "1"}, {"m": ema_step("m", "s.x", 2 / 61), "v": f"{1 - 2 / 61!r}::DOUBLE * (e.v + {2 / 61!r}::DOUBLE * (s.x - e.m) * (s.x - e.m))", "w": f"{(1 - 2 / 61) ** 2!r}::DOUBLE * e.w + {(2 / 61) ** 2!r}::DOUBLE"}) + ", z AS (SELECT asset, ts, i, CASE WHEN 1 - w > 1e-15 AND v > 0 THEN (x - m) / sqrt(v / (1 - w)) ELSE 0 END AS z FROM f JOIN p0 USING (asset, ts, i))"
_CARRY = ", c AS (SELECT *, last_value(CASE WHEN z <= -1 THEN 1 WHEN z >= 0.6 THEN 0 END IGNORE NULLS) OVER (ORDER BY i) AS lg, last_value(CASE WHEN z >= 1 THEN -1 WHEN z <= -0.6 THEN 0 END IGNORE NULLS) OVER (ORDER BY i) AS sh FROM z)"


def _pair(spark, sf):
    d = daily(spark, sf)
    a, b = d.where("asset = '1-URGENT'").select("day", F.col("price").alias("close_a")), d.where("asset = '5-LOW'").select("day", F.col("price").alias("close_b"))
    return a.join(b, "day").select(F.lit("P").alias("asset"), F.col("day").alias("ts"), "close_a", "close_b")


@query("signal_spread_zscore", f"WITH RECURSIVE {_PZ}{_CARRY} SELECT ts AS day, round(z, 5) + 0.0 AS zscore, (coalesce(lg, 0) + coalesce(sh, 0))::INTEGER AS signal FROM c")
def _(spark, sf):
    s = signals.spread_zscore(_pair(spark, sf), **K, weight=0.8, lookback=60, entry=1.0)
    return s.select(F.col("ts").alias("day"), (F.round("zscore", 5) + 0.0).alias("zscore"), "signal")


@query("signal_spread_stateless", f"WITH RECURSIVE {_PZ} SELECT ts AS day, (CASE WHEN z >= 0.6 THEN 0 WHEN z <= -1 THEN 1 ELSE 0 END + CASE WHEN z <= -0.6 THEN 0 WHEN z >= 1 THEN -1 ELSE 0 END)::INTEGER AS signal FROM z")
def _(spark, sf):
    return signals.spread_zscore(_pair(spark, sf), **K, weight=0.8, lookback=60, entry=1.0, carry=False).select(F.col("ts").alias("day"), "signal")


@query("single_leg_pnl", f"WITH RECURSIVE {_PZ}, g AS (SELECT z.i, ca, ca * 0.999::DOUBLE AS oa, (CASE WHEN z >= 0.6 THEN 0 WHEN z <= -1 THEN 1 ELSE 0 END + CASE WHEN z <= -0.6 THEN 0 WHEN z >= 1 THEN -1 ELSE 0 END) AS s FROM z JOIN p0 USING (i)), q AS (SELECT i, s, coalesce(lag(s) OVER (ORDER BY i), 0) AS b, (ca - oa) / oa AS r FROM g), p AS (SELECT i, s, b, b * r - abs(s - b) * 0.0005::DOUBLE AS pnl FROM q) SELECT round(sum(pnl) FILTER (WHERE i > 0) - CASE WHEN arg_max(s, i) <> 0 THEN 0.0005 ELSE 0 END, 8) AS daily_return, round(sqrt(98280::DOUBLE) * avg(pnl) FILTER (WHERE i > 0) / stddev_pop(pnl) FILTER (WHERE i > 0), 4) AS sharpe, count(*) FILTER (WHERE s <> b AND s <> 0) AS num_trades FROM p")
def _(spark, sf):
    s = signals.spread_zscore(_pair(spark, sf), **K, weight=0.8, lookback=60, entry=1.0, carry=False).withColumn("open_a", F.col("close_a") * 0.999)
    return backtest.single_leg(s, **K).select(F.round("daily_return", 8).alias("daily_return"), F.round("sharpe", 4).alias("sharpe"), "num_trades")


def _ta(kind):
    @query(f"ta_signal_{kind.lower()}")
    def _(spark, sf):
        s = signals.ta_signal(bars(spark, sf), kind, **K, period=14, low=30.0 if kind in ("RSI", "STOCH") else 20.0, high=70.0 if kind in ("RSI", "STOCH") else 20.0)
        return s.groupBy("asset").agg(F.count_if(F.col("signal") == 1).alias("buys"), F.count_if(F.col("signal") == -1).alias("sells"))


for _kind in ("RSI", "MACD", "EMA_CROSS", "STOCH", "ATR_BREAK"):
    _ta(_kind)


@query("ta_signal_boll", f"WITH {BARS} SELECT asset, ts, CASE WHEN count(*) OVER w < 14 THEN 0 WHEN close < avg(close) OVER w - 2 * stddev_samp(close) OVER w THEN 1 WHEN close > avg(close) OVER w + 2 * stddev_samp(close) OVER w THEN -1 ELSE 0 END AS signal FROM bars {_W(14)}")
def _(spark, sf):
    return signals.ta_signal(bars(spark, sf), "BOLL", **K, period=14).select("asset", "ts", "signal")


@query("ta_signal_vol_break", f"WITH {BARS} SELECT asset, ts, CASE WHEN row_number() OVER (PARTITION BY asset ORDER BY ts) = 1 THEN 0 WHEN volume / avg(volume) OVER w > 2 THEN CASE WHEN close > avg(close) OVER w THEN 1 ELSE -1 END ELSE 0 END AS signal FROM bars {_W(14)}")
def _(spark, sf):
    return signals.ta_signal(bars(spark, sf), "VOL_BREAK", **K, period=14).select("asset", "ts", "signal")


@query("ta_signal_vwap_rev", f"WITH {BARS}, v AS (SELECT *, sum(close * volume) OVER w / (sum(volume) OVER w + 1e-10) AS vw, row_number() OVER (PARTITION BY asset ORDER BY ts) AS n FROM bars {_W(14)}) SELECT asset, ts, CASE WHEN n = 1 THEN 0 WHEN (close - vw) / vw * 100 < -20 THEN 1 WHEN (close - vw) / vw * 100 > 20 THEN -1 ELSE 0 END AS signal FROM v")
def _(spark, sf):
    return signals.ta_signal(bars(spark, sf), "VWAP_REV", **K, period=14, low=20.0, high=20.0).select("asset", "ts", "signal")


@query("momentum_panel")
def _(spark, sf):
    m = signals.momentum_panel(bars(spark, sf), **K)
    return m.groupBy("asset").agg(*(F.round(F.sum(c), 6).alias(c) for c in ("volume_spike", "velocity", "consecutive", "breakout", "flow_imbalance")), F.count_if("actionable").alias("actionable"))


@query("cross_sectional_momentum", f"WITH {DAILY}, m AS (SELECT asset, day, (price / lag(price, 5) OVER w - 1 + price / lag(price, 20) OVER w - 1) / 2 AS score FROM daily WINDOW w AS (PARTITION BY asset ORDER BY day)) SELECT asset, day, round(score, 6) AS score, CASE WHEN row_number() OVER (PARTITION BY day ORDER BY score DESC, asset) <= 1 THEN 1.0 WHEN row_number() OVER (PARTITION BY day ORDER BY score, asset DESC) <= 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS weight FROM m WHERE score IS NOT NULL")
def _(spark, sf):
    return signals.cross_sectional_momentum(daily(spark, sf), key="asset", day="day", value="price").select("asset", "day", F.round("score", 6).alias("score"), "weight")


@query("mfi_momentum_events")
def _(spark, sf):
    c = indicators.cipher(bars(spark, sf), **K)
    return c.withColumn("signal", signals.mfi_momentum(windows.series(["asset"], "ts"))).groupBy("asset", "signal").count()


@query("anchor_trigger_events")
def _(spark, sf):
    c = indicators.cipher(bars(spark, sf), **K)
    return signals.anchor_trigger(c, **K, anchor=-20.0, trigger=0.0).where("event <> ''").groupBy("asset", "event").count()


@query("cooldown_pair_actions")
def _(spark, sf):
    s = signals.spread_zscore(_pair(spark, sf), **K, weight=0.8, lookback=60, entry=1.0)
    return signals.cooldown_pairs(s, **K, z="zscore").groupBy("action").count()


_VT = f"{_SMA}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY asset ORDER BY ts) - 1 AS r FROM sg), v AS (SELECT *, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w * sqrt(252::DOUBLE) END AS vol FROM r WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"


@query("size_fixed_fraction", f"WITH {_SMA} SELECT asset, ts, signal * 0.25::DOUBLE AS position FROM sg")
def _(spark, sf):
    return signals.sma_crossover(bars(spark, sf), **K, fast=3, slow=8).select("asset", "ts", backtest.fixed_fraction(F.col("signal"), 0.25).alias("position"))


@query("size_volatility_target", f"WITH {_VT} SELECT asset, ts, round(signal * CASE WHEN vol > 0 THEN least(0.15::DOUBLE / vol, 3) ELSE 1 END, 8) + 0.0 AS position FROM v")
def _(spark, sf):
    s = signals.sma_crossover(bars(spark, sf), **K, fast=3, slow=8)
    return backtest.volatility_target(s, **K).select("asset", "ts", (F.round("position", 8) + 0.0).alias("position"))


_BT = f"{_SMA}, s1 AS (SELECT asset, ts, close + 100 AS close, signal FROM sg), r AS (SELECT asset, ts, close, signal, row_number() OVER w - 1 AS i, coalesce(0.5::DOUBLE * lag(signal) OVER w * (close / lag(close) OVER w - 1), 0) AS ret, coalesce(0.5::DOUBLE * signal * (lead(close) OVER w / close - 1), 0) AS fwd, lead(close) OVER w AS nx FROM s1 WINDOW w AS (PARTITION BY asset ORDER BY ts)), eq AS (SELECT *, exp(sum(ln(abs(1 + ret))) OVER (PARTITION BY asset ORDER BY ts)) * CASE WHEN sum((1 + ret < 0)::INTEGER) OVER (PARTITION BY asset ORDER BY ts) % 2 = 1 THEN -1 ELSE 1 END AS equity FROM r)"
_TRADES = ", nw AS (SELECT *, CASE WHEN signal = lag(signal) OVER (PARTITION BY asset ORDER BY ts) THEN 0 ELSE 1 END AS nw FROM r), rn AS (SELECT *, sum(nw) OVER (PARTITION BY asset ORDER BY ts) AS run FROM nw), tr AS (SELECT asset, run, min(i) AS entry_bar, max(i) + CASE WHEN arg_max(coalesce(nx, -1), i) >= 0 THEN 1 ELSE 0 END AS exit_bar, any_value(signal) AS direction, arg_min(close, i) AS entry_price, sum(fwd) AS return_pct FROM rn WHERE signal <> 0 GROUP BY 1, 2)"


def _backtest(spark, sf):
    s = signals.sma_crossover(bars(spark, sf), **K, fast=3, slow=8).withColumn("position", F.col("signal") * 0.5).withColumn("close", F.col("close") + 100)
    return backtest.vectorised(s, **K), backtest.trades(s, **K)


@query("backtest_vectorised", f"WITH {_BT} SELECT asset, ts, round(ret, 8) + 0.0 AS ret, round(equity, 8) + 0.0 AS equity FROM eq")
def _(spark, sf):
    return _backtest(spark, sf)[0].select("asset", "ts", (F.round("ret", 8) + 0.0).alias("ret"), (F.round("equity", 8) + 0.0).alias("equity"))


@query("backtest_trades", f"WITH {_BT}{_TRADES} SELECT asset, entry_bar::INTEGER AS entry_bar, exit_bar::INTEGER AS exit_bar, direction, entry_price, round(return_pct, 8) + 0.0 AS return_pct FROM tr")
def _(spark, sf):
    return _backtest(spark, sf)[1].select("asset", "entry_bar", "exit_bar", "direction", "entry_price", (F.round("return_pct", 8) + 0.0).alias("return_pct"))


_METRICS = f"WITH {_BT}{_TRADES}, s AS (SELECT asset, arg_max(equity, i) / arg_min(equity, i) - 1 AS total_return, avg(ret) FILTER (WHERE i > 0) AS m, stddev_samp(ret) FILTER (WHERE i > 0) AS sd, stddev_samp(ret) FILTER (WHERE i > 0 AND ret < 0) AS dd FROM eq GROUP BY 1), dr AS (SELECT asset, min(equity / mx - 1) AS max_drawdown FROM (SELECT asset, equity, max(equity) OVER (PARTITION BY asset ORDER BY ts) AS mx FROM eq) GROUP BY 1), k AS (SELECT asset, count(*) AS n, avg((return_pct > 0)::INTEGER) AS win, sum(return_pct) FILTER (WHERE return_pct > 0) AS gp, abs(sum(return_pct) FILTER (WHERE return_pct <= 0)) AS gl, avg(exit_bar - entry_bar) AS hold FROM tr GROUP BY 1) SELECT asset, round(total_return, 6) AS total_return, round(m / sd * sqrt(252::DOUBLE), 6) AS sharpe, round(m / dd * sqrt(252::DOUBLE), 6) AS sortino, round(max_drawdown, 6) AS max_drawdown, round(sd * sqrt(252::DOUBLE), 6) AS volatility, n AS total_trades, round(win, 6) AS win_rate, round(gp / gl, 6) AS profit_factor, round(hold, 6) AS avg_holding FROM s JOIN dr USING (asset) JOIN k USING (asset)"


def flagship(spark, sf):
    """Crossover signals on hourly bars, back-tested: one row of figures for each asset."""
    result, trade_rows = _backtest(spark, sf)
    m = backtest.metrics(result, trade_rows, **K)
    r = lambda c: F.round(c, 6).alias(c)
    return m.select("asset", r("total_return"), r("sharpe"), r("sortino"), r("max_drawdown"), r("volatility"), "total_trades", r("win_rate"), r("profit_factor"), r("avg_holding"))


query("backtest_metrics", _METRICS)(flagship)


@query("event_driven_equity", f"WITH {_SMA}, p AS (SELECT asset, ts, close, open, coalesce(lag(signal) OVER w, 0) AS u, coalesce(lag(signal) OVER w, 0) - coalesce(lag(signal, 2) OVER w, 0) AS d FROM sg WINDOW w AS (PARTITION BY asset ORDER BY ts)) SELECT asset, ts, round(100000::DOUBLE + sum(-d * open - abs(d) * open * 0.001::DOUBLE) OVER (PARTITION BY asset ORDER BY ts) + u * close, 6) AS equity FROM p")
def _(spark, sf):
    s = signals.sma_crossover(bars(spark, sf), **K, fast=3, slow=8)
    return backtest.event_driven(s, **K, position="signal", commission=0.001).select("asset", "ts", F.round("equity", 6).alias("equity"))


@query("engine_reconciliation")
def _(spark, sf):
    s = signals.sma_crossover(bars(spark, sf), **K, fast=3, slow=8)
    a = backtest.event_driven(s, **K, position="signal", fill="close")
    b = backtest.event_driven(s, **K, position="signal", fill="open")
    return backtest.reconcile(a, b, **K)


@query("barrier_runs")
def _(spark, sf):
    s = signals.sma_crossover(bars(spark, sf), **K, fast=3, slow=8)
    return backtest.run_barriers(s, backtest.Barrier(0.3, 0.6, 0.1, 24), **K).where("event <> ''").groupBy("asset", "event").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net"), 6).alias("net"))


@query("grid_bot")
def _(spark, sf):
    return backtest.grid_bot(bars(spark, sf), **K, width=1.0).groupBy("asset").agg(F.max("inventory").alias("most"), F.round(F.max_by("realised", "ts"), 6).alias("realised"))


@query("variance_trade", f"WITH {BARS}, v AS (SELECT asset, stddev_samp(ln(close)) AS rv FROM bars WHERE close > 0 GROUP BY 1) SELECT asset, round(0.5::DOUBLE * (1.2::DOUBLE * 1.2 - rv * rv) * (30 / 365.0::DOUBLE) - 0.001, 8) AS pnl FROM v")
def _(spark, sf):
    v = bars(spark, sf).where("close > 0").groupBy("asset").agg(F.stddev_samp(F.ln("close")).alias("rv"))
    return v.select("asset", F.round(backtest.variance_trade(F.lit(1.2), F.col("rv"), 30, 1, 10.0), 8).alias("pnl"))


@query("triple_barrier_labels", f"WITH {_NUM}, p AS (SELECT a.asset, a.i, x.i - a.i AS k, x.close / a.close - 1 AS r FROM b a JOIN b x ON x.asset = a.asset AND x.i BETWEEN a.i + 1 AND a.i + 10), h AS (SELECT asset, i, min(k) FILTER (WHERE r >= 0.5) AS u, min(k) FILTER (WHERE r <= -0.4) AS d, max(k) AS n, arg_max(r, k) AS last FROM p GROUP BY 1, 2) SELECT asset, i, CASE WHEN u IS NOT NULL AND (d IS NULL OR u < d) THEN 1 WHEN d IS NOT NULL THEN -1 ELSE sign(last)::INTEGER END AS label, CASE WHEN u IS NOT NULL AND (d IS NULL OR u < d) THEN u WHEN d IS NOT NULL THEN d ELSE n END::INTEGER AS bars_held FROM h")
def _(spark, sf):
    b = labels.numbered(bars(spark, sf), keys=["asset"], order=["ts"])
    return labels.triple_barrier(b, **K, price="close", up=0.5, down=0.4, bars=10).where("barrier IS NOT NULL").select("asset", "i", "label", F.col("bars_held").cast("int").alias("bars_held"))


@query("sample_weights")
def _(spark, sf):
    b = labels.numbered(bars(spark, sf), keys=["asset"], order=["ts"])
    lab = b.select("asset", "i", (F.col("i") + 5).alias("x"), F.col("close").alias("r"))
    return labels.sample_weights(lab, keys=["asset"], entry="i", exit="x", ret="r", half_life=100.0).select("asset", "i", F.round("weight", 6).alias("weight"))


@query("purged_folds")
def _(spark, sf):
    b = labels.numbered(bars(spark, sf), keys=["asset"], order=["ts"])
    lab = b.select("asset", "i", (F.col("i") + 5).alias("x"))
    return labels.purged_folds(lab, keys=["asset"], entry="i", exit="x", folds=5).groupBy("asset", "fold", "role").count()


@query("sequence_building", f"WITH {_NUM} SELECT asset, ts, round(sum(close) OVER w, 6) AS seq_sum, lead(close, 3) OVER (PARTITION BY asset ORDER BY ts) AS label FROM b WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 9 PRECEDING) QUALIFY i >= 9 AND label IS NOT NULL")
def _(spark, sf):
    s = labels.sequences(bars(spark, sf), keys=["asset"], order="ts", features=["close"], length=10, target="close", horizon=3)
    return s.select("asset", "ts", F.round(F.aggregate("close_seq", F.lit(0.0), lambda a, x: a + x), 6).alias("seq_sum"), "label")


