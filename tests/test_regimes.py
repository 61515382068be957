"""The twelve regimes of a day against plain numpy over the bars up to it."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from gnomon.operators import regimes, statistics

BARS = 7


def series(seed: int, n: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    shared = np.random.default_rng(99).normal(0, 0.006, n)
    close = 100 * np.exp(np.cumsum(shared + rng.normal(0.0005 * seed, 0.004 + 0.004 * seed, n)))
    open_ = close * np.exp(rng.normal(0, 0.003, n))
    high, low = np.maximum(open_, close) * (1 + rng.random(n) * 0.01), np.minimum(open_, close) * (1 - rng.random(n) * 0.01)
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(n)]
    volume = rng.lognormal(3, 0.5, n) * np.where(np.arange(n) // BARS % 9 == seed, 6, 1)
    return pd.DataFrame({"asset": f"a{seed}", "ts": ts, "open": open_, "high": high, "low": low, "close": close, "volume": volume, "dvol": np.where(np.arange(n) % 11 == 0, 20.0 * seed, np.nan)})


def slow_ema(x: list[float], span: int) -> list[float]:
    out = [x[0]]
    for v in x[1:]:
        out.append(out[-1] + 2 / (span + 1) * (v - out[-1]))
    return out


def state(x: float, edges: list[float], first: int) -> int:
    return first + sum(x > e for e in edges)


def expected(g: pd.DataFrame, everyone: list[pd.DataFrame], pay: pd.DataFrame, d: int) -> dict[str, float]:
    """All figures at the end of day ``d`` (from 1)."""
    end = d * BARS
    x = g.iloc[:end]
    day = [x.iloc[i * BARS : (i + 1) * BARS] for i in range(d)]
    out: dict[str, float] = {}

    close, high, low = ([f(q) for q in day] for f in (lambda q: q.close.iloc[-1], lambda q: q.high.max(), lambda q: q.low.min()))
    tr = [max(high[i], close[i - 1]) - min(low[i], close[i - 1]) for i in range(1, d)]
    up, down = [max(high[i] - high[i - 1], 0) for i in range(1, d)], [max(low[i - 1] - low[i], 0) for i in range(1, d)]
    atr = slow_ema(tr, 14)
    plus = [100 * a / (b + 1e-10) for a, b in zip(slow_ema([u if u > w else 0 for u, w in zip(up, down)], 14), atr)]
    minus = [100 * a / (b + 1e-10) for a, b in zip(slow_ema([w if w > u else 0 for u, w in zip(up, down)], 14), atr)]
    adx = slow_ema([100 * abs(a - b) / (a + b + 1e-10) for a, b in zip(plus, minus)], 14)[-1]
    r1, r7, r30 = (math.log(close[-1] / close[-1 - k]) for k in (1, 7, 30))
    way = 1 if r7 > 0 else -1
    same = np.sign(r1) == np.sign(r7) == np.sign(r30) and r1 != 0
    out |= {"A_adx_14": adx, "A_plus_di_14": plus[-1], "A_minus_di_14": minus[-1], "A_ret_1d": r1, "A_ret_7d": r7, "A_ret_30d": r30}
    out["regime_trend"] = 2 * way if adx > 40 and same else way if adx > 25 else 0

    gk = 0.5 * np.log(x.high / x.low) ** 2 - (2 * math.log(2) - 1) * np.log(x.close / x.open) ** 2
    rv = lambda a, b: math.sqrt(gk.iloc[a:b].mean() * BARS * 365)
    days = [rv(i * BARS, (i + 1) * BARS) for i in range(d)][-252:]
    rank, ratio = np.mean(np.array(days) <= days[-1]), days[-1] / rv(end - 7 * BARS, end)
    out |= {"BC_rv_1d": days[-1], "BC_rv_30d": rv(end - 30 * BARS, end), "BC_vol_pct_rank": rank, "BC_vol_ratio": ratio}
    out["regime_vol_level"] = 0 if rank < 0.2 else 1 if rank < 0.6 else 2 if rank < 0.85 else 3
    out["regime_vol_trend"] = 1 if ratio > 1.25 else -1 if ratio < 0.8 else 0

    logs = np.log(x.close.to_numpy()[-21 * BARS :])
    xs, ys = [], []
    for lag in sorted({int(v) for v in np.logspace(math.log10(8), math.log10(len(logs) // 2), 20) if int(v) >= 8}):
        found = []
        for a in range(0, len(logs) - lag + 1, lag):
            diffs = [logs[a + i + 1] - logs[a + i] for i in range(lag - 1)]
            walk = np.cumsum(np.array(diffs) - np.mean(diffs))
            found.append((max(walk) - min(walk)) / np.std(diffs, ddof=1))
        xs.append(math.log(lag))
        ys.append(math.log(np.mean(found)))
    hurst = min(max(np.polyfit(xs, ys, 1)[0], 0), 1)
    vr = lambda q: np.var([logs[i] - logs[i - q] for i in range(q, len(logs))], ddof=1) / np.var(np.diff(logs), ddof=1) / q
    out |= {"D_hurst": hurst, "D_vr_4": vr(4), "D_vr_24": vr(BARS), "regime_serial_corr": float(regimes.serial_state(np.array([hurst]))[0])}

    last = day[-1]
    buy = last.volume * ((last.close - last.open) / (last.high - last.low)).clip(0, 1)
    ofi = (2 * buy - last.volume) / last.volume
    moved, dollars = math.log(last.close.iloc[-1] / last.close.iloc[0]), (last.close * last.volume).sum()
    out |= {"E_ofi_24h": ofi.mean(), "E_ofi_bar_last": ofi.iloc[-1], "E_amihud": abs(moved) / dollars}
    out["regime_microstructure"] = 1 if ofi.mean() > 0.15 else -1 if ofi.mean() < -0.15 else 0

    p = pay.iloc[: min(3 * d, len(pay))]
    out |= {"regime_funding_positioning": 0, "regime_term_structure": 0}
    if len(p) >= 3:
        fr = p.rate.iloc[-1] * 109500
        change = p.oi.iloc[-1] / p.oi.iloc[-22] - 1 if len(p) >= 22 else 0
        out |= {"F_fr_ann": fr, "F_oi_change_7d": change}
        out["regime_funding_positioning"] = 2 if fr > 30 and change > 0.1 else 1 if fr > 10 else -2 if fr < -15 and change < -0.1 else -1 if fr < -5 else 0
    if len(p) >= 90:
        a, b = p.rate.iloc[-21:].mean() * 109500, p.rate.iloc[-90:].mean() * 109500
        slope = (b - a) / (abs(b) + 1e-6)
        out |= {"J_fr_7d_ann": a, "J_fr_30d_ann": b, "J_fr_slope": slope, "regime_term_structure": 1 if slope > 0.15 else -1 if slope < -0.15 else 0}

    spreads = []
    for i in range(d - 4, d):
        beta = math.log(high[i] / low[i]) ** 2 + math.log(high[i - 1] / low[i - 1]) ** 2
        gamma = math.log(max(high[i], high[i - 1]) / min(low[i], low[i - 1])) ** 2
        k = 3 - 2 * math.sqrt(2)
        al = (math.sqrt(2 * beta) - math.sqrt(beta)) / k - math.sqrt(gamma / k)
        spreads.append(max(2 * (math.exp(al) - 1) / (1 + math.exp(al)), 0))
    spread, volumes = np.mean(spreads), [q.volume.sum() for q in day[-30:]]
    z = (volumes[-1] - np.mean(volumes)) / np.std(volumes, ddof=1)
    out |= {"G_cs_spread": spread, "G_vol_z": z, "regime_liquidity": 0 if z > 1 and spread < 0.002 else 3 - state(z, [-2, -0.5], 0)}

    there = [e for e in everyone if len(e) >= end]
    rets = [np.diff(np.log(e.close.to_numpy()[:end]))[-168:] for e in there]
    corr = [np.corrcoef(rets[i], rets[j])[0, 1] for i in range(len(rets)) for j in range(i + 1, len(rets))]
    out |= {"H_n_assets": len(there), "regime_cross_asset_corr": 0}
    if corr:
        out |= {"H_mean_pairwise_corr": np.mean(corr), "H_max_corr": max(corr), "H_min_corr": min(corr), "regime_cross_asset_corr": state(np.mean(corr), [0.45, 0.75], 0)}

    share = volumes[-1] / np.mean(volumes)
    sure = moved != 0 and share > 1
    out |= {"I_vol_ratio_24h": share, "I_ret_24h": moved, "I_conviction": sure}
    out["regime_volume_participation"] = 0 if share < 0.5 else 1 if share < 1.5 and sure else 2 if share < 3 and sure else 3 if share >= 3 else 1

    out["regime_dispersion"] = 1 if len(there) >= 3 else 0
    if len(there) >= 3:
        out["K_dispersion"] = np.std([math.log(e.close.iloc[end - 1] / e.close.iloc[end - BARS]) for e in there])
    dvol = x.dvol.dropna().iloc[-1]
    out |= {"L_vrp": dvol - days[-1], "regime_rv_iv_spread": 1 if dvol - days[-1] > 10 else -1 if dvol - days[-1] < -10 else 0}
    return out


@pytest.fixture(scope="module")
def market(spark):
    frames = [series(1, 60 * BARS), series(2, 50 * BARS + 3), series(3, 42 * BARS)]
    rng = np.random.default_rng(5)
    pay = pd.concat([pd.DataFrame({"asset": f"a{k}", "n": range(n), "rate": rng.normal(0.0001, 0.0003, n), "oi": rng.lognormal(3, 0.2, n)}) for k, n in ((1, 3 * 60), (2, 100))])
    return frames, pay, regimes.daily_states(spark.createDataFrame(pd.concat(frames)), keys=["asset"], ts="ts", bars=BARS, funding_rows=spark.createDataFrame(pay), funding_order=["n"])


def test_daily_states_match_numpy(market):
    frames, pay, states = market
    got = states.toPandas()
    assert len(got) == 26 + 16 + 8
    for g in frames:
        mine = got[got.asset == g.asset[0]].sort_values("ts").reset_index(drop=True)
        p = pay[pay.asset == g.asset[0]].reset_index(drop=True)
        for i, row in mine.iterrows():
            d = 35 + i
            assert row.ts == g.ts[d * BARS - 1]
            want = expected(g, frames, p, d)
            for name, value in want.items():
                assert row[name] == pytest.approx(float(value), rel=1e-6, abs=1e-7), (g.asset[0], d, name)
            asked = {"F": min(3 * d, len(p)) < 3, "J": min(3 * d, len(p)) < 90, "H": want["H_n_assets"] < 2, "K": want["H_n_assets"] < 3}
            assert set(row.missing) == {c for c, gone in asked.items() if gone}


def test_all_classes_take_more_than_one_state(market):
    got = market[2].toPandas()
    many = [c for c in got if c.startswith("regime_") and got[c].nunique() > 1]
    assert len(many) >= 8, many


def test_daily_states_of_odd_bars(spark):
    bars = series(1, 40 * BARS)
    bars.loc[250, ["open", "close"]] = np.nan
    bars.loc[251, "volume"] = 0.0
    df = spark.createDataFrame(bars.drop(columns="dvol"))
    got = regimes.daily_states(df, keys=["asset"], ts="ts", bars=BARS).collect()
    assert len(got) == 6 and all(set(r.missing) == {"F", "H", "J", "K"} and r.regime_rv_iv_spread == 0 for r in got)
    assert regimes.daily_states(df.limit(0), keys=["asset"], ts="ts", bars=BARS).collect() == []
    with pytest.raises(ValueError):
        regimes.daily_states(df, keys=["asset"], ts="ts", bars=5)


def test_hurst_of_short_series_is_neutral():
    assert statistics.hurst_rs(np.zeros(10)) == 0.5


@pytest.mark.parametrize("undefined", [None, math.nan])
def test_liquidity_of_a_day_with_a_price_of_zero(spark, undefined):
    days = [(1, 10.0, 9.0), (2, 11.0, 0.0), (3, 10.0, 9.0), (4, 10.0, 9.5), (5, 10.0, 9.0), (6, 12.0, 9.0), (7, 10.0, 9.0), (8, None, None), (9, 10.0, 9.0)]
    rows = [("a", dt.date(2024, 1, d), h, low, low, 9.5, 5.0, 50.0) for d, h, low in days]  # a day closes at its low
    frame = spark.createDataFrame(rows, "k string, day date, high double, low double, close double, open double, volume double, dollars double")
    got = {r.day.day: r.cs_spread for r in regimes.liquidity(frame, keys=["k"], least=3, undefined=undefined).collect()}
    assert got[1] == 0 and all(math.isfinite(got[d]) for d in (7, 8, 9))
    assert [math.isnan(got[d]) for d in (2, 3, 4, 5, 6)] == [undefined is not None] * 5
