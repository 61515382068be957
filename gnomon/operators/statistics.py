"""Statistics of series: stationarity, regressions, Monte-Carlo critical values, distributions, GARCH.

What SQL aggregates express is an aggregate; what needs a solver is numpy in an
Arrow function with one task per series, target or grid point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows as W

# --- aggregates -----------------------------------------------------------------------------------------------


def half_life(df: DataFrame, *, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Half-life of mean reversion, from the slope of changes on levels; null if there is none."""
    w = W.series(keys, *order)
    rows = df.withColumn("__l", F.lag(value).over(w)).where(F.col("__l").isNotNull()).withColumn("__d", F.col(value) - F.col("__l"))
    out = rows.groupBy(*keys).agg(F.regr_slope("__d", "__l").alias("b"))
    return out.withColumn("half_life", F.when((F.col("b") < 0) & (F.col("b") > -1), -math.log(2) / F.ln(1 + F.col("b"))))


def variance_ratio(df: DataFrame, *, keys: list[str], order: list[str], value: str, lags: list[int]) -> DataFrame:
    """``var(q) / (q var(1))`` of log prices for each lag, as ``vr_q``."""
    w = W.series(keys, *order)
    x = F.ln(value)
    rows = df.select(*keys, (x - F.lag(x).over(w)).alias("d1"), *((x - F.lag(x, q).over(w)).alias(f"d{q}") for q in lags if q != 1))
    return rows.groupBy(*keys).agg(*((F.var_samp(f"d{q}") / (q * F.var_samp("d1"))).alias(f"vr_{q}") for q in lags))


def durbin_watson(df: DataFrame, *, keys: list[str], order: list[str], value: str) -> DataFrame:
    w = W.series(keys, *order)
    rows = df.withColumn("__d", F.col(value) - F.lag(value).over(w))
    return rows.groupBy(*keys).agg((F.sum(F.col("__d") * F.col("__d")) / F.sum(F.col(value) * F.col(value))).alias("dw"))


def ljung_box(df: DataFrame, *, keys: list[str], order: list[str], value: str, lags: int = 10) -> DataFrame:
    """The statistic over the first ``lags`` autocorrelations."""
    w = W.series(keys, *order)
    mean = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.count(value).alias("__n"))
    rows = df.join(mean, keys).withColumn("__x", F.col(value) - F.col("__m"))
    for k in range(1, lags + 1):
        rows = rows.withColumn(f"__c{k}", F.col("__x") * F.lag("__x", k).over(w))
    n = F.first("__n")
    stat = F.lit(0.0)
    for k in range(1, lags + 1):
        r = F.sum(f"__c{k}") / F.sum(F.col("__x") * F.col("__x"))
        stat = stat + r * r / (n - k)
    return rows.groupBy(*keys).agg((n * (n + 2) * stat).alias("ljung_box"))


def adf_lag0(df: DataFrame, *, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Dickey-Fuller with a constant and no lags: ``t_stat`` and the level it passes (fixed values -3.51, -2.89, -2.58)."""
    w = W.series(keys, *order)
    rows = df.withColumn("__l", F.lag(value).over(w)).where(F.col("__l").isNotNull()).withColumn("__d", F.col(value) - F.col("__l"))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("__d", "__l").alias("b"), F.regr_sxx("__d", "__l").alias("sxx"), F.regr_syy("__d", "__l").alias("syy"), F.regr_sxy("__d", "__l").alias("sxy"))
    error = F.sqrt((F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    out = out.withColumn("t_stat", F.col("b") / error)
    t = F.col("t_stat")
    return out.withColumn("level", F.when(t < -3.51, 0.01).when(t < -2.89, 0.05).when(t < -2.58, 0.10).otherwise(1.0)).select(*keys, "n", "t_stat", "level")


def cointegration(df: DataFrame, *, keys: list[str], order: list[str], a: str, b: str, least_corr: float = 0.5) -> DataFrame:
    """Per pair: correlation, hedge ratio, then the residual's lag-0 test and half-life; a correlation below the gate has neither."""
    fit = df.groupBy(*keys).agg(F.corr(a, b).alias("corr"), F.regr_slope(a, b).alias("hedge_ratio"), F.regr_intercept(a, b).alias("intercept"))
    rows = df.join(fit, keys).where(F.abs("corr") >= least_corr).withColumn("resid", F.col(a) - F.col("hedge_ratio") * F.col(b) - F.col("intercept"))
    test = adf_lag0(rows, keys=keys, order=order, value="resid").select(*keys, "t_stat", "level")
    hl = half_life(rows, keys=keys, order=order, value="resid").select(*keys, "half_life")
    return fit.join(test, keys, "left").join(hl, keys, "left")


def empirical_risk(df: DataFrame, *, keys: list[str], value: str) -> DataFrame:
    """Value at risk, expected shortfall at 5 and 1 %, and the tail against a normal one."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.05)).alias("q5"), F.percentile(value, F.lit(0.01)).alias("q1"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    rows = df.join(q, keys)
    tail = lambda c: F.avg(F.when(F.col(value) <= F.col(c), F.col(value)))
    out = rows.groupBy(*keys).agg((-F.first("q5")).alias("var_95"), (-F.first("q1")).alias("var_99"), (-tail("q5")).alias("es_95"), (-tail("q1")).alias("es_99"), F.first("m").alias("m"), F.first("s").alias("s"))
    return out.withColumn("tail_ratio", F.col("var_99") / F.nullif(2.3263478740408408 * F.col("s") - F.col("m"), F.lit(0.0))).drop("m", "s")


def optimal_kelly(df: DataFrame, *, keys: list[str], value: str, steps: int = 100, most: float = 1.0) -> DataFrame:
    """The share of capital with the best mean log growth, on a grid."""
    shares = [most * i / steps for i in range(steps + 1)]
    growth = F.array(*(F.struct(F.avg(F.when(1 + f * F.col(value) > 0, F.ln(1 + f * F.col(value))).otherwise(-1e9)).alias("g"), F.lit(-f).alias("f")) for f in shares))
    out = df.groupBy(*keys).agg(F.array_max(growth).alias("b"))
    return out.select(*keys, (-F.col("b.f")).alias("kelly"), F.col("b.g").alias("growth"))


# --- numpy ----------------------------------------------------------------------------------------------------


def hurst_rs(log_prices: np.ndarray, low: int = 8, high: int = 200) -> float:
    """Hurst exponent: slope of log(R/S) on log(lag) over chunks of ``lag`` prices, between 0 and 1; 0.5 if too short."""
    n = len(log_prices)
    high = min(high, n // 2)
    if high <= low:
        return 0.5
    xs, ys = [], []
    for lag in np.unique(np.logspace(math.log10(low), math.log10(high), 20).astype(int)):
        if lag < low:
            continue
        m = n // lag
        c = np.diff(log_prices[: m * lag].reshape(m, lag), axis=1)
        dev = np.cumsum(c - c.mean(1, keepdims=True), 1)
        s = c.std(1, ddof=1)
        ok = s > 1e-12
        if ok.any():
            xs.append(math.log(lag))
            ys.append(math.log(((dev.max(1) - dev.min(1))[ok] / s[ok]).mean()))
    if len(xs) < 3:
        return 0.5
    return float(np.clip(np.polyfit(xs, ys, 1)[0], 0, 1))


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, their standard errors and the residuals."""
    inv = np.linalg.pinv(x.T @ x)
    b = inv @ (x.T @ y)
    e = y - x @ b
    return b, np.sqrt(np.maximum(np.diag(inv) * (e @ e) / max(len(y) - x.shape[1], 1), 0)), e


def adf_t(y: np.ndarray, max_lag: int | None = None) -> tuple[float, int]:
    """Augmented Dickey-Fuller t with a constant; lags by the smallest AIC on a common sample."""
    n = len(y)
    max_lag = int(math.ceil(12 * (n / 100) ** 0.25)) if max_lag is None else max_lag
    max_lag = max(0, min(max_lag, n // 2 - 3))
    d = np.diff(y)

    def design(p: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        t = d[skip:]
        cols = [y[skip:-1], np.ones(len(t)), *(d[skip - k : len(d) - k] for k in range(1, p + 1))]
        return t, np.column_stack(cols)

    best, lags = math.inf, 0
    for p in range(max_lag + 1):
        t, x = design(p, max_lag)
        _, _, e = ols(t, x)
        aic = len(t) * math.log(max(e @ e, 1e-300) / len(t)) + 2 * x.shape[1]
        if aic < best:
            best, lags = aic, p
    t, x = design(lags, lags)
    b, se, _ = ols(t, x)
    return float(b[0] / se[0]) if se[0] > 0 else -math.inf, lags


def johansen(x: np.ndarray, lags: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Trace and largest-eigenvalue statistics (constant), largest first."""
    d = np.diff(x, axis=0)
    t = len(d) - lags
    z0 = d[lags:]
    z1 = x[lags:-1]
    z2 = np.column_stack([d[lags - k : len(d) - k] for k in range(1, lags + 1)] + [np.ones(t)])
    m = z2 @ np.linalg.pinv(z2)
    r0, r1 = z0 - m @ z0, z1 - m @ z1
    s00, s11, s01 = r0.T @ r0 / t, r1.T @ r1 / t, r0.T @ r1 / t
    eig = np.sort(np.linalg.eigvals(np.linalg.pinv(s11) @ s01.T @ np.linalg.pinv(s00) @ s01).real)[::-1]
    logs = -t * np.log(np.clip(1 - eig, 1e-12, 1))
    return np.cumsum(logs[::-1])[::-1], logs


#: 95 % points of the trace statistic for 1 to 6 common trends (constant).
JOHANSEN_TRACE_95 = (3.8415, 15.4943, 29.7961, 47.8545, 69.8189, 95.7542)


def ridge(y: np.ndarray, x: np.ndarray, alpha: float = 0.01) -> np.ndarray:
    """Ridge coefficients with a column of ones at the end, penalised like the others."""
    z = np.column_stack([x, np.ones(len(x))])
    return np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ y)


def successive(target: int, m: np.ndarray, n: int, alpha: float = 0.01) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Greedy basket: always the series most correlated with the residual, refitted on all chosen. Chosen, weights, residual."""
    y, chosen = m[:, target], []
    resid, coef = y - y.mean(), np.empty(0)
    for _ in range(min(n, m.shape[1] - 1)):
        rest = [j for j in range(m.shape[1]) if j != target and j not in chosen]
        c = m[:, rest] - m[:, rest].mean(0)
        scale = np.sqrt((c * c).sum(0) * ((resid - resid.mean()) ** 2).sum())
        corr = np.abs(c.T @ (resid - resid.mean())) / np.where(scale > 0, scale, np.inf)
        chosen.append(rest[int(np.argmax(corr))])
        coef = ridge(y, m[:, chosen], alpha)
        resid = y - np.column_stack([m[:, chosen], np.ones(len(y))]) @ coef
    return chosen, coef, resid


def variance_profile(x: np.ndarray, last: int) -> np.ndarray:
    """Variance ratios of a level series for lags 2 to ``last + 1``."""
    one = np.var(np.diff(x), ddof=1)
    return np.array([np.var(x[q:] - x[:-q], ddof=1) / (q * one) if one > 0 else 1.0 for q in range(2, last + 2)])


def interp_percentile(values: np.ndarray, pct: float) -> float:
    """Percentile by interpolation at ``n * p / 100 - 1`` of the sorted values."""
    v = np.sort(values)
    return float(np.interp(len(v) * pct / 100 - 1, np.arange(len(v)), v))


def mahalanobis(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> float:
    d = x - mean
    return float(math.sqrt(max(d @ inverse @ d, 0)))


# --- per series in Arrow functions ----------------------------------------------------------------------------


def suite(df: DataFrame, *, keys: list[str], order: str, value: str) -> DataFrame:
    """Stationarity of each series: ADF (AIC lags), Hurst, half-life, variance ratio. A series goes to one task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values(order)[value].dropna().to_numpy(float)
        t, lags = adf_t(x) if len(x) > 20 else (math.nan, 0)
        d, level = np.diff(x), x[:-1]
        b = np.polyfit(level, d, 1)[0] if len(x) > 3 and level.std() > 0 else 0.0
        hl = -math.log(2) / math.log(1 + b) if -1 < b < 0 else None
        vr = variance_profile(x, 3)[2] if len(x) > 10 else None
        return pd.DataFrame([[*g[keys].iloc[0], len(x), t, lags, hurst_rs(np.log(np.maximum(x, 1e-9))), hl, vr]], columns=names)

    names = [*keys, "n", "adf_t", "adf_lags", "hurst", "half_life", "vr_4"]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{kinds}, n long, adf_t double, adf_lags int, hurst double, half_life double, vr_4 double")


def basket_scan(matrix: np.ndarray, names: list[str], spark: SparkSession, n: int) -> DataFrame:
    """Each series as the target of a greedy basket; one row per target. The matrix (bounded by the universe) is broadcast."""
    sent = spark.sparkContext.broadcast(matrix)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for target in part["target"]:
                chosen, coef, resid = successive(int(target), sent.value, n)
                rows.append((int(target), names[int(target)], [names[c] for c in chosen], coef.tolist(), adf_t(resid)[0]))
            yield pd.DataFrame(rows, columns=["target", "name", "basket", "weights", "adf_t"])

    return spark.range(len(names)).select(F.col("id").alias("target")).repartition(min(len(names), 64), "target").mapInPandas(run, "target long, name string, basket array<string>, weights array<double>, adf_t double")


# --- Monte-Carlo surfaces -------------------------------------------------------------------------------------


def surface_grid(spark: SparkSession, axes: dict[str, list[int]]) -> DataFrame:
    from ..plans.param_grids import grid

    g = grid(spark, axes)
    return g.withColumn("point", F.sha2(F.to_json(F.struct(*axes)), 256))


def build_surface(todo: DataFrame, *, samples: int, seed: int = 42, pcts: tuple[float, ...] = (1.0, 5.0, 10.0)) -> DataFrame:
    """Critical values of greedy baskets of random walks at each point ``n_assets, n_obs, n_vars``.

    Points are dealt to tasks one by one; each draws from a seed of its own, so
    any of them can be computed again alone.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p in part.itertuples(index=False):
                rng = np.random.default_rng([seed, int(p.point[:8], 16)])
                t = [adf_t(successive(0, rng.standard_normal((p.n_obs, p.n_assets)).cumsum(0), p.n_vars)[2], 1)[0] for _ in range(samples)]
                rows += [(p.point, p.n_assets, p.n_obs, p.n_vars, q, interp_percentile(np.array(t), q)) for q in pcts]
            yield pd.DataFrame(rows, columns=["point", "n_assets", "n_obs", "n_vars", "pct", "value"])

    dealt = todo.select("point", "n_assets", "n_obs", "n_vars").repartition(F.col("point"))
    return dealt.mapInPandas(run, "point string, n_assets int, n_obs int, n_vars int, pct double, value double")


def missing_points(grid: DataFrame, done: DataFrame) -> DataFrame:
    return grid.join(done.select("point").distinct(), "point", "left_anti")


def surface_status(grid: DataFrame, done: DataFrame) -> DataFrame:
    """READY, PARTIAL or MISSING."""
    n = grid.join(done.select("point").distinct().withColumn("__d", F.lit(1)), "point", "left").agg(F.count(F.lit(1)).alias("total"), F.count("__d").alias("computed"))
    return n.withColumn("status", F.when(F.col("computed") == F.col("total"), "READY").when(F.col("computed") > 0, "PARTIAL").otherwise("MISSING"))


def surface_lookup(asked: DataFrame, surface: DataFrame, axes: list[str], *, key: str, pct: str = "pct") -> DataFrame:
    """Multilinear interpolation among the corners around each point asked; outside the grid it is clamped, missing corners are left out and the rest reweighted."""
    rows = asked
    for a in axes:
        edges = surface.agg(F.array_sort(F.collect_set(a)).alias(f"__{a}s"))
        rows = rows.crossJoin(F.broadcast(edges))
        x = F.greatest(F.least(F.col(a).cast("double"), F.element_at(f"__{a}s", -1).cast("double")), F.element_at(f"__{a}s", 1).cast("double"))
        rows = rows.withColumn(f"__{a}x", x)
        rows = rows.withColumn(f"__{a}l", F.expr(f"array_max(filter(__{a}s, e -> cast(e as double) <= __{a}x))")).withColumn(f"__{a}h", F.expr(f"array_min(filter(__{a}s, e -> cast(e as double) >= __{a}x))"))
        share = F.when(F.col(f"__{a}h") == F.col(f"__{a}l"), 0.0).otherwise((F.col(f"__{a}x") - F.col(f"__{a}l")) / (F.col(f"__{a}h") - F.col(f"__{a}l")))
        corners = F.array_distinct(F.array(F.struct(F.col(f"__{a}l").alias("v"), (1 - share).alias("w")), F.struct(F.col(f"__{a}h").alias("v"), F.when(F.col(f"__{a}h") == F.col(f"__{a}l"), 1.0).otherwise(share).alias("w"))))
        rows = rows.withColumn(f"__{a}c", F.explode(corners))
    weight = F.lit(1.0)
    for a in axes:
        weight = weight * F.col(f"__{a}c.w")
    rows = rows.select(key, weight.alias("__w"), *(F.col(f"__{a}c.v").alias(a) for a in axes))
    hit = rows.join(surface, axes)
    return hit.groupBy(key, pct).agg((F.sum(F.col("__w") * F.col("value")) / F.nullif(F.sum("__w"), F.lit(0.0))).alias("value"))


def corrected_p(t: Column, c1: Column, c5: Column, c10: Column) -> Column:
    """p-value by pieces between Monte-Carlo critical values."""
    between = lambda a, b, pa, pb: pa + (t - a) / (b - a) * (pb - pa)
    return F.when(t <= c1, 0.01).when(t <= c5, between(c1, c5, 0.01, 0.05)).when(t <= c10, between(c5, c10, 0.05, 0.10)).otherwise(F.least(F.lit(1.0), 0.10 + (t - c10) * 0.2))


# --- volatility models ----------------------------------------------------------------------------------------


GARCH_KINDS = ("GARCH", "EGARCH", "GJR")


def garch_fit(r: np.ndarray, kind: str = "GARCH", grid: int = 8) -> dict[str, float]:
    """GARCH(1,1), EGARCH(1,1) without leverage, or GJR: variance targeting, likelihood on a grid that is refined twice.

    ``last`` is the variance of the last row and ``shock`` its deviation.
    """
    x = r - r.mean()
    var = float(x.var())
    if var <= 0:
        raise ValueError("the series doesn't vary")
    values, mean_size = x.tolist(), math.sqrt(2 / math.pi)

    def level(a: float, g: float, b: float) -> float:
        return math.log(var) * (1 - b) if kind == "EGARCH" else var * (1 - a - b - g / 2)

    def walk(a: float, g: float, b: float) -> tuple[float, float]:
        w, h, last, total = level(a, g, b), var, var, 0.0
        if kind == "EGARCH":
            u = math.log(var)
            for e in values:
                last = math.exp(u)
                total += u + e * e / last
                u = min(max(w + a * (abs(e) / math.sqrt(last) - mean_size) + b * u, -60.0), 60.0)
            return total, last
        if w <= 0 or a + b + g / 2 >= 0.9999:
            return math.inf, var
        for e in values:
            last = h
            total += math.log(h) + e * e / h
            h = w + (a + (g if e < 0 else 0.0)) * e * e + b * h
        return total, last

    gjr = kind == "GJR"
    a0, a1, b0, b1, g0, g1 = 0.01, 0.5 if kind == "EGARCH" else 0.3, 0.0 if kind == "EGARCH" else 0.5, 0.98, 0.0, 0.3 if gjr else 0.0
    best = (math.inf, 0.05, 0.0, 0.9)
    for _ in range(3):
        for a in np.linspace(a0, a1, grid):
            for b in np.linspace(b0, b1, grid):
                for g in np.linspace(g0, g1, 4) if gjr else (0.0,):
                    best = min(best, (walk(a, g, b)[0], a, g, b))
        _, a, g, b = best
        wa, wb, wg = (a1 - a0) / 4, (b1 - b0) / 4, (g1 - g0) / 4
        a0, a1, b0, b1 = max(a - wa, 1e-4), a + wa, max(b - wb, 0.0), min(b + wb, 0.995)
        g0, g1 = max(g - wg, 0.0), g + wg if gjr else 0.0
    total, a, g, b = best
    return {"omega": level(a, g, b), "alpha": a, "gamma": g, "beta": b, "aic": total + 2 * (5 if gjr else 4), "variance": var, "last": walk(a, g, b)[1], "shock": values[-1]}


def garch_forecast(omega: float, alpha: float, beta: float, last_var: float, last_ret: float, steps: int, gamma: float = 0.0) -> np.ndarray:
    """Variance for each of the next steps, closed form after the first."""
    first = omega + (alpha + (gamma if last_ret < 0 else 0.0)) * last_ret**2 + beta * last_var
    keep = alpha + beta + gamma / 2
    level = omega / (1 - keep) if keep < 1 else first
    return level + (first - level) * keep ** np.arange(steps)


def egarch_forecast(omega: float, alpha: float, beta: float, last_var: float, last_ret: float, steps: int) -> np.ndarray:
    """Variance for each of the next steps: the expected log variance after the first."""
    u = omega + alpha * (abs(last_ret) / math.sqrt(last_var) - math.sqrt(2 / math.pi)) + beta * math.log(last_var)
    level = omega / (1 - beta) if beta < 1 else u
    return np.exp(level + (u - level) * beta ** np.arange(steps))


def garch_ensemble(r: np.ndarray) -> dict[str, float]:
    """The three models on percent returns, weighted by AIC: yearly volatility over the next 7, 14 and 30 rows and now.

    A forecast isn't below a quarter of the variance now.
    """
    fits = {kind: garch_fit(r, kind) for kind in GARCH_KINDS}
    aic = np.array([f["aic"] for f in fits.values()])
    weights = np.exp(-0.5 * (aic - aic.min()))
    weights /= weights.sum()
    out = {f"w_{kind.lower()}": float(w) for kind, w in zip(fits, weights, strict=True)}
    out["best_model"] = GARCH_KINDS[int(np.argmin(aic))]
    ahead = []
    for kind, f in fits.items():
        state = (f["omega"], f["alpha"], f["beta"], f["last"], f["shock"], 30)
        h = egarch_forecast(*state) if kind == "EGARCH" else garch_forecast(*state, f["gamma"])
        floor = max(f["last"] * 0.25, 1e-4)
        ahead.append([*(math.sqrt(max(float(h[:n].mean()), floor) * 365) / 100 for n in (7, 14, 30)), math.sqrt(f["last"] * 365) / 100])
    out |= dict(zip(("vol_7d", "vol_14d", "vol_30d", "current_vol"), (weights @ np.array(ahead)).tolist(), strict=True))
    return out


def garch_per_series(df: DataFrame, *, keys: list[str], order: str, ret: str, least: int = 90) -> DataFrame:
    """The ensemble of each series of returns (fractions); one series to a task, none with fewer than ``least`` rows."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    figures = [*(f"w_{k.lower()}" for k in GARCH_KINDS), "vol_7d", "vol_14d", "vol_30d", "current_vol"]
    names = [*keys, "n", "best_model", *figures]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r = g.sort_values(order)[ret].dropna().to_numpy(float) * 100
        r = r[np.isfinite(r)]
        if len(r) < least or r.var() <= 0:
            return pd.DataFrame(columns=names)
        e = garch_ensemble(r)
        return pd.DataFrame([[*g[keys].iloc[0], len(r), e["best_model"], *(e[f] for f in figures)]], columns=names)

    return df.select(*keys, order, ret).groupBy(*keys).applyInPandas(run, f"{kinds}, n long, best_model string, " + ", ".join(f"{f} double" for f in figures))


# --- distributions --------------------------------------------------------------------------------------------


def tail_index(x: np.ndarray, share: float = 0.05) -> float:
    """Hill's estimate on the lower tail; infinite without losses there."""
    losses = np.sort(-x)[::-1]
    k = max(int(len(x) * share), 2)
    top = losses[: k + 1]
    if top[-1] <= 0:
        return math.inf
    return float(1 / np.mean(np.log(top[:-1] / top[-1])))


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """Quantiles of the normal distribution by bisection."""
    low, high = np.full(len(p), -10.0), np.full(len(p), 10.0)
    cdf = np.vectorize(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))
    for _ in range(60):
        mid = (low + high) / 2
        above = cdf(mid) > p
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return (low + high) / 2


def qq(x: np.ndarray, points: int = 99) -> pd.DataFrame:
    """Quantiles of a sample against those of a normal one with its mean and deviation."""
    p = np.arange(1, points + 1) / (points + 1)
    return pd.DataFrame({"p": p, "sample": np.quantile(x, p), "normal": x.mean() + x.std(ddof=1) * normal_quantiles(p)})


def fit_distributions(df: DataFrame, *, keys: list[str], value: str) -> DataFrame:
    """For each group the parameters of its fits, and the method that suits it; a group goes to one task."""
    from . import distributions as D

    names = [*keys, "n", "method", "nu", "var_99_cf", "hill", "calm_share"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = D.clean(g[value].to_numpy(float, na_value=math.nan))
        if len(x) < 10 or x.std() == 0:
            return pd.DataFrame(columns=names)
        mixed = D.gaussian_mixture(x).params
        calm = min((mixed["s1"], mixed["w1"]), (mixed["s2"], mixed["w2"]))[1]
        row = [*g[keys].iloc[0], len(x), D.auto_method(len(x), D.moments(x).skew), D.student_t(x).params["nu"], -float(D.cornish_fisher(x).quantile(np.array([0.01]))[0]), tail_index(x - x.mean()), calm]
        return pd.DataFrame([row], columns=names)

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, value).groupBy(*keys).applyInPandas(run, f"{kinds}, n long, method string, nu double, var_99_cf double, hill double, calm_share double")
