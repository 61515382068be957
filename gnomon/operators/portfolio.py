"""Portfolios: covariance, allocation methods, Kelly, gates.  Matrices of the universe are small and solved with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def covariance(r: np.ndarray, shrinkage: float = 0.0, target: str = "diagonal", decay: float | None = None) -> np.ndarray:
    """Sample or exponentially weighted covariance, shrunk to its diagonal or to a multiple of one, and made positive semi-definite."""
    if decay is None:
        c = np.cov(r, rowvar=False, ddof=1)
    else:
        w = decay ** np.arange(len(r))[::-1]
        w = w / w.sum()
        x = r - w @ r
        c = (x * w[:, None]).T @ x
    c = np.atleast_2d(c)
    if shrinkage:
        goal = np.diag(np.diag(c)) if target == "diagonal" else np.eye(len(c)) * np.trace(c) / len(c)
        c = (1 - shrinkage) * c + shrinkage * goal
    v, q = np.linalg.eigh((c + c.T) / 2)
    return (q * np.maximum(v, 1e-12)) @ q.T


def _simplex(w: np.ndarray, most: float = 1.0) -> np.ndarray:
    """The nearest weights that add up to 1, none negative or above ``most``."""
    low, high = w.min() - most, w.max()
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(w - mid, 0, most).sum() > 1 else (low, mid)
    return np.clip(w - high, 0, most)


def min_variance(c: np.ndarray, long_only: bool = True, most: float = 1.0) -> np.ndarray:
    if not long_only:
        w = np.linalg.solve(c, np.ones(len(c)))
        return w / w.sum()
    w = np.full(len(c), 1 / len(c))
    step = 1 / np.linalg.eigvalsh(c)[-1]
    for _ in range(1000):
        after = _simplex(w - step * (c @ w), most)
        if np.abs(after - w).max() < 1e-12:
            break
        w = after
    return w


def max_sharpe(mu: np.ndarray, c: np.ndarray, riskless: float = 0.0, long_only: bool = True, most: float = 1.0) -> np.ndarray:
    """Tangency weights; long only by a sweep of the efficient frontier."""
    if not long_only:
        w = np.linalg.solve(c, mu - riskless)
        return w / w.sum()
    best, out = -np.inf, np.full(len(c), 1 / len(c))
    step = 1 / np.linalg.eigvalsh(c)[-1]
    for risk in np.geomspace(0.1, 1000, 15):
        w = out.copy()
        for _ in range(100):
            w = _simplex(w - step * (c @ w - (mu - riskless) / risk), most)
        ratio = (w @ (mu - riskless)) / max(np.sqrt(w @ c @ w), 1e-12)
        if ratio > best:
            best, out = ratio, w
    return out


def risk_parity(c: np.ndarray, steps: int = 100) -> np.ndarray:
    """Equal risk contributions by Newton steps on ``x c x / 2 - mean(log x)``."""
    n = len(c)
    x = 1 / np.sqrt(np.diag(c))
    for _ in range(steps):
        grad = c @ x - 1 / (n * x)
        if np.abs(grad).max() < 1e-12:
            break
        d = np.linalg.solve(c + np.diag(1 / (n * x * x)), grad)
        t = 1.0
        while np.any(x - t * d <= 0):
            t /= 2
        x = x - t * d
    return x / x.sum()


def inverse_vol(c: np.ndarray) -> np.ndarray:
    w = 1 / np.sqrt(np.diag(c))
    return w / w.sum()


def inverse_variance(c: np.ndarray) -> np.ndarray:
    w = 1 / np.diag(c)
    return w / w.sum()


def hierarchical(c: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: single linkage on correlation distance, then inverse-variance bisection."""
    s = np.sqrt(np.diag(c))
    d = np.sqrt(np.maximum((1 - c / np.outer(s, s)) / 2, 0))
    groups = [[i] for i in range(len(c))]
    while len(groups) > 1:
        _, a, b = min((min(d[i, j] for i in groups[a] for j in groups[b]), a, b) for a in range(len(groups)) for b in range(a))
        groups[b] = groups[b] + groups.pop(a)
    w, parts = np.ones(len(c)), [groups[0]]
    while parts:
        p = parts.pop()
        if len(p) < 2:
            continue
        halves = p[: len(p) // 2], p[len(p) // 2 :]
        risk = [(v := inverse_variance(c[np.ix_(h, h)])) @ c[np.ix_(h, h)] @ v for h in halves]
        share = 1 - risk[0] / sum(risk)
        w[halves[0]] *= share
        w[halves[1]] *= 1 - share
        parts += halves
    return w


def max_diversification(c: np.ndarray) -> np.ndarray:
    s = np.sqrt(np.diag(c))
    w = min_variance(c / np.outer(s, s)) / s
    return w / w.sum()


def black_litterman(c: np.ndarray, market: np.ndarray, views: np.ndarray, values: np.ndarray, tau: float = 0.05, risk: float = 2.5) -> np.ndarray:
    """Weights of the posterior returns; view uncertainty in proportion to their variance."""
    prior = risk * c @ market
    omega = np.diag(np.diag(views @ (tau * c) @ views.T))
    gain = tau * c @ views.T @ np.linalg.inv(views @ (tau * c) @ views.T + omega)
    w = np.linalg.solve(risk * c, prior + gain @ (values - views @ prior))
    return w / w.sum()


def kelly(mu: np.ndarray, c: np.ndarray, share: float = 0.5, gross: float = 1.0) -> np.ndarray:
    """Fractional Kelly weights, scaled down to a gross limit."""
    w = share * np.linalg.solve(c, mu)
    return w * min(1.0, gross / max(np.abs(w).sum(), 1e-12))


def allocate(r: np.ndarray, method: str, *, target_vol: float = 0.10, per_year: int = 252) -> np.ndarray:
    """Weights of a method by name."""
    c, mu = covariance(r), r.mean(0)
    if method == "target_vol":
        w = inverse_vol(c)
        return w * target_vol / max(np.sqrt(w @ c @ w * per_year), 1e-12)
    if method == "black_litterman":
        return black_litterman(c, np.full(len(c), 1 / len(c)), np.eye(len(c)), mu)
    by = {"inverse_vol": inverse_vol, "min_variance": min_variance, "risk_parity": risk_parity, "hrp": hierarchical, "inverse_variance": inverse_variance, "max_diversification": max_diversification}
    if method == "max_sharpe":
        return max_sharpe(mu, c)
    return by[method](c) if method in by else np.full(len(c), 1 / len(c))


METHODS = ("equal", "inverse_vol", "min_variance", "max_sharpe", "risk_parity", "target_vol", "black_litterman", "hrp", "max_diversification")


def allocations(returns: DataFrame, *, portfolio: str, asset: str, ts: str, value: str, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Weights of every method for each portfolio; one portfolio's return matrix goes to a task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = g.pivot_table(index=ts, columns=asset, values=value, aggfunc="first").dropna()
        rows = []
        if len(m) > len(m.columns) > 1:
            rows = [(g[portfolio].iloc[0], how, a, float(x)) for how in methods for a, x in zip(m.columns, allocate(m.to_numpy(float), how), strict=True)]
        return pd.DataFrame(rows, columns=[portfolio, "method", asset, "weight"])

    kind = lambda c: returns.schema[c].dataType.simpleString()
    return returns.select(portfolio, asset, ts, value).groupBy(portfolio).applyInPandas(run, f"`{portfolio}` {kind(portfolio)}, method string, `{asset}` {kind(asset)}, weight double")


def gated_equal_weight(df: DataFrame, *, day: str, prob: str, gate: float, leverage: float = 1.0, cap: float = 0.25, base_rate: str | None = None, lift: float = 0.05) -> DataFrame:
    """Equal weights among the rows of a day above the gate (or above base rate plus lift), none above the cap."""
    level = F.lit(gate) if base_rate is None else F.col(base_rate) + lift
    rows = df.withColumn("active", F.col(prob) > level)
    n = F.sum(F.col("active").cast("int")).over(Window.partitionBy(day))
    return rows.withColumn("weight", F.when(F.col("active"), F.least(F.lit(leverage) / n, F.lit(cap))).otherwise(0.0))


def uncorrelated_subset(prob: np.ndarray, corr: np.ndarray, limit: float = 0.85) -> list[int]:
    """Walk by falling probability; what correlates above the limit with one kept is dropped."""
    kept: list[int] = []
    for i in np.argsort(-prob, kind="stable"):
        if all(abs(corr[i, j]) <= limit for j in kept):
            kept.append(int(i))
    return kept
