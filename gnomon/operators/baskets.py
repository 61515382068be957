"""Statistical-arbitrage baskets: significance, scores, walk-forward and artefacts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import statistics as S


def null_distribution(spark: SparkSession, *, n_obs: int, n_assets: int, n_vars: int, samples: int, seed: int = 42, tasks: int = 16) -> DataFrame:
    """ADF statistics of greedy baskets of random walks of the real size; one row for each sample."""

    def run(parts):
        for part in parts:
            out = [S.adf_t(S.successive(0, np.random.default_rng([seed, int(i)]).standard_normal((n_obs, n_assets)).cumsum(0), n_vars)[2], 1)[0] for i in part["id"]]
            yield pd.DataFrame({"id": part["id"], "t_stat": out})

    return spark.range(samples).repartition(tasks).mapInPandas(run, "id long, t_stat double")


def significant(baskets: DataFrame, null: DataFrame, *, t: str = "adf_t", pct: float = 5.0) -> DataFrame:
    """Baskets beyond the null's percentile; the cut-off is one row."""
    cut = null.agg(F.percentile("t_stat", F.lit(pct / 100)).alias("cut"))
    return baskets.crossJoin(F.broadcast(cut)).where(F.col(t) <= F.col("cut"))


def vr_null(*, n_obs: int, n_assets: int, n_vars: int, samples: int, last: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse covariance of the variance profiles of baskets of random walks."""
    p = np.array([S.variance_profile(S.successive(0, np.random.default_rng([seed, i]).standard_normal((n_obs, n_assets)).cumsum(0), n_vars)[2].cumsum(), last) for i in range(samples)])
    return p.mean(0), np.linalg.pinv(np.cov(p, rowvar=False))


def score(df: DataFrame, parts: dict[str, tuple[str, float, float, float]]) -> DataFrame:
    """``score``: weighted components ``name -> (column, worst, best, weight)``, each scaled to 0..1; and ``rank``."""
    total = F.lit(0.0)
    for column, worst, best, weight in parts.values():
        x = (F.col(column) - worst) / (best - worst)
        total = total + weight * F.coalesce(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("score", total / sum(p[3] for p in parts.values())).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), df.columns[0])))


def walk_forward(df: DataFrame, *, basket: str, order: str, target: str, hedges: list[str], estimation: int, signal: int, entry: float = 1.0) -> DataFrame:
    """Fit on each estimation window, trade the target on the residual's score in the next; one basket to a task."""
    kind = df.schema[basket].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        m, rows = g[[target, *hedges]].to_numpy(float), []
        for s in range(0, len(m) - estimation - signal + 1, signal):
            fit, test = m[s : s + estimation], m[s + estimation : s + estimation + signal]
            b = S.ridge(fit[:, 0], fit[:, 1:])
            resid = lambda x, b=b: x[:, 0] - np.column_stack([x[:, 1:], np.ones(len(x))]) @ b
            sd = resid(fit).std() or math.inf
            z = resid(test) / sd
            pos = np.where(z > entry, -1.0, np.where(z < -entry, 1.0, 0.0))
            rows.append((g[basket].iloc[0], s, float((pos[:-1] * (np.diff(test[:, 0]) / test[:-1, 0])).sum()), int((np.diff(pos) != 0).sum())))
        return pd.DataFrame(rows, columns=[basket, "start", "return", "trades"])

    return df.select(basket, order, target, *hedges).groupBy(basket).applyInPandas(run, f"`{basket}` {kind}, start long, return double, trades long")


def nearest_artifact(grid: DataFrame, axes: dict[str, float]) -> DataFrame:
    """The grid point nearest to a size, by the sum of relative distances."""
    far = F.lit(0.0)
    for a, v in axes.items():
        far = far + F.abs(F.col(a) - v) / max(abs(v), 1.0)
    return grid.withColumn("distance", far).orderBy("distance", *axes).limit(1)


def estimated_hours(grid: DataFrame, *, samples: int, cores: int = 8, obs: str = "n_obs") -> DataFrame:
    """Hours that a surface takes, by a fitted cost of a sample (fixed values: 15 ms and 0.12 ms a row)."""
    return grid.agg((F.sum((15 + 0.12 * F.col(obs)) * samples) / 3_600_000 / cores).alias("hours"), F.count(F.lit(1)).alias("points"))


def validate_oos(train: np.ndarray, test: np.ndarray, target: int, n_vars: int) -> dict:
    """A basket chosen on one span and refitted on another: both statistics, and whether it held."""
    chosen, _, resid = S.successive(target, train, n_vars)
    x = test[:, chosen]
    after = test[:, target] - np.column_stack([x, np.ones(len(x))]) @ S.ridge(test[:, target], x)
    t_in, t_out = S.adf_t(resid)[0], S.adf_t(after)[0]
    return {"basket": chosen, "adf_in": t_in, "adf_out": t_out, "holds": t_out < -2.58}


def vr_significance(resid: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> float:
    """How far a residual's variance profile is from the null's."""
    return S.mahalanobis(S.variance_profile(resid, len(mean)), mean, inverse)


def composite_p(df: DataFrame, parts: dict[str, tuple[list[float], list[float], float]]) -> DataFrame:
    """``composite``: weighted ``1 - p`` of columns, with p by interpolation in ``(values, p-values, weight)``; values rise."""
    total, weights = F.lit(0.0), 0.0
    for column, (xs, ps, weight) in parts.items():
        x = F.col(column)
        p = F.when(x <= xs[0], ps[0]).when(x >= xs[-1], ps[-1])
        for (a, pa_), (b, pb) in zip(zip(xs, ps, strict=True), zip(xs[1:], ps[1:], strict=True), strict=False):
            p = p.when(x < b, pa_ + (x - a) / (b - a) * (pb - pa_))
        total, weights = total + weight * (1 - p), weights + weight
    return df.withColumn("composite", total / weights)


def model_of_models(returns: np.ndarray, share: float = 0.5, least: float = 0.0) -> np.ndarray:
    """Capital across models: Kelly on those with a mean above the floor, none below zero, at most everything."""
    from .portfolio import covariance

    mu = returns.mean(0)
    w = np.zeros(len(mu))
    keep = np.flatnonzero(mu > least)
    if len(keep):
        w[keep] = np.maximum(share * np.linalg.solve(covariance(returns[:, keep], 0.1), mu[keep]), 0)
    return w / max(w.sum(), 1.0)
