"""Regressions and unit-root tests of any number of series from their moments.

A regression needs no rows, only sums of products of its columns.  So one
aggregate (combined before the shuffle) turns every series into a matrix as
wide as the regression, and only those matrices are solved in Python: neither
the length of a series nor their number bounds a task.  Rows with a null in any
column of the regression are left out; a series too short or without variation
has null results; keys that are null are a series of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .statistics import JOHANSEN_TRACE_95


def _moments(rows: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """The number of rows, the sums, and the sums of products of columns (upper triangle, by rows)."""
    names = list(columns)
    rows = rows.select(*by, *(c.cast("double").alias(f"__{n}") for n, c in columns.items())).dropna(subset=[f"__{n}" for n in names])
    col = {n: F.col(f"__{n}") for n in names}
    products = [F.sum(col[a] * col[b]) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.array(*(F.sum(c) for c in col.values())).alias("__s"), F.array(*products).alias("__p"))


def _matrix(n: int, s: list[float], p: list[float]) -> np.ndarray:
    """Products of all columns with the constant last."""
    k = len(s)
    out = np.empty((k + 1, k + 1))
    top = np.zeros((k, k))
    top[np.triu_indices(k)] = p
    out[:k, :k] = top + np.triu(top, 1).T
    out[k, :k] = out[:k, k] = s
    out[k, k] = n
    return out


def _solved(m: DataFrame, keys: list[str], solve: Callable[[np.ndarray], tuple], fields: str) -> DataFrame:
    """``solve`` on the matrix of each row of moments."""
    kinds = "".join(f"`{k}` {m.schema[k].dataType.simpleString()}, " for k in keys)
    names = [f.split()[0].strip("`") for f in fields.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in parts:
            solved = [solve(_matrix(n, list(s), list(p))) for n, s, p in zip(g["__n"], g["__s"], g["__p"], strict=True)]
            yield pd.concat([g[keys].reset_index(drop=True), pd.DataFrame(solved, columns=names)], axis=1)

    return m.mapInPandas(run, kinds + fields)


def _penalised(z: np.ndarray, y: int, xs: list[int], alpha: float) -> np.ndarray:
    """Coefficients of columns and the constant, all penalised."""
    at = [*xs, len(z) - 1]
    return np.linalg.solve(z[np.ix_(at, at)] + alpha * np.eye(len(at)), z[at, y])


def ridge(df: DataFrame, *, keys: list[str], y: str, xs: list[str], alpha: float = 0.01) -> DataFrame:
    """Ridge regression of ``y`` on ``xs`` and a constant for each key: ``n, b_<x>..., const``; ``alpha`` is above 0."""
    if alpha <= 0:
        raise ValueError("alpha must be above 0")
    m = _moments(df, keys, {"y": F.col(y), **{f"x{i}": F.col(x) for i, x in enumerate(xs)}})
    fields = ", ".join(["n long", *(f"`b_{x}` double" for x in xs), "const double"])
    return _solved(m, keys, lambda z: (int(z[-1, -1]), *_penalised(z, 0, list(range(1, len(xs) + 1)), alpha)), fields)


def _stepwise(z: np.ndarray, n: int, alpha: float) -> tuple[list[int], np.ndarray]:
    """Candidates 1.. against column 0: always the one most correlated with the residual, all refitted."""
    last = len(z) - 1
    rows = z[last, last]
    centred = z[:last, :last] - np.outer(z[last, :last], z[last, :last]) / rows
    chosen: list[int] = []
    coef = np.array([z[last, 0] / rows])
    for _ in range(min(n, last - 1)):
        rest = [j for j in range(1, last) if j not in chosen]
        cov = centred[rest, 0] - centred[np.ix_(rest, chosen)] @ coef[:-1]
        scale = np.sqrt(np.maximum(centred[rest, rest], 0))
        chosen.append(rest[int(np.argmax(np.abs(cov) / np.where(scale > 0, scale, np.inf)))])
        coef = _penalised(z, 0, chosen, alpha)
    return chosen, coef


def stepwise(df: DataFrame, *, keys: list[str], y: str, xs: list[str], n: int, alpha: float = 0.01) -> DataFrame:
    """Successive regression: the ``n`` columns chosen, in their order, with the weights of the last fit.

    ``n_rows, chosen array<string>, weights array<double>, const``; of equal
    correlations the earlier column is taken.
    """
    m = _moments(df, keys, {"y": F.col(y), **{f"x{i}": F.col(x) for i, x in enumerate(xs)}})

    def solve(z: np.ndarray) -> tuple:
        chosen, coef = _stepwise(z, n, alpha)
        return int(z[-1, -1]), [xs[j - 1] for j in chosen], coef[:-1].tolist(), float(coef[-1])

    return _solved(m, keys, solve, "n_rows long, chosen array<string>, weights array<double>, const double")


def johansen(df: DataFrame, *, keys: list[str], order: list[str], columns: list[str], lags: int = 1) -> DataFrame:
    """Johansen's test with a constant: ``n, trace, max_eig`` (largest first) and ``rank`` at 95 %.

    Levels count from the first of a series, which changes no statistic and
    keeps the sums small.  At most six columns have critical values; the rank
    of more is null.
    """
    w = W.series(keys, *order)
    k = len(columns)
    rows = df.select(*keys, *order, *(F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(columns)))
    level = {i: F.col(f"__c{i}") - F.first(f"__c{i}", ignorenulls=True).over(w) for i in range(k)}
    rows = rows.select(*keys, *order, *(level[i].alias(f"__l{i}") for i in range(k)))
    rows = rows.select("*", *(F.lag(f"__l{i}").over(w).alias(f"__b{i}") for i in range(k)))
    rows = rows.select("*", *((F.col(f"__l{i}") - F.col(f"__b{i}")).alias(f"__d{i}") for i in range(k)))
    rows = rows.select("*", *(F.lag(f"__d{i}", j).over(w).alias(f"__d{i}_{j}") for j in range(1, lags + 1) for i in range(k)))
    columns_ = {f"d{i}": F.col(f"__d{i}") for i in range(k)} | {f"b{i}": F.col(f"__b{i}") for i in range(k)}
    columns_ |= {f"z{i}_{j}": F.col(f"__d{i}_{j}") for j in range(1, lags + 1) for i in range(k)}

    def solve(z: np.ndarray) -> tuple:
        n = z[-1, -1]
        if n <= 2 * k + k * lags + 1:
            return int(n), None, None, None
        s = z[:-1, :-1] / n - np.outer(z[-1, :-1], z[-1, :-1]) / n**2
        a, q = s[: 2 * k, : 2 * k], s[: 2 * k, 2 * k :]
        r = a - q @ np.linalg.pinv(s[2 * k :, 2 * k :]) @ q.T if lags else a
        s00, s01, s11 = r[:k, :k], r[:k, k:], r[k:, k:]
        eig = np.sort(np.linalg.eigvals(np.linalg.pinv(s11) @ s01.T @ np.linalg.pinv(s00) @ s01).real)[::-1]
        logs = -n * np.log(np.clip(1 - eig, 1e-12, 1))
        trace = np.cumsum(logs[::-1])[::-1]
        rank = next((i for i in range(k) if trace[i] <= JOHANSEN_TRACE_95[k - i - 1]), k) if k <= len(JOHANSEN_TRACE_95) else None
        return int(n), trace.tolist(), logs.tolist(), rank

    return _solved(_moments(rows, keys, columns_), keys, solve, "n long, trace array<double>, max_eig array<double>, rank int")


def adf(df: DataFrame, *, keys: list[str], order: list[str], value: str, max_lag: int) -> DataFrame:
    """Augmented Dickey-Fuller t with a constant: ``n, adf_t, lags``, lags by the smallest AIC on a common sample.

    The first ``max_lag`` rows of a series are summed apart, as the last fit
    takes those of them that its lags leave.  Series of fewer than
    ``2 * max_lag + 6`` values have null results.
    """
    w = W.series(keys, *order)
    rows = df.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("__v"))
    rows = rows.select(*keys, *order, F.row_number().over(w).alias("__i"), F.lag("__v").over(w).alias("__y"), (F.col("__v") - F.lag("__v").over(w)).alias("__d"), F.first("__v").over(w).alias("__0"))
    lagged = {f"d{j}": F.coalesce(F.lag("__d", j).over(w), F.lit(0.0)) for j in range(1, max_lag + 1)}
    rows = rows.select("*", *(c.alias(f"__d{j}") for j, c in enumerate(lagged.values(), 1))).where("__i > 1")
    rows = rows.withColumn("__g", F.least(F.col("__i") - 2, F.lit(max_lag)))
    columns = {"d": F.col("__d"), "y": F.col("__y") - F.col("__0"), **{f"d{j}": F.col(f"__d{j}") for j in range(1, max_lag + 1)}}
    parts = _moments(rows, [*keys, "__g"], columns).groupBy(*keys).agg(F.collect_list(F.struct("__g", "__n", "__s", "__p")).alias("__m"))
    kinds = "".join(f"`{k}` {parts.schema[k].dataType.simpleString()}, " for k in keys)

    def fit(z: np.ndarray, p: int) -> tuple[float, float, float, float]:
        """Residual sum of squares, rows, coefficient and its squared error without the variance."""
        at = [1, *range(2, 2 + p), len(z) - 1]
        inv = np.linalg.pinv(z[np.ix_(at, at)], hermitian=True)
        b = inv @ z[at, 0]
        return max(z[0, 0] - b @ z[at, 0], 0.0), z[-1, -1], b[0], inv[0, 0]

    def solve(found: list[dict]) -> tuple:
        by = {m["__g"]: _matrix(m["__n"], list(m["__s"]), list(m["__p"])) for m in found}
        n = int(sum(z[-1, -1] for z in by.values())) + 1
        if n < 2 * max_lag + 6 or max_lag not in by:
            return n, None, None
        aic = []
        for p in range(max_lag + 1):
            e, rows_, _, _ = fit(by[max_lag], p)
            aic.append(rows_ * math.log(max(e, 1e-300) / rows_) + 2 * (p + 2))
        p = int(np.argmin(aic))
        e, rows_, b, q = fit(sum(z for g, z in by.items() if g >= p), p)
        se = math.sqrt(max(q * e / max(rows_ - p - 2, 1), 0))
        return n, float(b / se) if se > 0 else -math.inf, p

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            yield pd.concat([g[keys].reset_index(drop=True), pd.DataFrame([solve(list(m)) for m in g["__m"]], columns=["n", "adf_t", "lags"])], axis=1)

    return parts.mapInPandas(run, f"{kinds}n long, adf_t double, lags int")


def validate(df: DataFrame, *, keys: list[str], order: list[str], y: str, xs: list[str], n: int, held_out: Column, max_lag: int, alpha: float = 0.01, critical: float = -2.58) -> DataFrame:
    """A basket chosen on one span of each key and refitted on another: ``chosen, adf_in, adf_out, holds``.

    ``held_out`` says which rows are the second span; a key without rows on
    either side gives no row.  The residuals of both spans are tested with up to
    ``max_lag`` lags.
    """
    rows = df.select(*keys, *order, F.coalesce(held_out, F.lit(False)).alias("__test"), *(F.col(c).cast("double").alias(c) for c in dict.fromkeys([y, *xs]))).dropna(subset=[y, *xs])
    m = _moments(rows, [*keys, "__test"], {"y": F.col(y), **{f"x{i}": F.col(x) for i, x in enumerate(xs)}})
    side = lambda test: F.max(F.when(F.col("__test") == test, F.struct("__n", "__s", "__p")))
    both = m.groupBy(*keys).agg(side(False).alias("__a"), side(True).alias("__b")).where("__a IS NOT NULL AND __b IS NOT NULL")
    kinds = "".join(f"`{k}` {both.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = []
            for one, two in zip(g["__a"], g["__b"], strict=True):
                z, t = (_matrix(q["__n"], list(q["__s"]), list(q["__p"])) for q in (one, two))
                chosen, coef = _stepwise(z, n, alpha)
                again = _penalised(t, 0, chosen, alpha)
                spread = np.zeros((2, len(xs)))
                spread[:, [c - 1 for c in chosen]] = coef[:-1], again[:-1]
                out.append(([xs[c - 1] for c in chosen], spread[0].tolist(), float(coef[-1]), spread[1].tolist(), float(again[-1])))
            yield pd.concat([g[keys].reset_index(drop=True), pd.DataFrame(out, columns=["chosen", "__in", "__c_in", "__out", "__c_out"])], axis=1)

    fits = both.mapInPandas(run, kinds + "chosen array<string>, __in array<double>, __c_in double, __out array<double>, __c_out double")
    same = [F.col(f"__r.{k}").eqNullSafe(F.col(f"__f.{k}")) for k in keys] or F.lit(True)  # without keys one row of fits
    joined = rows.alias("__r").join(fits.alias("__f"), same)
    weights, const = F.when(F.col("__test"), F.col("__out")).otherwise(F.col("__in")), F.when(F.col("__test"), F.col("__c_out")).otherwise(F.col("__c_in"))
    total = const
    for i, x in enumerate(xs):
        total = total + weights[i] * F.col(f"__r.{x}")
    resid = joined.select(*(F.col(f"__r.{k}") for k in keys), *(F.col(f"__r.{o}") for o in order), "__test", (F.col(f"__r.{y}") - total).alias("__e"))
    t = adf(resid, keys=[*keys, "__test"], order=order, value="__e", max_lag=max_lag)
    tests = t.groupBy(*keys).agg(F.max(F.when(~F.col("__test"), F.col("adf_t"))).alias("adf_in"), F.max(F.when(F.col("__test"), F.col("adf_t"))).alias("adf_out"))
    same = [F.col(f"__t.{k}").eqNullSafe(F.col(f"__f.{k}")) for k in keys] or F.lit(True)
    out = fits.alias("__f").join(tests.alias("__t"), same)
    return out.select(*(F.col(f"__f.{k}") for k in keys), "chosen", "adf_in", "adf_out", (F.col("adf_out") < critical).alias("holds"))
