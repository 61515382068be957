"""Distributions of returns: six ways to fit one, their comparison, and how far a sample is from a normal one.

A fit has ``pdf``, ``cdf`` and ``quantile`` on arrays.  Values of one key are
fitted in one task, which holds them once (8 bytes each) and works on them in
pieces; nulls, NaN and infinities are left out, and a key with fewer than ten
values, or with all of them equal, gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Curve = Callable[[np.ndarray], np.ndarray]
GRID = 5000
PIECE = 1024

_erfc = np.vectorize(math.erfc, otypes=[float])
_probit = np.vectorize(NormalDist().inv_cdf, otypes=[float])
#: Free numbers of each method.
PARAMETERS = {"empirical": 0, "kde": 1, "student_t": 3, "cornish_fisher": 4, "gaussian_mixture": 5, "evt_composite": 6}


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2))


def normal_pdf(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * np.square(z)) / math.sqrt(2 * math.pi)


@dataclass
class Moments:
    mean: float
    std: float
    skew: float
    kurt: float
    n: int


def moments(x: np.ndarray) -> Moments:
    """Mean, deviation (n - 1), skewness and excess kurtosis (n)."""
    d = x - x.mean()
    v = (d * d).mean()
    return Moments(float(x.mean()), float(x.std(ddof=1)), float((d**3).mean() / v**1.5), float((d**4).mean() / v**2 - 3), len(x))


@dataclass
class Fit:
    name: str
    pdf: Curve
    cdf: Curve
    quantile: Curve
    params: dict[str, float]

    def shortfall(self, share: float, points: int = 10_000) -> float:
        """The mean of the worst ``share`` of outcomes."""
        return float(self.quantile(np.linspace(1e-6, share, points)).mean())

    def log_likelihood(self, x: np.ndarray) -> float:
        return float(np.log(np.maximum(self.pdf(x), 1e-300)).sum())


def _slope(cdf: Curve, dx: float) -> Curve:
    """A density as the slope of a distribution over two steps."""
    return lambda x: np.maximum(cdf(x + dx) - cdf(x - dx), 0) / (2 * dx)


def _read(xs: np.ndarray, cdf: np.ndarray) -> tuple[Curve, Curve]:
    """A distribution and its quantiles read between the points of a grid."""
    return (lambda x: np.interp(x, xs, cdf, left=0.0, right=1.0)), (lambda p: np.interp(p, cdf, xs))


def _kernel(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Gaussian kernels with Scott's width."""
    h = x.std(ddof=1) * len(x) ** -0.2
    out = np.zeros(len(at))
    for a in range(0, len(x), PIECE):
        out += np.exp(-0.5 * ((at[:, None] - x[None, a : a + PIECE]) / h) ** 2).sum(1)
    return out / (len(x) * h * math.sqrt(2 * math.pi))


def empirical(x: np.ndarray) -> Fit:
    """Shares read between the sorted values; the density is their slope over the range by the number of values."""
    s = np.sort(x)
    shares = np.arange(1, len(s) + 1) / len(s)
    cdf = lambda v: np.interp(v, s, shares, left=0.0, right=1.0)
    return Fit("empirical", _slope(cdf, (s[-1] - s[0]) / (2 * len(s))), cdf, lambda p: np.interp(p, shares, s), {})


def kde(x: np.ndarray) -> Fit:
    """Kernels on a grid of four deviations around the values; between its points all curves are straight."""
    xs = np.linspace(x.min() - 4 * x.std(), x.max() + 4 * x.std(), GRID)
    density = _kernel(x, xs)
    total = np.cumsum(density)
    cdf, quantile = _read(xs, total / total[-1])
    return Fit("kde", lambda v: np.interp(v, xs, density, left=0.0, right=0.0), cdf, quantile, {"bandwidth": float(x.std(ddof=1) * len(x) ** -0.2)})


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def t_cdf(z: np.ndarray, nu: float) -> np.ndarray:
    """Student's distribution, by quadrature over the angle ``atan(z / sqrt(nu))``."""
    z = np.asarray(z, float)
    angle = np.arctan(z / math.sqrt(nu))
    at = angle[..., None] * (_NODES + 1) / 2
    area = (np.cos(at) ** (nu - 1) * _WEIGHTS).sum(-1) * angle / 2
    return np.clip(0.5 + area * math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi), 0, 1)


def _t_logpdf(z: np.ndarray, nu: float) -> np.ndarray:
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - (nu + 1) / 2 * np.log1p(z * z / nu)


def student_t(x: np.ndarray) -> Fit:
    """Degrees of freedom, place and scale of the greatest likelihood (freedom at most 1,000)."""

    def inner(nu: float) -> tuple[float, float, float]:
        loc, scale = float(np.median(x)), float(x.std())
        for _ in range(200):
            w = (nu + 1) / (nu + ((x - loc) / scale) ** 2)
            new = float((w * x).sum() / w.sum())
            wide = math.sqrt(float((w * (x - new) ** 2).mean()))
            done = abs(new - loc) + abs(wide - scale) < 1e-9 * scale
            loc, scale = new, max(wide, 1e-300)
            if done:
                break
        return float(_t_logpdf((x - loc) / scale, nu).sum() - len(x) * math.log(scale)), loc, scale

    log_nu = _best(lambda u: inner(math.exp(u))[0], math.log(0.5), math.log(1000.0), 1e-4)
    nu = math.exp(log_nu)
    _, loc, scale = inner(nu)

    table = np.sinh(np.linspace(-30, 30, 4001))
    known = t_cdf(table, nu)

    def quantile(p: np.ndarray) -> np.ndarray:
        """Newton's steps within the piece of a table that holds the share."""
        p = np.asarray(p, float)
        i = np.clip(np.searchsorted(known, p), 1, len(table) - 1)
        low, high = table[i - 1], table[i]
        z = np.clip(np.interp(p, known, table), low, high)
        for _ in range(8):
            off = t_cdf(z, nu) - p
            low, high = np.where(off < 0, z, low), np.where(off < 0, high, z)
            new = z - off / np.maximum(np.exp(_t_logpdf(z, nu)), 1e-300)
            z = np.where((new >= low) & (new <= high), new, (low + high) / 2)
        return loc + scale * z

    return Fit("student_t", lambda v: np.exp(_t_logpdf((v - loc) / scale, nu)) / scale, lambda v: t_cdf((v - loc) / scale, nu), quantile, {"nu": nu, "loc": loc, "scale": scale})


def _best(f: Callable[[float], float], low: float, high: float, within: float) -> float:
    """Where a function with one peak is greatest (golden section)."""
    g = (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    while high - low > within:
        if fa >= fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
    return (low + high) / 2


def cornish_fisher(x: np.ndarray) -> Fit:
    """Normal quantiles bent by skewness and kurtosis."""
    m = moments(x)

    def quantile(p: np.ndarray) -> np.ndarray:
        z = _probit(np.clip(p, 1e-15, 1 - 1e-15))
        return m.mean + m.std * (z + (z * z - 1) * m.skew / 6 + (z**3 - 3 * z) * m.kurt / 24 - (2 * z**3 - 5 * z) * m.skew**2 / 36)

    share = np.linspace(1e-6, 1 - 1e-6, GRID)
    at = np.maximum.accumulate(quantile(share))
    cdf = lambda v: np.interp(v, at, share, left=0.0, right=1.0)
    return Fit("cornish_fisher", _slope(cdf, m.std / 500), cdf, quantile, {"skew": m.skew, "kurt": m.kurt})


def gaussian_mixture(x: np.ndarray) -> Fit:
    """Two normal parts by expectation-maximisation, from three starts."""

    def climb(m: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        w, before = np.array([0.5, 0.5]), -math.inf
        for _ in range(500):
            p = w * normal_pdf((x[:, None] - m) / s) / s + 1e-300
            total = float(np.log(p.sum(1)).mean())
            if total - before < 1e-9:
                break
            before, r = total, p / p.sum(1, keepdims=True)
            n = r.sum(0) + 1e-12
            m, w = (r * x[:, None]).sum(0) / n, n / n.sum()
            s = np.sqrt((r * (x[:, None] - m) ** 2).sum(0) / n + 1e-6 * x.var())
        return total, w, m, s

    mid, sd = x.mean(), x.std()
    starts = [([mid, mid], [sd / 2, sd * 1.5]), ([mid - sd, mid + sd], [sd / 2, sd / 2]), (np.quantile(x, [0.1, 0.6]), [sd, sd / 2])]
    _, w, m, s = max((climb(np.array(a, float), np.array(b, float)) for a, b in starts), key=lambda got: got[0])
    cdf = lambda v: sum(w[i] * normal_cdf((v - m[i]) / s[i]) for i in range(2))
    xs = np.linspace(x.min() - 4 * sd, x.max() + 4 * sd, GRID)
    _, quantile = _read(xs, cdf(xs))
    params = {f"{name}{i + 1}": float(values[i]) for name, values in (("w", w), ("m", m), ("s", s)) for i in range(2)}
    return Fit("gaussian_mixture", lambda v: sum(w[i] * normal_pdf((v - m[i]) / s[i]) / s[i] for i in range(2)), cdf, quantile, params)


def pareto_tail(y: np.ndarray) -> tuple[float, float]:
    """Shape and scale of the generalised Pareto distribution of excesses with the greatest likelihood.

    For a ratio of shape to scale the best shape is known, so only the ratio is
    searched; a shape below -1 has no greatest likelihood and isn't tried.
    """
    mean, top = float(y.mean()), float(y.max())
    shape = lambda q: float(np.log1p(q * y).mean())

    def gain(q: float) -> float:
        k = shape(q)
        return -math.log(mean) - 1 if abs(q) * mean < 1e-9 else -math.log(k / q) - k - 1 if k > -1 else -math.inf

    tried = np.concatenate([-np.geomspace(1 - 1e-6, 1e-6, 200) / top, [0.0], np.geomspace(1e-6, 1e4, 400) / mean])
    i = int(np.argmax([gain(q) for q in tried]))
    q = _best(gain, tried[max(i - 1, 0)], tried[min(i + 1, len(tried) - 1)], 1e-9 / mean)
    if abs(q) * mean < 1e-9:
        return 0.0, mean
    return shape(q), shape(q) / q


def _pareto_survival(y: np.ndarray, shape: float, scale: float) -> np.ndarray:
    if abs(shape) < 1e-12:
        return np.exp(-y / scale)
    return np.maximum(1 + shape * y / scale, 0) ** (-1 / shape)


def evt_composite(x: np.ndarray, tail: float = 0.10) -> Fit:
    """Pareto tails beyond the ``tail`` quantiles, the values themselves between; a tail of up to five values stays as it is."""
    s = np.sort(x)
    low, high = np.quantile(s, tail), np.quantile(s, 1 - tail)
    sides = {"left": low - s[s < low], "right": s[s > high] - high}
    fits = {side: pareto_tail(y) for side, y in sides.items() if len(y) > 5}
    xs = np.linspace(s[0] - 3 * s.std(), s[-1] + 3 * s.std(), GRID)
    total = np.clip(np.searchsorted(s, xs) / len(s), tail, 1 - tail)
    if "left" in fits:
        total = np.where(xs < low, tail * _pareto_survival(np.maximum(low - xs, 0), *fits["left"]), total)
    if "right" in fits:
        total = np.where(xs > high, 1 - tail * _pareto_survival(np.maximum(xs - high, 0), *fits["right"]), total)
    cdf, quantile = _read(xs, np.maximum.accumulate(total))
    params = {f"{side}_{name}": v for side, f in fits.items() for name, v in zip(("shape", "scale"), f, strict=True)}
    return Fit("evt_composite", _slope(cdf, x.std(ddof=1) / 500), cdf, quantile, params)


METHODS: dict[str, Callable[[np.ndarray], Fit]] = {"empirical": empirical, "kde": kde, "student_t": student_t, "cornish_fisher": cornish_fisher, "gaussian_mixture": gaussian_mixture, "evt_composite": evt_composite}


def auto_method(n: int, skew: float) -> str:
    """The method that suits a sample's size and skewness (fixed values)."""
    if n < 50:
        return "empirical"
    if n < 200:
        return "student_t"
    if n >= 500:
        return "evt_composite"
    return "gaussian_mixture" if abs(skew) > 0.5 else "kde"


def clean(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).ravel()
    return x[np.isfinite(x)]


def fit(x: np.ndarray, method: str = "auto") -> Fit:
    x = clean(x)
    if len(x) < 10:
        raise ValueError(f"{len(x)} values are fewer than 10")
    return METHODS[auto_method(len(x), moments(x).skew) if method == "auto" else method](x)


def kelly(f: Fit, m: Moments, most: float = 2.0, draws: int = 10_000) -> tuple[float, float]:
    """The stake of the greatest mean log growth, and its ratio to a normal distribution's."""
    r = f.quantile(np.random.RandomState(42).uniform(0, 1, draws))
    best = _best(lambda a: float(np.log(np.maximum(1 + a * r, 1e-10)).mean()), 0.0, most, 1e-6)
    gauss = m.mean / m.std**2 if m.std**2 > 1e-12 else 0.0
    return best, best / gauss if abs(gauss) > 1e-12 else 1.0


def compare(x: np.ndarray) -> list[dict]:
    """Every method's likelihood, AIC, 1 % quantile, shortfall and Kelly stake; the smallest AIC first."""
    x = clean(x)
    m, out = moments(x), []
    for name in METHODS:
        f = fit(x, name)
        total = f.log_likelihood(x)
        out.append({"method": name, "log_likelihood": total, "aic": 2 * PARAMETERS[name] - 2 * total, "n_params": PARAMETERS[name], "var_99": float(f.quantile(np.array([0.01]))[0]), "cvar_99": f.shortfall(0.01), "kelly": kelly(f, m)[0]})
    return sorted(out, key=lambda r: r["aic"])


def divergence(x: np.ndarray, method: str = "auto") -> dict:
    """How a sample and its fit differ from the normal distribution with its mean and deviation."""
    x = clean(x)
    m, f = moments(x), fit(x, method)
    at = np.linspace(m.mean - 5 * m.std, m.mean + 5 * m.std, 2000)
    p, q = f.pdf(at), normal_pdf((at - m.mean) / m.std) / m.std
    both = (p > 1e-12) & (q > 1e-12)
    z = (np.sort(x) - m.mean) / m.std
    i = np.arange(1, len(x) + 1)
    logs = np.log(np.maximum(normal_cdf(z), 1e-300)) + np.log(np.maximum(normal_cdf(-z[::-1]), 1e-300))
    darling = float(-len(x) - ((2 * i - 1) * logs).sum() / len(x))
    critical = round(1.092 / (1 + 4 / len(x) - 25 / len(x) ** 2), 3)  # fixed value: 1 %
    shares = np.linspace(0.005, 0.995, 200)
    tail = float(normal_cdf(np.array([-2.0]))[0])
    left, right = float(f.cdf(np.array([m.mean - 2 * m.std]))[0]) / tail, (1 - float(f.cdf(np.array([m.mean + 2 * m.std]))[0])) / tail
    ratio = kelly(f, m)[1]
    fits = abs(m.kurt) < 1 and abs(m.skew) < 0.5 and abs(ratio - 1) < 0.15 and left < 1.5
    if fits:
        advice = "gaussian"
    elif abs(m.skew) < 0.3 and m.kurt > 1:
        advice = "student_t"
    elif abs(m.skew) > 0.5:
        advice = "gaussian_mixture"
    else:
        advice = "evt_composite" if m.n >= 500 else "kde"
    return {
        "method": f.name, "skew": m.skew, "kurt": m.kurt, "kl": float((p[both] * np.log(p[both] / q[both])).sum() * (at[1] - at[0])), "anderson_darling": darling, "ad_p": 0.01 if darling > critical else 0.5,
        "qq_std": float((f.quantile(shares) - m.mean - m.std * _probit(shares)).std()), "tail_left": left, "tail_right": right, "kelly_correction": ratio, "recommended": advice, "gaussian_adequate": fits,
    }


def _each(df: DataFrame, keys: list[str], value: str, run: Callable[[np.ndarray], list[dict]], fields: str) -> DataFrame:
    names = [*keys, "n", *(f.split()[0] for f in fields.split(", "))]
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        x = clean(g[value].to_numpy(float, na_value=math.nan))
        if len(x) < 10 or x.std() == 0:
            return pd.DataFrame(columns=names)
        return pd.DataFrame([[*g[keys].iloc[0], len(x), *r.values()] for r in run(x)], columns=names)

    return df.select(*keys, value).groupBy(*keys).applyInPandas(one, f"{kinds}n long, {fields}")


def compare_fits(df: DataFrame, *, keys: list[str], value: str) -> DataFrame:
    """For each key all six fits with their place by AIC (``rank`` from 1)."""
    run = lambda x: [{**r, "rank": i} for i, r in enumerate(compare(x), 1)]
    return _each(df, keys, value, run, "method string, log_likelihood double, aic double, n_params int, var_99 double, cvar_99 double, kelly double, rank int")


def normal_divergence(df: DataFrame, *, keys: list[str], value: str, method: str = "auto") -> DataFrame:
    """For each key how its fit differs from a normal distribution, and the method advised."""
    return _each(df, keys, value, lambda x: [divergence(x, method)], "method string, skew double, kurt double, kl double, anderson_darling double, ad_p double, qq_std double, tail_left double, tail_right double, kelly_correction double, recommended string, gaussian_adequate boolean")
