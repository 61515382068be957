"""Fits of distributions and volatility models against closed forms and what made the samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from gnomon.operators import distributions as D
from gnomon.operators import statistics


def sample(kind: str, n: int = 3000) -> np.ndarray:
    rng = np.random.default_rng(11)
    if kind == "t":
        return 0.001 + 0.02 * rng.standard_t(4, n)
    if kind == "mixture":
        return np.where(rng.random(n) < 0.7, rng.normal(0.002, 0.01, n), rng.normal(-0.02, 0.04, n))
    return rng.normal(0.001, 0.02, n)


def test_t_distribution_has_its_closed_forms():
    z = np.linspace(-60, 60, 241)
    assert np.allclose(D.t_cdf(z, 1), 0.5 + np.arctan(z) / math.pi, atol=1e-9)
    assert np.allclose(D.t_cdf(z, 2), 0.5 + z / (2 * np.sqrt(2 + z * z)), atol=1e-9)
    assert np.allclose(D.t_cdf(np.linspace(-4, 4, 81), 1000), D.normal_cdf(np.linspace(-4, 4, 81)), atol=1e-3)


@pytest.mark.parametrize("method", sorted(D.METHODS))
@pytest.mark.parametrize("kind", ("t", "mixture", "normal"))
def test_every_fit_is_a_distribution_near_its_sample(method, kind):
    x = sample(kind)
    f = D.fit(x, method)
    at = np.linspace(x.min(), x.max(), 400)
    cdf = f.cdf(at)
    assert f.name == method and (np.diff(cdf) >= -1e-12).all() and 0 <= cdf[0] and cdf[-1] <= 1
    share = np.linspace(0.02, 0.98, 49)
    assert np.allclose(f.cdf(f.quantile(share)), share, atol=0.006)
    if method != "cornish_fisher" or kind == "normal":  # the expansion is no approximation of a body with such tails
        assert np.abs(f.cdf(np.sort(x)) - np.arange(1, len(x) + 1) / len(x)).max() < 0.06
    wide = np.linspace(x.min() - 1, x.max() + 1, 40_001)
    assert abs(np.trapezoid(f.pdf(wide), wide) - 1) < 0.02 and (f.pdf(wide) >= 0).all()
    assert f.shortfall(0.01) < float(f.quantile(np.array([0.01]))[0])


def test_expansion_by_hand():
    x = sample("mixture", 500)
    d = x - x.mean()
    s, k = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3
    z = -2.3263478740408408
    bent = z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    assert D.cornish_fisher(x).quantile(np.array([0.01]))[0] == pytest.approx(x.mean() + x.std(ddof=1) * bent, rel=1e-9)


def test_parameters_come_back():
    t = D.student_t(sample("t")).params
    f, p = D.student_t(sample("t")), np.array([1e-6, 1e-4, 0.01, 0.3, 0.5, 0.9, 1 - 1e-6])
    assert np.allclose(f.cdf(f.quantile(p)), p, rtol=1e-9)
    assert 3.2 < t["nu"] < 5 and abs(t["scale"] - 0.02) < 0.002 and abs(t["loc"] - 0.001) < 0.002
    g = D.gaussian_mixture(sample("mixture", 8000)).params
    calm = min((g["s1"], g["w1"]), (g["s2"], g["w2"]))
    assert abs(calm[0] - 0.01) < 0.002 and abs(calm[1] - 0.7) < 0.06


@pytest.mark.parametrize("shape", (-0.3, 0.0, 0.4))
def test_pareto_tail_has_the_greatest_likelihood(shape):
    u = np.random.default_rng(3).random(4000)
    y = -2 * np.log(u) if shape == 0 else 2 * (u**-shape - 1) / shape
    got = D.pareto_tail(y)
    assert got[0] == pytest.approx(shape, abs=0.06) and got[1] == pytest.approx(2, rel=0.08)

    def gain(k: float, s: float) -> float:
        inside = 1 + k * y / s
        return -math.inf if (inside <= 0).any() else -len(y) * math.log(s) - (1 / k + 1) * np.log(inside).sum()

    top = gain(*(got if abs(got[0]) > 1e-9 else (1e-9, got[1])))
    assert all(top >= gain(got[0] + a, got[1] * b) - 1e-6 for a in (-0.02, 0.02) for b in (0.97, 1, 1.03))


def test_methods_follow_size_and_skew():
    assert [D.auto_method(*q) for q in ((49, 3), (199, 3), (300, 0.6), (300, -0.4), (500, 0.1), (500, 2))] == ["empirical", "student_t", "gaussian_mixture", "kde", "evt_composite", "evt_composite"]
    with pytest.raises(ValueError):
        D.fit(np.arange(9.0))
    with pytest.raises(ValueError):
        D.fit(np.array([1.0, np.nan] * 9))


def test_comparison_and_divergence():
    ranked = [r["method"] for r in D.compare(sample("mixture")) if r["method"] in ("student_t", "gaussian_mixture", "cornish_fisher")]
    assert ranked[0] == "gaussian_mixture"
    far, near = D.divergence(sample("t")), D.divergence(sample("normal"), "kde")
    assert far["anderson_darling"] > 1.092 and far["ad_p"] == 0.01 and near["ad_p"] == 0.5
    assert far["kl"] > near["kl"] and abs(near["tail_left"] - 1) < 0.4 and not far["gaussian_adequate"]
    x = sample("normal", 40)
    z = (np.sort(x) - x.mean()) / x.std(ddof=1)
    slow = -40 - sum((2 * i - 1) / 40 * (math.log(D.normal_cdf(z[i - 1])) + math.log(1 - D.normal_cdf(z[40 - i]))) for i in range(1, 41))
    assert D.divergence(x)["anderson_darling"] == pytest.approx(slow, rel=1e-9)


def test_frames_leave_out_short_flat_and_missing(spark):
    g = pd.concat([pd.DataFrame({"k": "a", "v": sample("t", 300)}), pd.DataFrame({"k": "b", "v": [1.0] * 20}), pd.DataFrame({"k": "c", "v": [1.0, 2.0]}), pd.DataFrame({"k": "a", "v": [math.nan, math.inf]})])
    df = spark.createDataFrame(g)
    fits = D.compare_fits(df, keys=["k"], value="v").collect()
    assert sorted(r["rank"] for r in fits) == [1, 2, 3, 4, 5, 6] and {r["k"] for r in fits} == {"a"} and {r["n"] for r in fits} == {300}
    assert [r["k"] for r in D.normal_divergence(df, keys=["k"], value="v").collect()] == ["a"]
    assert [r["k"] for r in statistics.fit_distributions(df, keys=["k"], value="v").collect()] == ["a"]
    assert D.compare_fits(df.limit(0), keys=["k"], value="v").collect() == []


def test_volatility_models_prefer_what_made_the_series():
    rng = np.random.default_rng(2)
    u, r = 0.0, []
    for _ in range(1500):
        z = rng.normal()
        r.append(math.exp(u / 2) * z)
        u = 0.35 * (abs(z) - math.sqrt(2 / math.pi)) + 0.9 * u
    e = statistics.garch_fit(np.array(r), "EGARCH")
    assert abs(e["alpha"] - 0.35) < 0.12 and abs(e["beta"] - 0.9) < 0.08
    out = statistics.garch_ensemble(np.array(r))
    assert out["best_model"] == "EGARCH" and abs(out["w_garch"] + out["w_egarch"] + out["w_gjr"] - 1) < 1e-12
    assert 0 < out["vol_30d"] < 1 and out["current_vol"] > 0
    h = statistics.egarch_forecast(e["omega"], e["alpha"], e["beta"], 4.0, 3.0, 400)
    assert h[-1] == pytest.approx(math.exp(e["omega"] / (1 - e["beta"])), rel=1e-3)
    with pytest.raises(ValueError):
        statistics.garch_fit(np.ones(100))
