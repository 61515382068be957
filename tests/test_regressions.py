"""Regressions from moments against the same on whole series in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gnomon.operators import baskets, regressions, statistics

XS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def walks():
    out = []
    for k, n in enumerate((160, 90, 240)):
        rng = np.random.default_rng(k)
        x = rng.normal(0, 1, (n, 3)).cumsum(0) + 50
        y = 2 * x[:, k] - 0.5 * x[:, (k + 1) % 3] + rng.normal(0, 0.5, n) + (rng.normal(0, 1, n).cumsum() if k == 1 else 0)
        out.append(pd.DataFrame({"k": f"s{k}", "i": np.arange(n), "y": y, **{c: x[:, j] for j, c in enumerate(XS)}}))
    return out


@pytest.fixture(scope="module")
def frame(spark, walks):
    rows = spark.createDataFrame(pd.concat(walks).sample(frac=1, random_state=1))
    blank = rows.limit(1).select(F.lit("s0").alias("k"), F.lit(1_000_000).cast("long").alias("i"), F.lit(None).cast("double").alias("y"), *XS)
    return rows.unionByName(blank).withColumn("extra", F.lit("n"))


def by_key(df):
    return {r["k"]: r for r in df.collect()}


def test_ridge(frame, walks):
    got = by_key(regressions.ridge(frame, keys=["k"], y="y", xs=XS, alpha=0.3))
    for g in walks:
        r = got[g.k[0]]
        assert r["n"] == len(g) and np.allclose([r["b_x0"], r["b_x1"], r["b_x2"], r["const"]], statistics.ridge(g.y.to_numpy(), g[XS].to_numpy(), 0.3), rtol=1e-6)
    with pytest.raises(ValueError):
        regressions.ridge(frame, keys=["k"], y="y", xs=XS, alpha=0)


def test_stepwise(frame, walks):
    for n in (1, 2, 3):
        got = by_key(regressions.stepwise(frame, keys=["k"], y="y", xs=XS, n=n))
        for g in walks:
            chosen, coef, _ = statistics.successive(0, g[["y", *XS]].to_numpy(), n)
            r = got[g.k[0]]
            assert r["chosen"] == [XS[c - 1] for c in chosen] and np.allclose([*r["weights"], r["const"]], coef, rtol=1e-5)


@pytest.mark.parametrize("lags", (0, 1, 2))
def test_johansen(frame, walks, lags):
    got = by_key(regressions.johansen(frame.where("y is not null"), keys=["k"], order=["i"], columns=["y", "x0", "x1"], lags=lags))
    for g in walks:
        trace, largest = statistics.johansen(g[["y", "x0", "x1"]].to_numpy(), lags)
        r = got[g.k[0]]
        assert np.allclose(r["trace"], trace, rtol=1e-5) and np.allclose(r["max_eig"], largest, rtol=1e-5, atol=1e-6)
        assert r["rank"] == next((i for i in range(3) if trace[i] <= statistics.JOHANSEN_TRACE_95[2 - i]), 3)


@pytest.mark.parametrize("most", (0, 1, 6))
def test_adf(frame, walks, most):
    got = by_key(regressions.adf(frame, keys=["k"], order=["i"], value="x1", max_lag=most))
    for g in walks:
        x = g.x1.to_numpy()
        if g.k[0] == "s0":
            x = np.append(x, frame.where("i = 1000000").first()["x1"])
        t, lags = statistics.adf_t(x, most)
        assert got[g.k[0]]["lags"] == lags and got[g.k[0]]["adf_t"] == pytest.approx(t, rel=1e-5)


def test_baskets_hold_out_of_sample(frame, walks):
    got = by_key(regressions.validate(frame, keys=["k"], order=["i"], y="y", xs=XS, n=2, held_out=F.col("i") % 240 >= 60, max_lag=3))
    for g in walks:
        m = g[["y", *XS]].to_numpy()
        chosen, _, resid = statistics.successive(0, m[:60], 2)
        x = m[60:][:, chosen]
        after = m[60:, 0] - np.column_stack([x, np.ones(len(x))]) @ statistics.ridge(m[60:, 0], x)
        r = got[g.k[0]]
        assert r["chosen"] == [XS[c - 1] for c in chosen]
        assert r["adf_in"] == pytest.approx(statistics.adf_t(resid, 3)[0], rel=1e-4)
        assert r["adf_out"] == pytest.approx(statistics.adf_t(after, 3)[0], rel=1e-4)
        assert r["holds"] == (r["adf_out"] < -2.58)
    assert baskets.validate_oos(walks[0][["y", *XS]].to_numpy()[:80], walks[0][["y", *XS]].to_numpy()[80:], 0, 2)["basket"]


def test_empty_short_flat_and_null_keys(spark):
    kind = "k string, i long, y double, x0 double, x1 double, x2 double"
    none = spark.createDataFrame([], kind)
    flat = spark.createDataFrame([(None, i, 1.0, 2.0, 2.0, 2.0) for i in range(4)] + [("n", 0, None, 1.0, 1.0, 1.0)], kind)
    o = {"keys": ["k"], "order": ["i"]}
    for run in (
        lambda d: regressions.ridge(d, keys=["k"], y="y", xs=XS),
        lambda d: regressions.stepwise(d, keys=["k"], y="y", xs=XS, n=2),
        lambda d: regressions.johansen(d, **o, columns=["y", "x0"]),
        lambda d: regressions.adf(d, **o, value="y", max_lag=2),
        lambda d: regressions.validate(d, **o, y="y", xs=XS, n=1, held_out=F.col("i") > 1, max_lag=0),
    ):
        assert run(none).collect() == []
        assert [r["k"] for r in run(flat).collect()] == [None]
    assert regressions.adf(flat, **o, value="y", max_lag=2).first()["adf_t"] is None
