"""The core library: registered queries against SQL, and what SQL can't say against hand traces or numpy."""

from __future__ import annotations

import datetime as dt
import json
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gnomon.functions import calendar, scalars
from gnomon.operators import backtest, baskets, features, folds, indicators, infobars, joins, labels, ml, portfolio, scans, signals, statistics
from gnomon.plans import base, config, logs, plugins, registry, workflow
from gnomon.sources import catalog, loader, readers, sinks, store
from gnomon.streaming import flows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = base.REGISTERED[name](spark, sf_dir)
    cur = duck.execute(base.SQL[name])
    names = [d[0] for d in cur.description]
    order = sorted(names)
    assert order == sorted(df.columns)
    got = Counter(repr(tuple(r[c] for c in order)) for r in df.select(*order).collect())
    assert got == Counter(repr(tuple(r[names.index(c)] for c in order)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    rows = base.REGISTERED[name](spark, sf_dir).collect()
    assert rows or name in ("allocation_methods", "basket_walk_forward", "regime_daily_states")  # so small a table has too few days with all assets


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


# --- folds ----------------------------------------------------------------------------------------------------


def chunks(fold, x, sizes=(1, 2, 5, 3, 50)):
    out, at = [], 0
    for n in [*sizes, len(x)]:
        if at < len(x):
            out.append(fold(x[at : at + n]))
            at += n
    return np.concatenate(out)


@pytest.mark.parametrize("seed", range(3))
def test_folds_match_pandas_however_they_are_cut(seed):
    x = np.random.default_rng(seed).normal(100, 5, 200).cumsum()
    s = pd.Series(x)
    assert np.allclose(chunks(folds.Ema(10), x), s.ewm(span=10, adjust=False).mean())
    assert np.allclose(chunks(folds.EmaAdjusted(10), x), s.ewm(span=10, adjust=True).mean())
    assert np.allclose(chunks(folds.EwmStd(10), x)[1:], s.ewm(span=10, adjust=False).std()[1:])
    assert np.allclose(chunks(folds.Rolling(7, "std"), x)[6:], s.rolling(7).std()[6:])
    assert np.allclose(chunks(folds.Lag(3), x)[3:], x[:-3])
    gaps = np.where(np.arange(200) % 7 == 3, np.nan, x)
    assert np.allclose(chunks(folds.Ema(10), gaps), pd.Series(gaps).ewm(span=10, adjust=False).mean())
    r = chunks(folds.Rma(5), x)
    assert np.isnan(r[:4]).all() and math.isclose(r[4], x[:5].mean()) and math.isclose(r[5], r[4] * 0.8 + x[5] * 0.2)


def test_ordered_fold_keeps_series_apart(spark):
    rows = [(k, i, float(i * (k + 1))) for k in range(5) for i in range(40)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, x double")
    out = indicators.ema(df, keys=["k"], order=["i"], value="x", span=5).toPandas().sort_values(["k", "i"])
    for k, g in out.groupby("k"):
        assert np.allclose(g.ema, pd.Series(g.x.to_numpy()).ewm(span=5, adjust=False).mean())
        assert g.i.tolist() == list(range(40))


def test_spread_carries_until_it_comes_back(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(180 + rng.normal(0, 1, 300).cumsum(), 30 + rng.normal(0, 0.3, 300).cumsum(), strict=True))]
    df = spark.createDataFrame(rows, "k int, i int, close_a double, close_b double")
    got = signals.spread_zscore(df, keys=["k"], order=["i"], weight=3.0, lookback=60, entry=1.0).toPandas().sort_values("i")
    s = pd.Series([a - 3 * b for *_, a, b in rows])
    z = ((s - s.ewm(span=60, adjust=False).mean()) / s.ewm(span=60, adjust=False).std()).fillna(0)
    pos = []
    long = short = 0
    for v in z:
        long = 1 if v <= -1 else 0 if v >= 0.6 else long
        short = -1 if v >= 1 else 0 if v <= -0.6 else short
        pos.append(long + short)
    assert np.allclose(got.zscore, z) and got.signal.tolist() == pos


# --- information bars -----------------------------------------------------------------------------------------

TAPE = [(1, 1000, 100.0, 4000.0, 400_000.0, "buy"), (2, 2000, 101.0, 4000.0, 400_000.0, "sell"), (3, 3000, 99.0, 7.0, 400_000.0, "buy"), (4, 4000, 98.0, 1.0, 100.0, "sell")]


def test_dollar_bar_takes_the_trade_that_closes_it(spark):
    df = spark.createDataFrame([("BTC", *r) for r in TAPE], "asset string, trade_id long, ts_ms long, price double, amount double, quote double, side string")
    bar = infobars.info_bars(df, "dollar", 1_000_000, keys=["asset"]).collect()
    assert len(bar) == 1 and bar[0].tick_count == 3 and bar[0].quote_volume == 1_200_000 and bar[0].end_ms == 3000 and (bar[0].high, bar[0].low) == (101.0, 99.0)


@pytest.mark.parametrize("kind", infobars.KINDS)
def test_stream_and_batch_give_the_same_bars(spark, tmp_path, kind):
    rng = np.random.default_rng(2)
    n = 300
    rows = pd.DataFrame({"asset": rng.choice(["A", "B"], n), "trade_id": range(n), "ts_ms": 1_700_000_000_000 + np.arange(n) * 1000, "price": rng.uniform(90, 110, n), "amount": rng.uniform(1, 5, n), "side": rng.choice(["buy", "sell"], n)})
    rows["quote"] = rows.price * rows.amount
    df = spark.createDataFrame(rows).withColumn("ts", F.timestamp_millis("ts_ms")).select("asset", "ts", "ts_ms", "trade_id", "price", "amount", "quote", "side")
    limit = 30.0 if kind == "volume" else 2000.0
    want = infobars.info_bars(df, kind, limit, keys=["asset"]).toPandas()
    for i in range(3):
        df.where((F.col("trade_id") / 100).cast("int") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = flows.file_stream(spark, df.schema, f"{tmp_path}/in")
    got = flows.run_to_end(infobars.stream_bars(stream, kind, limit, key="asset"), f"bars_{kind}", f"{tmp_path}/cp").toPandas()
    assert len(want) > 5
    both = [x.sort_values(["asset", "bar_index"]).reset_index(drop=True) for x in (got, want)]
    pd.testing.assert_frame_equal(both[0], both[1][both[0].columns], check_dtype=False)
    assert np.isclose(want.base_volume.sum() + 0, want.base_volume.sum())


def test_batches_append_only_what_is_settled(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 12, 0, s)
    rows = spark.createDataFrame([("a", at(1)), ("a", at(5)), ("a", at(20)), ("a", at(25)), ("b", at(2)), ("b", at(29))], "k string, ts timestamp")
    done = spark.createDataFrame([("a", at(1)), ("a", at(5)), ("c", at(9))], "k string, last timestamp")
    found = flows.settled(rows, done, keys=["k"], ts="ts", last="last", now=F.lit("2024-01-01 12:00:55").cast("timestamp")).collect()
    assert sorted((r.k, r.ts.second) for r in found) == [("a", 20), ("b", 2)]


def test_streamed_windows_exits_and_replays(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 1, 0, 0, s), float(s), 100.0 + s, s == 0, "buy" if s % 2 else "sell") for s in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "asset string, ts timestamp, ts_s double, price double, open boolean, side string").withColumn("quote", F.col("price"))
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: flows.file_stream(spark, df.schema, f"{tmp_path}/in")
    once = flows.run_to_end(flows.dedup(read(), keys=["asset", "ts"]), "once", f"{tmp_path}/c1")
    assert once.count() == len(rows)
    flow = flows.run_to_end(flows.windowed_flow(read(), keys=["asset"], late="0 seconds"), "flow", f"{tmp_path}/c2")
    assert [r.n for r in flow.orderBy("start").collect()][:1] == [12]  # the second file comes before the watermark has moved
    exits = flows.run_to_end(flows.keyed_state(read(), key="asset", fields="why string, move double", step=flows.exit_rules(0.04, 0.1, 100), order=["ts_s"]), "exits", f"{tmp_path}/c3").collect()
    assert exits[0].why == "target" and math.isclose(exits[0].move, 0.05)


# --- back-tests -----------------------------------------------------------------------------------------------


def brute_barrier(p, side, b, cost):
    best, armed = p[0], False
    last = min(b.bars, len(p) - 1)
    for i in range(1, last + 1):
        gain = side * (p[i] - p[0]) / p[0]
        why = None
        if armed:
            best = max(best, p[i]) if side == 1 else min(best, p[i])
            why = "trailing_stop" if side * (best - p[i]) / best >= b.trail else None
        elif gain <= -b.stop:
            why = "stop_loss"
        elif gain >= b.target:
            if b.trail == 0:
                why = "take_profit"
            else:
                armed, best = True, p[i]
        if why or i == last:
            return i, why or "vertical_barrier", gain - 2 * cost
    return 0, "vertical_barrier", -2 * cost


def test_barriers_match_a_walk():
    rng = np.random.default_rng(4)
    assert len(backtest.barrier_grid()) == 72
    for b in backtest.barrier_grid()[::5]:
        for side in (1, -1):
            p = 100 * np.exp(rng.normal(0, 0.01, 60).cumsum())
            r = backtest.simulate_trade(p, side, b)
            i, why, net = brute_barrier(p, side, b, 0.0002)
            assert (r["exit_idx"], r["exit_reason"]) == (i, why) and math.isclose(r["net_return"], net)


def test_backtest_figures_match_numpy(spark):
    rng = np.random.default_rng(5)
    px, pos = 100 * np.exp(rng.normal(0, 0.02, 120).cumsum()), rng.choice([-1.0, 0.0, 0.5, 1.0], 120)
    df = spark.createDataFrame([(0, i, float(p), float(q)) for i, (p, q) in enumerate(zip(px, pos, strict=True))], "k int, i int, close double, position double")
    k = {"keys": ["k"], "order": ["i"]}
    res, tr = backtest.vectorised(df, **k), backtest.trades(df, **k)
    m = backtest.metrics(res, tr, **k).first()
    r = pos[:-1] * (np.diff(px) / px[:-1])
    eq = np.concatenate([[1], np.cumprod(1 + r)])
    dd = eq / np.maximum.accumulate(eq) - 1
    assert math.isclose(m.total_return, eq[-1] - 1, rel_tol=1e-9) and math.isclose(m.max_drawdown, dd.min(), rel_tol=1e-9)
    assert math.isclose(m.sharpe, r.mean() / r.std(ddof=1) * 252**0.5, rel_tol=1e-9)
    assert math.isclose(sum(t.return_pct for t in tr.collect()), r.sum(), rel_tol=1e-9)


# --- statistics and portfolios --------------------------------------------------------------------------------


def test_statistics_tell_walks_from_reversion():
    rng = np.random.default_rng(6)
    walk = rng.normal(0, 1, 600).cumsum()
    ar = np.zeros(600)
    for i in range(1, 600):
        ar[i] = 0.7 * ar[i - 1] + rng.normal()
    assert statistics.adf_t(ar)[0] < -3.5 < statistics.adf_t(walk)[0]
    assert statistics.hurst_rs(ar) < statistics.hurst_rs(walk) < 0.75
    assert statistics.variance_profile(ar, 5)[-1] < 0.6 < statistics.variance_profile(walk, 5)[-1]
    y = np.column_stack([walk, 0.5 * walk + rng.normal(0, 0.5, 600)])
    assert statistics.johansen(y)[0][0] > statistics.JOHANSEN_TRACE_95[1]
    m = np.column_stack([2 * walk + rng.normal(0, 0.1, 600), rng.normal(0, 1, 600).cumsum(), walk])
    assert statistics.successive(0, m, 1)[0] == [2]
    assert math.isclose(statistics.interp_percentile(np.arange(1.0, 101.0), 5), 5.0)


def test_surface_is_built_once_and_read_between_points(spark):
    g = statistics.surface_grid(spark, {"n_assets": [3], "n_obs": [60, 80], "n_vars": [1]})
    one = statistics.build_surface(g.where("n_obs = 60"), samples=10).cache()
    assert statistics.missing_points(g, one).count() == 1 and statistics.surface_status(g, one).first().status == "PARTIAL"
    rest = statistics.build_surface(statistics.missing_points(g, one), samples=10)
    again = statistics.build_surface(g, samples=10)
    assert sorted(map(tuple, one.unionByName(rest).collect())) == sorted(map(tuple, again.collect()))


def test_portfolios_hold_their_promises():
    rng = np.random.default_rng(7)
    r = rng.normal(0.001, 0.01, (300, 4)) * np.array([1, 2, 3, 4])
    c = portfolio.covariance(r)
    w = portfolio.risk_parity(c)
    rc = w * (c @ w)
    assert np.allclose(rc, rc.mean(), rtol=1e-6) and np.isclose(w.sum(), 1)
    mv = portfolio.min_variance(c)
    assert mv.min() >= 0 and np.isclose(mv.sum(), 1) and all(mv @ c @ mv <= x @ c @ x + 1e-12 for x in np.eye(4))
    assert (np.linalg.eigvalsh(portfolio.covariance(r, 0.3, "identity", 0.97)) > 0).all()
    assert np.isclose(portfolio.hierarchical(c).sum(), 1) and portfolio.max_sharpe(r.mean(0), c).min() >= 0
    assert portfolio.uncorrelated_subset(np.array([0.9, 0.8, 0.7]), np.array([[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1]])) == [0, 2]


def test_garch_finds_clusters():
    rng = np.random.default_rng(8)
    h, r = 1.0, []
    for _ in range(800):
        r.append(math.sqrt(h) * rng.normal())
        h = 0.1 + 0.15 * r[-1] ** 2 + 0.75 * h
    m = statistics.garch_fit(np.array(r))
    assert 0.05 < m["alpha"] < 0.35 and 0.5 < m["beta"] < 0.9
    f = statistics.garch_forecast(m["omega"], m["alpha"], m["beta"], 4.0, 3.0, 200)
    assert f[0] > f[-1] and math.isclose(f[-1], m["variance"], rel_tol=0.05)


def test_forest_and_phases(spark):
    rng = np.random.default_rng(9)
    rows = [(m, dt.date(2024, 1, 1) + dt.timedelta(d), float(rng.normal()), float(rng.normal())) for m in range(3) for d in range(60)]
    feats = spark.createDataFrame(rows, "model int, day date, f1 double, f2 double")
    configs = spark.createDataFrame([(i, float(i)) for i in range(3)], "config_id long, p double")
    bars = feats.withColumn("close", F.col("f1"))
    rets = ml.grid_returns(bars, configs, lambda g, c: float(g.close.sum() * (c["p"] - 1)), model="model", day="day")
    assert rets.count() == 3 * 60 * 3
    train = ml.training_rows(feats, rets, configs, model="model", day="day")
    fitted = ml.forest(train, ["f1", "f2", "p"], "label", trees=5)
    scored = ml.predict(fitted, feats.crossJoin(configs))
    chosen = ml.choose(scored, model="model", day="day")
    assert chosen.count() == 180
    assert ml.out_of_sample(chosen, rets, model="model", day="day").count() == 60


# --- scalars --------------------------------------------------------------------------------------------------


def test_ids_prices_and_pools(spark):
    row = spark.createDataFrame([("EQUITY|TICKER|AAPL",)], "bpk string").select(scalars.base_id("bpk").alias("i"), scalars.valid_business_key(F.col("bpk")).alias("v")).first()
    assert row.i == -8071290226336435521 and row.v
    ids = {"ticker": F.lit("AAPL"), "isin": F.lit("US0378331005"), "figi": F.lit("BBG000B9XRY4"), "cusip": F.lit("")}
    keys = spark.range(1).select(scalars.business_key(F.lit("equity"), ids).alias("a"), scalars.business_key(F.lit("ETF"), {"figi": F.lit("F"), "cusip": F.lit("C")}).alias("b"), scalars.business_key(F.lit("FX"), ids).alias("c")).first()
    assert tuple(keys) == ("EQUITY|ISIN|US0378331005", "ETF|CUSIP|C", None)
    bad = spark.createDataFrame([(x,) for x in ("EQUITY|ISIN|", "EQUITY|ISIN", " EQUITY|ISIN|X", "STOCK|ISIN|X", "", None)], "k string")
    assert not any(r[0] for r in bad.select(scalars.valid_business_key(F.col("k"))).collect())
    p = scalars.bs_price_np([100.0], [100.0], [1.0], 0.05, [0.2])[0]
    assert math.isclose(p, 10.4506, abs_tol=1e-4)
    call, put = (scalars.bs_price_np([100.0], [90.0], [0.5], 0.03, [0.3], 0.0, c)[0] for c in (True, False))
    assert math.isclose(call - put, 100 - 90 * math.exp(-0.015), rel_tol=1e-9)
    assert math.isclose(scalars.implied_vol_np(np.array([call]), 100.0, 90.0, 0.5, 0.03)[0], 0.3, abs_tol=1e-6)
    g = scalars.bs_greeks_np(np.array([100.0]), 100.0, 1.0, 0.05, 0.2)
    up, down = (scalars.bs_price_np([s], [100.0], [1.0], 0.05, [0.2])[0] for s in (100.01, 99.99))
    assert math.isclose(g["delta"][0], (up - down) / 0.02, abs_tol=1e-6)
    out, after = scalars.swap_output(scalars.Q96, 10**24, 10**18, 3000, True)
    assert after < scalars.Q96 and 0.996 * 10**18 < out < 0.9971 * 10**18


def test_calendar_and_cron():
    assert calendar.cron_field("*/15", 0, 59) == {0, 15, 30, 45} and calendar.cron_field("1-3,7", 0, 7) == {1, 2, 3, 7}
    assert calendar.cron_matches("0 9 * * 7", dt.datetime(2024, 1, 7, 9, 0)) and calendar.cron_matches("0 9 * * 0", dt.datetime(2024, 1, 7, 9, 0))
    assert not calendar.cron_matches("0 9 * * 1", dt.datetime(2024, 1, 7, 9, 0))


def test_easter_over_the_years(spark):
    got = {r.y: r.e for r in spark.createDataFrame([(y,) for y in (2000, 2016, 2024, 2025, 2038)], "y int").select("y", calendar.easter(F.col("y")).alias("e")).collect()}
    assert got == {2000: dt.date(2000, 4, 23), 2016: dt.date(2016, 3, 27), 2024: dt.date(2024, 3, 31), 2025: dt.date(2025, 4, 20), 2038: dt.date(2038, 4, 25)}


def test_conditions_and_references():
    out = {"a": {"b": {"c": 3, "s": "x"}}}
    assert scalars.resolve("a.b.c", out) == 3
    assert scalars.condition("a.b.c >= 3", out) and not scalars.condition("a.b.c < 3", out) and scalars.condition("a.b.s == 'x'", out)


# --- store ----------------------------------------------------------------------------------------------------


def test_catalog_views_and_guard(spark):
    t0 = dt.datetime(2024, 1, 1)
    sec = spark.createDataFrame([(t0, 1, "k", "EQUITY", *[None] * 13), (t0 + dt.timedelta(days=5), 1, "k", "ETF", *[None] * 13)], catalog.schema("dim_security"))
    made = catalog.bootstrap(spark, {"dim_security": sec})
    assert len(made) == 22 and spark.table("vew_security").first().sec_type == "ETF"
    iv = spark.table("vt2_security").orderBy("start_date").collect()
    assert [(r.start_date, r.end_date) for r in iv] == [(dt.date(2024, 1, 1), dt.date(2024, 1, 5)), (dt.date(2024, 1, 6), dt.date(9999, 12, 31))]
    assert catalog.describe(spark).where("`table` = 'fact_price_daily'").count() == 13
    df, n = catalog.read_only(spark, "SELECT 'drop table' AS x FROM dim_security;", 5000)
    assert df.count() == 2 and n == 2000
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "EXPLAIN SELECT 1", "with a as (select 1) insert into b select * from a"):
        with pytest.raises(ValueError):
            catalog.read_only(spark, bad)


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 7), (3, "e", 8)], "k int, v string, n int")
    assert sorted(map(tuple, sinks.insert_ignore(old, new, keys=["k"], order=["n"]).collect())) == [(3, "d", 7)]
    assert sorted(map(tuple, sinks.insert_replace(old, new, keys=["k"], order=["n"]).collect())) == [(1, "a", 10), (2, "c", 5), (3, "e", 8)]
    up = sinks.upsert(old, new.where("n <> 8"), keys=["k"], merge={"n": lambda a, b: a + b})
    assert sorted(map(tuple, up.collect())) == [(1, "a", 10), (2, "c", 25), (3, "d", 7)]
    stage = spark.createDataFrame([(1, "pending"), (2, "done")], "k int, process_status string")
    assert not sinks.safe_to_wipe(stage) and sinks.safe_to_wipe(sinks.set_status(stage, F.col("k") == 1, "done"))
    merged, filled, clash = sinks.fill_missing(spark.createDataFrame([(1, None, "x")], "k int, a string, b string"), spark.createDataFrame([(1, "n", "y")], "k int, a string, b string"), key="k", fields=["a", "b"])
    assert tuple(merged.first()) == (1, "n", "x") and filled.first().field == "a" and clash.first().incoming == "y"
    fixed, check = sinks.rebuild(spark.createDataFrame([(1, 1700000000, "?")], "id int, ts long, iso string"), seconds="ts", text="iso", key=["id"])
    assert fixed.first().iso == "2023-11-14T22:13:20Z" and check.first().ok


def test_readers(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,2,0.5,1.5,100\n")
    assert readers.prices_csv(spark, str(tmp_path / "AAA.csv")).first().ticker == "AAA"
    (tmp_path / "p.json").write_text(json.dumps([{"target": "A", "hedge": "B", "score": 1.0}, {"target": "B", "hedge": "A", "score": 2.0}, {"target": "C", "hedge": "D", "score": 1.5}]))
    assert [tuple(r) for r in readers.pairs_json(spark, str(tmp_path / "p.json"), 1).collect()] == [("B", "A", 2.0)]
    (tmp_path / "e.md").write_text("# T\n\n## First\n**Status:** done\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## Second\ntext\n")
    rows = readers.experiments_markdown(spark, str(tmp_path / "e.md")).orderBy("n").collect()
    assert [r.title for r in rows] == ["First", "Second"] and rows[0].fields == {"Status": "done"} and rows[0].bullets == ["one", "two"] and rows[0].tables == [["a", "b"], ["1", "2"]]
    (tmp_path / "cap.txt").write_text("===== 1\nGET /x\nbody\nmore\n===== 2\nPOST\nz\n")
    assert [(r.header, r.payload) for r in readers.captures(spark, str(tmp_path / "cap.txt")).collect()] == [("GET /x", "body\nmore"), ("POST", "z")]
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert readers.cached_parquet(spark, f"{tmp_path}/c", make).count() == 3
    assert len(calls) == 1
    spark.dataSource.register(readers.PriceProvider)
    got = spark.read.format("gnomon_prices").option("tickers", "A,B").option("rows", 10).load()
    assert got.count() == 20 and got.rdd.getNumPartitions() == 2
    walks = readers.random_walks(spark, 2, 50)
    assert walks.collect() == walks.collect() and readers.synthetic_bars(walks).where("low > high OR weekday(date) > 4").count() == 0
    a = spark.createDataFrame([("A", 1)], "k string, v int")
    b = spark.createDataFrame([("A", 9), ("B", 2)], "k string, v int")
    assert sorted(map(tuple, readers.cascade(b.select("k"), [a, b], keys=["k"]).collect())) == [("A", 1), ("B", 2)]


# --- orchestration --------------------------------------------------------------------------------------------


def test_workflow_conditions_loops_and_failures():
    S = workflow.Step
    done = workflow.run_workflow([
        S("load", lambda o, i: {"n": 3}), S("loop", lambda o, i: i * 2, ["load"], for_each="items", parallel=True), S("items", lambda o, i: [1, 2, 3]),
        S("skip", lambda o, i: 1, ["load"], when="load.n > 5"), S("bad", lambda o, i: 1 / 0), S("after", lambda o, i: 1, ["bad"]), S("far", lambda o, i: 1, ["after"]),
    ])
    assert done["loop"]["output"] == [2, 4, 6] and done["skip"]["status"] == "skipped" and [done[x]["status"] for x in ("bad", "after", "far")] == ["failed", "skipped", "skipped"]
    with pytest.raises(ValueError):
        workflow.order([S("a", print, ["b"]), S("b", print, ["a"])])


def test_schedules_states_and_plugins(spark, sf_dir):
    jobs = [workflow.Job("x", "* * * * *", lambda: 1 / 0), workflow.Job("y", "0 5 * * *", lambda: None)]
    for _ in range(4):
        workflow.tick(jobs, dt.datetime(2024, 1, 1, 4, 0))
    assert not jobs[0].active and jobs[0].failures == 3
    assert workflow.transition(None, "draft") == "DRAFT" and workflow.transition("ACTIVE", "paused") == "PAUSED"
    for state, to in (("RETIRED", "ACTIVE"), (None, "ACTIVE"), ("DRAFT", "PAUSED")):
        with pytest.raises(ValueError):
            workflow.transition(state, to)
    moves = [("a", 1, "DRAFT"), ("a", 2, "ACTIVE"), ("a", 3, "DRAFT"), ("a", 4, "error"), ("b", 1, "ACTIVE"), ("b", 2, None)]
    found = workflow.lifecycle(spark.createDataFrame(moves, "m string, t int, s string"), key="m", ts="t", state="s").collect()
    assert {r.m: (r.state, r.moves, r.rejected) for r in found} == {"a": ("ERROR", 4, 1), "b": (None, 2, 2)}
    r = plugins.defaults()
    with pytest.raises(ValueError):
        plugins.load_user_code("import os", r)
    code = "from pyspark.sql import functions as F\nclass Up(SignalTemplate):\n    name = 'up'\n    def generate(self, df, *, keys, order, **p):\n        return df.withColumn('signal', F.lit(1))\n"
    assert plugins.load_user_code(code, r) == ["up"]
    c = config.ModelConfig.from_dict({"name": "m", "signal": {"name": "up"}})
    out = workflow.run_model(c, base.bars(spark, sf_dir), keys=["asset"], order_by=["ts"], registry=r)
    assert out["metrics"].count() == 5 and out["metrics"].first().config_hash == c.content_hash()
    assert config.ModelConfig.from_dict({"name": "m", "signal": {"name": "up"}, "source": "z"}).content_hash() == c.content_hash()
    with pytest.raises(ValueError):
        config.ModelConfig.from_dict({"name": "m", "signal": {"name": "up"}, "kind": "?"})
    assert plugins.ParamSpec("n", int, 10, 5, 20, 5).values() == [5, 10, 15, 20]


def test_labels_and_scans(spark):
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate([100.0, 101.0, 103.0, 99.0, 90.0])], "k int, i int, p double")
    got = labels.triple_barrier(df, keys=["k"], order=["i"], price="p", up=0.02, down=0.05, bars=2).orderBy("i").collect()
    assert [(r.barrier, r.bars_held, r.label) for r in got] == [("profit", 2, 1), ("time", 2, -1), ("loss", 2, -1), ("loss", 1, -1), (None, None, None)]
    row = spark.createDataFrame([("Who will be the next chair?",), ("Top 4 finish",), ("BTC above $100k",)], "t string").select(*scans.event_structure(F.col("t"))).collect()
    assert [r.k for r in row] == [1, 4, 0]


def test_load_lifecycle_and_store(spark, tmp_path):
    d = dt.date(2024, 1, 2)
    rows = spark.createDataFrame([("A", d, 1.0, 2.0, 0.5, 1.5, 10), ("A", d, 1.0, 2.0, 0.5, 1.6, 10), ("B", d, 1.0, 0.5, 2.0, 1.0, 5), ("C", d, 1.0, 2.0, 0.5, 1.0, 5)], "symbol string, date date, open double, high double, low double, close double, volume long")
    sec = spark.createDataFrame([(1, "A"), (2, "B")], "base_id long, ticker string")
    old = spark.createDataFrame([], "security_base_id long, trade_date date")
    out = loader.load(rows, sec, old, batch="b1", now=F.lit("2024-01-03").cast("timestamp"))
    assert {r.process_status: r["rows"] for r in out["report"].collect()} == {"loaded": 2, "rejected": 2}
    assert out["facts"].count() == 1 and sinks.safe_to_wipe(out["archive"])
    tape = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "k string, i long")
    assert sorted(map(tuple, loader.incremental(tape, keys=["k"], order="i", seen=loader.high_water(tape.where("i = 1 AND k = 'A'"), keys=["k"], order="i")).collect())) == [("A", 2), ("B", 1)]
    live = store.LiveStore(spark, f"{tmp_path}/live")
    now = dt.datetime(2024, 1, 1)
    order = spark.createDataFrame([("o1", "m", "A", "buy", "market", 1.0, 2.0, "new", now)], store.TABLES["orders"])
    live.put("orders", order)
    live.set_order_status("o1", "filled")
    assert live.orders("m", "filled").count() == 1 and live.orders("m", "new").count() == 0 and live.read("fills").count() == 0


def test_logs(spark, tmp_path):
    ring, sink, router = logs.Ring(3), logs.TableSink(spark, f"{tmp_path}/log", 2), logs.Router()
    router.route("*", 0, ring)
    router.route("trade", 20, sink)
    for i in range(5):
        router.write(logs.record(10 * i, f"m{i}", {"trade"} if i % 2 else {"other"}, i=i))
    sink.flush()
    table = spark.read.parquet(f"{tmp_path}/log")
    assert [r["message"] for r in ring.records()] == ["m2", "m3", "m4"] and table.count() == 1 and logs.search(table, tags=["trade"], level=30, contains="m3").count() == 1
    assert json.loads(logs.as_json(ring.records()[0]))["message"] == "m2" and "m2" in logs.as_text(ring.records()[0])


def test_baskets_and_chains(spark):
    rng = np.random.default_rng(10)
    m = rng.normal(0, 1, (400, 4)).cumsum(0)
    m[:, 0] = m[:, 1] + rng.normal(0, 0.3, 400)
    good = baskets.validate_oos(m[:200], m[200:], 0, 1)
    assert good["basket"] == [1] and good["holds"]
    mean, inv = baskets.vr_null(n_obs=150, n_assets=4, n_vars=1, samples=30, last=5)
    ar = rng.normal(0, 1, 400)
    assert baskets.vr_significance(ar, mean, inv) > baskets.vr_significance(rng.normal(0, 1, 400).cumsum(), mean, inv)
    df = spark.createDataFrame([(1, -3.0), (2, 0.0)], "id int, t double")
    assert [round(r.composite, 6) for r in baskets.composite_p(df, {"t": ([-4.0, -2.0, 0.0], [0.01, 0.05, 1.0], 1.0)}).orderBy("id").collect()] == [0.97, 0.0]
    w = baskets.model_of_models(rng.normal([0.01, -0.01, 0.005], 0.02, (300, 3)))
    assert w[1] == 0 and 0 < w.sum() <= 1 + 1e-9
    chain = spark.createDataFrame([("X", 30, 1.0, 0.5), ("X", 30, 0.9, 0.6), ("X", 30, 1.1, 0.55), ("X", 90, 1.0, 0.45)], "k string, expiry_days int, moneyness double, iv double")
    r = scans.surface_features(chain, keys=["k"]).first()
    assert (r.atm_iv, round(r.skew, 6), round(r.term_slope, 6)) == (0.5, 0.05, -0.05)
    q = scans.depth_quote(scalars.Q96, 10**24, 500, scalars.Q96, 10**24, 500, 10**18)
    assert q["net"] < 0 and 0 < q["impact_a"] < 1e-4


def test_critical_values_come_from_enough_draws(spark, sf_dir):
    got = {}
    for r in base.REGISTERED["critical_value_surface"](spark, sf_dir).collect():
        got.setdefault(r["point"], {})[r["pct"]] = r["value"]
    assert len(got) == 8 and all(v[1.0] < v[5.0] < v[10.0] for v in got.values())


def test_garch_models_cover_all_series(spark, sf_dir):
    want = {r["asset"] for r in base.daily(spark, sf_dir).select("asset").distinct().collect()}
    assert {r["asset"] for r in base.REGISTERED["garch_models"](spark, sf_dir).collect()} == want and len(want) == 5


def test_sample_weights_cover_all_bars(spark, sf_dir):
    got = base.REGISTERED["sample_weights"](spark, sf_dir)
    assert got.count() == base.bars(spark, sf_dir).count() and got.where("weight IS NULL").count() == 0


def test_bar_features_by_hand_over_many_batches(spark):
    rng = np.random.default_rng(5)
    close = 50 + np.cumsum(rng.normal(size=900))
    close[300:340] = close[300]
    bars = pd.DataFrame({"k": "a", "i": np.arange(900), "high": close + rng.random(900), "low": close - rng.random(900), "close": close, "volume": rng.integers(1, 9, 900).astype(float)})
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        got = features.bar_features(spark.createDataFrame(bars), keys=["k"], order=["i"], lookbacks=(12, 700)).toPandas().set_index("i")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    h, lo, c, v = (bars[x].to_numpy() for x in ("high", "low", "close", "volume"))
    typical, mid = (h + lo + c) / 3, (h + lo) / 2

    def ema(xs, span):
        y = xs[0]
        for x in xs[1:]:
            y += 2 / (span + 1) * (x - y)
        return y

    for n, at in ((12, 5), (12, 9), (12, 11), (12, 12), (12, 330), (12, 899), (700, 400), (700, 699), (700, 700), (700, 899)):
        w, moves = slice(max(0, at - n + 1), at + 1), range(max(1, at - n + 1), at + 1)
        full, more, p = at + 1 >= n, at + 1 > n, max(3, min(14, n // 3))
        tr = [max(h[j], c[j - 1]) - min(lo[j], c[j - 1]) for j in moves]
        up, down = [max(h[j] - h[j - 1], 0) for j in moves], [max(lo[j - 1] - lo[j], 0) for j in moves]
        plus, minus = [u if u > d else 0 for u, d in zip(up, down, strict=True)], [d if d > u else 0 for u, d in zip(up, down, strict=True)]
        index = []
        for j in range(len(moves)):
            a, b = (100 * ema(x[: j + 1], p) / (ema(tr[: j + 1], p) + 1e-10) for x in (plus, minus))
            index.append(100 * abs(a - b) / (a + b + 1e-10))
        pos, neg = (sum(typical[j] * v[j] for j in moves if s * (typical[j] - typical[j - 1]) > 0) for s in (1, -1))
        sd = np.std(c[w], ddof=1)
        want = {
            "bb_zscore": (c[at] - c[w].mean()) / sd if full and sd > 1e-12 else 0, "bb_bandwidth": 4 * sd / c[w].mean() if full else 0,
            "mfi": 50 if not more else 100 if neg == 0 else 100 * pos / (pos + neg), "force_index": ema([(c[j] - c[j - 1]) * v[j] for j in moves], n) / (c[w] * v[w]).mean() if more else 0,
            "donchian_width": (h[w].max() - lo[w].min()) / c[at] if full else 0, "atr": ema(tr, n) / c[at] if more else 0,
            "awesome_osc": (mid[at + 1 - max(5, n // 7) : at + 1].mean() - mid[w].mean()) / mid[w].mean() if full else 0, "adx": ema(index, p) if at + 1 >= 3 * p else 25,
        }
        assert {f"{x}_{n}": pytest.approx(y, abs=1e-8) for x, y in want.items()} == {f"{x}_{n}": got.loc[at, f"{x}_{n}"] for x in want}
    assert len(features.feature_names()) == 112


def test_spikes_of_prices_at_zero(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("a", at(0), 0.0), ("a", at(1), 50.0), ("a", at(2), 0.0), ("a", at(3), 60.0), ("a", at(4), 0.0)]
    s = scans.spikes(spark.createDataFrame(rows, "k string, ts timestamp, p double"), keys=["k"], ts="ts", price="p", minutes=60, threshold_pct=50.0, lowest=0.0, highest=100.0)
    got = {r.ts.minute: (r.start_price, r.peak_price, r.pct, r.direction, r.reversion_pct) for r in s.collect()}
    assert got == {1: (50.0, 0.0, -100.0, "DOWN", 0.0), 3: (60.0, 0.0, -100.0, "DOWN", 0.0)}


def test_spike_features_against_prices_of_zero_and_of_one_second(spark):
    at = lambda s, us=0: dt.datetime(2024, 1, 1, 0, 0, s, us)
    rows = [(1, at(0), 0.0), (2, at(1, 900), 8.0), (3, at(1, 100), 5.0), (4, at(1, 900), 4.0), (5, at(3), 2.0)]
    f = features.spike_features(spark.createDataFrame([("a", *r) for r in rows], "k string, id int, ts timestamp, p double").repartition(1), keys=["k"], ts="ts", price="p", minutes=(0, 1), tolerance=1)
    assert {r.id: r.ret_0m for r in f.select("id", "ret_0m").collect()} == {1: 0.0, 2: 0.0, 3: 5 / 8 - 1, 4: -0.5, 5: 0.0}
    later = spark.createDataFrame([("a", 1, at(0), 0.0), ("a", 2, dt.datetime(2024, 1, 1, 0, 1), 7.0)], "k string, id int, ts timestamp, p double")
    f = features.spike_features(later, keys=["k"], ts="ts", price="p", minutes=(1, 5)).orderBy("id").collect()
    assert [(r.ret_1m, r.ret_5m, r.velocity, r.acceleration) for r in f] == [(None, None, None, None), (0.0, None, 0.0, None)]


def test_log_return_to_zero_is_clipped_low(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0), (2, 2.0, 2.0), (3, 1.0, 0.0), (4, 0.0, 0.0), (5, None, 1.0), (6, -1.0, 1.0)], "id int, a double, b double")
    r = scalars.log_return(F.col("a"), F.col("b"))
    got = {x.id: (x.r, x.c) for x in rows.select("id", r.alias("r"), scalars.clip(r, -1.0, 1.0).alias("c")).collect()}
    assert got == {1: (-math.inf, -1.0), 2: (0.0, 0.0), 3: (None, 1.0), 4: (None, 1.0), 5: (None, 1.0), 6: (None, 1.0)}


def test_windowed_whales_are_high_outliers_only(spark, tmp_path):
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    totals = [500.0, 501.0, 502.0, 503.0, 504.0, 30.0, 590.0, 700.0, 10.0]
    tape = [("a", hour(h), x, "buy") for h, x in enumerate(totals)] + [("b", hour(0), 900.0, "sell")]
    rows = spark.createDataFrame(tape, "asset string, ts timestamp, quote double, side string")
    w = scans.windowed_whales(rows, keys=["asset"], seconds=3600, always=600.0, never=20.0)
    assert {(r.asset, r.total, r.reason, r.middle) for r in w.collect()} == {("a", 590.0, "statistical", 7), ("a", 700.0, "always_floor", 7), ("b", 900.0, "always_floor", 0)}

    # few windows in the middle zone, one of them low; and an asset with none there
    events = [(i, hour(h), i, asset, x, "") for i, (asset, h, x, _) in enumerate((a, t.hour, x, s) for a, t, x, s in tape)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.connect().execute(base.SQL["windowed_whales"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert Counter(map(tuple, base.REGISTERED["windowed_whales"](spark, str(tmp_path)).collect())) == Counter(want) != Counter()


@pytest.mark.parametrize("newest", [False, True])
def test_nearest_makes_no_pairs(spark, newest):
    rng, start, second = random.Random(3), 1704067200_000_000, 1_000_000
    key = lambda: rng.choice(["a", "a", "b", None])
    when = lambda: rng.choice([None, *(start + rng.choice([rng.randrange(40), rng.randrange(40) * 5 * second, rng.randrange(100 * second)]) for _ in range(6))])
    left = [(key(), i // 2 if i < 40 else i, when()) for i in range(300)]  # some ids name two rows
    right = [(key(), i, when()) for i in range(300)]
    frame = lambda rows, i, t: spark.createDataFrame(rows, f"k string, {i} long, us long").select("k", i, F.timestamp_micros("us").alias(t))
    j = joins.nearest(frame(left, "probe", "ts"), frame(right, "id", "rts"), keys=["k"], left_id="probe", ts="ts", right_ts="rts", right_id="id", tolerance=5, newest=newest)
    best: dict = {}
    for k, probe, t in left:
        for k2, i, r in right:
            if k is not None and k == k2 and t is not None and r is not None and abs(t - r) <= 5 * second:
                best.setdefault((k, probe), []).append((-r, -i, i) if newest else (abs(t - r), i, i))
    assert Counter((r.k, r.probe, r.id) for r in j.collect()) == Counter((*k, min(v)[2]) for k, v in best.items())
    assert "Join" not in j._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["bucket_flow", "windowed_whales"])
def test_buckets_before_1970_match_sql(spark, tmp_path, name):
    start, rng = dt.datetime(1970, 1, 1), random.Random(5)
    times = [start + dt.timedelta(seconds=rng.randrange(-40000, 40000), microseconds=rng.randrange(1_000_000)) for _ in range(300)]
    times += [start + dt.timedelta(hours=h, microseconds=us) for h in (-2, -1, 0, 1) for us in (-1000, -500, -1, 0, 1, 500, 1000)]
    events = [(i, at, rng.randrange(9), rng.choice("ab"), rng.choice([0.0, 13.01, 55.5, 300.0]), "") for i, at in enumerate(times)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"SET timezone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(base.SQL[name].replace("epoch_ms(ts)", "epoch_ms(ts::TIMESTAMP)")).fetchall()
    assert Counter(map(tuple, base.REGISTERED[name](spark, str(tmp_path)).collect())) == Counter(want) != Counter()
