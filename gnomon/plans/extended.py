"""Feature vectors, carry, paper accounts, baskets, composites and the query service as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import MOVES
from ..operators import baskets, carry, features, paper, signals, statistics, windows
from .base import BARS, DAILY, TRADES, bars, daily, query, t, trades
from .param_grids import literal

K = {"keys": ["asset"], "order": ["ts"]}


def _vector_sql(rows: str, n: int, leg: str = "") -> str:
    """The eight indicators over a lookback, each row's frame walked through as a list."""
    p = max(3, min(14, n // 3))
    ema = lambda of, span: f"(2.0::DOUBLE / {span + 1} * e.{of} + {span - 1}.0::DOUBLE / {span + 1} * s.{of})"
    dx = lambda r, u, d: f"(100 * abs(100 * {u} / ({r} + 1e-10) - 100 * {d} / ({r} + 1e-10)) / (100 * {u} / ({r} + 1e-10) + 100 * {d} / ({r} + 1e-10) + 1e-10))"
    walk = f"{{'f': {ema('f', n)}, 't': {ema('t', n)}, 'r': {ema('r', p)}, 'u': {ema('u', p)}, 'd': {ema('d', p)}, 'x': 2.0::DOUBLE / {p + 1} * {dx(ema('r', p), ema('u', p), ema('d', p))} + {p - 1}.0::DOUBLE / {p + 1} * s.x}}"
    made = {
        "bb_zscore": f"CASE WHEN i < {n} OR sd < 1e-12 THEN 0 ELSE (close - mu) / sd END", "bb_bandwidth": f"CASE WHEN i < {n} OR mu < 1e-12 THEN 0 ELSE 4 * sd / mu END",
        "mfi": f"CASE WHEN i <= {n} THEN 50 WHEN neg < 1e-12 THEN 100 ELSE 100 - 100 / (1 + pos / neg) END", "force_index": f"CASE WHEN i <= {n} OR worth < 1e-12 THEN 0 ELSE z.f / worth END",
        "donchian_width": f"CASE WHEN i < {n} THEN 0 ELSE (hh - ll) / close END", "atr": f"CASE WHEN i <= {n} THEN 0 ELSE z.t / close END",
        "awesome_osc": f"CASE WHEN i < {n} THEN 0 ELSE (quick - slow) / slow END", "adx": f"CASE WHEN i < {3 * p} THEN 25 ELSE greatest(0, least(100, z.x)) END",
    }
    s = "(PARTITION BY asset ORDER BY ts)"
    m = f"SELECT *, row_number() OVER {s} AS i, (high + low + close) / 3 AS tp, (high + low) / 2 AS mid, close - lag(close) OVER {s} AS dc, greatest(high - low, abs(high - lag(close) OVER {s}), abs(low - lag(close) OVER {s})) AS tr, greatest(high - lag(high) OVER {s}, 0) AS up, greatest(lag(low) OVER {s} - low, 0) AS dn FROM {rows}"
    k = f"SELECT *, tp - lag(tp) OVER {s} AS dt, CASE WHEN up > dn THEN up ELSE 0 END AS u, CASE WHEN dn > up THEN dn ELSE 0 END AS d FROM ({m})"
    frame = lambda length: f"(PARTITION BY asset ORDER BY ts ROWS {length - 1} PRECEDING)"
    f = f"SELECT *, avg(close) OVER w AS mu, stddev_samp(close) OVER w AS sd, sum(CASE WHEN dt > 0 THEN tp * volume ELSE 0 END) OVER w AS pos, sum(CASE WHEN dt < 0 THEN tp * volume ELSE 0 END) OVER w AS neg, avg(close * volume) OVER w AS worth, max(high) OVER w AS hh, min(low) OVER w AS ll, avg(mid) OVER w AS slow, avg(mid) OVER v AS quick, list({{'f': (dc * volume)::DOUBLE, 't': tr::DOUBLE, 'r': tr::DOUBLE, 'u': u::DOUBLE, 'd': d::DOUBLE, 'x': {dx('tr', 'u', 'd')}::DOUBLE}}) FILTER (i > 1) OVER w AS l FROM ({k}) WINDOW w AS {frame(n)}, v AS {frame(max(5, n // 7))}"
    z = f"SELECT *, CASE WHEN i > 1 THEN list_reduce(l, lambda s, e: {walk}) END AS z FROM ({f})"
    return f"SELECT asset, ts, i, {', '.join(f'round(({x})::DOUBLE, 5) + 0.0 AS {name}_{leg}{n}' for name, x in made.items())} FROM ({z})"


def _rounded(f: DataFrame) -> DataFrame:
    return f.select("asset", "ts", *((F.round(c, 5) + 0.0).alias(c) for c in f.columns if c not in ("asset", "ts")))


@query("bar_feature_vector", f"WITH {BARS} SELECT * EXCLUDE (i) FROM ({_vector_sql('bars', 50)})")
def _(spark, sf):
    return _rounded(features.bar_features(bars(spark, sf), **K, lookbacks=(50,)))


_LEG = "(SELECT * REPLACE ('pair' AS asset) FROM bars WHERE asset = '{}')"
_LEGS = [_vector_sql(_LEG.format(asset), n, f"{leg}_") for asset, leg in (("click", "target"), ("view", "hedge")) for n in (50, 100)]


@query("minute_feature_vector", f"WITH {BARS} SELECT * EXCLUDE (i) FROM ({_LEGS[0]}) JOIN (SELECT * EXCLUDE (i) FROM ({_LEGS[1]})) USING (asset, ts) JOIN (SELECT * EXCLUDE (i) FROM ({_LEGS[2]}) WHERE i >= 150) USING (asset, ts) JOIN (SELECT * EXCLUDE (i) FROM ({_LEGS[3]})) USING (asset, ts) WHERE i >= 150")
def _(spark, sf):
    b = bars(spark, sf)
    pair = lambda a: b.where(F.col("asset") == a).withColumn("asset", F.lit("pair"))
    return _rounded(features.minute_vector(pair("click"), pair("view"), keys=["asset"], ts="ts", lookbacks=(50, 100)))


@query("daily_feature_vector", f"WITH {DAILY}, r AS (SELECT asset, day, price, price / lag(price) OVER w - 1 AS r1, price / lag(price, 5) OVER w - 1 AS r5 FROM daily WINDOW w AS (PARTITION BY asset ORDER BY day)), f AS (SELECT asset, day, r1, r5, CASE WHEN count(r1) OVER v = 20 THEN stddev_samp(r1) OVER v END AS vol, CASE WHEN count(*) OVER v = 20 THEN price / avg(price) OVER v - 1 END AS gap FROM r WINDOW v AS (PARTITION BY asset ORDER BY day ROWS 19 PRECEDING)) SELECT asset, day, round(lag(r1) OVER w, 6) AS ret_1, round(lag(r5) OVER w, 6) AS ret_5, round(lag(vol) OVER w, 6) AS vol_20, round(lag(gap) OVER w, 6) AS gap_20 FROM f WINDOW w AS (PARTITION BY asset ORDER BY day)")
def _(spark, sf):
    f = features.as_of_previous(features.daily_vector(daily(spark, sf), keys=["asset"], day="day", value="price"), keys=["asset"], day="day")
    return f.select("asset", "day", *(F.round(c, 6).alias(c) for c in ("ret_1", "ret_5", "vol_20", "gap_20")))


@query("funding_feature_vector", "SELECT event_id, round(avg(value - 50) OVER w, 6) AS mean_3d, round(avg((value > 50)::INTEGER) OVER w, 6) AS positive_3d FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 8 PRECEDING)")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("rate", F.col("value") - 50)
    f = features.funding_vector(e, keys=["event_type"], order=["ts", "event_id"])
    return f.select("event_id", F.round("mean_3d", 6).alias("mean_3d"), F.round("positive_3d", 6).alias("positive_3d"))


@query("spike_feature_vector")
def _(spark, sf):
    f = features.spike_features(trades(spark, sf), keys=["asset"], ts="ts", price="quote", tolerance=1800)
    return f.select("trade_id", "ret_1m", "ret_60m", "velocity", "acceleration", "place")


_HOLD = f"{TRADES}, h AS (SELECT asset, trade_id AS hold, ts AS start, ts + INTERVAL 3 DAY AS fin FROM trades), sp AS (SELECT asset, ts, trade_id, quote + 100 AS p FROM trades WHERE trade_id % 2 = 0), pp AS (SELECT asset, ts, trade_id, quote + 101 AS p FROM trades WHERE trade_id % 2 = 1), fu AS (SELECT asset, ts, (quote - 40) / 100000 AS rate FROM trades)"


def _holds(spark, sf):
    r = trades(spark, sf)
    holds = r.select("asset", F.col("trade_id").alias("hold"), F.col("ts").alias("start"))
    px = lambda odd, add: r.where(F.col("trade_id") % 2 == odd).select("asset", "ts", (F.col("quote") + add).alias("price"), F.col("trade_id").alias("tie"))
    fund = r.select("asset", "ts", ((F.col("quote") - 40) / 100000).alias("rate"))
    return holds, px(0, 100), px(1, 101), fund


@query("funding_carry_hold", f"WITH {_HOLD}, q AS (SELECT h.*, (SELECT arg_max(p, (ts, trade_id)) FROM sp WHERE sp.asset = h.asset AND ts <= start) AS s0, (SELECT arg_max(p, (ts, trade_id)) FROM sp WHERE sp.asset = h.asset AND ts <= fin) AS s1, (SELECT arg_max(p, (ts, trade_id)) FROM pp WHERE pp.asset = h.asset AND ts <= start) AS p0, (SELECT arg_max(p, (ts, trade_id)) FROM pp WHERE pp.asset = h.asset AND ts <= fin) AS p1, (SELECT coalesce(sum(rate), 0) FROM fu WHERE fu.asset = h.asset AND ts > start AND ts <= fin) AS f FROM h) SELECT asset, hold, round(f, 8) + 0.0 AS funding, round(greatest(least(s1 / s0 - p1 / p0 + f, 0.5), -0.5) - 0.002, 8) AS net FROM q WHERE s0 IS NOT NULL AND p0 IS NOT NULL")
def _(spark, sf):
    h = carry.carry_hold(*_holds(spark, sf), keys=["asset"])
    return h.where("spot_in IS NOT NULL AND perp_in IS NOT NULL").select("asset", "hold", (F.round("funding", 8) + 0.0).alias("funding"), F.round("net", 8).alias("net"))


@query("funding_spread_hold", f"WITH {_HOLD}, g AS (SELECT asset, ts, rate - rate * 0.7::DOUBLE AS gap FROM fu), q AS (SELECT h.asset, hold, (SELECT arg_max(gap, ts) FROM g WHERE g.asset = h.asset AND ts <= start) AS entry, (SELECT sum(gap) FROM g WHERE g.asset = h.asset AND ts > start AND ts <= fin) AS total, (SELECT count(*) FROM g WHERE g.asset = h.asset AND ts > start AND ts <= fin) AS n FROM h) SELECT asset, hold, nullif(n, 0) AS events, round(sign(entry) * coalesce(total, 0) - 4 * 1.0::DOUBLE / 10000, 9) AS net FROM q")
def _(spark, sf):
    holds, _, _, fund = _holds(spark, sf)
    other = fund.withColumn("rate", F.col("rate") * 0.7)
    return carry.spread_hold(holds, fund, other, keys=["asset"], days=3, cost_bps=1.0).select("asset", "hold", "events", F.round("net", 9).alias("net"))


@query("carry_accrual", "WITH p AS (SELECT event_type AS asset, event_id AS position, ts AS opened FROM events), f AS (SELECT event_type AS asset, ts, (value - 40) / 1000 AS rate FROM events), a AS (SELECT p.asset, position, sum(rate * 100) AS a, arg_max(rate, ts) AS r FROM p JOIN f ON f.asset = p.asset AND f.ts > opened AND f.ts <= TIMESTAMP '2024-01-31' GROUP BY 1, 2) SELECT p.asset, position, round(coalesce(a, 0), 6) + 0.0 AS accrued, CASE WHEN epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', opened)) >= 10 * 86400 THEN 'expired' WHEN coalesce(r, 1) < 0 THEN 'rate_negative' END AS exit FROM p LEFT JOIN a USING (asset, position)")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    pos = e.select(F.col("event_type").alias("asset"), F.col("event_id").alias("position"), F.col("ts").alias("opened"), F.col("ts").alias("paid_until"), F.lit(100.0).alias("notional"), F.lit(10).alias("max_days"))
    fund = e.select(F.col("event_type").alias("asset"), "ts", ((F.col("value") - 40) / 1000).alias("rate"))
    a = carry.accrue(pos, fund, keys=["asset"], until=F.lit("2024-01-31").cast("timestamp"))
    return a.select("asset", "position", (F.round("accrued", 6) + 0.0).alias("accrued"), "exit")


@query("paper_account", f"WITH {BARS}, o AS (SELECT asset, ts, close, CASE WHEN close < 30 THEN 1.0::DOUBLE WHEN close > 90 THEN -1.0 ELSE 0 END AS q FROM bars), f AS (SELECT *, close * (1 + sign(q) * 0.0005::DOUBLE) AS fp FROM o) SELECT asset, ts, round(100000::DOUBLE + sum(-q * fp - abs(q) * fp * 0.001::DOUBLE) OVER w + sum(q) OVER w * close, 4) AS nav FROM f WINDOW w AS (PARTITION BY asset ORDER BY ts)")
def _(spark, sf):
    b = bars(spark, sf).withColumn("quantity", F.when(F.col("close") < 30, 1.0).when(F.col("close") > 90, -1.0).otherwise(0.0))
    return paper.paper_account(b, **K).select("asset", "ts", F.round("nav", 4).alias("nav"))


@query("replay_statistics")
def _(spark, sf):
    b = bars(spark, sf).withColumn("close", F.col("close") + 100).withColumn("entry", F.col("close") < 120).withColumn("exit", F.col("close") > 180)
    r = paper.running_stats(paper.replay(b, **K), **K)
    return r.groupBy("asset").agg(F.max("trades").alias("trades"), F.round(F.min("max_drawdown"), 6).alias("max_drawdown"), F.round(F.max_by("win_rate", "ts"), 6).alias("win_rate"))


@query("spike_trade_params", f"WITH {TRADES} SELECT trade_id, CASE WHEN quote > 50 THEN 'SELL' WHEN quote < 50 THEN 'BUY' ELSE 'NONE' END AS side, round(CASE WHEN quote <> 50 THEN least(100, 100 * abs((quote - 50) / 500) / 0.20) ELSE 0 END, 6) AS size FROM trades")
def _(spark, sf):
    r = trades(spark, sf).withColumn("move", (F.col("quote") - 50) / 500)
    return paper.trade_params(r, move="move", price="price").select("trade_id", "side", F.round("size", 6).alias("size"))


@query("composite_alpha", f"WITH {DAILY}, q AS (SELECT asset, day, price, n::DOUBLE AS n FROM daily), l AS (SELECT day, quantile_cont(price, 0.05) AS a, quantile_cont(price, 0.95) AS b, quantile_cont(n, 0.05) AS c, quantile_cont(n, 0.95) AS d FROM q GROUP BY 1), w AS (SELECT asset, q.day, greatest(least(price, b), a) AS p, greatest(least(n, d), c) AS m FROM q JOIN l USING (day)) SELECT asset, day, round(0.7::DOUBLE * CASE WHEN stddev_samp(p) OVER v > 0 THEN (p - avg(p) OVER v) / stddev_samp(p) OVER v ELSE 0 END + 0.3::DOUBLE * CASE WHEN stddev_samp(m) OVER v > 0 THEN (m - avg(m) OVER v) / stddev_samp(m) OVER v ELSE 0 END, 5) + 0.0 AS alpha FROM w WINDOW v AS (PARTITION BY day)")
def _(spark, sf):
    d = daily(spark, sf).withColumn("n", F.col("n").cast("double"))
    a = signals.composite_alpha(d, day="day", parts={"price": 0.7, "n": 0.3})
    return a.select("asset", "day", (F.round("alpha", 5) + 0.0).alias("alpha"))


@query("signal_decay", "SELECT event_id, round(value * exp(-(user_id % 30) * ln(2::DOUBLE) / 10), 6) AS exp_decay, round(value * greatest(0, 1 - (user_id % 30) / 20.0::DOUBLE), 6) AS line_decay FROM events")
def _(spark, sf):
    age = (F.col("user_id") % 30).cast("double")
    return t(spark, sf, "events").select("event_id", F.round(signals.decayed(F.col("value"), age, 10.0), 6).alias("exp_decay"), F.round(signals.decayed(F.col("value"), age, 10.0, "line"), 6).alias("line_decay"))


@query("basket_scan")
def _(spark, sf):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(0, 1, (200, 6)).cumsum(0)
    m[:, 0] = 0.5 * m[:, 1] + 0.3 * m[:, 2] + rng.normal(0, 0.2, 200)
    found = statistics.basket_scan(m, [f"A{i}" for i in range(6)], spark, 2)
    return baskets.score(found, {"adf": ("adf_t", 0.0, -6.0, 1.0)}).select("name", "basket", F.round("adf_t", 6).alias("adf_t"), F.round("score", 6).alias("score"), "rank")


@query("basket_null_filter")
def _(spark, sf):
    null = baskets.null_distribution(spark, n_obs=100, n_assets=4, n_vars=2, samples=500, tasks=4)
    return baskets.significant(literal(spark, ["name", "adf_t"], [("good", -9.0), ("bad", -0.5)]), null).select("name")


@query("basket_walk_forward")
def _(spark, sf):
    d = daily(spark, sf).groupBy("day").pivot("asset", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.first("price")).dropna()
    d = d.select(F.lit("b").alias("basket"), "day", F.col("`1-URGENT`").alias("x"), F.col("`2-HIGH`").alias("y"), F.col("`5-LOW`").alias("z"))
    return baskets.walk_forward(d, basket="basket", order="day", target="x", hedges=["y", "z"], estimation=60, signal=20)


@query("basket_scores", "WITH s AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1) SELECT l_suppkey, round((2 * greatest(least((q - 20) / 10, 1), 0) + greatest(least((d - 0.1) / -0.1::DOUBLE, 1), 0)) / 3, 8) AS score FROM s")
def _(spark, sf):
    s = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    return baskets.score(s, {"q": ("q", 20.0, 30.0, 2.0), "d": ("d", 0.1, 0.0, 1.0)}).select("l_suppkey", F.round("score", 8).alias("score"))


@query("surface_cost", "SELECT round(sum((15 + 0.12::DOUBLE * n_obs) * 500) / 3600000 / 8, 8) AS hours, count(*) AS points FROM (VALUES (60), (120), (250)) a(n_obs), (VALUES (3), (5)) b(n_assets)")
def _(spark, sf):
    g = statistics.surface_grid(spark, {"n_obs": [60, 120, 250], "n_assets": [3, 5]})
    return baskets.estimated_hours(g, samples=500).withColumn("hours", F.round("hours", 8))


@query("nearest_artifact", "SELECT 120 AS n_obs, 5 AS n_assets")
def _(spark, sf):
    g = statistics.surface_grid(spark, {"n_obs": [60, 120, 250], "n_assets": [3, 5]})
    return baskets.nearest_artifact(g, {"n_obs": 130.0, "n_assets": 6.0}).select("n_obs", "n_assets")


@query("corrected_p_values", "SELECT event_id, round(CASE WHEN x <= -4 THEN 0.01 WHEN x <= -3 THEN 0.01 + (x + 4) * 0.04 WHEN x <= -2.5 THEN 0.05 + (x + 3) / 0.5 * 0.05 ELSE least(1, 0.10 + (x + 2.5) * 0.2) END, 6) AS p FROM (SELECT event_id, -value / 20 AS x FROM events)")
def _(spark, sf):
    x = -F.col("value") / 20
    return t(spark, sf, "events").select("event_id", F.round(statistics.corrected_p(x, F.lit(-4.0), F.lit(-3.0), F.lit(-2.5)), 6).alias("p"))


@query("row_wise_correlation", f"WITH {DAILY}, d AS (SELECT asset, day, price FROM daily) SELECT a.asset AS a, b.asset AS b, round(corr(a.price, b.price), 6) AS corr FROM d a JOIN d b USING (day) GROUP BY 1, 2")
def _(spark, sf):
    d = daily(spark, sf)
    other = d.select(F.col("asset").alias("b"), "day", F.col("price").alias("pb"))
    return d.select(F.col("asset").alias("a"), "day", "price").join(other, "day").groupBy("a", "b").agg(F.round(F.corr("price", "pb"), 6).alias("corr"))


@query("smart_money_performance", "WITH s AS (SELECT user_id % 20 AS wallet, value - 50 AS pnl, value > 60 AS won FROM events) SELECT wallet, count(*) AS signals, count(*) FILTER (WHERE won) AS wins, round(sum(pnl), 6) AS pnl, round(count(*) FILTER (WHERE won) / count(*)::DOUBLE, 6) AS win_rate FROM s GROUP BY 1")
def _(spark, sf):
    s = t(spark, sf, "events").select((F.col("user_id") % 20).alias("wallet"), (F.col("value") - 50).alias("pnl"), (F.col("value") > 60).alias("won"))
    return s.groupBy("wallet").agg(F.count(F.lit(1)).alias("signals"), F.count_if("won").alias("wins"), F.round(F.sum("pnl"), 6).alias("pnl"), F.round(F.count_if("won") / F.count(F.lit(1)), 6).alias("win_rate"))


@query("dashboard_aggregates", "SELECT event_type, count(*) AS n, epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS span_seconds, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("span_seconds"), F.round(F.avg("value"), 6).alias("mean"), F.countDistinct("user_id").alias("users"))


@query("short_favourites", "SELECT event_id, price, days FROM (SELECT event_id, (user_id % 97 + 1) / 100.0::DOUBLE AS price, event_id % 200 + 1 AS days, event_type FROM events) WHERE price BETWEEN 0.85 AND 0.97 AND days <= 7 AND event_type NOT IN ('error')")
def _(spark, sf):
    m = t(spark, sf, "events").select("event_id", ((F.col("user_id") % 97 + 1) / 100.0).alias("price"), (F.col("event_id") % 200 + 1).alias("days"), "event_type")
    return m.where(F.col("price").between(0.85, 0.97) & (F.col("days") <= 7) & ~F.col("event_type").isin("error")).select("event_id", "price", "days")


@query("confluence", f"WITH {BARS}, z AS (SELECT asset, ts, (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) AS z, close - lag(close, 3) OVER o AS f3, close - lag(close, 6) OVER o AS f6, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING), o AS (PARTITION BY asset ORDER BY ts)) SELECT asset, ts, CASE WHEN n < 20 THEN 'none' WHEN z < -1 AND f3 < 0 AND f6 < 0 THEN 'buy' WHEN z > 1 AND f3 > 0 AND f6 > 0 THEN 'sell' ELSE 'none' END AS signal FROM z")
def _(spark, sf):
    from ..operators.indicators import zscore

    w = windows.series(["asset"], "ts")
    z, f3, f6 = zscore("close", w, 20), F.col("close") - F.lag("close", 3).over(w), F.col("close") - F.lag("close", 6).over(w)
    return bars(spark, sf).select("asset", "ts", F.when((z < -1) & (f3 < 0) & (f6 < 0), "buy").when((z > 1) & (f3 > 0) & (f6 > 0), "sell").otherwise("none").alias("signal"))


@query("information_bars")
def _(spark, sf):
    from ..operators.infobars import KINDS, info_bars

    tape = trades(spark, sf).withColumn("ts_ms", F.unix_millis("ts"))
    out = None
    for kind in KINDS:
        b = info_bars(tape, kind, 100.0 if kind == "volume" else 2000.0, keys=["asset"]).withColumn("kind", F.lit(kind))
        out = b if out is None else out.unionByName(b)
    return out


@query("info_bar_slices", "SELECT * FROM (VALUES ('click'), ('view')) a(asset), (VALUES ('dollar', 1000.0::DOUBLE), ('volume', 50.0::DOUBLE)) b(bar_type, threshold)")
def _(spark, sf):
    a, b = literal(spark, ["asset"], [("click",), ("view",)]), literal(spark, ["bar_type", "threshold"], [("dollar", 1000.0), ("volume", 50.0)])
    return a.crossJoin(F.broadcast(b))


_STATES = list(MOVES)
_MOVES = ["'>DRAFT'", *(f"'{a}>{b}'" for a, bs in MOVES.items() for b in bs)]


@query("model_lifecycle", f"WITH o AS (SELECT o_custkey AS model, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, {_STATES!r}[o_orderkey % {len(_STATES)} + 1] AS to_ FROM orders), g AS (SELECT model, count(*)::INTEGER AS moves, list_prepend(struct_pack(s := '', r := 0), list(struct_pack(s := CASE WHEN n = 1 THEN 'DRAFT' ELSE to_ END, r := 0) ORDER BY n)) AS l FROM o GROUP BY 1), e AS (SELECT model, moves, list_reduce(l, lambda a, x: CASE WHEN list_contains([{', '.join(_MOVES)}], a.s || '>' || x.s) THEN struct_pack(s := x.s, r := a.r) ELSE struct_pack(s := a.s, r := a.r + 1) END) AS e FROM g) SELECT model, e.s AS state, moves, e.r::INTEGER AS rejected FROM e")
def _(spark, sf):
    from .workflow import lifecycle

    w = windows.series(["model"], "o_orderdate", "o_orderkey")
    o = t(spark, sf, "orders").withColumn("model", F.col("o_custkey")).withColumn("n", F.row_number().over(w))
    to = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("o_orderkey") % len(_STATES) + 1).cast("int"))
    return lifecycle(o.withColumn("state", F.when(F.col("n") == 1, "DRAFT").otherwise(to)), key="model", ts="n", state="state")
