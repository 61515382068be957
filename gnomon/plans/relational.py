"""Projections, filters, joins, aggregates, sorts and set operations as registered queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, windows
from .base import DAILY, TRADES, bucket_ms, daily, query, t, trades


@query("filter_point_range", "SELECT o_orderkey, o_orderdate::DATE AS day, o_totalprice FROM orders WHERE o_custkey = 330 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '2000-12-31'")
def _(spark, sf):
    o = t(spark, sf, "orders").where("o_custkey = 330 AND o_orderdate >= timestamp'1996-01-01' AND o_orderdate <= timestamp'2000-12-31'")
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice").orderBy("day", "o_orderkey")


@query("filter_in_list", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(spark, sf):
    keys = t(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return t(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD")).join(keys, "c_nationkey", "left_semi").select("c_custkey", "c_name", "c_mktsegment")


@query("filter_optional_predicates", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value >= 100 AND props LIKE '%7%'")
def _(spark, sf):
    given = {"event_type": "purchase", "min_value": 100, "contains": "7", "user_id": None}
    e = t(spark, sf, "events")
    tests = {"event_type": F.col("event_type") == given["event_type"], "min_value": F.col("value") >= given["min_value"], "contains": F.col("props").contains(given["contains"])}
    for name, test in tests.items():
        e = e.where(test) if given[name] is not None else e
    return e.select("event_id", "user_id", "value")


@query("conditional_sums", "SELECT event_type, count(*) AS n, sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_buy, round(sum(value) FILTER (WHERE user_id % 2 = 0), 6) AS buy, round(sum(value) FILTER (WHERE user_id % 2 = 1), 6) AS sell FROM events GROUP BY 1")
def _(spark, sf):
    buy = F.col("user_id") % 2 == 0
    return t(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(buy, 1).otherwise(0)).alias("n_buy"), F.round(F.sum(F.when(buy, F.col("value"))), 6).alias("buy"), F.round(F.sum(F.when(~buy, F.col("value"))), 6).alias("sell"))


@query("column_exclude", "SELECT * EXCLUDE (p_type, p_size) FROM part WHERE p_size > 40")
def _(spark, sf):
    return t(spark, sf, "part").where("p_size > 40").drop("p_type", "p_size")


_RUNS = """runs AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE {'sharpe': c_acctbal / 1000, 'risk': {'limits': {'max_dd': c_acctbal / 20000, 'tags': [c_mktsegment, 'n' || c_nationkey::VARCHAR]}}} END AS results,
  [{'param': 'fast', 'v': c_nationkey}, {'param': 'slow', 'v': c_nationkey + 10}] AS grid FROM customer)"""


def _nested(spark, sf):
    c = t(spark, sf, "customer")
    limits = F.struct((F.col("c_acctbal") / 20000).alias("max_dd"), F.array("c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("tags"))
    results = F.struct((F.col("c_acctbal") / 1000).alias("sharpe"), F.struct(limits.alias("limits")).alias("risk"))
    one = lambda p, v: F.struct(F.lit(p).alias("param"), v.alias("v"))
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 != 0, results).alias("results"), F.array(one("fast", F.col("c_nationkey")), one("slow", F.col("c_nationkey") + 10)).alias("grid"))


@query("struct_paths", f"WITH {_RUNS} SELECT id, round(results.sharpe, 6) AS sharpe, round(results.risk.limits.max_dd, 8) AS max_dd, grid[1].param AS first_param FROM runs WHERE results.risk.limits.max_dd > 0.2")
def _(spark, sf):
    return _nested(spark, sf).where("results.risk.limits.max_dd > 0.2").select("id", F.round("results.sharpe", 6).alias("sharpe"), F.round("results.risk.limits.max_dd", 8).alias("max_dd"), F.element_at("grid", 1)["param"].alias("first_param"))


@query("array_contains", f"WITH {_RUNS} SELECT id, len(results.risk.limits.tags)::INTEGER AS n_tags FROM runs WHERE list_contains(results.risk.limits.tags, 'BUILDING')")
def _(spark, sf):
    return _nested(spark, sf).where(F.array_contains("results.risk.limits.tags", "BUILDING")).select("id", F.size("results.risk.limits.tags").alias("n_tags"))


@query("unnest_structs", f"WITH {_RUNS} SELECT id, g.param, g.v FROM (SELECT id, unnest(grid) AS g FROM runs)")
def _(spark, sf):
    return _nested(spark, sf).select("id", F.inline("grid"))


@query("null_structs", f"WITH {_RUNS} SELECT count(*) FILTER (WHERE results IS NULL) AS n_null, count(*) FILTER (WHERE results.risk.limits.max_dd IS NULL) AS n_null_leaf, count(results.sharpe) AS n_sharpe FROM runs")
def _(spark, sf):
    return _nested(spark, sf).agg(F.count_if(F.col("results").isNull()).alias("n_null"), F.count_if(F.col("results.risk.limits.max_dd").isNull()).alias("n_null_leaf"), F.count("results.sharpe").alias("n_sharpe"))


@query("coalesce_overrides", "SELECT e.event_id, coalesce(CASE WHEN user_id % 5 = 0 THEN 'corrected' END, CASE WHEN value > 50 THEN 'classified' END, 'default') AS class FROM events e")
def _(spark, sf):
    return t(spark, sf, "events").select("event_id", F.coalesce(F.when(F.col("user_id") % 5 == 0, "corrected"), F.when(F.col("value") > 50, "classified"), F.lit("default")).alias("class"))


@query("universe_liquidity_filter", "SELECT p_brand AS asset, round(avg(l_extendedprice), 6) AS avg_dollar, count(DISTINCT l_shipdate::DATE) AS n_days, round(arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)), 6) AS last_close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING avg(l_extendedprice) > 36000 AND arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) > 5 AND count(DISTINCT l_shipdate::DATE) > 0.3 * (SELECT count(DISTINCT l_shipdate::DATE) FROM lineitem)")
def _(spark, sf):
    l = t(spark, sf, "lineitem")  # noqa: E741
    days = l.agg(F.countDistinct(F.to_date("l_shipdate")).alias("all_days"))
    rows = l.join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    per = rows.groupBy(F.col("p_brand").alias("asset")).agg(F.avg("l_extendedprice").alias("a"), F.countDistinct(F.to_date("l_shipdate")).alias("n_days"), F.max_by(F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("c"))
    kept = per.crossJoin(F.broadcast(days)).where("a > 36000 AND c > 5 AND n_days > 0.3 * all_days")
    return kept.select("asset", F.round("a", 6).alias("avg_dollar"), "n_days", F.round("c", 6).alias("last_close"))


@query("inner_join_report", "SELECT n_name, r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(spark, sf):
    j = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("left_join_taxonomy", "SELECT p_partkey, coalesce(b.n, 0) AS n_sold FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) b ON l_partkey = p_partkey")
def _(spark, sf):
    sold = t(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return t(spark, sf, "part").join(sold, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n_sold"))


@query("left_join_defaults", f"WITH {DAILY}, ev AS (SELECT ts::DATE - 8766 AS day, avg(value) AS a, sum(value) AS s FROM events GROUP BY 1) SELECT d.asset, d.day, round(d.price, 4) AS price, round(coalesce(ev.a, 50.0), 6) AS sentiment, round(coalesce(ev.s, 0.0), 6) AS funding, CASE WHEN d.asset = '2-HIGH' THEN coalesce(ev.a, 0.0) > 0 END AS onchain FROM daily d LEFT JOIN ev ON ev.day = d.day")
def _(spark, sf):
    ev = t(spark, sf, "events").groupBy(F.date_sub(F.to_date("ts"), 8766).alias("day")).agg(F.avg("value").alias("a"), F.sum("value").alias("s"))
    j = daily(spark, sf).join(ev, "day", "left")
    return j.select("asset", "day", F.round("price", 4).alias("price"), F.round(F.coalesce("a", F.lit(50.0)), 6).alias("sentiment"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("funding"), F.when(F.col("asset") == "2-HIGH", F.coalesce("a", F.lit(0.0)) > 0).alias("onchain"))


@query("snapshot_diff", "WITH a AS (SELECT user_id, event_type, sum(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2), b AS (SELECT user_id, event_type, sum(value) AS s FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2), j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, a.s AS o, b.s AS n FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type), k AS (SELECT *, CASE WHEN o IS NULL THEN 'ENTER' WHEN n IS NULL THEN 'EXIT' WHEN n > o * 1.05 THEN 'INCREASE' WHEN n < o * 0.95 THEN 'DECREASE' END AS change FROM j) SELECT user_id, event_type, change, round(n, 6) AS new_size, round(o, 6) AS old_size FROM k WHERE change IS NOT NULL")
def _(spark, sf):
    e = t(spark, sf, "events")
    mid = F.lit("2024-01-15").cast("timestamp")
    old, new = (e.where(x).groupBy("user_id", "event_type").agg(F.sum("value").alias("size")) for x in (F.col("ts") < mid, F.col("ts") >= mid))
    d = joins.diff_snapshots(new, old, keys=["user_id", "event_type"], size="size")
    return d.select("user_id", "event_type", "change", F.round("new_size", 6).alias("new_size"), F.round("old_size", 6).alias("old_size"))


@query("full_outer_merge", "SELECT coalesce(a.u, b.u) AS user_id, coalesce(a.n, 0) AS filled, coalesce(b.n, 0) AS pending FROM (SELECT user_id AS u, count(*) AS n FROM events WHERE value > 120 GROUP BY 1) a FULL JOIN (SELECT user_id AS u, count(*) AS n FROM events WHERE value < 1 GROUP BY 1) b ON a.u = b.u")
def _(spark, sf):
    e = t(spark, sf, "events")
    a, b = e.where("value > 120").groupBy("user_id").agg(F.count(F.lit(1)).alias("a")), e.where("value < 1").groupBy("user_id").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "user_id", "full_outer").select("user_id", F.coalesce("a", F.lit(0)).alias("filled"), F.coalesce("b", F.lit(0)).alias("pending"))


@query("needs_anti_join", "WITH c AS (SELECT c_custkey, d::DATE AS day FROM customer, range(TIMESTAMP '1996-03-01', TIMESTAMP '1996-04-01', INTERVAL 1 DAY) r(d) WHERE isodow(d) < 6), f AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day FROM orders), n AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.o_custkey = c.c_custkey AND f.day = c.day)) SELECT c_custkey, day, round(100.0::DOUBLE * (1 - (SELECT count(*) FROM n) / (SELECT count(*) FROM c)::DOUBLE), 6) AS savings_pct FROM n")
def _(spark, sf):
    from ..operators.resample import expand_calendar

    ids = t(spark, sf, "customer").select("c_custkey", F.lit("1996-03-01").cast("date").alias("a"), F.lit("1996-03-31").cast("date").alias("b"))
    required = expand_calendar(ids, keys=["c_custkey"], first="a", last="b")
    loaded = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day"))
    needs = required.join(loaded, ["c_custkey", "day"], "left_anti")
    n = needs.agg(F.count(F.lit(1)).alias("n")).crossJoin(required.agg(F.count(F.lit(1)).alias("all_n")))
    return needs.crossJoin(F.broadcast(n)).select("c_custkey", "day", F.round(100 * (1 - F.col("n") / F.col("all_n")), 6).alias("savings_pct"))


@query("not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(spark, sf):
    return t(spark, sf, "customer").join(t(spark, sf, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("semi_join", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING avg(l_quantity) > 29)")
def _(spark, sf):
    l = t(spark, sf, "lineitem")  # noqa: E741
    keys = l.groupBy("l_partkey").agg(F.avg("l_quantity").alias("a")).where("a > 29").select("l_partkey")
    return l.join(keys, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("scalar_stats_cross", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events), 6) AS z FROM events WHERE abs(value - (SELECT avg(value) FROM events)) > 5 * (SELECT stddev_samp(value) FROM events)")
def _(spark, sf):
    e = t(spark, sf, "events")
    stats = e.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return e.crossJoin(F.broadcast(stats)).where("abs(value - m) > 5 * s").select("event_id", F.round((F.col("value") - F.col("m")) / F.col("s"), 6).alias("z"))


@query("parameter_grid", f"WITH {DAILY}, g AS (SELECT * FROM (VALUES (5), (10), (20)) a(lookback), (VALUES (1.0::DOUBLE), (1.5::DOUBLE)) b(entry)) SELECT asset, day, lookback, entry, round(price * lookback / entry, 4) AS x FROM daily, g")
def _(spark, sf):
    from .param_grids import grid

    g = grid(spark, {"lookback": [5, 10, 20], "entry": [1.0, 1.5]})
    d = daily(spark, sf).crossJoin(F.broadcast(g))
    return d.select("asset", "day", "lookback", "entry", F.round(F.col("price") * F.col("lookback") / F.col("entry"), 4).alias("x"))


@query("next_day_join", f"WITH {DAILY} SELECT asset, day, lead(day) OVER w AS outcome_day, n AS feature, lead(n) OVER w AS outcome FROM daily WINDOW w AS (PARTITION BY asset ORDER BY day) QUALIFY outcome_day IS NOT NULL")
def _(spark, sf):
    d = daily(spark, sf)
    j = joins.shifted(d.select("asset", "day", F.col("n").alias("feature")), d.select("asset", "day", F.col("n").alias("outcome")), keys=["asset"], day="day")
    return j.select("asset", "day", "outcome_day", "feature", "outcome")


@query("timestamp_align", f"WITH {DAILY} SELECT a.day, round(a.price - 0.5::DOUBLE * b.price, 6) AS spread FROM daily a JOIN daily b USING (day) WHERE a.asset = '1-URGENT' AND b.asset = '5-LOW'")
def _(spark, sf):
    d = daily(spark, sf)
    a, b = d.where("asset = '1-URGENT'").select("day", F.col("price").alias("pa")), d.where("asset = '5-LOW'").select("day", F.col("price").alias("pb"))
    return a.join(b, "day").select("day", F.round(F.col("pa") - 0.5 * F.col("pb"), 6).alias("spread"))


@query("asof_backward", f"WITH {TRADES}, v AS (SELECT asset, trade_id, ts, quote FROM trades WHERE trade_id % 2 = 0), u AS (SELECT asset, trade_id AS probe, ts FROM trades WHERE trade_id % 2 = 1) SELECT u.asset, u.probe, max(v.ts) AS asof_ts, round(arg_max(v.quote, (v.ts, v.trade_id)), 6) AS asof_quote FROM u LEFT JOIN v ON u.asset = v.asset AND v.ts <= u.ts GROUP BY 1, 2")
def _(spark, sf):
    r = trades(spark, sf)
    left, right = r.where("trade_id % 2 = 1").select("asset", F.col("trade_id").alias("probe"), "ts"), r.where("trade_id % 2 = 0").select("asset", "trade_id", F.col("ts").alias("vts"), "quote")
    j = joins.asof_backward(left, right, keys=["asset"], ts="ts", right_ts="vts", values=["quote"], tie="trade_id")
    return j.select("asset", "probe", "asof_ts", F.round("asof_quote", 6).alias("asof_quote"))


_NEAR = f"WITH {TRADES}, p AS (SELECT u.asset, u.trade_id AS probe, v.trade_id, abs(epoch_us(u.ts) - epoch_us(v.ts)) AS d, v.ts FROM trades u JOIN trades v ON u.asset = v.asset AND u.trade_id % 2 = 1 AND v.trade_id % 2 = 0 AND v.ts BETWEEN u.ts - INTERVAL 1800 SECOND AND u.ts + INTERVAL 1800 SECOND)"


def _near(spark, sf, newest):
    r = trades(spark, sf)
    left, right = r.where("trade_id % 2 = 1").select("asset", F.col("trade_id").alias("probe"), "ts"), r.where("trade_id % 2 = 0").select("asset", "trade_id", F.col("ts").alias("vts"))
    return joins.nearest(left, right, keys=["asset"], left_id="probe", ts="ts", right_ts="vts", right_id="trade_id", tolerance=1800, newest=newest).select("asset", "probe", "trade_id")


@query("asof_tolerance_newest", f"{_NEAR} SELECT asset, probe, arg_max(trade_id, (ts, trade_id)) AS trade_id FROM p GROUP BY 1, 2")
def _(spark, sf):
    return _near(spark, sf, True)


@query("nearest_match", f"{_NEAR} SELECT asset, probe, arg_min(trade_id, (d, trade_id)) AS trade_id FROM p GROUP BY 1, 2")
def _(spark, sf):
    return _near(spark, sf, False)


@query("window_join", f"WITH {TRADES} SELECT u.asset, u.trade_id AS probe, count(v.trade_id) AS n, round(coalesce(sum(v.quote), 0), 6) AS total FROM trades u LEFT JOIN trades v ON u.asset = v.asset AND v.ts > u.ts AND v.ts <= u.ts + INTERVAL 2 HOUR GROUP BY 1, 2")
def _(spark, sf):
    r = trades(spark, sf)
    left = r.select("asset", F.col("trade_id").alias("probe"), "ts")
    pairs = joins.within(left, r.select("asset", "trade_id", F.col("ts").alias("vts"), "quote"), keys=["asset"], ts="ts", right_ts="vts", before=0, after=7200).where("vts > ts")
    held = pairs.groupBy("asset", "probe").agg(F.count(F.lit(1)).alias("n"), F.sum("quote").alias("s"))
    return left.join(held, ["asset", "probe"], "left").select("asset", "probe", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("total"))


@query("self_pairs", "SELECT n_regionkey, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey")
def _(spark, sf):
    return joins.pairs(t(spark, sf, "nation"), keys=["n_regionkey"], member="n_nationkey").select("n_regionkey", F.col("n_name").alias("a"), F.col("n_name_2").alias("b"))


@query("theta_dominance", "WITH m AS (SELECT p_brand, p_size, avg(p_retailprice) / 2000 AS price FROM part GROUP BY 1, 2) SELECT a.p_brand, a.p_size AS low, b.p_size AS high FROM m a JOIN m b ON a.p_brand = b.p_brand AND a.p_size < b.p_size AND a.price < b.price - 0.02")
def _(spark, sf):
    m = t(spark, sf, "part").groupBy("p_brand", "p_size").agg((F.avg("p_retailprice") / 2000).alias("price"))
    return joins.pairs(m, keys=["p_brand"], member="p_size").where("price < price_2 - 0.02").select("p_brand", F.col("p_size").alias("low"), F.col("p_size_2").alias("high"))


@query("causal_edges", "WITH edges(cause, effect) AS (VALUES ('1-URGENT', '2-HIGH'), ('2-HIGH', '3-MEDIUM'), ('9', '2-HIGH')), c AS (SELECT o_orderpriority AS k, o_orderstatus AS g, count(*) AS n FROM orders GROUP BY 1, 2) SELECT cause, effect, a.g, a.n AS n_cause, b.n AS n_effect FROM edges JOIN c a ON a.k = cause JOIN c b ON b.k = effect AND b.g = a.g")
def _(spark, sf):
    edge = lambda a, b: F.struct(F.lit(a).alias("cause"), F.lit(b).alias("effect"))
    edges = spark.range(1).select(F.inline(F.array(edge("1-URGENT", "2-HIGH"), edge("2-HIGH", "3-MEDIUM"), edge("9", "2-HIGH"))))
    c = t(spark, sf, "orders").groupBy("o_orderpriority", F.col("o_orderstatus").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    a, b = c.select(F.col("o_orderpriority").alias("cause"), "g", F.col("n").alias("n_cause")), c.select(F.col("o_orderpriority").alias("effect"), "g", F.col("n").alias("n_effect"))
    return a.join(F.broadcast(edges), "cause").join(b, ["effect", "g"]).select("cause", "effect", "g", "n_cause", "n_effect")


@query("lookup_latest_mapping", "WITH m(code, class, version) AS (VALUES ('O', 'open', 1), ('O', 'open2', 2), ('F', 'filled', 1)) SELECT o_orderkey, (SELECT arg_max(class, version) FROM m WHERE code = o_orderstatus) AS class FROM orders")
def _(spark, sf):
    one = lambda a, b, c: F.struct(F.lit(a).alias("code"), F.lit(b).alias("class"), F.lit(c).alias("version"))
    m = spark.range(1).select(F.inline(F.array(one("O", "open", 1), one("O", "open2", 2), one("F", "filled", 1))))
    newest = m.groupBy("code").agg(F.max_by("class", "version").alias("class"))
    o = t(spark, sf, "orders")
    return o.join(F.broadcast(newest), F.col("code") == F.col("o_orderstatus"), "left").select("o_orderkey", "class")


@query("cascading_identifiers", "WITH want AS (SELECT c_custkey AS id, 'EQ' AS kind, unnest([{'p': 1, 'v': 'Customer#' || lpad((c_custkey * 3)::VARCHAR, 9, '0')}, {'p': 2, 'v': 'Customer#' || lpad((c_custkey + 7)::VARCHAR, 9, '0')}]) AS i FROM customer), hit AS (SELECT id, i.p AS p, c.c_custkey AS found, CASE WHEN c.c_nationkey % 2 = 0 THEN 'EQ' ELSE 'BOND' END AS k, kind FROM want JOIN customer c ON c.c_name = i.v) SELECT id, arg_min(found, p) AS found, arg_min(p, p)::INTEGER AS by_priority, arg_min(k, p) <> 'EQ' AS conflict FROM hit GROUP BY id")
def _(spark, sf):
    c = t(spark, sf, "customer")
    name = lambda x: F.concat(F.lit("Customer#"), F.lpad(x.cast("string"), 9, "0"))
    ids = F.array(F.struct(F.lit(1).alias("p"), name(F.col("c_custkey") * 3).alias("v")), F.struct(F.lit(2).alias("p"), name(F.col("c_custkey") + 7).alias("v")))
    want = c.select(F.col("c_custkey").alias("id"), F.inline(ids))
    known = c.select(F.col("c_name").alias("v"), F.col("c_custkey").alias("found"), F.when(F.col("c_nationkey") % 2 == 0, "EQ").otherwise("BOND").alias("k"))
    best = want.join(known, "v").groupBy("id").agg(F.min_by(F.struct("found", "p", "k"), "p").alias("b"))
    return best.select("id", "b.found", F.col("b.p").alias("by_priority"), (F.col("b.k") != "EQ").alias("conflict"))


@query("flow_summary", f"WITH {TRADES} SELECT count(*) AS n, round(sum(quote), 4) AS total, round(avg(quote), 6) AS mean, max(quote) AS largest, round(CASE WHEN sum(quote) = 0 THEN 0 ELSE sum(CASE WHEN side = 'buy' THEN quote ELSE -quote END) / sum(quote) END, 8) AS imbalance FROM trades")
def _(spark, sf):
    signed = F.sum(F.when(F.col("side") == "buy", F.col("quote")).otherwise(-F.col("quote")))
    total = F.sum("quote")
    return trades(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.round(total, 4).alias("total"), F.round(F.avg("quote"), 6).alias("mean"), F.max("quote").alias("largest"), F.round(F.when(total == 0, F.lit(0.0)).otherwise(signed / total), 8).alias("imbalance"))


@query("group_aggregate", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 6) AS mean, max(o_totalprice) AS largest, min(o_orderdate) AS first_at FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return t(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean"), F.max("o_totalprice").alias("largest"), F.min("o_orderdate").alias("first_at"))


@query("count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_cust, count(DISTINCT (o_custkey, o_orderdate)) AS n_pairs FROM orders GROUP BY 1")
def _(spark, sf):
    return t(spark, sf, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("n_cust"), F.countDistinct("o_custkey", "o_orderdate").alias("n_pairs"))


@query("having", "SELECT o_custkey, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("distinct_slices", "SELECT DISTINCT event_type AS asset, user_id % 3 AS bar_type FROM events")
def _(spark, sf):
    return t(spark, sf, "events").select(F.col("event_type").alias("asset"), (F.col("user_id") % 3).alias("bar_type")).distinct()


@query("bucket_flow", f"WITH {TRADES} SELECT asset, epoch_ms(ts) // 1800000 * 1800000 AS bucket_ms, count(*) AS n, round(sum(quote), 6) AS total, round(sum(quote) FILTER (WHERE side = 'buy'), 6) AS buy, round(sum(quote) FILTER (WHERE side = 'sell'), 6) AS sell FROM trades GROUP BY 1, 2")
def _(spark, sf):
    side = lambda s: F.round(F.sum(F.when(F.col("side") == s, F.col("quote"))), 6).alias(s)
    return trades(spark, sf).groupBy("asset", bucket_ms("ts", 1800000).alias("bucket_ms")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("quote"), 6).alias("total"), side("buy"), side("sell"))


@query("daily_aggregate", "SELECT event_type, ts::DATE AS day, round(avg(value), 6) AS mean, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(spark, sf):
    return t(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 6).alias("total"))


@query("range_bins_upper_median", "WITH b AS (SELECT CASE WHEN value < 10 THEN '0-10' WHEN value < 50 THEN '10-50' WHEN value < 100 THEN '50-100' ELSE '100+' END AS bin, value FROM events) SELECT bin, count(*) AS n, round(avg(value), 6) AS mean, (list(value ORDER BY value))[count(*) // 2 + 1] AS upper_median FROM b GROUP BY 1")
def _(spark, sf):
    v = F.col("value")
    b = t(spark, sf, "events").select(F.when(v < 10, "0-10").when(v < 50, "10-50").when(v < 100, "50-100").otherwise("100+").alias("bin"), "value")
    n = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    # a row number instead of a collected list: the upper median is the row n div 2 + 1
    ranked = b.withColumn("i", F.row_number().over(Window.partitionBy("bin").orderBy("value")))
    return ranked.join(F.broadcast(n), "bin").where("i = n div 2 + 1").select("bin", "n", "mean", F.col("value").alias("upper_median"))


@query("convergence", "WITH p AS (SELECT user_id, event_type, event_id % 20 AS slug, sum(value) AS cap, avg(value) AS price FROM events GROUP BY 1, 2, 3) SELECT event_type, slug, count(DISTINCT user_id) AS n_wallets, round(sum(cap), 4) AS capital, round(avg(price), 6) AS mean_price, round(10 * count(DISTINCT user_id) + least(sum(cap) / 1e4, 50), 6) AS score FROM p GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 50")
def _(spark, sf):
    p = t(spark, sf, "events").groupBy("user_id", "event_type", (F.col("event_id") % 20).alias("slug")).agg(F.sum("value").alias("cap"), F.avg("value").alias("price"))
    n = F.countDistinct("user_id")
    g = p.groupBy("event_type", "slug").agg(n.alias("n_wallets"), F.sum("cap").alias("c"), F.round(F.avg("price"), 6).alias("mean_price"))
    return g.where("n_wallets >= 50").select("event_type", "slug", "n_wallets", F.round("c", 4).alias("capital"), "mean_price", F.round(10 * F.col("n_wallets") + F.least(F.col("c") / 1e4, F.lit(50.0)), 6).alias("score"))


@query("position_aggregates", "WITH p AS (SELECT c_mktsegment AS sector, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS v FROM orders JOIN customer ON o_custkey = c_custkey) SELECT sector, round(sum(abs(v)), 2) AS gross, round(sum(v), 2) AS net, round(1e6::DOUBLE + sum(v), 2) AS nav FROM p GROUP BY 1")
def _(spark, sf):
    v = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    p = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("sector"), v.alias("v"))
    return p.groupBy("sector").agg(F.round(F.sum(F.abs("v")), 2).alias("gross"), F.round(F.sum("v"), 2).alias("net"), F.round(1e6 + F.sum("v"), 2).alias("nav"))


@query("group_mean_prefilter", "WITH m AS (SELECT c_custkey AS model, c_nationkey AS grp, avg(o_totalprice) AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), g AS (SELECT grp FROM m GROUP BY 1 HAVING avg(r) > 250000) SELECT model, grp, round(r, 6) AS mean_return FROM m WHERE grp IN (FROM g)")
def _(spark, sf):
    m = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("model"), F.col("c_nationkey").alias("grp")).agg(F.avg("o_totalprice").alias("r"))
    g = m.groupBy("grp").agg(F.avg("r").alias("a")).where("a > 250000").select("grp")
    return m.join(g, "grp", "left_semi").select("model", "grp", F.round("r", 6).alias("mean_return"))


@query("pivot_matrix", f"WITH {DAILY} SELECT day, max(round(price, 4)) FILTER (WHERE asset = '1-URGENT') AS urgent, max(round(price, 4)) FILTER (WHERE asset = '2-HIGH') AS high, max(round(price, 4)) FILTER (WHERE asset = '5-LOW') AS low FROM daily WHERE asset IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1")
def _(spark, sf):
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    p = daily(spark, sf).groupBy("day").pivot("asset", list(names)).agg(F.first(F.round("price", 4)))
    return p.where(" OR ".join(f"`{k}` IS NOT NULL" for k in names)).select("day", *(F.col(f"`{k}`").alias(v) for k, v in names.items()))


@query("pairwise_correlation", f"WITH {DAILY} SELECT a.asset AS asset, b.asset AS asset_2, count(*) AS n, round(corr(a.price, b.price), 6) AS corr, round(covar_samp(a.price, b.price) / 1e6, 4) AS cov FROM daily a JOIN daily b USING (day) WHERE a.asset < b.asset GROUP BY 1, 2")
def _(spark, sf):
    d = daily(spark, sf).select("asset", "day", "price")
    return joins.pairs(d, keys=["day"], member="asset").groupBy("asset", "asset_2").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("price", "price_2"), 6).alias("corr"), F.round(F.covar_samp("price", "price_2") / 1e6, 4).alias("cov"))


@query("moments", "WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS a, var_samp(value) AS v FROM events GROUP BY 1) SELECT event_type, round(a, 6) AS mean, round(v, 4) AS var, round(sqrt(v), 6) AS sd, round(avg((value - a) ** 3) / avg((value - a) ** 2) ** 1.5, 6) AS skew, round(avg((value - a) ** 4) / avg((value - a) ** 2) ** 2 - 3, 6) AS kurt FROM events JOIN m USING (event_type) GROUP BY event_type, a, v")
def _(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_samp("value"), 4).alias("var"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.skewness("value"), 6).alias("skew"), F.round(F.kurtosis("value"), 6).alias("kurt"))


@query("percentile_rank_and_z", "WITH l AS (SELECT event_type, arg_max(value, (ts, event_id)) AS x FROM events GROUP BY 1), h AS (SELECT event_type, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT e.event_type, round(CASE WHEN any_value(n) < 10 THEN 0.5 ELSE avg((value <= x)::INTEGER) END, 6) AS pct, round(CASE WHEN any_value(n) < 10 OR any_value(s) < 1e-12 THEN 0 ELSE (any_value(x) - any_value(m)) / any_value(s) END, 6) AS z FROM events e JOIN l USING (event_type) JOIN h USING (event_type) GROUP BY 1")
def _(spark, sf):
    e = t(spark, sf, "events")
    last = e.groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("x"))
    g = e.join(F.broadcast(last), "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") <= F.col("x")).cast("int")).alias("p"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.first("x").alias("x"))
    return g.select("event_type", F.round(F.when(F.col("n") < 10, 0.5).otherwise(F.col("p")), 6).alias("pct"), F.round(F.when((F.col("n") < 10) | (F.col("s") < 1e-12), 0.0).otherwise((F.col("x") - F.col("m")) / F.col("s")), 6).alias("z"))


@query("robust_z", "WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT event_type, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1) SELECT event_id, round(0.6745::DOUBLE * (value - med) / mad, 6) AS z FROM events JOIN m USING (event_type) JOIN d USING (event_type) WHERE 0.6745::DOUBLE * abs(value - med) / mad > 3.5")
def _(spark, sf):
    from ..operators.quality import modified_z

    z = modified_z(t(spark, sf, "events"), keys=["event_type"], value="value")
    return z.where("abs(z) > 3.5").select("event_id", F.round("z", 6).alias("z"))


@query("funding_stats", "SELECT event_type AS asset, round(avg(value - 50), 6) AS mean, round(min(value - 50), 6) AS low, round(max(value - 50), 6) AS high, round(avg((value > 50)::INTEGER), 6) AS positive, round(arg_max(value - 50, (ts, event_id)), 6) AS latest FROM events GROUP BY 1")
def _(spark, sf):
    r = F.col("value") - 50
    return t(spark, sf, "events").groupBy(F.col("event_type").alias("asset")).agg(F.round(F.avg(r), 6).alias("mean"), F.round(F.min(r), 6).alias("low"), F.round(F.max(r), 6).alias("high"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("positive"), F.round(F.max_by(r, F.struct("ts", "event_id")), 6).alias("latest"))


@query("gap_check_counts", "WITH c AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, day, n, 70 - n AS missing, date_diff('day', day, DATE '2024-02-01') AS age_days FROM c WHERE n < 60")
def _(spark, sf):
    c = t(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return c.where("n < 60").select("event_type", "day", "n", (70 - F.col("n")).alias("missing"), F.datediff(F.lit("2024-02-01").cast("date"), "day").cast("long").alias("age_days"))


@query("calibration_bins", "WITH p AS (SELECT (user_id % 100) / 100.0::DOUBLE AS p, (value > 50)::INTEGER AS y FROM events) SELECT floor(round(p / 0.05, 9))::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS actual, round(avg(y) - (SELECT avg(y) FROM p), 6) AS lift FROM p GROUP BY 1")
def _(spark, sf):
    p = t(spark, sf, "events").select(((F.col("user_id") % 100) / 100.0).alias("p"), (F.col("value") > 50).cast("int").alias("y"))
    base = p.agg(F.avg("y").alias("base"))
    g = p.groupBy(F.floor(F.round(F.col("p") / 0.05, 9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("pp"), F.avg("y").alias("yy")).crossJoin(F.broadcast(base))
    return g.select("bin", "n", F.round("pp", 6).alias("predicted"), F.round("yy", 6).alias("actual"), F.round(F.col("yy") - F.col("base"), 6).alias("lift"))


@query("universe_merge", "WITH u AS (SELECT o_custkey AS strategy, o_orderpriority AS freq, unnest([l_partkey % 50, l_suppkey % 50]) AS ticker FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT freq, count(DISTINCT ticker) AS n_merged, count(DISTINCT (strategy, ticker)) AS n_separate, round(1 - count(DISTINCT ticker) / count(DISTINCT (strategy, ticker))::DOUBLE, 6) AS savings FROM u GROUP BY 1")
def _(spark, sf):
    u = t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("strategy"), F.col("o_orderpriority").alias("freq"), F.explode(F.array(F.col("l_partkey") % 50, F.col("l_suppkey") % 50)).alias("ticker"))
    one = u.distinct().groupBy("freq", "ticker").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("freq").agg(F.count(F.lit(1)).alias("n_merged"), F.sum("n").alias("n_separate")).withColumn("savings", F.round(1 - F.col("n_merged") / F.col("n_separate"), 6))


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("latest_n_reversed", "SELECT * FROM (SELECT event_id, ts, value FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 50) ORDER BY ts")
def _(spark, sf):
    return t(spark, sf, "events").where("event_type = 'view'").select("event_id", "ts", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).orderBy("ts", "event_id")


@query("arg_best_per_group", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, max(o_totalprice) AS price FROM orders GROUP BY 1")
def _(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"), F.max("o_totalprice").alias("price"))


@query("business_day_neighbours", f"WITH {DAILY}, b AS (SELECT DISTINCT day FROM daily WHERE isodow(day) < 6), a AS (SELECT DISTINCT day FROM daily WHERE asset = '2-HIGH') SELECT day, (SELECT min(b.day) FROM b WHERE b.day > a.day) AS next_day, (SELECT max(b.day) FROM b WHERE b.day < a.day) AS prev_day FROM a")
def _(spark, sf):
    from ..functions.calendar import neighbours

    d = daily(spark, sf)
    asked = d.where("asset = '2-HIGH'").select("day").distinct()
    return neighbours(asked, d.where(F.weekday("day") < 5).select("day").distinct(), day="day")


@query("rank_by_score", "WITH s AS (SELECT l_suppkey, 0.6::DOUBLE * avg(l_quantity) / 50 + 0.4::DOUBLE * avg(l_discount) * 10 AS score FROM lineitem GROUP BY 1) SELECT l_suppkey, round(score, 8) AS score, row_number() OVER (ORDER BY round(score, 8) DESC, l_suppkey)::INTEGER AS rank FROM s ORDER BY rank LIMIT 40")
def _(spark, sf):
    s = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(0.6 * F.avg("l_quantity") / 50 + 0.4 * F.avg("l_discount") * 10, 8).alias("score"))
    top = s.orderBy(F.desc("score"), "l_suppkey").limit(40)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "l_suppkey")))


@query("union_of_days", "SELECT DISTINCT day FROM (SELECT o_orderdate::DATE AS day FROM orders UNION ALL SELECT l_shipdate::DATE FROM lineitem)")
def _(spark, sf):
    return t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).unionByName(t(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))).distinct()


@query("concat_frames", "SELECT 'h' AS part, event_id, value FROM events WHERE ts < TIMESTAMP '2024-01-29' AND event_type = 'click' UNION ALL SELECT 'd', event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND event_type = 'click'")
def _(spark, sf):
    e = t(spark, sf, "events").where("event_type = 'click'")
    cut = F.lit("2024-01-29").cast("timestamp")
    return e.where(F.col("ts") < cut).select(F.lit("h").alias("part"), "event_id", "value").unionByName(e.where(F.col("ts") >= cut).select(F.lit("d").alias("part"), "event_id", "value"))


@query("intersect_days", f"WITH {DAILY} SELECT day FROM daily WHERE asset = '1-URGENT' INTERSECT SELECT day FROM daily WHERE asset = '2-HIGH'")
def _(spark, sf):
    d = daily(spark, sf)
    return d.where("asset = '1-URGENT'").select("day").intersect(d.where("asset = '2-HIGH'").select("day"))


@query("difference_days", f"WITH {DAILY} SELECT day FROM daily WHERE asset = '1-URGENT' EXCEPT SELECT day FROM daily WHERE asset = '2-HIGH'")
def _(spark, sf):
    d = daily(spark, sf)
    return d.where("asset = '1-URGENT'").select("day").subtract(d.where("asset = '2-HIGH'").select("day"))


@query("tag_overlap", "SELECT event_id FROM events WHERE list_has_any([event_type, 'u' || (user_id % 10)::VARCHAR], ['purchase', 'u3'])")
def _(spark, sf):
    tags = F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")))
    return t(spark, sf, "events").where(F.arrays_overlap(tags, F.array(F.lit("purchase"), F.lit("u3")))).select("event_id")


@query("dedup_keep_one", "SELECT o_custkey, o_orderdate::DATE AS day, min(o_orderkey) AS kept FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.min("o_orderkey").alias("kept"))


@query("nth_row_sample", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) // 100 AS step FROM events) SELECT event_type, event_id FROM r WHERE i % step = 0 AND i <= step * 100")
def _(spark, sf):
    return windows.sample_every(t(spark, sf, "events"), ["event_type"], ["ts", "event_id"], 100).select("event_type", "event_id")
