"""The versioned store, window functions and resampling as registered queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality, resample, temporal, windows
from .base import BARS, DAILY, TRADES, VERSIONS, bars, daily, query, t, trades, versions
from .param_grids import literal


@query("latest_version", f"WITH {VERSIONS} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY hist_id DESC, seq DESC) AS rn FROM versions) WHERE rn = 1")
def _(spark, sf):
    return temporal.latest(versions(spark, sf), key=["base_id"], order=["hist_id", "seq"])


@query("same_day_collapse", f"WITH {VERSIONS} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY base_id, hist_id::DATE ORDER BY hist_id DESC, seq DESC) AS rn FROM versions) WHERE rn = 1")
def _(spark, sf):
    return temporal.same_day_last(versions(spark, sf), key=["base_id"], ts="hist_id", tie="seq")


_IV = f"{VERSIONS}, iv AS (SELECT * EXCLUDE (rn), hist_id::DATE AS start_date, coalesce(lead(hist_id::DATE) OVER (PARTITION BY base_id ORDER BY hist_id) - 1, DATE '9999-12-31') AS end_date FROM (SELECT *, row_number() OVER (PARTITION BY base_id, hist_id::DATE ORDER BY hist_id DESC, seq DESC) AS rn FROM versions) WHERE rn = 1)"


def _intervals(spark, sf):
    return temporal.intervals(versions(spark, sf), key=["base_id"], ts="hist_id", tie="seq")


@query("validity_intervals", f"WITH {_IV} SELECT base_id, seq, status, start_date, end_date FROM iv")
def _(spark, sf):
    return _intervals(spark, sf).select("base_id", "seq", "status", "start_date", "end_date")


@query("overlap_audit", f"WITH {_IV} SELECT base_id, seq FROM (SELECT *, lead(start_date) OVER (PARTITION BY base_id ORDER BY start_date) AS nx FROM iv) WHERE nx <= end_date")
def _(spark, sf):
    return temporal.overlaps(_intervals(spark, sf), key=["base_id"]).select("base_id", "seq")


@query("as_was", f"WITH {_IV} SELECT base_id, seq, status, amount FROM iv WHERE DATE '1998-06-30' BETWEEN start_date AND end_date")
def _(spark, sf):
    return temporal.as_was(_intervals(spark, sf), F.lit("1998-06-30").cast("date")).select("base_id", "seq", "status", "amount")


@query("as_is_one_id", f"WITH {_IV} SELECT base_id, seq, status, amount FROM iv WHERE end_date = DATE '9999-12-31' AND base_id = 330")
def _(spark, sf):
    rows = versions(spark, sf).where("base_id = 330")  # the key's filter reaches the scan
    return temporal.intervals(rows, key=["base_id"], ts="hist_id", tie="seq").where("end_date = date'9999-12-31'").select("base_id", "seq", "status", "amount")


@query("as_was_batch", f"WITH {_IV}, q AS (SELECT c_custkey AS base_id, DATE '1996-01-01' + (c_custkey % 1500)::INTEGER AS day FROM customer) SELECT q.base_id, q.day, iv.seq FROM q JOIN iv ON iv.base_id = q.base_id AND q.day BETWEEN start_date AND end_date")
def _(spark, sf):
    asked = t(spark, sf, "customer").select(F.col("c_custkey").alias("base_id"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 1500).cast("int")).alias("day"))
    return temporal.as_was_batch(_intervals(spark, sf), asked, key="base_id", day="day").select("base_id", "day", "seq")


@query("temporal_compare", f"WITH {_IV}, a AS (SELECT base_id, status, amount FROM iv WHERE DATE '1998-06-30' BETWEEN start_date AND end_date), b AS (SELECT base_id, status, amount FROM iv WHERE end_date = DATE '9999-12-31') SELECT base_id, 'status' AS field, a.status AS was, b.status AS is_now FROM a JOIN b USING (base_id) WHERE a.status <> b.status")
def _(spark, sf):
    iv = _intervals(spark, sf)
    return temporal.compare(temporal.as_was(iv, F.lit("1998-06-30").cast("date")), iv.where("end_date = date'9999-12-31'"), key="base_id", fields=["status"])


@query("point_in_time_members", "WITH iv(idx, ticker, a, b) AS (VALUES ('X', 'AAA', DATE '1996-01-01', DATE '1998-02-28'), ('X', 'BBB', DATE '1995-01-01', DATE '9999-12-31'), ('X', 'CCC', DATE '1998-03-01', DATE '9999-12-31')), d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT day, ticker FROM d JOIN iv ON day BETWEEN a AND b")
def _(spark, sf):
    iv = literal(spark, ["ticker", "a", "b"], [("AAA", "1996-01-01", "1998-02-28"), ("BBB", "1995-01-01", "9999-12-31"), ("CCC", "1998-03-01", "9999-12-31")])
    iv = iv.select("ticker", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    d = t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return d.join(F.broadcast(iv), F.col("day").between(F.col("a"), F.col("b"))).select("day", "ticker")


@query("membership_from_changes", "SELECT * FROM (VALUES ('X', 'AAA', DATE '1996-05-01', DATE '1999-12-31'), ('X', 'BBB', DATE '1990-01-01', DATE '9999-12-31'), ('X', 'CCC', DATE '1990-01-01', DATE '1996-04-30'), ('X', 'CCC', DATE '2001-01-01', DATE '9999-12-31')) v(idx, ticker, start_date, end_date)")
def _(spark, sf):
    changes = literal(spark, ["idx", "ticker", "d", "action"], [("X", "AAA", "1996-05-01", "added"), ("X", "AAA", "2000-01-01", "removed"), ("X", "CCC", "1996-05-01", "removed"), ("X", "CCC", "2001-01-01", "added")]).withColumn("d", F.to_date("d"))
    current = literal(spark, ["idx", "ticker"], [("X", "BBB"), ("X", "CCC")])
    return temporal.reversed_membership(changes, current, index="idx", ticker="ticker", day="d", action="action", history_start="1990-01-01")


@query("lag_return", f"WITH {DAILY} SELECT asset, day, round((price - lag(price) OVER w) / nullif(lag(price) OVER w, 0), 8) AS ret FROM daily WINDOW w AS (PARTITION BY asset ORDER BY day)")
def _(spark, sf):
    return daily(spark, sf).select("asset", "day", F.round(windows.pct_change("price", windows.series(["asset"], "day")), 8).alias("ret"))


@query("gap_by_lead", f"WITH {DAILY} SELECT asset, day, lead(day) OVER w AS next_day, date_diff('day', day, lead(day) OVER w)::INTEGER AS gap_days FROM daily WINDOW w AS (PARTITION BY asset ORDER BY day) QUALIFY gap_days > 4")
def _(spark, sf):
    return quality.gap_by_lead(daily(spark, sf).select("asset", "day"), keys=["asset"], day="day")


@query("rolling_stats", f"WITH {BARS} SELECT asset, ts, CASE WHEN count(close) OVER w = 20 THEN round(avg(close) OVER w, 6) END AS ma, CASE WHEN count(close) OVER w = 20 THEN round(stddev_samp(close) OVER w, 6) END AS sd, CASE WHEN count(close) OVER w = 20 THEN max(high) OVER w END AS hi, CASE WHEN count(close) OVER w = 20 THEN min(low) OVER w END AS lo FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING)")
def _(spark, sf):
    w = windows.series(["asset"], "ts")
    return bars(spark, sf).select("asset", "ts", F.round(windows.rolling_mean("close", w, 20), 6).alias("ma"), F.round(windows.rolling_std("close", w, 20), 6).alias("sd"), windows.rolling_max("high", w, 20).alias("hi"), windows.rolling_min("low", w, 20).alias("lo"))


@query("rolling_before_current", f"WITH {BARS} SELECT asset, ts, round(avg(close) OVER w, 6) AS ma, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def _(spark, sf):
    w = windows.series(["asset"], "ts").rowsBetween(-20, -1)
    return bars(spark, sf).select("asset", "ts", F.round(F.avg("close").over(w), 6).alias("ma"), F.count(F.lit(1)).over(w).alias("n"))


_EQ = f"{BARS}, r AS (SELECT asset, ts, greatest(coalesce(0.01::DOUBLE * (close - lag(close) OVER (PARTITION BY asset ORDER BY ts)) / lag(close) OVER (PARTITION BY asset ORDER BY ts), 0), -0.999999) AS r FROM bars), e AS (SELECT asset, ts, exp(sum(ln(1 + r)) OVER (PARTITION BY asset ORDER BY ts)) AS eq FROM r)"


def _equity(spark, sf):
    w = windows.series(["asset"], "ts")
    r = bars(spark, sf).select("asset", "ts", (0.01 * windows.pct_change("close", w)).alias("r"))
    return r.select("asset", "ts", windows.growth("r", w).alias("eq")), w


@query("cumulative_product", f"WITH {_EQ} SELECT asset, ts, round(ln(eq), 6) + 0.0 AS log_equity FROM e")
def _(spark, sf):
    e, _ = _equity(spark, sf)
    return e.select("asset", "ts", (F.round(F.ln("eq"), 6) + 0.0).alias("log_equity"))


@query("drawdown", f"WITH {_EQ} SELECT asset, ts, round((eq - max(eq) OVER w) / max(eq) OVER w, 6) AS dd FROM e WINDOW w AS (PARTITION BY asset ORDER BY ts)")
def _(spark, sf):
    e, w = _equity(spark, sf)
    return e.select("asset", "ts", F.round(windows.drawdown("eq", w), 6).alias("dd"))


@query("underwater_runs", f"WITH {_EQ}, d AS (SELECT asset, ts, eq < max(eq) OVER (PARTITION BY asset ORDER BY ts) AS under FROM e), g AS (SELECT asset, ts, under, sum(CASE WHEN under THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY ts) AS g FROM d), c AS (SELECT asset, g, count(*) FILTER (WHERE under) AS n FROM g GROUP BY 1, 2) SELECT asset, max(n) AS longest FROM c GROUP BY 1")
def _(spark, sf):
    e, w = _equity(spark, sf)
    d = e.withColumn("under", windows.drawdown("eq", w) < 0)
    runs = windows.run_ids(d, ["asset"], ["ts"], F.col("under"))
    return runs.groupBy("asset", "run").agg(F.count_if("under").alias("n")).groupBy("asset").agg(F.max("n").alias("longest"))


@query("cumulative_deviation", f"WITH {BARS}, c AS (SELECT asset, ts, close, (row_number() OVER (PARTITION BY asset ORDER BY ts) - 1) // 63 AS chunk FROM bars), m AS (SELECT *, close - avg(close) OVER (PARTITION BY asset, chunk) AS d FROM c) SELECT asset, ts, chunk, round(sum(d) OVER (PARTITION BY asset, chunk ORDER BY ts), 4) + 0.0 AS cumdev FROM m")
def _(spark, sf):
    c = bars(spark, sf).withColumn("chunk", F.floor((F.row_number().over(windows.series(["asset"], "ts")) - 1) / 63))
    part = Window.partitionBy("asset", "chunk")
    c = c.withColumn("d", F.col("close") - F.avg("close").over(part))
    return c.select("asset", "ts", "chunk", (F.round(F.sum("d").over(part.orderBy("ts")), 4) + 0.0).alias("cumdev"))


@query("stale_runs", "WITH r AS (SELECT event_type, event_id, ts, user_id % 3 AS v FROM events), n AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS nw FROM r WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), g AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM n) SELECT event_type, any_value(v) AS v, min(ts) AS first_at, max(ts) AS last_at, count(*) AS rows FROM g GROUP BY event_type, g HAVING count(*) >= 4")
def _(spark, sf):
    r = t(spark, sf, "events").select("event_type", "event_id", "ts", (F.col("user_id") % 3).alias("v"))
    return quality.stale_runs(r, keys=["event_type"], order=["ts", "event_id"], value="v", least=4)


@query("missing_day_islands", f"WITH {DAILY}, c AS (SELECT a.asset, d::DATE AS day FROM (SELECT DISTINCT asset FROM daily) a, range(TIMESTAMP '1995-01-02', TIMESTAMP '1995-12-30', INTERVAL 1 DAY) r(d) WHERE isodow(d) < 6), m AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM daily x WHERE x.asset = c.asset AND x.day = c.day)), n AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) <= 4 THEN 0 ELSE 1 END AS nw FROM m WINDOW w AS (PARTITION BY asset ORDER BY day)), g AS (SELECT *, sum(nw) OVER (PARTITION BY asset ORDER BY day) AS g FROM n) SELECT asset, min(day) AS first_missing, max(day) AS last_missing, count(*) AS days FROM g GROUP BY asset, g")
def _(spark, sf):
    d = daily(spark, sf)
    spans = d.select("asset").distinct().select("asset", F.lit("1995-01-02").cast("date").alias("a"), F.lit("1995-12-29").cast("date").alias("b"))
    return quality.missing_day_islands(resample.expand_calendar(spans, keys=["asset"], first="a", last="b"), d, keys=["asset"], day="day")


@query("shift_and_diff", f"WITH {BARS} SELECT asset, ts, lag(close, 3) OVER w AS close_3, round(close - lag(close) OVER w, 6) AS diff FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts)")
def _(spark, sf):
    w = windows.series(["asset"], "ts")
    return bars(spark, sf).select("asset", "ts", F.lag("close", 3).over(w).alias("close_3"), F.round(F.col("close") - F.lag("close").over(w), 6).alias("diff"))


_MA2 = f"{BARS}, m AS (SELECT asset, ts, CASE WHEN count(*) OVER f = 5 THEN avg(close) OVER f END AS a, CASE WHEN count(*) OVER s = 20 THEN avg(close) OVER s END AS b FROM bars WINDOW f AS (PARTITION BY asset ORDER BY ts ROWS 4 PRECEDING), s AS (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING))"


@query("cross_events", f"WITH {_MA2} SELECT asset, ts, coalesce(lag(a) OVER w <= lag(b) OVER w AND a > b, false) AS up, coalesce(lag(a) OVER w >= lag(b) OVER w AND a < b, false) AS down FROM m WINDOW w AS (PARTITION BY asset ORDER BY ts)")
def _(spark, sf):
    w = windows.series(["asset"], "ts")
    m = bars(spark, sf).select("asset", "ts", windows.rolling_mean("close", w, 5).alias("a"), windows.rolling_mean("close", w, 20).alias("b"))
    return m.select("asset", "ts", windows.crosses_up("a", "b", w).alias("up"), windows.crosses_down("a", "b", w).alias("down"))


@query("rolling_any", f"WITH {BARS} SELECT asset, ts, max((close > 150)::INTEGER) OVER (PARTITION BY asset ORDER BY ts ROWS 9 PRECEDING) AS seen FROM bars")
def _(spark, sf):
    w = windows.series(["asset"], "ts").rowsBetween(-9, 0)
    return bars(spark, sf).select("asset", "ts", F.max((F.col("close") > 150).cast("int")).over(w).alias("seen"))


@query("divergences", f"WITH {BARS} SELECT asset, ts, count(*) OVER o = 5 AND min(low) OVER n < min(low) OVER o AND min(volume) OVER n > min(volume) OVER o AS bull_div, count(*) OVER o = 5 AND max(high) OVER n > max(high) OVER o AND max(volume) OVER n < max(volume) OVER o AS bear_div FROM (SELECT * REPLACE (close AS low, close AS high) FROM bars) WINDOW n AS (PARTITION BY asset ORDER BY ts ROWS 4 PRECEDING), o AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING)")
def _(spark, sf):
    d = windows.divergence(bars(spark, sf), ["asset"], "ts", "close", "volume")
    return d.select("asset", "ts", F.coalesce("bull_div", F.lit(False)).alias("bull_div"), F.coalesce("bear_div", F.lit(False)).alias("bear_div"))


@query("cross_sectional_rank", f"WITH {DAILY} SELECT day, asset, row_number() OVER (PARTITION BY day ORDER BY price, asset)::INTEGER - 1 AS rank FROM daily")
def _(spark, sf):
    return daily(spark, sf).select("day", "asset", (F.row_number().over(windows.series(["day"], "price", "asset")) - 1).alias("rank"))


@query("forward_fill", "WITH x AS (SELECT event_type, event_id, ts, CASE WHEN user_id % 4 = 0 THEN value END AS v FROM events) SELECT event_type, event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS filled FROM x")
def _(spark, sf):
    x = t(spark, sf, "events").withColumn("v", F.when(F.col("user_id") % 4 == 0, F.col("value")))
    return x.select("event_type", "event_id", windows.forward_fill("v", windows.series(["event_type"], "ts", "event_id")).alias("filled"))


@query("time_range_frame", f"WITH {TRADES} SELECT asset, trade_id, round(quote - min(quote) OVER w, 6) AS up, round(max(quote) OVER w - quote, 6) AS down, count(*) OVER w AS n FROM trades WINDOW w AS (PARTITION BY asset ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    w = Window.partitionBy("asset").orderBy(F.unix_micros("ts")).rangeBetween(-3600 * 1000000, 0)
    return trades(spark, sf).select("asset", "trade_id", F.round(F.col("quote") - F.min("quote").over(w), 6).alias("up"), F.round(F.max("quote").over(w) - F.col("quote"), 6).alias("down"), F.count(F.lit(1)).over(w).alias("n"))


@query("resample_ohlcv", f"WITH {BARS} SELECT asset, ts, open, high, low, close, volume FROM bars")
def _(spark, sf):
    return bars(spark, sf)


@query("resample_last", "SELECT event_type AS asset, ts::DATE::TIMESTAMP AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def _(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    return resample.last_per_window(e, keys=["asset"], ts="ts", value="value", tie="event_id", every="1 day")


@query("complete_bars", "SELECT event_type AS asset, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume FROM events WHERE value > 0 GROUP BY 1, 2 HAVING count(*) = 2")
def _(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    return resample.ohlcv(e, keys=["asset"], ts="ts", price="value", amount="value", tie="event_id", every="30 minutes", exact=2)


@query("calendar_expansion", "SELECT c_custkey, d::DATE AS day FROM customer, range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-15', INTERVAL 1 DAY) r(d) WHERE isodow(d) < 6")
def _(spark, sf):
    ids = t(spark, sf, "customer").select("c_custkey", F.lit("2024-01-01").cast("date").alias("a"), F.lit("2024-01-14").cast("date").alias("b"))
    return resample.expand_calendar(ids, keys=["c_custkey"], first="a", last="b")


@query("walk_forward_windows", f"WITH {BARS}, n AS (SELECT asset, count(*) AS n FROM bars GROUP BY 1) SELECT asset, s::INTEGER AS est_start, s::INTEGER + 100 AS est_end, s::INTEGER + 100 AS sig_start, s::INTEGER + 130 AS sig_end FROM n, range(0, 100000, 30) r(s) WHERE s + 130 <= n")
def _(spark, sf):
    n = bars(spark, sf).groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    return resample.walk_forward(n, keys=["asset"], length="n", estimation=100, signal=30, step=30)


@query("concurrency_weights", f"WITH {BARS}, b AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM bars), l AS (SELECT asset, i, least(i + 5 + i % 7, n - 1) AS x FROM b), e AS (SELECT asset, i, unnest(range(i, x + 1)) AS j FROM l), c AS (SELECT asset, j, count(*) AS c FROM e GROUP BY 1, 2) SELECT asset, i, round(avg(1.0::DOUBLE / c), 6) AS uniqueness FROM e JOIN c USING (asset, j) GROUP BY 1, 2")
def _(spark, sf):
    from ..operators.labels import uniqueness

    w = windows.series(["asset"], "ts")
    b = bars(spark, sf).select("asset", (F.row_number().over(w) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(Window.partitionBy("asset")).alias("n"))
    lab = b.select("asset", "i", F.least(F.col("i") + 5 + F.col("i") % 7, F.col("n") - 1).alias("x"))
    return uniqueness(lab, keys=["asset"], entry="i", exit="x").select("asset", "i", F.round("uniqueness", 6).alias("uniqueness"))


@query("batch_validation", "WITH p AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS day, o_orderkey AS k, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END AS close, o_totalprice * 1.01 AS high, CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice * 1.02 ELSE o_totalprice * 0.99 END AS low, CASE WHEN o_orderkey % 103 = 0 THEN -1 ELSE o_totalprice END AS open FROM orders) SELECT count(*) AS received, count(*) FILTER (WHERE close IS NULL) AS nulls, count(*) FILTER (WHERE close IS NOT NULL AND open < 0) AS non_positive, count(*) FILTER (WHERE high < low) AS high_below_low, count(*) FILTER (WHERE day > DATE '2001-06-30') AS future FROM p")
def _(spark, sf):
    o, k = t(spark, sf, "orders"), F.col("o_orderkey")
    x = F.col("o_totalprice")
    p = o.select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day"), F.when(k % 97 != 0, x).alias("close"), (x * 1.01).alias("high"), F.when(k % 101 == 0, x * 1.02).otherwise(x * 0.99).alias("low"), F.when(k % 103 == 0, -1.0).otherwise(x).alias("open"))
    v = quality.validate_batch(p, keys=["symbol"], day="day", today=F.lit("2001-06-30").cast("date"))
    return v.select("received", "nulls", "non_positive", "high_below_low", "future")


@query("cross_source_check", "WITH a AS (SELECT o_orderkey AS k, o_totalprice AS close, o_totalprice AS volume FROM orders), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice * 1.03 ELSE o_totalprice END AS close, o_totalprice * 1.04 AS volume FROM orders), u AS (SELECT 'close' AS field, a.close AS x, b.close AS y, 0.01::DOUBLE AS tol FROM a JOIN b USING (k) UNION ALL SELECT 'volume', a.volume, b.volume, 0.05::DOUBLE FROM a JOIN b USING (k)) SELECT field, count(*) AS compared, count(*) FILTER (WHERE abs(x - y) / ((x + y) / 2) > tol) AS apart, round(max(abs(x - y) / ((x + y) / 2)), 9) AS largest FROM u GROUP BY 1")
def _(spark, sf):
    o, x = t(spark, sf, "orders"), F.col("o_totalprice")
    a = o.select(F.col("o_orderkey").alias("k"), x.alias("close"), x.alias("volume"))
    b = o.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 20 == 0, x * 1.03).otherwise(x).alias("close"), (x * 1.04).alias("volume"))
    return quality.cross_source(a, b, keys=["k"], fields={"close": 0.01, "volume": 0.05}).withColumn("largest", F.round("largest", 9))


@query("split_suspects", f"WITH {DAILY}, r AS (SELECT asset, day, price / lag(price) OVER (PARTITION BY asset ORDER BY day) AS ratio FROM daily) SELECT asset, day, CASE WHEN abs(ratio - 0.5) <= 0.01 THEN '2:1' WHEN abs(ratio - 1/3::DOUBLE) <= 0.02 / 3::DOUBLE THEN '3:1' WHEN abs(ratio - 0.25) <= 0.005 THEN '4:1' WHEN abs(ratio - 0.2) <= 0.004 THEN '5:1' WHEN abs(ratio - 0.1) <= 0.002 THEN '10:1' WHEN abs(ratio - 2) <= 0.04 THEN '1:2' WHEN abs(ratio - 5) <= 0.1 THEN '1:5' WHEN abs(ratio - 10) <= 0.2 THEN '1:10' END AS split FROM r WHERE split IS NOT NULL")
def _(spark, sf):
    return quality.split_suspects(daily(spark, sf), keys=["asset"], order="day", value="price").select("asset", "day", "split")


@query("adaptive_outliers", "WITH m AS (SELECT user_id, count(*) AS n, median(value) AS med, stddev_pop(value) AS sd FROM events GROUP BY 1), d AS (SELECT user_id, median(abs(value - med)) AS mad FROM events JOIN m USING (user_id) GROUP BY 1) SELECT event_id FROM events JOIN m USING (user_id) JOIN d USING (user_id) WHERE CASE WHEN n < 70 THEN abs(0.6745::DOUBLE * (value - med) / mad) > 3.5 ELSE value > med + 3 * sd END")
def _(spark, sf):
    return quality.adaptive_outliers(t(spark, sf, "events"), keys=["user_id"], value="value", n_threshold=70).where("outlier").select("event_id")


@query("collector_health", "SELECT event_type, count(*) AS rows, max(ts) AS latest, epoch(TIMESTAMP '2024-01-31')::BIGINT - epoch(date_trunc('second', max(ts)))::BIGINT AS age_seconds, CASE WHEN epoch(TIMESTAMP '2024-01-31')::BIGINT - epoch(date_trunc('second', max(ts)))::BIGINT > 1800 THEN 'stale' ELSE 'fresh' END AS status FROM events GROUP BY 1")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return quality.collector_health(e, keys=["event_type"], ts="ts", now=F.lit("2024-01-31").cast("timestamp"), limit_seconds=1800)
