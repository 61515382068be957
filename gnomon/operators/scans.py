"""Market scans: whales, spikes, sum-to-one deviations, arbitrage, prediction markets, health ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import quality


def whales(trades: DataFrame, *, keys: list[str], always: float) -> DataFrame:
    """Single trades at the floor or above, largest first."""
    return trades.where(F.col("quote") >= always).orderBy(F.desc("quote"), "trade_id")


def windowed_whales(trades: DataFrame, *, keys: list[str], seconds: int, always: float, never: float, n_threshold: int = 30, start: Column | None = None) -> DataFrame:
    """Windows whose total is at the ``always`` floor, or in the middle zone and a high outlier among its key's windows there.

    ``middle`` counts those; of fewer than ``n_threshold``, outliers are told by the modified z.
    ``start`` is where a trade's window starts, in milliseconds, if not at whole windows since 1970.
    """
    bucket = F.floor(F.unix_millis("ts") / (seconds * 1000)) * (seconds * 1000) if start is None else start
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("quote")).otherwise(0.0))
    rows = trades.groupBy(*keys, bucket.alias("window_ms")).agg(F.count(F.lit(1)).alias("trades"), F.sum("quote").alias("total"), side("buy").alias("buy"), side("sell").alias("sell"))
    rows = rows.withColumn("imbalance", F.when(F.col("total") > 0, (F.col("buy") - F.col("sell")) / F.col("total")).otherwise(0.0))
    rows = rows.withColumn("__mid", F.when((F.col("total") >= never) & (F.col("total") < always), F.col("total")))
    rows = rows.withColumn("middle", F.count("__mid").over(Window.partitionBy(*keys)))
    rows = quality.adaptive_outliers(rows, keys=keys, value="__mid", n_threshold=n_threshold, upper=True)
    flag, _ = quality.tiered(F.col("total"), F.col("outlier"), always, never)
    return rows.where(flag).withColumn("reason", F.when(F.col("total") >= always, "always_floor").otherwise("statistical")).drop("__mid", "outlier")


def spikes(prices: DataFrame, *, keys: list[str], ts: str, price: str, minutes: int, threshold_pct: float, lowest: float, highest: float, reversion_rows: int = 120) -> DataFrame:
    """Rows whose largest move within the next minutes is at least the threshold; its peak and how far it came back after.

    The ways ahead are range and row frames of the ordered series.  A price of 0
    starts no move, and nothing comes back from a peak of 0.
    """
    w = Window.partitionBy(*keys).orderBy("__t")
    rows = prices.withColumn("__t", F.unix_micros(ts)).withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy("__t", price)))
    ahead = w.rangeBetween(1, minutes * 60 * 1_000_000)
    point = F.struct(F.col(price).alias("p"), F.col("__t").alias("t"), F.col("__i").alias("i"))
    rows = rows.withColumn("__hi", F.max(point).over(ahead)).withColumn("__lo", F.min(point).over(ahead))
    start, peak = F.nullif(F.col(price), F.lit(0.0)), F.nullif(F.col("__peak.p"), F.lit(0.0))
    up, down = F.col("__hi.p") / start - 1, F.col("__lo.p") / start - 1
    rows = rows.withColumn("__peak", F.when(F.abs(up) >= F.abs(down), F.col("__hi")).otherwise(F.col("__lo"))).withColumn("pct", 100 * (F.col("__peak.p") / start - 1))
    found = rows.where((F.abs("pct") >= threshold_pct) & F.col(price).between(lowest, highest))
    after = rows.select(*keys, F.col("__i").alias("__pi"), F.min(price).over(w.rowsBetween(1, reversion_rows)).alias("__after_lo"), F.max(price).over(w.rowsBetween(1, reversion_rows)).alias("__after_hi"))
    joined = found.withColumn("__pi", F.col("__peak.i")).join(after, [*keys, "__pi"], "left")
    back = F.when(F.col("pct") > 0, F.least(F.col("__after_lo") / peak - 1, F.lit(0.0))).otherwise(F.greatest(F.col("__after_hi") / peak - 1, F.lit(0.0)))
    return joined.select(*keys, ts, F.col(price).alias("start_price"), F.timestamp_micros("__peak.t").alias("peak_ts"), F.col("__peak.p").alias("peak_price"), "pct", F.when(F.col("pct") > 0, "UP").otherwise("DOWN").alias("direction"), F.coalesce(100 * back, F.lit(0.0)).alias("reversion_pct"))


def event_structure(title: Column) -> list[Column]:
    """How many outcomes of an event come true, from its title (fixed values); 0 where a sum means nothing."""
    low = F.lower(title)
    nested = low.rlike(r"before|released by|out by|hit \$|reach \$|above \$|more than \$|over \$|exceed|market cap|what will happen")
    k = F.when(nested, 0).when(low.rlike("top 4"), 4).when(low.rlike("top 6"), 6).when(low.rlike("top 2"), 2).when(low.rlike("relegat|promot"), 3).otherwise(1)
    return [k.alias("k"), (k == 0).alias("skip")]


def sum_to_one(outcomes: DataFrame, *, event: str, price: str, k: str, fee: float = S.FEE, least: int = 3) -> DataFrame:
    """Deviation of an event's summed prices from its ``k``, and what is left after fees."""
    g = outcomes.groupBy(event).agg(F.count(price).alias("outcomes"), F.sum(price).alias("total"), F.max(k).alias("k"))
    g = g.where((F.col("outcomes") >= least) & (F.col("k") > 0)).withColumn("deviation", F.col("total") - F.col("k"))
    return g.withColumn("net_profit", F.abs("deviation") - fee * F.col("k"))


def bundle(outcomes: DataFrame, *, event: str, k: str, fee: float = S.FEE) -> DataFrame:
    """Buying or selling every outcome: sums of asks and bids against ``k``, sized by the thinnest book."""
    g = outcomes.groupBy(event).agg(F.sum("ask").alias("asks"), F.sum("bid").alias("bids"), F.min(F.least("ask_depth", "bid_depth")).alias("size"), F.max(k).alias("k"))
    return g.withColumn("buy_edge", F.col("k") * (1 - fee) - F.col("asks")).withColumn("sell_edge", F.col("bids") - F.col("k") * (1 + fee))


def binary_merge(markets: DataFrame, *, yes: str, no: str, fee: float = S.FEE) -> DataFrame:
    """Markets where both sides together cost less than a payout after fees."""
    return markets.withColumn("edge", 1 - fee - F.col(yes) - F.col(no)).where("edge > 0")


def venue_arbitrage(quotes: DataFrame, *, pair: str, venue: str, bid: str, ask: str, fee_bps: str, sanity_bps: float = 500.0) -> DataFrame:
    """Buying at one venue and selling at another of the same pair, net of both fees; gaps beyond the sanity limit are bad quotes.

    The number of rows is that of venues squared within a pair, not of quotes: each venue has one quote.
    """
    sell = quotes.select(pair, *(F.col(c).alias(f"{c}_2") for c in (venue, bid, fee_bps)))
    both = quotes.join(sell, pair).where(F.col(venue) != F.col(f"{venue}_2"))
    gross = (F.col(f"{bid}_2") / F.col(ask) - 1) * 10_000
    out = both.withColumn("gross_bps", gross).withColumn("net_bps", gross - F.col(fee_bps) - F.col(f"{fee_bps}_2"))
    return out.where((F.col("net_bps") > 0) & (F.col("gross_bps") <= sanity_bps))


#: Flash-loan providers and their fees in basis points.
PROVIDERS = (("balancer", 0.0), ("aave", 5.0), ("uniswap", 30.0))


def flash_profit(deviation: Column, capital: Column, gas: Column, fee: float = S.FEE) -> tuple[Column, Column]:
    """Net profit with the cheapest provider, and its name."""
    options = F.array(*(F.struct((capital * bps / 1e4).alias("cost"), F.lit(n).alias("name")) for n, bps in PROVIDERS))
    best = F.array_min(options)
    return deviation * capital - fee * capital - best["cost"] - gas, best["name"]


def gas_threshold(df: DataFrame, *, order: list[str], keys: list[str], gas: str, ratio: float = 0.5, n: int = 20) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("gas_avg", F.avg(gas).over(w)).withColumn("gas_limit", F.col("gas_avg") * (1 + ratio)).withColumn("gas_ok", F.col(gas) <= F.col("gas_limit"))


def evaluate(df: DataFrame, *, price: str, prob: str, days: str, side: str) -> DataFrame:
    """Expected value, annual return, Kelly share, efficiency and recommendation of a binary position."""
    no = F.col(side) == "NO"
    p, q, d = F.when(no, 1 - F.col(price)).otherwise(F.col(price)), F.when(no, 1 - F.col(prob)).otherwise(F.col(prob)), F.col(days)
    rows = df.withColumn("ev", S.expected_value(p, q))
    rows = rows.withColumn("annual", S.annualised(F.col("ev"), d)).withColumn("kelly", S.kelly(q, p))
    rows = rows.withColumn("efficiency", S.capital_efficiency(F.col("annual"), d))
    a, k = F.col("annual"), F.col("kelly")
    what = F.when(F.col("ev") <= 0, "AVOID").when(a < S.RISKLESS, "AVOID").when(a < S.LEAST_RETURN, "MARGINAL").when((d > 180) & (a < 0.20), "WEAK_HOLD").when((k > 0.05) & (a > 0.30), "STRONG_BUY").when(k > 0.02, "BUY").otherwise("MARGINAL")
    return rows.withColumn("recommendation", what)


def clusters(markets: DataFrame, *, market: str, keys: str, least: int = 2) -> DataFrame:
    """Markets that share a key (of an array of keys), with at least so many members."""
    return markets.select(market, F.explode(keys).alias("key")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(market).alias("first_member")).where(F.col("members") >= least)


def maker_score(bid: Column, ask: Column, volume: Column) -> list[Column]:
    """Suitability for quoting: wide enough spread, enough volume; and quotes around the middle."""
    mid, spread = (bid + ask) / 2, ask - bid
    score = F.least(spread / 0.10, F.lit(1.0)) * 50 + F.least(volume / 10_000, F.lit(1.0)) * 50
    ok = (spread >= 0.02) & (volume >= 1000) & mid.between(0.1, 0.9)
    return [F.when(ok, score).otherwise(0.0).alias("score"), F.round(mid - spread / 4, 4).alias("quote_bid"), F.round(mid + spread / 4, 4).alias("quote_ask")]


def threshold_probability(members: DataFrame, *, keys: list[str], value: str, threshold: Column, over: bool = True) -> DataFrame:
    """Share of an ensemble's members above (or below) a threshold."""
    hit = F.col(value) > threshold if over else F.col(value) < threshold
    return members.groupBy(*keys).agg(F.avg(hit.cast("int")).alias("probability"), F.count(value).alias("members"))


def overreaction(snapshots: DataFrame, *, market: str, ts: str, price: str, tie: str, hours: tuple[int, ...] = (6, 12, 24), tolerance: int = 1800) -> DataFrame:
    """Largest move of each snapshot against the newest one around some hours earlier; the best snapshot of each market."""
    w = Window.partitionBy(market).orderBy("__t")
    rows = snapshots.withColumn("__t", F.unix_seconds(ts))
    point = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(price).alias("price"))
    moves = []
    for h in hours:
        rows = rows.withColumn(f"__p{h}", F.max(point).over(w.rangeBetween(-h * 3600 - tolerance, -h * 3600 + tolerance))["price"])
        move = F.col(price) / F.nullif(F.col(f"__p{h}"), F.lit(0.0)) - 1
        moves.append(F.when(move.isNotNull(), F.struct(F.abs(move).alias("size"), F.lit(h).alias("hours"), move.alias("move"))))
    rows = rows.withColumn("__b", F.array_max(F.array_compact(F.array(*moves)))).where(F.col("__b").isNotNull())
    best = F.max_by(F.struct("__b.move", "__b.hours", F.col(ts)), F.struct("__b.size", "__b.hours", F.col(ts), F.col(tie)))
    return rows.groupBy(market).agg(best.alias("r")).select(market, "r.*")


def health(df: DataFrame, *, failures: str, age_hours: str) -> Column:
    """What to do about a scheduled model."""
    f, a = F.col(failures), F.col(age_hours)
    return F.when(f >= 3, "disable").when(f >= 2, "reduce").when(a > 48, "restart").when(a > 24, "warn").otherwise("ok")


def trade_summary(trades: DataFrame, *, keys: list[str], ret: str) -> DataFrame:
    win = F.col(ret) > 0
    return trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(win.cast("int")).alias("win_rate"), F.avg(ret).alias("mean"), F.sum(ret).alias("total"), F.min(ret).alias("worst"), F.max(ret).alias("best"))


def flash_gate(df: DataFrame, *, strength: str, profit: str, gas: str, trades_today: str, least_strength: float = 1.5, most_trades: int = 20) -> DataFrame:
    """``go`` and the first reason against it."""
    why = F.when(F.col(strength) < least_strength, "weak_signal").when(F.col(profit) <= F.col(gas), "cost").when(F.col(trades_today) >= most_trades, "daily_limit")
    return df.withColumn("reason", why).withColumn("go", F.col("reason").isNull())


def depth_quote(sqrt_a: int, liquidity_a: int, fee_a: int, sqrt_b: int, liquidity_b: int, fee_b: int, amount: int, gas: float = 0.0) -> dict:
    """Two legs, in at one pool and back at the other: output, impact of each leg, and what is left after gas, in whole units."""
    out, after_a = S.swap_output(sqrt_a, liquidity_a, amount, fee_a, True)
    back, after_b = S.swap_output(sqrt_b, liquidity_b, out, fee_b, False)
    return {"out": back, "impact_a": 1 - (after_a / sqrt_a) ** 2, "impact_b": (after_b / sqrt_b) ** 2 - 1, "net": back - amount - gas}


def surface_features(chain: DataFrame, *, keys: list[str]) -> DataFrame:
    """At-the-money volatility, skew and term slope of option chains ``(keys, expiry_days, moneyness, iv)``."""
    near = lambda m: F.min_by("iv", F.abs(F.col("moneyness") - m))
    by = chain.groupBy(*keys, "expiry_days").agg(near(1.0).alias("atm"), near(0.9).alias("put"), near(1.1).alias("call"))
    return by.groupBy(*keys).agg(F.min_by("atm", "expiry_days").alias("atm_iv"), F.min_by(F.col("put") - F.col("call"), F.col("expiry_days")).alias("skew"), (F.max_by("atm", "expiry_days") - F.min_by("atm", "expiry_days")).alias("term_slope"), F.max("expiry_days").alias("longest"))
