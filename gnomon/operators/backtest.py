"""Sizing, back-tests, trades and risk checks."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W
from .folds import Columns, Machine, Step, ordered_fold

YEAR = 252


def fixed_fraction(signal: Column, fraction: float = 1.0) -> Column:
    return signal * F.lit(fraction)


def volatility_target(df: DataFrame, *, keys: list[str], order: list[str], value: str = "close", signal: str = "signal", target: float = 0.15, n: int = 20, per_year: int = YEAR, cap: float = 3.0) -> DataFrame:
    """``position``: the signal scaled to a target volatility, measured on the ``n`` returns before the row; the raw signal without one."""
    w = W.series(keys, *order)
    rows = df.withColumn("__r", W.pct_change(value, w))
    frame = w.rowsBetween(-n, -1)
    vol = F.when(F.count("__r").over(frame) == n, F.stddev_samp("__r").over(frame) * float(per_year) ** 0.5)
    scale = F.greatest(F.least(F.lit(target) / vol, F.lit(cap)), F.lit(-cap))
    return rows.withColumn("__vol", vol).withColumn("position", F.col(signal) * F.when(F.col("__vol") > 0, scale).otherwise(1.0)).drop("__r", "__vol")


def vectorised(df: DataFrame, *, keys: list[str], order: list[str], value: str = "close", position: str = "position", capital: float = 1.0) -> DataFrame:
    """``ret``: the position of the row before times the price change (missing counts as 0); ``equity`` with a first row at the capital."""
    w = W.series(keys, *order)
    ret = F.coalesce(F.lag(position).over(w) * W.pct_change(value, w), F.lit(0.0))
    rows = df.withColumn("ret", F.nanvl(ret, F.lit(0.0)))
    return rows.withColumn("equity", F.lit(capital) * W.growth("ret", w))


def trades(df: DataFrame, *, keys: list[str], order: list[str], value: str = "close", position: str = "position") -> DataFrame:
    """One row per trade: a run of one sign of the position; returns add up, an open trade ends with the series."""
    w = W.series(keys, *order)
    side = F.coalesce(F.signum(F.nanvl(F.col(position).cast("double"), F.lit(0.0))), F.lit(0.0))
    later = F.coalesce(F.col(position) * (F.lead(value).over(w) / F.col(value) - 1), F.lit(0.0))
    rows = df.withColumn("__side", side).withColumn("__fwd", later).withColumn("__i", F.row_number().over(w) - 1).withColumn("__next", F.lead(value).over(w))
    runs = W.run_ids(rows, keys, order, F.col("__side") == F.lag("__side").over(w))
    out = runs.where("__side <> 0").groupBy(*keys, "run").agg(
        F.min("__i").alias("entry_bar"), F.max(F.struct("__i", F.col("__next").alias("x"), F.col(value).alias("v"))).alias("__l"), F.first("__side").cast("int").alias("direction"), F.min_by(value, "__i").alias("entry_price"), F.sum("__fwd").alias("return_pct")
    )
    last = F.col("__l.__i") + F.when(F.col("__l.x").isNotNull(), 1).otherwise(0)
    return out.select(*keys, "entry_bar", last.alias("exit_bar"), (last - F.col("entry_bar")).alias("duration"), "direction", "entry_price", F.coalesce("__l.x", "__l.v").alias("exit_price"), "return_pct")


def metrics(result: DataFrame, trade_rows: DataFrame, *, keys: list[str], order: list[str], per_year: int = YEAR) -> DataFrame:
    """The thirteen figures of a back-test; 0 where one isn't defined (profit factor: null without losses)."""
    w = W.series(keys, *order)
    rows = result.withColumn("__i", F.row_number().over(w)).withColumn("__dd", W.drawdown("equity", w))
    rows = W.run_ids(rows, keys, order, F.col("__dd") < 0, "__run")
    longest = rows.groupBy(*keys, "__run").agg(F.count_if(F.col("__dd") < 0).alias("n")).groupBy(*keys).agg(F.max("n").alias("max_drawdown_duration"))
    later = F.when(F.col("__i") > 1, F.col("ret"))  # the first row earns nothing and is no return
    down = F.when((F.col("__i") > 1) & (F.col("ret") < 0), F.col("ret"))
    root = float(per_year) ** 0.5
    s = rows.groupBy(*keys).agg(
        F.count(later).alias("__n"), (F.max_by("equity", "__i") / F.min_by("equity", "__i") - 1).alias("total_return"), F.avg(later).alias("__m"), F.stddev_samp(later).alias("__s"), F.stddev_samp(down).alias("__d"), F.min("__dd").alias("max_drawdown")
    )
    win, loss = F.when(F.col("return_pct") > 0, F.col("return_pct")), F.when(F.col("return_pct") <= 0, F.col("return_pct"))
    tr = trade_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_trades"), (F.count(win) / F.count(F.lit(1))).alias("win_rate"), F.avg("return_pct").alias("avg_trade_return"), F.avg("duration").alias("avg_holding"), F.sum(win).alias("__w"), F.abs(F.sum(loss)).alias("__l"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = s.join(longest, keys, "left").join(tr, keys, "left")
    out = out.withColumn("annualized_return", F.when((F.col("__n") > 0) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), float(per_year) / F.col("__n")) - 1).otherwise(0.0))
    return out.select(
        *keys, "total_return", "annualized_return",
        zero(F.when(F.col("__s") > 0, F.col("__m") / F.col("__s") * root)).alias("sharpe"), zero(F.when(F.col("__d") > 0, F.col("__m") / F.col("__d") * root)).alias("sortino"),
        "max_drawdown", F.coalesce("max_drawdown_duration", F.lit(0)).alias("max_drawdown_duration"), zero(F.col("win_rate")).alias("win_rate"),
        F.when(F.col("__l") > 0, F.coalesce("__w", F.lit(0.0)) / F.col("__l")).when(F.coalesce("__w", F.lit(0.0)) > 0, F.lit(None).cast("double")).otherwise(0.0).alias("profit_factor"),
        F.coalesce("total_trades", F.lit(0)).alias("total_trades"), zero(F.col("avg_trade_return")).alias("avg_trade_return"), zero(F.col("avg_holding")).alias("avg_holding"),
        zero(F.when(F.col("max_drawdown") != 0, F.abs(F.col("annualized_return") / F.col("max_drawdown")))).alias("calmar"), zero(F.col("__s") * root).alias("volatility"),
    )


def event_driven(df: DataFrame, *, keys: list[str], order: list[str], value: str = "close", fill: str = "open", position: str = "position", capital: float = 100_000.0, commission: float = 0.0) -> DataFrame:
    """Orders of one row are filled at the next row's ``fill`` price; cash, units and equity as running sums."""
    w = W.series(keys, *order)
    held = F.coalesce(F.lag(position).over(w), F.lit(0.0))
    rows = df.withColumn("units", held).withColumn("traded", held - F.coalesce(F.lag(position, 2).over(w), F.lit(0.0)))
    cost = -F.col("traded") * F.col(fill) - F.abs("traded") * F.col(fill) * commission
    rows = rows.withColumn("cash", F.lit(capital) + F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("equity", F.col("cash") + F.col("units") * F.col(value))


def reconcile(a: DataFrame, b: DataFrame, *, keys: list[str], order: list[str], tolerance: float = 1e-6) -> DataFrame:
    """How far two equity curves are apart: root mean square, largest gap, rows apart."""
    both = a.select(*keys, *order, F.col("equity").alias("x")).join(b.select(*keys, *order, F.col("equity").alias("y")), [*keys, *order])
    gap = F.col("x") - F.col("y")
    return both.groupBy(*keys).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.max(F.abs(gap)).alias("largest"), F.count_if(F.abs(gap) > tolerance).alias("apart"), F.count(F.lit(1)).alias("rows"))


def single_leg(df: DataFrame, *, keys: list[str], order: list[str], cost: float = 0.0005, per_year: float = 252 * 6.5 * 60, close: str = "close_a", open_: str = "open_a", signal: str = "signal") -> DataFrame:
    """Profit of trading leg A by a signal: open to close, cost for each change, a sum and not a product."""
    w = W.series(keys, *order)
    pos, before = F.col(signal), F.coalesce(F.lag(signal).over(w), F.lit(0))
    move = F.when(F.col(open_) != 0, (F.col(close) - F.col(open_)) / F.col(open_)).otherwise(0.0)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("__d", pos - before).withColumn("__p", before * move - F.abs(pos - before) * cost)
    later = F.when(F.col("__i") > 1, F.col("__p"))
    g = rows.groupBy(*keys).agg(F.sum(later).alias("__s"), F.avg(later).alias("__m"), F.stddev_pop(later).alias("__v"), F.max_by(signal, "__i").alias("__last"), F.count_if((F.col("__d") != 0) & (F.col(signal) != 0)).alias("num_trades"))
    total = F.coalesce("__s", F.lit(0.0)) - F.when(F.col("__last") != 0, cost).otherwise(0.0)
    root = float(per_year) ** 0.5
    return g.select(*keys, total.alias("daily_return"), (F.pow(1 + total, 252.0) - 1).alias("annualized_return"), (F.coalesce("__v", F.lit(0.0)) * root).alias("volatility"), F.when(F.col("__v") > 0, root * F.col("__m") / F.col("__v")).otherwise(0.0).alias("sharpe"), "num_trades")


# --- barriers -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Barrier:
    stop: float
    target: float
    trail: float
    bars: int


def barrier_grid(stops=(0.010, 0.020, 0.030), ratios=(2.0, 3.0), trails=(0.000, 0.003, 0.005, 0.010), bars=(24, 48, 96)) -> list[Barrier]:
    """The standard exits; a trail wider than the stop is left out."""
    return [Barrier(s, round(s * r, 4), t, b) for s, r, t, b in product(stops, ratios, trails, bars) if t <= s]


def simulate_trade(prices: np.ndarray, direction: int, barrier: Barrier, cost: float = 0.0002) -> dict:
    """Exit of one trade entered at ``prices[0]``.

    Before the target the stop counts; at the target a trade without a trail
    ends, one with a trail is let run until it falls back by the trail.
    """
    entry = prices[0]
    last = min(barrier.bars, len(prices) - 1)
    gain = direction * (prices[1 : last + 1] - entry) / entry
    hits = np.flatnonzero((gain <= -barrier.stop) | (gain >= barrier.target))
    at, why = last, "vertical_barrier"
    if len(hits):
        first = int(hits[0])
        if gain[first] <= -barrier.stop:
            at, why = first + 1, "stop_loss"
        elif barrier.trail == 0:
            at, why = first + 1, "take_profit"
        else:
            path = prices[first + 1 : last + 1]
            best = np.maximum.accumulate(path) if direction == 1 else np.minimum.accumulate(path)
            back = direction * (best - path) / best
            fell = np.flatnonzero(back[1:] >= barrier.trail)
            if len(fell):
                at, why = first + 2 + int(fell[0]), "trailing_stop"
    gross = direction * (prices[at] - entry) / entry if last > 0 else 0.0
    net = gross - 2 * cost
    return {"exit_idx": at, "exit_price": float(prices[at]), "exit_reason": why, "gross_return": float(gross), "net_return": float(net), "label": 1 if net > 0 else -1}


def run_barriers(df: DataFrame, barrier: Barrier, *, keys: list[str], order: list[str], price: str = "close", signal: str = "signal", cost: float = 0.0002) -> DataFrame:
    """One position at a time along each series: ``event`` (entry, or why it ended) and ``net`` return at the exit."""

    def make() -> Step:
        def rule(state, price_now: float, sig: float):
            # state: direction, entry price, bars held, best price once the target was reached
            side, entry, held, best = state
            if side == 0:
                return ((int(np.sign(sig)), price_now, 0, None), ("entry", np.nan)) if sig == sig and sig != 0 else (state, ("", np.nan))
            gain, held, why = side * (price_now - entry) / entry, held + 1, ""
            if best is not None:
                best = max(best, price_now) if side == 1 else min(best, price_now)
                why = "trailing_stop" if side * (best - price_now) / best >= barrier.trail else ""
            elif gain <= -barrier.stop:
                why = "stop_loss"
            elif gain >= barrier.target:
                why, best = ("take_profit", None) if barrier.trail == 0 else ("", price_now)
            if not why and held >= barrier.bars:
                why = "vertical_barrier"
            return ((0, 0.0, 0, None), (why, gain - 2 * cost)) if why else ((side, entry, held, best), ("", np.nan))

        fold = Machine(rule, (0, 0.0, 0, None))

        def step(c: Columns) -> Columns:
            out = fold(c[price], c[signal])
            return {"event": out[:, 0], "net": out[:, 1].astype(float)}

        return step

    return ordered_fold(df, keys=keys, order=order, make=make, fields="event string, net double")


def grid_bot(df: DataFrame, *, keys: list[str], order: list[str], price: str = "close", levels: int = 10, width: float = 0.05, cost: float = 0.0005) -> DataFrame:
    """A grid around a series' first price: buys below, sells what it holds one level up; ends at a breakout beyond twice the width.

    Adds ``inventory`` and the ``realised`` return so far, in grid units.
    """

    def make() -> Step:
        def rule(state, now: float):
            base, level, held, realised, done = state
            if base is None:
                return (now, 0, (), 0.0, False), (0, 0.0)
            if done or now != now:
                return state, (len(held), realised)
            gap = 2 * width / levels
            at = int(np.floor((now / base - 1) / gap))
            for step_level in range(level - 1, at - 1, -1):
                if -levels // 2 <= step_level < levels // 2:
                    held = (*held, step_level)
            for step_level in range(level + 1, at + 1):
                if held:
                    bought, held = held[-1], held[:-1]
                    realised += (step_level - bought) * gap / levels - 2 * cost / levels
            if abs(now / base - 1) > 2 * width:
                realised += sum((now / base - 1 - lv * gap) / levels - cost / levels for lv in held)
                held, done = (), True
            return (base, at, held, realised, done), (len(held), realised)

        fold = Machine(rule, (None, 0, (), 0.0, False))

        def step(c: Columns) -> Columns:
            out = fold(c[price])
            return {"inventory": out[:, 0], "realised": out[:, 1]}

        return step

    return ordered_fold(df, keys=keys, order=order, make=make, fields="inventory int, realised double")


def variance_trade(iv: Column, rv: Column, days: int, direction: int, cost_bps: float) -> Column:
    """Profit of a variance swap held for some days: ``direction`` 1 sells variance, -1 buys it."""
    return F.lit(direction) * 0.5 * (iv * iv - rv * rv) * (days / 365.0) - cost_bps / 1e4


# --- risk -----------------------------------------------------------------------------------------------------


def pre_trade_checks(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Eight ordered checks of an order against its account; the first rejection decides, size limits only reduce.

    Columns read: ``order_value, nav, gross, sector_gross, position_value,
    drawdown, daily_loss, open_orders, last_trade_age``.  Adds ``decision`` (APPROVE, REDUCE, REJECT),
    ``approved_value`` and ``reasons``.
    """
    v, nav = F.col("order_value"), F.col("nav")
    rejects = [
        ("no_capital", nav <= 0), ("max_drawdown", F.col("drawdown") <= -limits["max_drawdown"]), ("daily_loss", F.col("daily_loss") >= limits["daily_loss"] * nav),
        ("open_orders", F.col("open_orders") >= limits["open_orders"]), ("cooldown", F.col("last_trade_age") < limits["cooldown"]),
    ]
    caps = [
        ("position_size", F.greatest(limits["position"] * nav - F.col("position_value"), F.lit(0.0))), ("gross_exposure", F.greatest(limits["gross"] * nav - F.col("gross"), F.lit(0.0))), ("sector_exposure", F.greatest(limits["sector"] * nav - F.col("sector_gross"), F.lit(0.0))),
    ]
    first = F.coalesce(*(F.when(test, F.lit(name)) for name, test in rejects))
    room = F.least(v, *(cap for _, cap in caps))
    tight = F.array_compact(F.array(*(F.when(cap < v, F.lit(name)) for name, cap in caps)))
    rows = df.withColumn("__first", first).withColumn("__room", room).withColumn("__tight", tight)
    decision = F.when(F.col("__first").isNotNull(), "REJECT").when(F.col("__room") <= 0, "REJECT").when(F.col("__room") < v, "REDUCE").otherwise("APPROVE")
    rows = rows.withColumn("decision", decision)
    rows = rows.withColumn("approved_value", F.when(F.col("decision") == "REJECT", 0.0).otherwise(F.col("__room")))
    return rows.withColumn("reasons", F.when(F.col("__first").isNotNull(), F.array("__first")).otherwise(F.col("__tight"))).drop("__first", "__room", "__tight")


def executor_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All checks evaluated and kept as JSON; ``decision`` is execute or skip, with the first failed check as the reason."""
    results = F.struct(*(F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()))
    rows = df.withColumn("__c", results)
    reason = F.coalesce(*(F.when(~F.col(f"__c.{k}"), F.lit(k)) for k in checks))
    return rows.withColumn("risk_checks", F.to_json("__c")).withColumn("skip_reason", reason).withColumn("decision", F.when(F.col("skip_reason").isNull(), "execute").otherwise("skip")).drop("__c")
