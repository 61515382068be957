"""Paper accounts and replays: state machines over ordered prices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W
from .folds import Columns, Machine, Step, ordered_fold


def paper_account(df: DataFrame, *, keys: list[str], order: list[str], price: str = "close", quantity: str = "quantity", limit: str | None = None, cash: float = 100_000.0, slippage_bps: float = 5.0, commission_bps: float = 10.0) -> DataFrame:
    """An account for each key: a row's order is filled at its price with slippage and commission, or when its limit is reached.

    Adds ``filled`` (units), ``fill_price``, ``units``, ``cash``, ``nav``, ``peak``.
    """

    def make() -> Step:
        def rule(state, now: float, want: float, lim: float):
            units, money, peak = state
            want = 0.0 if want != want else want
            ok = want != 0 and (lim != lim or (now <= lim if want > 0 else now >= lim))
            at = np.nan
            if ok:
                at = now * (1 + np.sign(want) * slippage_bps / 1e4)
                units += want
                money -= want * at + abs(want) * at * commission_bps / 1e4
            nav = money + units * now
            peak = max(peak, nav)
            return (units, money, peak), (want if ok else 0.0, at, units, money, nav, peak)

        fold = Machine(rule, (0.0, cash, cash))

        def step(c: Columns) -> Columns:
            lim = c[limit] if limit else np.full(len(c[price]), np.nan)
            out = fold(c[price], c[quantity], lim)
            return dict(zip(("filled", "fill_price", "units", "cash", "nav", "peak"), out.T, strict=True))

        return step

    return ordered_fold(df, keys=keys, order=order, make=make, fields="filled double, fill_price double, units double, cash double, nav double, peak double")


def replay(df: DataFrame, *, keys: list[str], order: list[str], price: str = "close", entry: str = "entry", exit_: str = "exit", cost: float = 0.001) -> DataFrame:
    """One position at a time; a row's exit counts before its entry. Adds ``trade_return`` where one ends and ``equity``."""

    def make() -> Step:
        def rule(state, now: float, enter: float, leave: float):
            held, equity = state
            ret = np.nan
            if held is not None and leave == 1:
                ret = now / held - 1 - 2 * cost
                equity, held = equity * (1 + ret), None
            if held is None and enter == 1:
                held = now
            return (held, equity), (ret, equity if held is None else equity * now / held)

        fold = Machine(rule, (None, 1.0))

        def step(c: Columns) -> Columns:
            flags = [np.array([0.0 if v is None or v != v else float(v) for v in c[k].tolist()]) for k in (entry, exit_)]
            out = fold(c[price], *flags)
            return {"trade_return": out[:, 0].astype(float), "equity": out[:, 1].astype(float)}

        return step

    return ordered_fold(df, keys=keys, order=order, make=make, fields="trade_return double, equity double")


def running_stats(df: DataFrame, *, keys: list[str], order: list[str], ret: str = "trade_return", equity: str = "equity") -> DataFrame:
    """Total, drawdown so far, win rate and mean of the trades up to each row."""
    w = W.series(keys, *order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    win = F.when(F.col(ret).isNotNull(), (F.col(ret) > 0).cast("double"))
    rows = df.withColumn("total_return", F.col(equity) / F.first(equity).over(so_far) - 1).withColumn("__dd", W.drawdown(equity, w))
    return rows.withColumn("max_drawdown", F.min("__dd").over(so_far)).withColumn("trades", F.count(ret).over(so_far)).withColumn("win_rate", F.coalesce(F.avg(win).over(so_far), F.lit(0.0))).withColumn("mean_trade", F.coalesce(F.avg(ret).over(so_far), F.lit(0.0))).drop("__dd")


def trade_params(df: DataFrame, *, move: str, price: str, largest: float = 100.0) -> DataFrame:
    """Side, limit price and size for fading a spike."""
    m = F.col(move)
    side = F.when(m > 0, "SELL").when(m < 0, "BUY").otherwise("NONE")
    limit = F.when(m > 0, F.col(price) * 0.99).when(m < 0, F.col(price) * 1.01)
    return df.withColumn("side", side).withColumn("limit_price", limit).withColumn("size", F.when(m != 0, F.least(F.lit(largest), largest * F.abs(m) / 0.20)).otherwise(0.0))
