"""Information bars: bars that close on dollars, volume, imbalance or runs, in batch and in streams."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .folds import Columns, Step, ordered_fold  # noqa: F401 - the step's types

KINDS = ("dollar", "volume", "imbalance", "run")
FIELDS = "bar_index long, start_ms long, end_ms long, open double, high double, low double, close double, base_volume double, quote_volume double, tick_count long, buy_quote double, sell_quote double"


@dataclass
class Open:
    """The bar that is being built."""

    index: int = 0
    start_ms: int = 0
    open: float = 0.0
    high: float = -np.inf
    low: float = np.inf
    close: float = 0.0
    base: float = 0.0
    quote: float = 0.0
    ticks: int = 0
    buy: float = 0.0
    sell: float = 0.0
    end_ms: int = 0


@dataclass
class BarBuilder:
    """Feeds on trades in order; a bar takes the whole trade that closes it, the next one starts empty."""

    kind: str
    threshold: float
    bar: Open = field(default_factory=Open)

    def add(self, ms: int, price: float, amount: float, quote: float, side: str) -> tuple | None:
        b = self.bar
        if b.ticks == 0:
            b.start_ms, b.open = ms, price
        b.high, b.low, b.close, b.end_ms = max(b.high, price), min(b.low, price), price, ms
        b.base += amount
        b.quote += quote
        b.ticks += 1
        if side == "buy":
            b.buy += quote
        else:
            b.sell += quote
        size = {"dollar": b.quote, "volume": b.base, "imbalance": abs(b.buy - b.sell), "run": max(b.buy, b.sell)}[self.kind]
        if size < self.threshold:
            return None
        self.bar = Open(index=b.index + 1)
        return (b.index, b.start_ms, b.end_ms, b.open, b.high, b.low, b.close, b.base, b.quote, b.ticks, b.buy, b.sell)

    def state(self) -> dict:
        return asdict(self.bar)

    @classmethod
    def resume(cls, kind: str, threshold: float, state: dict | None) -> BarBuilder:
        return cls(kind, threshold, Open(**state) if state else Open())


def info_bars(trades: DataFrame, kind: str, threshold: float, *, keys: list[str], ms: str = "ts_ms", tie: str = "trade_id") -> DataFrame:
    """Closed bars of every series; trades of one millisecond are ordered by id, a bar left open at the end isn't given."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def make() -> Step:
        builder = BarBuilder(kind, threshold)

        def step(c: Columns) -> Columns:
            out = {n: np.full(len(c[ms]), np.nan) for n in names}
            for i, row in enumerate(zip(c[ms].astype(np.int64).tolist(), c["price"].tolist(), c["amount"].tolist(), c["quote"].tolist(), c["side"].tolist(), strict=True)):
                closed = builder.add(*row)
                if closed:
                    for n, v in zip(names, closed, strict=True):
                        out[n][i] = v
            return out

        return step

    rows = trades.select(*keys, ms, tie, "price", "amount", "quote", "side")
    done = ordered_fold(rows, keys=keys, order=[ms, tie], make=make, fields=FIELDS)
    return done.where("bar_index IS NOT NULL").select(*keys, *names)


def stream_bars(trades: DataFrame, kind: str, threshold: float, *, key: str, ms: str = "ts_ms", tie: str = "trade_id", watermark: str = "30 seconds") -> DataFrame:
    """The same bars from a stream ``key, ts, ts_ms, trade_id, price, amount, quote, side``; the open bar is the key's state.

    Trades behind the watermark are late and dropped, as in the batch with a
    safety lag; in a micro-batch they are ordered by time and id.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    state = "bar_state string"

    def run(group: tuple, parts, held):
        import json

        builder = BarBuilder.resume(kind, threshold, json.loads(held.get[0]) if held.exists else None)
        rows = pd.concat(list(parts)).sort_values([ms, tie])
        out = [closed for r in rows.itertuples(index=False) if (closed := builder.add(int(getattr(r, ms)), r.price, r.amount, r.quote, r.side))]
        held.update((json.dumps({k: v if np.isfinite(v) else (1e308 if v > 0 else -1e308) for k, v in builder.state().items()}),))
        frame = pd.DataFrame(out, columns=names)
        frame.insert(0, key, group[0])
        yield frame

    rows = trades.withWatermark("ts", watermark)
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` string, {FIELDS}", state, "append", "NoTimeout")
