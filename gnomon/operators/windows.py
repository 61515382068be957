"""Window operators over ordered series; every one is partitioned by its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def series(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def full(value: Column, agg: Column, w: WindowSpec, n: int) -> Column:
    """An aggregate over the last ``n`` rows; null until there are ``n``."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, agg.over(frame))


def rolling_mean(c: str, w: WindowSpec, n: int) -> Column:
    return full(F.col(c), F.avg(c), w, n)


def rolling_std(c: str, w: WindowSpec, n: int, ddof: int = 1) -> Column:
    return full(F.col(c), F.stddev_samp(c) if ddof else F.stddev_pop(c), w, n)


def rolling_max(c: str, w: WindowSpec, n: int) -> Column:
    return full(F.col(c), F.max(c), w, n)


def rolling_min(c: str, w: WindowSpec, n: int) -> Column:
    return full(F.col(c), F.min(c), w, n)


def rolling_sum(c: str, w: WindowSpec, n: int) -> Column:
    return full(F.col(c), F.sum(c), w, n)


def pct_change(c: str, w: WindowSpec, n: int = 1) -> Column:
    before = F.lag(c, n).over(w)
    return (F.col(c) - before) / F.nullif(before, F.lit(0.0))


def crosses_up(a: str, b: str, w: WindowSpec) -> Column:
    return F.coalesce((F.lag(a).over(w) <= F.lag(b).over(w)) & (F.col(a) > F.col(b)), F.lit(False))


def crosses_down(a: str, b: str, w: WindowSpec) -> Column:
    return F.coalesce((F.lag(a).over(w) >= F.lag(b).over(w)) & (F.col(a) < F.col(b)), F.lit(False))


def growth(r: str, w: WindowSpec) -> Column:
    """Cumulative product of ``1 + r``, with missing returns as 0; a return below -1 turns its sign, one of -1 ends it at 0."""
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    x = 1 + F.coalesce(F.col(r), F.lit(0.0))
    size = F.exp(F.sum(F.ln(F.nullif(F.abs(x), F.lit(0.0)))).over(so_far))
    turns = F.sum((x < 0).cast("int")).over(so_far)
    gone = F.max((x == 0).cast("int")).over(so_far) == 1
    return F.when(gone, 0.0).when(turns % 2 == 1, -size).otherwise(F.coalesce(size, F.lit(1.0)))


def drawdown(equity: str, w: WindowSpec) -> Column:
    peak = F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (F.col(equity) - peak) / peak


def forward_fill(c: str, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def run_ids(df: DataFrame, keys: list[str], order: list[str], same: Column, name: str = "run") -> DataFrame:
    """Numbers runs of rows; ``same`` says that a row belongs to the run of the one before."""
    w = series(keys, *order)
    return df.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def sample_every(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """Evenly thinned series: every ``rows // cap``-th row of a key, ``cap`` rows at most."""
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    rows = df.withColumn("__i", F.row_number().over(series(keys, *order))).join(total, keys)
    step = F.greatest(F.floor(F.col("__n") / cap), F.lit(1))
    return rows.where((F.col("__i") % step == 0) & (F.col("__i") <= step * cap)).drop("__i", "__n")


def divergence(df: DataFrame, keys: list[str], order: str, price: str, osc: str, n: int = 5) -> DataFrame:
    """Bullish: lower low of the price with a higher low of the oscillator than ``n`` bars earlier; bearish the reverse."""
    w = series(keys, order)
    now, old = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-(2 * n - 1), -n)
    full_old = F.count(F.lit(1)).over(old) == n
    bull = full_old & (F.min(price).over(now) < F.min(price).over(old)) & (F.min(osc).over(now) > F.min(osc).over(old))
    bear = full_old & (F.max(price).over(now) > F.max(price).over(old)) & (F.max(osc).over(now) < F.max(osc).over(old))
    return df.withColumn("bull_div", bull).withColumn("bear_div", bear)
