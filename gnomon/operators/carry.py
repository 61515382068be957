"""Funding carry: holds of spot against perpetual, spreads between venues, and a position's life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_backward


def paid_between(rows: DataFrame, payments: DataFrame, *, keys: list[str], start: str, end: str, amount: str) -> DataFrame:
    """``rows`` with ``total``, ``payments``, ``positive`` (share above 0) and ``paid_to``, ``last`` of the key's payments after ``start`` up to ``end``.

    Payments are summed up once along their key; a row takes the sums at its end
    less those at its start.  So rows and payments are never paired.
    """
    along = Window.partitionBy(*keys).orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    at = payments.groupBy(*keys, "ts").agg(F.sum(amount).alias("s"), F.count(amount).alias("n"), F.count_if(F.col(amount) > 0).alias("p"), F.max(amount).alias("last"))
    sums = at.select(*keys, F.col("ts").alias("pts"), F.lit(0).alias("tie"), F.struct(F.sum("s").over(along).alias("s"), F.sum("n").over(along).alias("n"), F.sum("p").over(along).alias("p"), "last").alias("sums"))
    for when, name in ((start, "__from"), (end, "__to")):
        rows = asof_backward(rows, sums, keys=keys, ts=when, right_ts="pts", values=["sums"], tie="tie").withColumnRenamed("asof_sums", name).withColumnRenamed("asof_ts", f"{name}_ts")
    of = lambda c: F.coalesce(F.col(f"__to.{c}"), F.lit(0)) - F.coalesce(F.col(f"__from.{c}"), F.lit(0))
    some = of("n") > 0
    new = [F.when(some, of("s")).otherwise(0.0).alias("total"), of("n").alias("payments"), F.when(some, of("p") / of("n")).alias("positive"), F.when(some, F.col("__to_ts")).alias("paid_to"), F.when(some, F.col("__to.last")).alias("last")]
    return rows.select(*(c for c in rows.columns if not c.startswith("__")), *new)


def carry_hold(holds: DataFrame, spot: DataFrame, perp: DataFrame, funding: DataFrame, *, keys: list[str], cost_bps: float = 10.0, days: int = 3, clip: float = 0.5) -> DataFrame:
    """Profit of each hold ``(keys, hold, start)``: spot's return less the perpetual's, plus the funding paid inside it, less both ends' costs.

    Prices are the last at or before start and end; without one at either end
    the hold has no return.
    """
    end = F.col("start") + F.make_dt_interval(F.lit(days))

    def priced(rows: DataFrame, prices: DataFrame, at: str, name: str) -> DataFrame:
        out = asof_backward(rows, prices, keys=keys, ts=at, right_ts="ts", values=["price"], tie="tie")
        return out.withColumnRenamed("asof_price", name).drop("asof_ts")

    rows = holds.withColumn("end", end)
    for prices, leg in ((spot, "spot"), (perp, "perp")):
        rows = priced(priced(rows, prices, "start", f"{leg}_in"), prices, "end", f"{leg}_out")
    out = paid_between(rows, funding, keys=keys, start="start", end="end", amount="rate").withColumnRenamed("total", "funding")
    gross = F.col("spot_out") / F.col("spot_in") - F.col("perp_out") / F.col("perp_in") + F.col("funding")
    return out.withColumn("net", F.greatest(F.least(gross, F.lit(clip)), F.lit(-clip)) - 2 * cost_bps / 1e4)


def gate(rate: Column, positive: Column, least_annual: float, least_share: float = 0.6) -> Column:
    """Whether a hold is entered: annual rate and share of positive payments before it."""
    return (rate * 3 * 365 >= least_annual) & (positive >= least_share)


def spread_hold(holds: DataFrame, a: DataFrame, b: DataFrame, *, keys: list[str], days: int, cost_bps: float) -> DataFrame:
    """Long the cheaper venue's funding: the sign of the last common difference before the start, times the differences at common times inside."""
    both = a.select(*keys, "ts", F.col("rate").alias("ra")).join(b.select(*keys, "ts", F.col("rate").alias("rb")), [*keys, "ts"]).withColumn("gap", F.col("ra") - F.col("rb")).withColumn("tie", F.lit(0))
    entry = asof_backward(holds, both, keys=keys, ts="start", right_ts="ts", values=["gap"], tie="tie").withColumnRenamed("asof_gap", "entry_gap").drop("asof_ts")
    inside = paid_between(entry.withColumn("end", F.col("start") + F.make_dt_interval(F.lit(days))), both, keys=keys, start="start", end="end", amount="gap")
    out = inside.withColumn("events", F.when(F.col("payments") > 0, F.col("payments")))
    return out.withColumn("net", F.signum("entry_gap") * F.col("total") - 2 * 2 * cost_bps / 1e4)


def accrue(positions: DataFrame, funding: DataFrame, *, keys: list[str], until: Column) -> DataFrame:
    """Funding of open positions ``(keys, position, opened, paid_until, notional)`` since their last payment, and why they should close."""
    got = paid_between(positions.withColumn("until", until), funding, keys=keys, start="paid_until", end="until", amount="rate")
    out = got.withColumn("accrued", F.col("total") * F.col("notional")).withColumnRenamed("last", "last_rate").drop("until")
    age = (F.unix_seconds(until) - F.unix_seconds("opened")) / 86400
    why = F.when(age >= F.col("max_days"), "expired").when(F.coalesce("last_rate", F.lit(1.0)) < 0, "rate_negative")
    return out.withColumn("exit", why)
