"""Joins that SQL has no word for: as-of, nearest, windowed and shifted joins.

All of them are equi-joins or windows on the key and a coarse time bucket; none
is a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, *, keys: list[str], ts: str, right_ts: str, values: list[str], tie: str) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before its time.

    Both sides are one sorted stream per key; the last values seen are carried
    along.  Linear in both sides, and no pairs are made.
    """
    lcols = left.columns
    held = F.struct(F.col(right_ts).alias("ts"), *values)
    a = left.select(*keys, F.col(ts).alias("__t"), F.lit(1).alias("__o"), F.lit(None).cast("long").alias("__i"), F.struct(*lcols).alias("__l"))
    b = right.select(*keys, F.col(right_ts).alias("__t"), F.lit(0).alias("__o"), F.col(tie).cast("long").alias("__i"), held.alias("__r"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__o", "__i").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__o = 1")
    return seen.select("__l.*", F.col("__r.ts").alias("asof_ts"), *(F.col(f"__r.{v}").alias(f"asof_{v}") for v in values))


def _bucketed(left: DataFrame, right: DataFrame, keys: list[str], lt: Column, rt: Column, lo: int, hi: int) -> DataFrame:
    """Pairs with ``lt + lo <= rt <= lt + hi`` (seconds), by buckets of the window's width."""
    width = max(1, hi - lo)
    lefts = left.withColumn("__lt", lt).withColumn("__b", F.explode(F.sequence(F.floor((F.col("__lt") + lo) / width), F.floor((F.col("__lt") + hi) / width))))
    rights = right.withColumn("__rt", rt).withColumn("__b", F.floor(F.col("__rt") / width))
    return lefts.join(rights, [*keys, "__b"]).where((F.col("__rt") >= F.col("__lt") + lo) & (F.col("__rt") <= F.col("__lt") + hi)).drop("__b")


def within(left: DataFrame, right: DataFrame, *, keys: list[str], ts: str, right_ts: str, before: int, after: int) -> DataFrame:
    """All pairs of a key whose right time is from ``before`` seconds before to ``after`` after the left one."""
    return _bucketed(left, right, keys, F.unix_micros(ts) / 1e6, F.unix_micros(right_ts) / 1e6, -before, after)


#: Buckets of ``nearest`` are so many tolerances wide; a right row goes to two of them where its reach crosses a border.
NEAREST_WIDTH = 8


def nearest(left: DataFrame, right: DataFrame, *, keys: list[str], left_id: str, ts: str, right_ts: str, right_id: str, tolerance: int, newest: bool = False) -> DataFrame:
    """For each left row the right row nearest in time, within a tolerance in seconds; of equally near ones that with the smallest id.

    With ``newest`` the latest row in the window counts, not the nearest, and of
    one time that with the largest id.

    One sorted stream per key and bucket of time, with the last right row carried
    along, once forwards and, for the nearest, once backwards.  Linear in both
    sides, and no pairs are made.
    """
    reach = int(tolerance * 1_000_000)
    width = NEAREST_WIDTH * max(reach, 1)
    bucket = lambda t: t - F.pmod(t, F.lit(width))
    some = lambda df, t: df.where(F.greatest(*(F.col(c).isNull().cast("int") for c in [*keys, t])) == 0)
    cols = [c for c in right.columns if c not in keys]
    # the latest row up to the end of the window is the newest; so left rows stand there
    at = F.unix_micros(ts) + (reach if newest else 0)
    a = some(left, ts).select(*keys, at.alias("__t"), F.lit(1).alias("__o"), F.col(left_id).alias("__left")).withColumn("__b", bucket(F.col("__t")))
    rt = F.unix_micros(right_ts)
    ends = (rt, rt + 2 * reach) if newest else (rt - reach, rt + reach)
    b = some(right, right_ts).select(*keys, rt.alias("__t"), F.lit(0).alias("__o"), F.struct(rt.alias("t"), F.col(right_id).alias("i"), F.struct(*cols).alias("r")).alias("__r"), F.explode(F.array_distinct(F.array(*map(bucket, ends)))).alias("__b"))
    both = a.unionByName(b, allowMissingColumns=True)
    last = lambda *order: F.last("__r", ignorenulls=True).over(Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    gap = lambda c: F.abs(F.col(f"{c}.t") - F.col("__t"))
    near = lambda c, most: F.when(gap(c) <= most, F.struct(gap(c).alias("d"), F.col(f"{c}.i").alias("i")))
    if newest:
        seen = both.withColumn("__past", last("__t", "__o", F.col("__r.i").asc_nulls_last())).where("__o = 1")
        best = seen.select(*keys, "__left", near("__past", 2 * reach).alias("__far"), "__past.r")
        order = F.struct(F.col("__far.d").alias("d"), (-F.col("__far.i")).alias("i"))
    else:
        by_id = F.col("__r.i").desc_nulls_last()
        seen = both.withColumn("__past", last("__t", "__o", by_id)).withColumn("__next", last(F.desc("__t"), "__o", by_id)).where("__o = 1")
        seen = seen.withColumn("__fp", near("__past", reach)).withColumn("__fn", near("__next", reach))
        behind = F.col("__fn").isNull() | (F.col("__fp") <= F.col("__fn"))
        best = seen.select(*keys, "__left", F.when(behind, F.col("__fp")).otherwise(F.col("__fn")).alias("__far"), F.when(behind, F.col("__past")).otherwise(F.col("__next"))["r"].alias("r"))
        order = F.col("__far")
    found = best.where(F.col("__far").isNotNull()).groupBy(*keys, F.col("__left").alias(left_id)).agg(F.min_by("r", order).alias("__r"))
    return found.select(*keys, left_id, "__r.*")


def shifted(features: DataFrame, outcomes: DataFrame, *, keys: list[str], day: str) -> DataFrame:
    """Features of a day with the outcomes of the key's next day that has any."""
    w = Window.partitionBy(*keys).orderBy(day)
    days = outcomes.select(*keys, F.col(day).alias("outcome_day")).distinct()
    marks = features.select(*keys, day).distinct().withColumn("__f", F.lit(True)).unionByName(days.withColumnRenamed("outcome_day", day).withColumn("__f", F.lit(False)))
    ahead = w.rangeBetween(1, Window.unboundedFollowing)
    numbered = marks.withColumn("__d", F.unix_date(day))
    ahead = Window.partitionBy(*keys).orderBy("__d").rangeBetween(1, Window.unboundedFollowing)
    nexts = numbered.withColumn("outcome_day", F.min(F.when(~F.col("__f"), F.col(day))).over(ahead)).where("__f").select(*keys, day, "outcome_day")
    out = outcomes.withColumnRenamed(day, "outcome_day")
    return features.join(nexts, [*keys, day]).join(out, [*keys, "outcome_day"])


def pairs(df: DataFrame, *, keys: list[str], member: str) -> DataFrame:
    """Unordered pairs of different members of a key: columns of the first, then of the second with ``_2``.

    The number of rows is that of the pairs asked for; it is meant for keys with few members.
    """
    right = df.select(*keys, *(F.col(c).alias(f"{c}_2") for c in df.columns if c not in keys))
    return df.join(right, keys).where(F.col(member) < F.col(f"{member}_2"))


def diff_snapshots(new: DataFrame, old: DataFrame, *, keys: list[str], size: str, up: float = 1.05, down: float = 0.95) -> DataFrame:
    """Positions that changed: ENTER, EXIT, INCREASE (above ``up`` times), DECREASE (below ``down`` times)."""
    a, b = new.select(*keys, F.col(size).alias("new_size")), old.select(*keys, F.col(size).alias("old_size"))
    both = a.join(b, keys, "full_outer")
    kind = F.when(F.col("old_size").isNull(), "ENTER").when(F.col("new_size").isNull(), "EXIT").when(F.col("new_size") > F.col("old_size") * up, "INCREASE").when(F.col("new_size") < F.col("old_size") * down, "DECREASE")
    return both.withColumn("change", kind).where(F.col("change").isNotNull())
