"""The bitemporal store: latest versions, validity intervals, point-in-time reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def latest(df: DataFrame, *, key: list[str], order: list[str]) -> DataFrame:
    """The last version of each key.  One shuffle, with partial aggregation before it."""
    at = F.struct(*order)
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), at).alias("__v")).select("__v.*")


def same_day_last(df: DataFrame, *, key: list[str], ts: str, tie: str) -> DataFrame:
    """Of the versions of one key on one day, the last."""
    rows = df.withColumn("__day", F.to_date(ts))
    return latest(rows, key=[*key, "__day"], order=[ts, tie]).drop("__day")


def intervals(df: DataFrame, *, key: list[str], ts: str, tie: str) -> DataFrame:
    """Validity of each version: from its day to the day before the next version's.

    Of several versions of a day only the last counts.  One ordered pass serves
    both: a version is its day's last if the next one is of a later day, and that
    day bounds it.
    """
    w = Window.partitionBy(*key).orderBy(ts, tie)
    rows = df.withColumn("start_date", F.to_date(ts)).withColumn("__next", F.lead("start_date").over(w))
    rows = rows.where(F.col("__next").isNull() | (F.col("__next") > F.col("start_date")))
    return rows.withColumn("end_date", F.coalesce(F.date_sub("__next", 1), F.to_date(F.lit(OPEN_END)))).drop("__next")


def as_was(interval_rows: DataFrame, day: Column) -> DataFrame:
    """The versions that were valid on a day; none before a key's first version."""
    return interval_rows.where((F.col("start_date") <= day) & (F.col("end_date") >= day))


def as_was_batch(interval_rows: DataFrame, asked: DataFrame, *, key: str, day: str) -> DataFrame:
    """For each ``(key, day)`` asked, the version that was valid then."""
    return asked.join(interval_rows, key).where(F.col(day).between(F.col("start_date"), F.col("end_date")))


def overlaps(interval_rows: DataFrame, *, key: list[str]) -> DataFrame:
    """Intervals that reach into the next one of their key."""
    w = Window.partitionBy(*key).orderBy("start_date")
    return interval_rows.withColumn("next_start", F.lead("start_date").over(w)).where("next_start <= end_date")


def compare(before: DataFrame, after: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """Fields that differ between two states: ``key, field, was, is``."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("string") for f in fields)))).alias("field", name))

    both = long(before, "was").join(long(after, "is_now"), [key, "field"])
    return both.where(~F.col("was").eqNullSafe(F.col("is_now")))


def reversed_membership(changes: DataFrame, current: DataFrame, *, index: str, ticker: str, day: str, action: str, history_start: str) -> DataFrame:
    """Membership intervals from a log of additions and removals and today's members.

    Each ticker's changes are walked newest first: a removal opens an interval
    that ends the day before it, an addition starts the interval above it.
    """
    adds = changes.where(F.col(action) == "added").select(index, ticker, F.col(day).alias("start_date"))
    ends = changes.where(F.col(action) == "removed").select(index, ticker, F.date_sub(day, 1).alias("end_date"))
    now = current.select(index, ticker, F.to_date(F.lit(OPEN_END)).alias("end_date"))
    w = Window.partitionBy(index, ticker).orderBy(F.col("end_date"))
    closed = ends.unionByName(now).distinct().withColumn("after", F.lag("end_date").over(w))
    joined = closed.join(adds, [index, ticker], "left").where(F.col("start_date").isNull() | ((F.col("start_date") <= F.col("end_date")) & (F.col("after").isNull() | (F.col("start_date") > F.col("after")))))
    out = closed.join(joined.groupBy(index, ticker, "end_date").agg(F.max("start_date").alias("start_date")), [index, ticker, "end_date"], "left")
    return out.select(index, ticker, F.coalesce("start_date", F.to_date(F.lit(history_start))).alias("start_date"), "end_date")
