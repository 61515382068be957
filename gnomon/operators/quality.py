"""Data quality: batch validation, cross-source checks, series checks, outlier tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import run_ids, series


def modified_z(df: DataFrame, *, keys: list[str], value: str, name: str = "z") -> DataFrame:
    """``0.6745 (x - median) / MAD``; a MAD of 0 gives 0 at the median and infinity elsewhere; null stays null."""
    med = df.groupBy(*keys).agg(F.median(value).alias("__med"))
    rows = df.join(F.broadcast(med) if not keys else med, keys) if keys else df.crossJoin(F.broadcast(med))
    mad = rows.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("__med"))).alias("__mad"))
    rows = rows.join(mad, keys) if keys else rows.crossJoin(F.broadcast(mad))
    gap = F.col(value) - F.col("__med")
    z = F.when(F.col("__mad") == 0, F.when(gap == 0, F.lit(0.0)).when(gap.isNotNull(), F.signum(gap) * float("inf"))).otherwise(0.6745 * gap / F.col("__mad"))
    return rows.withColumn(name, z).drop("__med", "__mad")


def adaptive_outliers(df: DataFrame, *, keys: list[str], value: str, sigma_z: float = 3.5, sigma: float = 3.0, n_threshold: int = 30, upper: bool = False) -> DataFrame:
    """Flags outliers: by the modified z below ``n_threshold`` rows, else beyond ``median + sigma`` deviations (population).

    With ``upper`` the modified z flags only high values, as the other way does.
    """
    stats = df.groupBy(*keys).agg(F.count(value).alias("__n"), F.median(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    rows = modified_z(df, keys=keys, value=value, name="__z").join(stats, keys)
    few, many = (F.col("__z") if upper else F.abs("__z")) > sigma_z, F.col(value) > F.col("__m") + sigma * F.col("__s")
    return rows.withColumn("outlier", F.when(F.col("__n") < n_threshold, few).otherwise(many)).drop("__n", "__m", "__s", "__z")


def tiered(value: Column, outlier: Column, always: float, never: float) -> tuple[Column, Column]:
    """Flag and reason: at ``always`` or above flagged, below ``never`` not, between them if an outlier."""
    flag = F.when(value >= always, True).when(value < never, False).otherwise(F.coalesce(outlier, F.lit(False)))
    reason = F.when(value >= always, "always").when(value < never, "never").when(outlier, "outlier").otherwise("normal")
    return flag, reason


def validate_batch(df: DataFrame, *, keys: list[str], day: str, today: Column, sigma: float = 5.0) -> DataFrame:
    """One row of counts for a batch of price rows, and its score ``max(received - rejected, 0) / received``."""
    w = series(keys, day)
    back = F.lag("close").over(w)
    rows = df.withColumn("__r", (F.col("close") - back) / F.nullif(back, F.lit(0.0)))
    stats = rows.agg(F.avg("__r").alias("__m"), F.stddev_samp("__r").alias("__s"))
    rows = rows.crossJoin(F.broadcast(stats))
    prices = ["open", "high", "low", "close"]
    null = F.greatest(*(F.col(c).isNull().cast("int") for c in prices)) == 1
    bad = F.least(*prices) <= 0
    checks = {"nulls": null, "non_positive": ~null & bad, "high_below_low": F.col("high") < F.col("low"), "future": F.col(day) > today, "ancient": F.col(day) < F.lit("1900-01-01").cast("date"), "outliers": F.abs(F.col("__r") - F.col("__m")) > sigma * F.col("__s")}
    one = rows.agg(F.count(F.lit(1)).alias("received"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()))
    rejected = F.col("nulls") + F.col("non_positive") + F.col("high_below_low") + F.col("future") + F.col("ancient")
    return one.withColumn("rejected", rejected).withColumn("score", F.when(F.col("received") > 0, F.greatest(F.col("received") - F.col("rejected"), F.lit(0)) / F.col("received")).otherwise(0.0))


def cross_source(a: DataFrame, b: DataFrame, *, keys: list[str], fields: dict[str, float]) -> DataFrame:
    """For each field the number of rows that two sources share, and of those apart by more than its tolerance (share of the mean)."""
    right = b.select(*keys, *(F.col(f).alias(f"{f}_b") for f in fields))
    both = a.join(right, keys)
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("x"), F.col(f"{f}_b").alias("y"), F.lit(tol).alias("tol")) for f, tol in fields.items()))
    long = both.select(F.inline(rows))
    gap = F.abs(F.col("x") - F.col("y")) / F.nullif((F.abs("x") + F.abs("y")) / 2, F.lit(0.0))
    return long.withColumn("gap", F.coalesce(gap, F.lit(0.0))).groupBy("field").agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("gap") > F.col("tol")).alias("apart"), F.max("gap").alias("largest"))


def missing_day_islands(required: DataFrame, present: DataFrame, *, keys: list[str], day: str, join_days: int = 4) -> DataFrame:
    """Runs of required days that are missing; days at most ``join_days`` apart are one run."""
    missing = required.select(*keys, day).distinct().join(present.select(*keys, day).distinct(), [*keys, day], "left_anti")
    w = series(keys, day)
    runs = run_ids(missing, keys, [day], F.datediff(day, F.lag(day).over(w)) <= join_days)
    return runs.groupBy(*keys, "run").agg(F.min(day).alias("first_missing"), F.max(day).alias("last_missing"), F.count(F.lit(1)).alias("days")).drop("run")


def stale_runs(df: DataFrame, *, keys: list[str], order: list[str], value: str, least: int) -> DataFrame:
    """Runs of equal values of at least so many rows."""
    w = series(keys, *order)
    runs = run_ids(df, keys, order, F.col(value) == F.lag(value).over(w))
    return runs.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least).drop("run")


#: Price ratios that look like splits: name, ratio.
SPLITS = (("2:1", 0.5), ("3:1", 1 / 3), ("4:1", 0.25), ("5:1", 0.2), ("10:1", 0.1), ("1:2", 2.0), ("1:5", 5.0), ("1:10", 10.0))


def split_suspects(df: DataFrame, *, keys: list[str], order: str, value: str, tolerance: float = 0.02) -> DataFrame:
    """Rows whose ratio to the row before is near a split's."""
    back = F.lag(value).over(series(keys, order))
    ratio = F.col(value) / F.nullif(back, F.lit(0.0))
    name = F.coalesce(*(F.when(F.abs(F.col("ratio") - r) <= tolerance * r, F.lit(n)) for n, r in SPLITS))
    return df.withColumn("ratio", ratio).withColumn("split", name).where(F.col("split").isNotNull())


def collector_health(df: DataFrame, *, keys: list[str], ts: str, now: Column, limit_seconds: int) -> DataFrame:
    """Age of the newest row of each source, and whether it is too old."""
    age = F.unix_seconds(now) - F.unix_seconds(F.max(ts))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.max(ts).alias("latest"), age.alias("age_seconds")).withColumn("status", F.when(F.col("age_seconds") > limit_seconds, "stale").otherwise("fresh"))


def gap_by_lead(df: DataFrame, *, keys: list[str], day: str, limit: int = 4) -> DataFrame:
    """Days after which more than ``limit`` days pass until the next."""
    w = Window.partitionBy(*keys).orderBy(day)
    return df.withColumn("next_day", F.lead(day).over(w)).withColumn("gap_days", F.datediff("next_day", day)).where(F.col("gap_days") > limit)
