"""Labels and weights for learning: first touch of barriers, uniqueness, purged folds, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import series


def numbered(df: DataFrame, *, keys: list[str], order: list[str], name: str = "i") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(series(keys, *order)) - 1).cast("long"))


def triple_barrier(df: DataFrame, *, keys: list[str], order: list[str], price: str, up: float, down: float, bars: int, side: int = 1, min_return: float = 0.0) -> DataFrame:
    """First of the profit, loss and time barriers after each row.

    ``label`` is 1, -1 or (time) the sign of the return, 0 below ``min_return``;
    rows with fewer than one later bar have none.  The path is the window frame
    of the next ``bars`` rows, so nothing is joined.
    """
    w = series(keys, *order)
    ahead = w.rowsBetween(1, bars)
    path = F.collect_list(F.col(price)).over(ahead)
    ret = F.transform(F.col("__path"), lambda p: side * (p / F.col(price) - 1))
    rows = df.withColumn("__path", path).withColumn("__r", ret)
    first = lambda test: F.array_min(F.filter(F.transform("__r", lambda r, i: F.when(test(r), i + 1)), lambda i: i.isNotNull()))
    rows = rows.withColumn("__u", first(lambda r: r >= up)).withColumn("__d", first(lambda r: r <= -down))
    barrier = F.when(F.size("__path") == 0, None).when(F.col("__u").isNotNull() & (F.col("__d").isNull() | (F.col("__u") < F.col("__d"))), "profit").when(F.col("__d").isNotNull(), "loss").otherwise("time")
    rows = rows.withColumn("barrier", barrier).withColumn("bars_held", F.when(F.col("barrier") == "profit", F.col("__u")).when(F.col("barrier") == "loss", F.col("__d")).when(F.col("barrier") == "time", F.size("__path")))
    rows = rows.withColumn("ret", F.when(F.col("bars_held") > 0, F.try_element_at("__r", F.col("bars_held"))))
    sign = F.when(F.abs("ret") < min_return, 0).otherwise(F.signum("ret").cast("int"))
    rows = rows.withColumn("label", F.when(F.col("barrier") == "profit", 1).when(F.col("barrier") == "loss", -1).when(F.col("barrier") == "time", sign))
    return rows.drop("__path", "__r", "__u", "__d")


def uniqueness(labels: DataFrame, *, keys: list[str], entry: str, exit: str) -> DataFrame:  # noqa: A002
    """Mean of ``1 / labels alive`` over the bars of each label."""
    bars = labels.withColumn("__j", F.explode(F.sequence(F.col(entry), F.col(exit))))
    alive = bars.groupBy(*keys, "__j").agg(F.count(F.lit(1)).alias("__c"))
    return bars.join(alive, [*keys, "__j"]).groupBy(*keys, entry, exit).agg(F.avg(1.0 / F.col("__c")).alias("uniqueness"))


def sample_weights(labels: DataFrame, *, keys: list[str], entry: str, exit: str, ret: str, half_life: float) -> DataFrame:  # noqa: A002
    """Uniqueness times absolute return times decay by age, scaled to a mean of 1 per key."""
    u = uniqueness(labels, keys=keys, entry=entry, exit=exit)
    w = Window.partitionBy(*keys)
    rows = labels.join(u, [*keys, entry, exit])
    age = F.max(entry).over(w) - F.col(entry)
    rows = rows.withColumn("__raw", F.col("uniqueness") * F.abs(F.col(ret)) * F.pow(F.lit(0.5), age / half_life))
    total = F.sum("__raw").over(w)
    return rows.withColumn("weight", F.when(total > 0, F.col("__raw") * F.count(F.lit(1)).over(w) / total).otherwise(1.0)).drop("__raw")


def purged_folds(labels: DataFrame, *, keys: list[str], entry: str, exit: str, folds: int, embargo: float = 0.01) -> DataFrame:  # noqa: A002
    """``fold, role`` (test or train) of each label; training labels that overlap the test span or its embargo are left out."""
    w = series(keys, entry)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = labels.withColumn("__f", F.floor((F.row_number().over(w) - 1) * folds / n).cast("int")).withColumn("__n", n)
    spans = rows.groupBy(*keys, F.col("__f").alias("fold")).agg(F.min(entry).alias("__a"), F.max(exit).alias("__b"), F.ceil(F.max("__n") * embargo).alias("__e"))
    both = rows.join(spans, keys)
    clear = (F.col(exit) < F.col("__a")) | (F.col(entry) > F.col("__b") + F.col("__e"))
    role = F.when(F.col("__f") == F.col("fold"), "test").when(clear, "train")
    return both.withColumn("role", role).where(F.col("role").isNotNull()).drop("__f", "__n", "__a", "__b", "__e")


def sequences(df: DataFrame, *, keys: list[str], order: str, features: list[str], length: int, target: str, horizon: int) -> DataFrame:
    """Sliding arrays of the last ``length`` rows with the value ``horizon`` rows later."""
    w = series(keys, order)
    frame = w.rowsBetween(-(length - 1), 0)
    out = df.select(*keys, order, *(F.collect_list(c).over(frame).alias(f"{c}_seq") for c in features), F.lead(target, horizon).over(w).alias("label"))
    return out.where((F.size(f"{features[0]}_seq") == length) & F.col("label").isNotNull())
