"""Keyed writes as DataFrames: first wins, last wins, upserts, archive with a guarded wipe, rebuilds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(existing: DataFrame, new: DataFrame, *, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: those whose key isn't there yet, the first of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


def insert_replace(existing: DataFrame, new: DataFrame, *, keys: list[str], order: list[str]) -> DataFrame:
    """The table after a write in which the last row of each key wins; new rows win over old ones."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    cols = F.struct(*existing.columns)
    return both.groupBy(*keys).agg(F.max_by(cols, F.struct("__new", *order)).alias("__v")).select("__v.*")


def upsert(existing: DataFrame, new: DataFrame, *, keys: list[str], merge: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """The table after an upsert; columns in ``merge`` combine (old, new), the others take the new value where there is one."""
    a, b = existing.alias("a"), new.alias("b")
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.join(b, test, "full_outer")
    out = []
    for c in existing.columns:
        old, now = F.col(f"a.{c}"), F.col(f"b.{c}")
        value = F.coalesce(old, now) if c in keys else F.coalesce(merge[c](old, now), now, old) if c in merge else F.coalesce(now, old)
        out.append(value.alias(c))
    return both.select(*out)


def set_status(df: DataFrame, where: Column, status: str, column: str = "process_status") -> DataFrame:
    return df.withColumn(column, F.when(where, F.lit(status)).otherwise(F.col(column)))


def archive(rows: DataFrame, now: Column) -> DataFrame:
    return rows.withColumn("archived_timestamp", now)


def safe_to_wipe(rows: DataFrame, pending: str = "pending") -> bool:
    """True only without a pending row."""
    return not rows.where(F.col("process_status") == pending).limit(1).count()


def rebuild(df: DataFrame, *, seconds: str, text: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Times in seconds as milliseconds with their text derived again; and a row of checks against the old table."""
    new = df.withColumn(seconds, F.col(seconds) * 1000).withColumn(text, F.date_format(F.timestamp_millis(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    old = df.agg(F.count(F.lit(1)).alias("old_rows"), F.min(seconds).alias("old_min"), F.max(seconds).alias("old_max"))
    now = new.agg(F.count(F.lit(1)).alias("new_rows"), F.min(seconds).alias("new_min"), F.max(seconds).alias("new_max"), F.countDistinct(*key).alias("keys"))
    checks = old.crossJoin(now).select("*", ((F.col("old_rows") == F.col("new_rows")) & (F.col("old_min") * 1000 == F.col("new_min")) & (F.col("old_max") * 1000 == F.col("new_max")) & (F.col("keys") == F.col("new_rows"))).alias("ok"))
    return new, checks


def undelivered(alerts: DataFrame, ledger: DataFrame, *, keys: list[str]) -> DataFrame:
    """Alerts that no row of the ledger says were delivered, one for each key."""
    return alerts.dropDuplicates(keys).join(ledger, keys, "left_anti")


def fill_missing(old: DataFrame, new: DataFrame, *, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Security-master merge: rows with nulls filled from the incoming ones, an audit of what was filled, and conflicts of differing values."""
    a, b = old.select(key, *fields), new.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    both = a.join(b, key, "left")
    merged = both.select(key, *(F.coalesce(f, f"__{f}").alias(f) for f in fields))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("existing"), F.col(f"__{f}").cast("string").alias("incoming")) for f in fields))
    long = both.select(key, F.inline(pairs))
    return merged, long.where("existing IS NULL AND incoming IS NOT NULL"), long.where("existing <> incoming")
