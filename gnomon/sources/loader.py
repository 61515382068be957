"""Loads of price rows: stage, match to securities, facts, archive, wipe; and incremental collectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sinks

#: States of a staged row.
PENDING, MATCHED, LOADED, REJECTED = "pending", "matched", "loaded", "rejected"


def stage(rows: DataFrame, batch: str, now: Column) -> DataFrame:
    """Incoming rows as pending ones of a batch, numbered."""
    w = Window.partitionBy("symbol").orderBy("date")
    number = F.xxhash64(F.lit(batch), "symbol", "date", F.row_number().over(w))
    return rows.withColumn("load_id", number).withColumn("batch_id", F.lit(batch)).withColumn("load_timestamp", now).withColumn("process_status", F.lit(PENDING)).withColumn("reject_reason", F.lit(None).cast("string"))


def match(staged: DataFrame, securities: DataFrame) -> DataFrame:
    """Rows with the security that their symbol names now; those without one, or with a bad price, are rejected."""
    known = securities.where(F.col("ticker").isNotNull()).groupBy(F.col("ticker").alias("symbol")).agg(F.min("base_id").alias("security_base_id"))
    rows = staged.drop("security_base_id").join(known, "symbol", "left")
    why = F.when(F.col("security_base_id").isNull(), "no security").when(F.col("close").isNull() | (F.col("close") <= 0), "bad close").when(F.col("high") < F.col("low"), "high below low")
    return rows.withColumn("reject_reason", why).withColumn("process_status", F.when(why.isNull(), MATCHED).otherwise(REJECTED))


def facts(matched: DataFrame, existing: DataFrame) -> DataFrame:
    """New facts, one for each security and day that has none."""
    rows = matched.where(F.col("process_status") == MATCHED).select("security_base_id", F.col("date").alias("trade_date"), "open", "high", "low", "close", "volume", "batch_id", "load_id")
    return sinks.insert_ignore(existing, rows, keys=["security_base_id", "trade_date"], order=["load_id"]).drop("load_id")


def load(rows: DataFrame, securities: DataFrame, existing: DataFrame, *, batch: str, now: Column) -> dict[str, DataFrame]:
    """All steps as lazy frames: ``staged, matched, facts, archive, report``."""
    staged = stage(rows, batch, now)
    matched = match(staged, securities)
    new = facts(matched, existing)
    done = matched.withColumn("process_status", F.when(F.col("process_status") == MATCHED, LOADED).otherwise(F.col("process_status")))
    report = done.groupBy("process_status").agg(F.count(F.lit(1)).alias("rows"))
    return {"staged": staged, "matched": matched, "facts": new, "archive": sinks.archive(done, now), "report": report}


def incremental(tape: DataFrame, *, keys: list[str], order: str, seen: DataFrame | None) -> DataFrame:
    """Rows beyond the last that each key has: ``seen`` is one row ``(keys, last)`` for each."""
    if seen is None:
        return tape
    rows = tape.join(seen, keys, "left")
    return rows.where(F.col("last").isNull() | (F.col(order) > F.col("last"))).drop("last")


def high_water(df: DataFrame, *, keys: list[str], order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(order).alias("last"))


def merge_daily(frames: list[DataFrame], *, day: str) -> DataFrame:
    """Daily series of several metrics as one row a day."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, day, "full_outer")
    return out


def daily_highs(members: DataFrame, *, member: str, ts: str, value: str) -> DataFrame:
    """An ensemble's daily maximum for each member."""
    return members.groupBy(member, F.to_date(ts).alias("day")).agg(F.max(value).alias("high"))


def side_of(buyer_is_maker: Column) -> Column:
    """The aggressor's side of a trade."""
    return F.when(buyer_is_maker, "sell").otherwise("buy")


def with_fallback(primary: DataFrame, fallback: DataFrame, *, keys: list[str], value: str) -> DataFrame:
    """The primary value where there is one, else the fallback's, and which it was."""
    b = fallback.select(*keys, F.col(value).alias("__b"))
    j = primary.join(b, keys, "full_outer")
    return j.select(*keys, F.coalesce(value, "__b").alias(value), F.when(F.col(value).isNotNull(), "primary").otherwise("fallback").alias("origin"))
