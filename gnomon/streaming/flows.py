"""Structured Streaming versions of the windowed and stateful operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_stream(spark, schema, path: str, per_trigger: int = 1) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def settled(rows: DataFrame, done: DataFrame, *, keys: list[str], ts: str, last: str, now: Column, lag_seconds: int = 30) -> DataFrame:
    """What a micro-batch appends: rows after the ``last`` time done of their key and before ``now`` less a safety lag.

    Both ends are open.  A key of which nothing is done yet begins with its first row.
    """
    ready = rows.where(F.unix_micros(ts) < F.unix_micros(now) - lag_seconds * 1_000_000)
    upto = done.groupBy(*keys).agg(F.max(last).alias("__last"))
    return ready.join(upto, keys, "left").where(F.col("__last").isNull() | (F.col(ts) > F.col("__last"))).drop("__last")


def windowed_flow(trades: DataFrame, *, keys: list[str], ts: str = "ts", window: str = "30 seconds", slide: str | None = None, late: str | None = "30 seconds") -> DataFrame:
    """Count, total and imbalance of each window, once it is behind the watermark (``late`` is null where the stream has one)."""
    signed = F.sum(F.when(F.col("side") == "buy", F.col("quote")).otherwise(-F.col("quote")))
    rows = trades.withWatermark(ts, late) if late else trades
    g = rows.groupBy(*keys, F.window(ts, window, slide).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("quote").alias("total"), signed.alias("net")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", F.when(F.col("total") > 0, F.col("net") / F.col("total")).otherwise(0.0).alias("imbalance"))


def dedup(rows: DataFrame, *, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: replays change nothing."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def keyed_state(rows: DataFrame, *, key: str, fields: str, step: Callable, order: list[str]) -> DataFrame:
    """A state machine for each key over an ordered stream: ``step(state or None, row) -> (state, output tuple or None)``.

    The state is kept as JSON in the state store.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    kind = rows.schema[key].dataType.simpleString()

    def run(group: tuple, parts, held):
        import json

        state = json.loads(held.get[0]) if held.exists else None
        out = []
        for row in pd.concat(list(parts)).sort_values(order).itertuples(index=False):
            state, value = step(state, row)
            if value is not None:
                out.append(value)
        held.update((json.dumps(state),))
        frame = pd.DataFrame(out, columns=names)
        frame.insert(0, key, group[0])
        yield frame

    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, {fields}", "state string", "append", "NoTimeout")


def exit_rules(target: float, stop: float, seconds: int) -> Callable:
    """Step for positions: rows ``ts_s, price, open`` open one where there is none; target, stop or time end it."""

    def step(state, row):
        if state is None:
            return ({"t": float(row.ts_s), "p": float(row.price)}, None) if row.open else (None, None)
        move = row.price / state["p"] - 1
        why = "target" if move >= target else "stop" if move <= -stop else "time" if row.ts_s - state["t"] >= seconds else None
        return (None, (why, float(move))) if why else (state, None)

    return step


def cooldown(seconds: int, per_day: int) -> Callable:
    """Step that lets a signal through if the last one is long enough ago and the day's count isn't used up."""

    def step(state, row):
        state = state or {"last": -1e18, "day": -1, "n": 0}
        day = int(row.ts_s // 86400)
        if day != state["day"]:
            state = {**state, "day": day, "n": 0}
        if row.ts_s - state["last"] >= seconds and state["n"] < per_day:
            return {"last": float(row.ts_s), "day": day, "n": state["n"] + 1}, (float(row.ts_s), state["n"] + 1)
        return state, None

    return step


def last_n(rows: DataFrame, *, key: str, value: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` values of each key after every micro-batch, as a string list."""

    def step(state, row):
        kept = [*(state or []), float(getattr(row, value))][-n:]
        return kept, (",".join(f"{x:g}" for x in kept),)

    return keyed_state(rows, key=key, fields="recent string", step=step, order=order)


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream into a table in memory (tests and smoke runs)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def deliver_once(df: DataFrame, ledger_path: str, keys: list[str], post: Callable[[list], None], checkpoint: str):
    """Posts each key that is not in the ledger, and enters a batch's keys after its delivery.

    So a batch that fails on the way is posted again from its beginning: at least
    once, and once where nothing fails.  Posts go one by one from the driver.
    """
    from ..sources.readers import exists
    from ..sources.sinks import undelivered

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        ledger = spark.read.parquet(ledger_path) if exists(spark, ledger_path) else rows.select(*keys).limit(0)
        new = undelivered(rows, ledger, keys=keys).persist()
        for row in new.toLocalIterator():
            post(row)
        new.select(*keys).write.mode("append").parquet(ledger_path)
        new.unpersist()

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
