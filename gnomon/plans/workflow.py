"""Workflows of lazy steps, schedules, model states and executors: the driver's side."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import cron_matches
from ..functions.scalars import condition
from ..operators import backtest
from .config import ModelConfig
from .plugins import FunctionRegistry, defaults
from ..functions.fixed import MOVES


@dataclass
class Step:
    """A step: ``run(outputs, item) -> value``; it runs if its condition holds, once for each item of ``for_each``."""

    name: str
    run: Callable
    after: list[str] = field(default_factory=list)
    when: str | None = None
    for_each: str | None = None
    parallel: bool = False


def order(steps: list[Step]) -> list[str]:
    """Names so that each follows those it is after; ``ValueError`` on a cycle or an unknown name."""
    names = {s.name for s in steps}
    if missing := {a for s in steps for a in s.after} - names:
        raise ValueError(f"unknown steps: {sorted(missing)}")
    waits = {s.name: set(s.after) for s in steps}
    ready = [n for n, w in waits.items() if not w]
    heapq.heapify(ready)
    out = []
    while ready:
        n = heapq.heappop(ready)
        out.append(n)
        for m, w in waits.items():
            if n in w:
                w.discard(n)
                if not w:
                    heapq.heappush(ready, m)
    if len(out) < len(steps):
        raise ValueError("the steps form a cycle")
    return out


def run_workflow(steps: list[Step]) -> dict[str, dict]:
    """``status`` (done, failed, skipped) and ``output`` of every step; what follows a failed step is skipped.

    Steps marked ``parallel`` run their items on threads, so that their Spark
    jobs share the cluster.
    """
    by = {s.name: s for s in steps}
    done: dict[str, dict] = {}
    for name in order(steps):
        s = by[name]
        outputs = {n: d["output"] for n, d in done.items() if d["status"] == "done"}
        if any(done[a]["status"] == "failed" or done[a].get("blocked") for a in s.after):
            done[name] = {"status": "skipped", "output": None, "blocked": True}
        elif s.when and not condition(s.when, outputs):
            done[name] = {"status": "skipped", "output": None}
        else:
            try:
                if s.for_each:
                    items = list(outputs[s.for_each])
                    with ThreadPoolExecutor(8 if s.parallel else 1) as pool:
                        value = list(pool.map(lambda i, s=s, o=outputs: s.run(o, i), items))
                else:
                    value = s.run(outputs, None)
                done[name] = {"status": "done", "output": value}
            except Exception as e:  # noqa: BLE001 - a failed step is a result
                done[name] = {"status": "failed", "output": None, "error": str(e)}
    return done


def merged_loads(wants: list[dict]) -> list[dict]:
    """Loads of one source and frequency as one, with the union of their tickers."""
    out: dict[tuple, dict] = {}
    for w in wants:
        m = out.setdefault((w["source"], w["frequency"]), {"source": w["source"], "frequency": w["frequency"], "tickers": set()})
        m["tickers"] |= set(w["tickers"])
    return [m | {"tickers": sorted(m["tickers"])} for m in out.values()]


@dataclass
class Job:
    name: str
    cron: str
    run: Callable
    failures: int = 0
    active: bool = True


def tick(jobs: list[Job], at: datetime, most_failures: int = 3) -> dict[str, str]:
    """Runs the jobs whose cron matches; one that failed three times in a row is switched off."""
    out = {}
    for j in jobs:
        if not j.active or not cron_matches(j.cron, at):
            continue
        try:
            j.run()
            j.failures, out[j.name] = 0, "done"
        except Exception:  # noqa: BLE001 - counted
            j.failures += 1
            j.active = j.failures < most_failures
            out[j.name] = "failed"
    return out


def priorities(df: DataFrame, *, score: str, name: str) -> DataFrame:
    """Models ranked by score: ``priority`` from 1."""
    return df.withColumn("priority", F.row_number().over(Window.orderBy(F.desc(score), name)))


def transition(state: str | None, to: str) -> str:
    """The state that a model goes to; it begins as a draft."""
    to = to.upper()
    if state is None:
        if to != "DRAFT":
            raise ValueError("a model starts as a draft")
    elif to not in MOVES[state.upper()]:
        raise ValueError(f"{state} can't become {to}")
    return to


def lifecycle(moves: DataFrame, *, key: str, ts: str, state: str) -> DataFrame:
    """``(key, state, moves, rejected)``: the state of each model after its moves; one that is not allowed changes nothing.

    A model's moves are one array, in order of time.
    """
    allowed = F.array(F.lit(">DRAFT"), *(F.lit(f"{a}>{b}") for a, bs in MOVES.items() for b in bs))
    begin = F.struct(F.lit("").alias("state"), F.lit(0).alias("rejected"))

    def step(acc, x):
        ok = F.array_contains(allowed, F.concat(acc["state"], F.lit(">"), x["to"]))
        return F.struct(F.when(ok, x["to"]).otherwise(acc["state"]).alias("state"), (acc["rejected"] + F.when(ok, 0).otherwise(1)).alias("rejected"))

    asked = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("at"), F.coalesce(F.upper(state), F.lit("?")).alias("to"))))
    found = moves.groupBy(key).agg(asked.alias("asked")).select(key, F.size("asked").alias("moves"), F.aggregate("asked", begin, step).alias("end"))
    return found.select(key, F.nullif(F.col("end.state"), F.lit("")).alias("state"), "moves", F.col("end.rejected").alias("rejected"))


def run_model(config: ModelConfig, bars: DataFrame, *, keys: list[str], order_by: list[str], registry: FunctionRegistry | None = None) -> dict[str, DataFrame]:
    """Config to signal, size, back-test: lazy frames ``result, trades, metrics``."""
    registry = registry or defaults()
    if config.kind != "SINGLE_ASSET":
        raise ValueError(f"{config.kind} models run by phases")
    k = {"keys": keys, "order": order_by}
    rows = registry.resolve("signals", config.signal["name"])(bars, **k, **config.signal.get("params", {}))
    rows = registry.resolve("sizing", config.sizing["name"])(rows, **k, **config.sizing.get("params", {}))
    result = backtest.vectorised(rows, **k, **config.backtest)
    trades = backtest.trades(rows, **k)
    return {"result": result, "trades": trades, "metrics": backtest.metrics(result, trades, **k).withColumn("config_hash", F.lit(config.content_hash()))}
