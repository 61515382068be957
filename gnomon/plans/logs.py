"""Structured logs: formats, routing by tags, a ring of the last records, and a buffered table sink."""

from __future__ import annotations

import json
import logging
from collections import deque
from datetime import UTC, datetime
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def record(level: int, message: str, tags: set[str] = frozenset(), **context) -> dict:
    return {"ts": datetime.now(UTC), "level": level, "message": message, "tags": sorted(tags), "context": json.dumps(context, sort_keys=True, default=str)}


def as_text(r: dict) -> str:
    return f"{r['ts']:%Y-%m-%d %H:%M:%S} {logging.getLevelName(r['level']):8} [{','.join(r['tags'])}] {r['message']} {r['context']}"


def as_json(r: dict) -> str:
    return json.dumps(r | {"ts": r["ts"].isoformat(), "level": logging.getLevelName(r["level"])}, sort_keys=True)


class Ring:
    """The last records, with the filters of a query tool."""

    def __init__(self, size: int = 1000):
        self._rows: deque = deque(maxlen=size)

    def write(self, r: dict) -> None:
        self._rows.append(r)

    def records(self, tags: set[str] | None = None, level: int = 0, contains: str = "", limit: int = 100) -> list[dict]:
        out = [r for r in self._rows if r["level"] >= level and contains in r["message"] and (not tags or tags & set(r["tags"]))]
        return out[-limit:]


class TableSink:
    """Keeps records until there are enough and appends them as Parquet."""

    SCHEMA = "ts timestamp, level int, message string, tags array<string>, context string"

    def __init__(self, spark: SparkSession, path: str, buffer: int = 500):
        self.spark, self.path, self.buffer, self._rows, self._lock = spark, path, buffer, [], Lock()

    def write(self, r: dict) -> None:
        with self._lock:
            self._rows.append(r)
            full = len(self._rows) >= self.buffer
        if full:
            self.flush()

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            data = [(r["ts"].replace(tzinfo=None), r["level"], r["message"], r["tags"], r["context"]) for r in rows]
            self.spark.createDataFrame(data, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


class Router:
    """Sends a record to every sink that one of its tags is routed to at its level; sinks under ``*`` get all."""

    def __init__(self):
        self._routes: list[tuple[str, int, object]] = []

    def route(self, tag: str, level: int, sink) -> None:
        self._routes.append((tag, level, sink))

    def write(self, r: dict) -> None:
        for sink in {id(s): s for tag, level, s in self._routes if r["level"] >= level and (tag == "*" or tag in r["tags"])}.values():
            sink.write(r)


def search(logs: DataFrame, *, tags: list[str] | None = None, level: int = 0, contains: str | None = None) -> DataFrame:
    """The same filters over the log table."""
    rows = logs.where(F.col("level") >= level)
    rows = rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else rows
    return rows.where(F.col("message").contains(contains)) if contains else rows
