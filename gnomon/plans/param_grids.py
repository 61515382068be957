"""Parameter grids and literal tables."""

from __future__ import annotations

from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import BARRIER_AXES, FUNDING_AXES, GRIDBOT_AXES, PAIRS_AXES, TA_AXES


def literal(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of literals, without a Python round trip."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows))))


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """The Cartesian product of the axes; its size is the product of their lengths."""
    frames = [literal(spark, [name], [(v,) for v in values]) for name, values in axes.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def grid_rows(axes: dict[str, list]) -> list[dict]:
    """The same on the driver."""
    return [dict(zip(axes, values, strict=True)) for values in product(*axes.values())]


def numbered(axes: dict[str, list], keep=lambda row: True) -> list[dict]:
    """The rows of a grid that are kept, in the order of its axes."""
    return [row for row in grid_rows(axes) if keep(row)]


def barrier_rows() -> list[dict]:
    """Exits: stop, target, trail (never wider than the stop) and longest hold."""
    rows = numbered(BARRIER_AXES, lambda r: r["trail_pct"] <= r["sl_pct"])
    return [{"sl_pct": r["sl_pct"], "tp_pct": round(r["sl_pct"] * r["tp_ratio"], 4), "trail_pct": r["trail_pct"], "t_bars": r["t_bars"]} for r in rows]


def ta_rows() -> list[dict]:
    """Every signal's settings with every exit, numbered over all signals; a fast period is below its slow one."""
    out = []
    for kind, axes in TA_AXES.items():
        for signal in numbered(axes, lambda r: r.get("fast_period", 0) < r.get("slow_period", 1)):
            if "threshold" in signal:
                level = signal.pop("threshold")
                signal |= {"threshold_lo": level, "threshold_hi": level}
            out += [{"config_id": len(out) + i, "kind": kind, **signal, **exit_} for i, exit_ in enumerate(barrier_rows())]
    return out


def funding_rows() -> list[dict]:
    return numbered(FUNDING_AXES)


def pairs_rows() -> list[dict]:
    """The exit lies inside the entry, the stop outside."""
    return numbered(PAIRS_AXES, lambda r: r["exit_z"] < r["entry_z"] < r["stop_z"])


def gridbot_rows() -> list[dict]:
    """The spacing is below the range."""
    return numbered(GRIDBOT_AXES, lambda r: r["grid_spacing_pct"] < r["range_width_pct"])


def as_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A grid as a table: ``config_id`` and its parameters as doubles, null where a signal has none."""
    names = list(dict.fromkeys(name for row in rows for name in row if name not in ("config_id", "kind")))
    full = [(row.get("config_id", i), row.get("kind"), *(None if row.get(n) is None else float(row[n]) for n in names)) for i, row in enumerate(rows)]
    frame = pa.table([pa.array([r[0] for r in full], pa.int64()), pa.array([r[1] for r in full], pa.string()), *(pa.array([r[j] for r in full], pa.float64()) for j in range(2, len(names) + 2))], names=["config_id", "kind", *names])
    return spark.createDataFrame(frame)
