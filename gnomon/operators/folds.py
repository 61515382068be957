"""Ordered folds: operators that carry a state from row to row of a series.

One kernel serves all of them.  Rows are dealt by key and sorted inside the
partitions by Spark (which can spill), and stream through Python in Arrow
batches; of a series only its state is kept between batches.  So the length of
one series does not bound the memory, and several short ones share a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Columns = dict[str, np.ndarray]
Step = Callable[[Columns], Columns]


def ordered_fold(df: DataFrame, *, keys: list[str], order: list[str], make: Callable[[], Step], fields: str) -> DataFrame:
    """``df`` with the columns that a fold computes along each series.

    ``make()`` gives a new fold for a key; it is called with the columns of the
    next rows of the series and returns one array for each of ``fields``.
    Numbers come as floats with NaN for null, and NaN goes back as null.
    """
    new = StructType.fromDDL(fields)
    schema = StructType([*df.schema.fields, *new.fields])
    names = [f.name for f in schema]
    kinds = {f.name: f.dataType.simpleString() for f in new}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            columns = {f: _numbers(batch.column(i)) for i, f in enumerate(batch.schema.names)}
            parts = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if fold is None or key[a] != now:
                    now, fold = key[a], make()
                parts.append(fold({c: v[a:b] for c, v in columns.items()}))
            out = [_back(np.concatenate([np.asarray(p[f.name]) for p in parts]), kinds[f.name]) for f in new]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=names)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order) if keys else df.coalesce(1).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, schema)


def _numbers(column: pa.Array) -> np.ndarray:
    if pa.types.is_floating(column.type) or pa.types.is_integer(column.type):
        return column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    return column.to_numpy(zero_copy_only=False)


def _back(values: np.ndarray, kind: str) -> pa.Array:
    if kind == "double":
        return pa.array(values.astype(np.float64), pa.float64(), from_pandas=True)
    if kind in ("int", "bigint"):
        to = pa.int32() if kind == "int" else pa.int64()
        return pa.array([None if x is None or x != x else int(x) for x in values.tolist()], to)
    if kind == "boolean":
        return pa.array([None if x is None else bool(x) for x in values.tolist()], pa.bool_())
    return pa.array(values.tolist(), pa.string())


# --- pieces of folds: each is fed the next values of a series -------------------------------------------------


class Ema:
    """``y = a x + (1 - a) y`` from the first value on; with ``hold`` a missing value leaves it as it is.

    Without ``hold`` a gap lets the old value fade for every missing row.
    """

    def __init__(self, span: float | None = None, *, alpha: float | None = None, hold: bool = False, seed: float | None = None):
        self.alpha = 2.0 / (span + 1) if alpha is None else alpha
        self.hold, self.y, self.gap = hold, seed, 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x.astype(float)
        if self.gap == 0 and not np.isnan(x).any():
            first = x if self.y is None else np.concatenate([[self.y], x])
            y = pd.Series(first).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[len(first) - len(x) :]
            self.y = float(y[-1])
            return y
        out, a = np.empty(len(x)), self.alpha
        for i, v in enumerate(x.tolist()):
            if v != v:
                self.gap += self.y is not None and not self.hold
            elif self.y is None:
                self.y = v
            else:
                old = (1 - a) ** (self.gap + 1)
                self.y = (old * self.y + a * v) / (old + a)
                self.gap = 0
            out[i] = math.nan if self.y is None else self.y
        return out


class EmaAdjusted:
    """Weighted mean with weights ``(1 - a)**age`` over all values so far."""

    def __init__(self, span: float):
        self.alpha = 2.0 / (span + 1)
        self.sum, self.n = Ema(alpha=self.alpha, seed=0.0), 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        ages = self.n + 1 + np.arange(len(x))
        out = self.sum(x) / (1 - (1 - self.alpha) ** ages)
        if self.n == 0 and len(x):
            out[0] = x[0]
        self.n += len(x)
        return out


class EwmStd:
    """Exponentially weighted deviation about the mean before each row, corrected for bias; 0 at the first row."""

    def __init__(self, span: float):
        self.alpha = 2.0 / (span + 1)
        self.mean, self.var, self.last, self.n = Ema(span, hold=True), Ema(alpha=self.alpha, seed=0.0), None, 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a = self.alpha
        mean = self.mean(x)
        before = np.concatenate([[x[0] if self.last is None else self.last], mean[:-1]])
        self.last = mean[-1]
        var = self.var((1 - a) * (x - before) ** 2)
        q = (1 - a) ** 2
        level = a * a / (1 - q) if q < 1 else 1.0
        weights = level + (1 - level) * q ** (self.n + np.arange(len(x)))
        self.n += len(x)
        room = 1 - weights
        return np.where((room > 1e-15) & (var > 0), np.sqrt(np.maximum(var, 0) / np.maximum(room, 1e-300)), 0.0)


class Rma:
    """Wilder's mean: the plain mean of the first ``n`` values, then ``a = 1 / n``; NaN before."""

    def __init__(self, n: int):
        self.n, self.head, self.ema = n, [], None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        at = 0
        if self.ema is None:
            at = min(self.n - len(self.head), len(x))
            self.head += x[:at].tolist()
            if len(self.head) == self.n:
                seed = float(np.mean(self.head))
                self.ema = Ema(alpha=1.0 / self.n, seed=seed)
                out[at - 1] = seed
        if self.ema is not None and at < len(x):
            out[at:] = self.ema(x[at:])
        return out


class Rolling:
    """Mean, sum, std, min or max of the last ``n`` values; NaN until there are ``least``."""

    def __init__(self, n: int, what: str, least: int | None = None, ddof: int = 1):
        self.n, self.what, self.least, self.ddof, self.tail = n, what, n if least is None else least, ddof, np.empty(0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.tail, x])
        window = pd.Series(both).rolling(self.n, min_periods=self.least)
        out = window.std(ddof=self.ddof) if self.what == "std" else getattr(window, self.what)()
        self.tail = both[max(0, len(both) - (self.n - 1)) :] if self.n > 1 else np.empty(0)
        return out.to_numpy()[len(both) - len(x) :]


class Lag:
    """The value ``n`` rows before; ``first`` where there is none."""

    def __init__(self, n: int = 1, first: float = math.nan):
        self.tail = np.full(n, first)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.tail, x])
        self.tail = both[len(x) :]
        return both[: len(x)]


class Machine:
    """A state machine: ``step(state, *values) -> (state, output)`` row by row."""

    def __init__(self, step: Callable, state):
        self.step, self.state = step, state

    def __call__(self, *columns: np.ndarray) -> np.ndarray:
        out = []
        for row in zip(*(c.tolist() for c in columns), strict=True):
            self.state, value = self.step(self.state, *row)
            out.append(value)
        return np.array(out)
